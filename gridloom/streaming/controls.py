"""Incremental controls and slabs with Structured Streaming.

A stream of controls keeps, for each surface and node, the latest; each batch re-solves the surfaces it touched. The state of
controls is a table in the folder the caller names, so a restarted query goes on from it. Slabs are appended as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lattice import Lattice
from ..operators.mincurv import grid_min_curvature

STATE = "surface string, i int, j int, v double, seq long"


class ConvergentGridder:
    """Controls of one surface that are added and re-solved, outside a stream."""

    def __init__(self, spark: SparkSession, lattice: Lattice):
        self.spark, self.lattice, self.controls, self.seq = spark, lattice, {}, 0

    def add_control(self, i: int, j: int, v: float) -> None:
        """A control at a node replaces an earlier one there."""
        from ..errors import InvalidArgument

        if not (0 <= i < self.lattice.ncol and 0 <= j < self.lattice.nrow):
            raise InvalidArgument(f"node ({i}, {j}) is not on the lattice")
        self.controls[i, j] = v

    def add_controls(self, controls: list[tuple[int, int, float]]) -> None:
        for c in controls:
            self.add_control(*c)

    def field(self) -> DataFrame:
        rows = [(n, *self.lattice.node_xy(i, j), float(v)) for n, ((i, j), v) in enumerate(sorted(self.controls.items()))]
        return grid_min_curvature(self.spark.createDataFrame(rows, "pid long, x double, y double, z double"), self.lattice)


def latest(rows: DataFrame) -> DataFrame:
    """The control of the highest seq for each surface and node."""
    return rows.groupBy("surface", "i", "j").agg(F.max(F.struct("seq", "v")).alias("_m")).select("surface", "i", "j", F.col("_m.v").alias("v"), F.col("_m.seq").alias("seq"))


def solve(controls: DataFrame, lattice: Lattice) -> DataFrame:
    """(surface, i, j, v) of all surfaces in controls."""
    x, y = lattice.node_xy(F.col("i"), F.col("j"))
    points = controls.select("surface", (F.col("i") * lattice.nrow + F.col("j")).cast("long").alias("pid"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.col("v").alias("z"))
    return grid_min_curvature(points, lattice, ["surface"])


def stream_surfaces(stream: DataFrame, lattice: Lattice, folder: str, **options) -> StreamingQuery:
    """stream (surface, i, j, v, seq) -> in folder/fields/batch=N the fields of the surfaces that the batch touched; state in folder/state/batch=N."""
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(STATE).parquet(f"{folder}/state/batch={n - 1}") if n else spark.createDataFrame([], STATE)
        latest(before.unionByName(batch.select("surface", "i", "j", "v", "seq"))).write.mode("overwrite").parquet(f"{folder}/state/batch={n}")
        now = spark.read.schema(STATE).parquet(f"{folder}/state/batch={n}")
        touched = batch.select("surface").distinct()
        solve(now.join(touched, "surface", "left_semi"), lattice).write.mode("overwrite").parquet(f"{folder}/fields/batch={n}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(options or {"availableNow": True})).start()


def stream_slabs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """stream (lane, slab, values) appended to a lane table; memory holds a row group at most."""
    return stream.writeStream.format("parquet").partitionBy("lane").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_ntg(stream: DataFrame, cutoff: float, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events (ts, user_id, value) -> the part at or above the cutoff by user and window, for streams and tables alike; rows later than `late` are left out of a stream."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.avg((F.col("value") >= cutoff).cast("int")).alias("ntg"), F.count("*").alias("n"))

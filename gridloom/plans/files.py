"""Queries of files and streams: what is written is read back, and that is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import payload
from ..functions.ieee import at_scale
from ..functions.lattice import Georef, Lattice
from ..operators import gridding, synth
from ..queries import query, table
from ..sources import lanes, sections, textgrids
from ..sources.shared import fresh_path
from ..streaming import controls
from .series import PROFILES, SUMS, station_sql
from .space import DOME, DOME_SQL, TARGET, TURNED, points
from .sql import POINTS, rounded


def _dome(spark: SparkSession) -> DataFrame:
    return synth.dome_surface(spark, DOME, 100.0, 1.0, 5.0)


def _grid_file(name: str, write, read) -> None:
    @query(name, f"WITH {DOME_SQL} SELECT i, j, {rounded('v', 4)} AS v FROM f")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{fresh_path(spark, name)}/grid"
        write(_dome(spark), DOME, path)
        field, lattice = read(spark, path)
        if lattice != DOME:
            raise ValueError("the lattice was not read back")
        return field.select("i", "j", at_scale(F.col("v"), 4).alias("v"))


_grid_file("irap_grid_file", textgrids.write_irap_grid, textgrids.read_irap_grid)
_grid_file("cps3_grid_file", textgrids.write_cps3_grid, textgrids.read_cps3_grid)


def _node_file(name: str, write) -> None:
    @query(name, f"WITH {DOME_SQL} SELECT x, y, {rounded('-v', 4)} AS z FROM f")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{fresh_path(spark, name)}/nodes"
        write(_dome(spark), DOME, path)
        return textgrids.read_xyz(spark, path).select("x", "y", at_scale(F.col("z"), 4).alias("z"))


_node_file("irap_points_file", textgrids.write_irap_points)
_node_file("earthvision_file", textgrids.write_earthvision_grid)


@query("cps3_lines_file", f"WITH {POINTS} SELECT pid // 1000 AS ring_id, row_number() OVER (PARTITION BY pid // 1000 ORDER BY pid) - 1 AS seq, x, y FROM pts")
def cps3_lines_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{fresh_path(spark, 'lines')}/rings"
    seq = F.row_number().over(Window.partitionBy(F.floor(F.col("pid") / 1000)).orderBy("pid")) - 1
    textgrids.write_cps3_lines(points(spark, sf_dir).select(F.floor(F.col("pid") / 1000).alias("ring_id"), seq.alias("seq"), "x", "y"), path)
    return textgrids.read_cps3_lines(spark, path)


@query("wellpath_file", f"{station_sql('build_hold')} SELECT {rounded('md', 3)} AS md, {', '.join(f'{rounded(SUMS[k], 3)} AS {k}' for k in ('x', 'y', 'z', 'tvd'))}, {rounded('azim', 3)} AS azim, {rounded('incl', 3)} AS incl FROM h WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def wellpath_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{fresh_path(spark, 'wellpath')}/W-1"
    textgrids.write_wellpath(synth.trajectory(spark, (1000.0, 2000.0), 25.0, 2345.0, 30.0, PROFILES["build_hold"]), path, 25.0)
    return textgrids.read_wellpath(spark, path).select(*[at_scale(F.col(c), 3).alias(c) for c in ("md", "x", "y", "z", "tvd", "azim", "incl")])


_LOGS = "SELECT CAST(floor(value) AS BIGINT) AS k, avg(value) / 700 AS por, avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END) AS ntg, CASE WHEN count(*) < 5 THEN -1.0 ELSE count(*) / 1000.0 END AS sw FROM events GROUP BY 1"


@query("las_file", f"WITH l AS ({_LOGS}) SELECT {rounded('k * 0.5', 3)} AS md, {rounded('por', 4)} AS por, {rounded('ntg', 4)} AS ntg, {rounded('sw', 4)} AS sw FROM l")
def las_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of the events by their value; undefined saturations are read back as such (-1)."""
    path = f"{fresh_path(spark, 'las')}/W-1.las"
    n = F.count("*")
    rows = table(spark, sf_dir, "events").groupBy(F.floor("value").alias("k")).agg((F.avg("value") / 700).alias("por"), F.avg((F.col("value") >= 100).cast("int")).alias("ntg"), F.when(n < 5, float("nan")).otherwise(n / 1000.0).alias("sw"))
    textgrids.write_las2(rows.withColumn("md", F.col("k") * 0.5), path, "W-1", 0.5)
    _, _, found = textgrids.read_las2(path)
    back = spark.createDataFrame([tuple(r) for r in found], "md double, por double, ntg double, sw double")
    return back.select(at_scale(F.col("md"), 3).alias("md"), *[at_scale(F.when(F.isnan(c), -1.0).otherwise(F.col(c)), 4).alias(c) for c in ("por", "ntg", "sw")])


@query("tops_file", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS ord, n_nationkey * 10.0 AS x, n_regionkey * 5.0 AS y, 1000.0 + n_nationkey AS tvdss, 1025.0 + n_nationkey AS md, 'Horizon' AS type, n_name || ' é' AS surface, 'W ' || n_regionkey AS well FROM nation")
def tops_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{fresh_path(spark, 'tops')}/Tops"
    key = F.col("n_nationkey").cast("double")
    textgrids.write_tops(
        table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("ord"), (key * 10).alias("x"), (F.col("n_regionkey") * 5.0).alias("y"), (key + 1000).alias("tvdss"), (key + 1025).alias("md"), F.lit("Horizon").alias("type"),
            F.concat("n_name", F.lit(" é")).alias("surface"), F.concat(F.lit("W "), F.col("n_regionkey")).alias("well"),
        ),
        path,
    )
    return textgrids.read_tops(spark, path)


@query("store_file", "SELECT vec_id AS slab, len(embedding) AS n, floor(embedding[1]::FLOAT::DOUBLE * 1000 + 0.5) AS first, floor(embedding[len(embedding)]::FLOAT::DOUBLE * 1000 + 0.5) AS last FROM embeddings")
def store_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a slab of one lane of a sealed file, and the lane read back by tasks that map the file."""
    import os

    e = table(spark, sf_dir, "embeddings").select(F.lit("e").alias("lane"), F.col("vec_id").alias("slab"), F.col("embedding").alias("values"))
    shape = e.agg(F.count("*").alias("n"), F.max(F.size("values")).alias("elems")).first()
    folder = fresh_path(spark, "store").removeprefix("file://")
    os.makedirs(folder)
    lanes.store_to_file(e, f"{folder}/e.lanes", lanes.StoreSchema(shape.n, (lanes.Lane("e", "f32", shape.elems),)))
    back = lanes.file_to_rows(spark, f"{folder}/e.lanes", "e")
    thousandths = lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("double")
    return back.select("slab", F.size("values").cast("long").alias("n"), thousandths(F.element_at("values", 1)).alias("first"), thousandths(F.element_at("values", -1)).alias("last"))


@query("slab_stream", "SELECT 'l' || label AS lane, count(*) AS slabs, CAST(sum(vec_id) AS BIGINT) AS ids, max(len(embedding)) AS n FROM embeddings GROUP BY label")
def slab_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings that arrive as a stream, appended to a lane table."""
    folder = fresh_path(spark, "slabs")
    table(spark, sf_dir, "embeddings").select(F.concat(F.lit("l"), F.col("label")).alias("lane"), F.col("vec_id").alias("slab"), F.col("embedding").alias("values")).write.parquet(f"{folder}/in")
    coming = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    controls.stream_slabs(coming, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("lane").agg(F.count("*").alias("slabs"), F.sum("slab").alias("ids"), F.max(F.size("values")).cast("long").alias("n"))


@query("control_stream", "SELECT event_type AS surface, CAST(user_id % 4 AS INT) AS i, CAST(event_id % 4 AS INT) AS j, arg_max(value, event_id) AS v, max(event_id) AS seq FROM events GROUP BY 1, 2, 3")
def control_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of controls: the latest of each node, which the surfaces are solved from."""
    folder = fresh_path(spark, "controls")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("surface"), (F.col("user_id") % 4).cast("int").alias("i"), (F.col("event_id") % 4).cast("int").alias("j"), F.col("value").alias("v"), F.col("event_id").cast("long").alias("seq"))
    e.write.parquet(f"{folder}/in")
    coming = spark.readStream.schema(controls.STATE).parquet(f"{folder}/in")
    controls.stream_surfaces(coming, Lattice(0.0, 0.0, 1.0, 1.0, 4, 4), f"{folder}/out").awaitTermination()
    return spark.read.schema(controls.STATE).parquet(f"{folder}/out/state/batch=0")


@query("control_upsert", "SELECT CAST(l_partkey % 7 AS INT) AS i, CAST(l_suppkey % 5 AS INT) AS j, arg_max(l_quantity, l_orderkey * 8 + l_linenumber) AS v, max(l_orderkey * 8 + l_linenumber)::BIGINT AS seq FROM lineitem GROUP BY 1, 2")
def control_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 7).cast("int").alias("i"), (F.col("l_suppkey") % 5).cast("int").alias("j"), F.col("l_quantity").alias("v"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    first = F.pmod("seq", F.lit(8)) == 1  # the first line of each order, which the others come after
    return gridding.upsert_controls(rows.where(first), rows.where(~first))


@query("section_read", "SELECT 'n' || n_nationkey AS name, n_name AS payload FROM nation WHERE n_nationkey = 3")
def section_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sections, and one of them read."""
    path = f"{fresh_path(spark, 'nations')}/n.sections"
    n = table(spark, sf_dir, "nation").select(F.lit("doc").alias("kind"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"), F.array(F.lit("n")).alias("tags"), F.lit(1).alias("version"), F.col("n_name").cast("binary").alias("payload"))
    sections.write_sections(n, path, {"made": "here"}, 3)
    return spark.createDataFrame([("n3", sections.read_section(spark, path, "n3").decode())], "name string, payload string")


@query("standardise_field", f"SELECT o_orderpriority AS p, o_orderkey AS i, {rounded('(o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w', 6)} AS v FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def standardise_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gridding.standardise(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")), ["p"])
    return out.select("p", "i", at_scale(F.col("v"), 6).alias("v"))


_TRI = "t AS (SELECT event_id AS tid, user_id % 50 AS a, event_id % 50 AS b, CAST(floor(value) AS BIGINT) % 50 AS c FROM events), n AS (SELECT range AS nid, CASE WHEN range % 10 = 9 THEN CAST('nan' AS DOUBLE) ELSE range * 1.5 END AS value FROM range(50))"


@query("triangle_values", f"WITH {_TRI} SELECT tid, {rounded('(x.value + y.value + z.value) / 3', 6)} AS value FROM t JOIN n x ON x.nid = a JOIN n y ON y.nid = b JOIN n z ON z.nid = c WHERE NOT isnan(x.value) AND NOT isnan(y.value) AND NOT isnan(z.value)")
def triangle_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(50).select(F.col("id").alias("nid"), F.when(F.col("id") % 10 == 9, float("nan")).otherwise(F.col("id") * 1.5).alias("value"))
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("tid"), (F.col("user_id") % 50).alias("a"), (F.col("event_id") % 50).alias("b"), (F.floor("value") % 50).alias("c"))
    return payload.triangle_colours(nodes, t, 0.0, 75.0).select("tid", at_scale(F.col("value"), 6).alias("value"))


@query("sampled_lines", f"WITH {DOME_SQL} SELECT i, j, {rounded('v', 6)} AS v FROM f WHERE i % 6 = 0 OR i = 19")
def sampled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.sampled_lines(_dome(spark), "i", 20, 6).select("i", "j", at_scale(F.col("v"), 6).alias("v"))


@query("raster_window", f"WITH {DOME_SQL} SELECT i, j, {rounded('v', 6)} AS v FROM f WHERE i BETWEEN 3 AND 17 AND j BETWEEN 2 AND 9 AND (i - 3) % 4 = 0 AND (j - 2) % 3 = 0")
def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.raster_window(_dome(spark), (3, 17), (2, 9), (4, 3)).select("i", "j", at_scale(F.col("v"), 6).alias("v"))


@query("vertex_ids", f"WITH {POINTS}, r AS (SELECT pid, floor(x / 10) AS x, floor(y / 10) AS y, 0.0::DOUBLE AS z FROM pts) SELECT pid, CAST(dense_rank() OVER (ORDER BY x, y, z) - 1 AS INT) AS nid FROM r")
def vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("pid", F.floor(F.col("x") / 10).cast("double").alias("x"), F.floor(F.col("y") / 10).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return payload.vertex_ids(p).select("pid", F.col("nid").cast("int").alias("nid"))


@query("lattice_bbox", f"WITH n AS (SELECT 100.0 + i * 25.0 * cos(radians(30.0)) + j * 50.0 * sin(radians(30.0)) AS x, 200.0 + i * 25.0 * sin(radians(30.0)) - j * 50.0 * cos(radians(30.0)) AS y FROM (SELECT range // 20 AS i, range % 20 AS j FROM range(600))) SELECT {rounded('min(x)', 6)} AS x0, {rounded('min(y)', 6)} AS y0, {rounded('max(x)', 6)} AS x1, {rounded('max(y)', 6)} AS y1 FROM n")
def lattice_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([tuple(map(float, TURNED.bbox()))], "x0 double, y0 double, x1 double, y1 double").select(*[at_scale(F.col(c), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("georef_points", f"WITH {POINTS} SELECT pid, x + 5000.0 AS x, y - 250.0 AS y FROM pts")
def georef_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Georef(5000.0, -250.0).place_points(points(spark, sf_dir)).select("pid", "x", "y")


@query("anchor_average", f"WITH {POINTS}, s AS (SELECT CAST(floor((x - 1.0) / 4.0 + 0.5) AS INT) AS i, CAST(floor(y / 4.5 + 0.5) AS INT) AS j, z FROM pts) SELECT i, j, {rounded('avg(z)', 4)} AS v FROM s WHERE i BETWEEN 0 AND 11 AND j BETWEEN 0 AND 11 GROUP BY i, j")
def anchor_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.anchor_average(points(spark, sf_dir), TARGET).select("i", "j", at_scale(F.col("v"), 4).alias("v"))

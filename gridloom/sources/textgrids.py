"""Text formats of grids, points, lines, well paths, logs and tops: writers from DataFrames, and readers for round trips.

Lines are made by Spark (format_string, six values to a line by one aggregation) and numbered; a file is one ordered write.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, ParseFailure
from ..functions.lattice import Lattice

PER_LINE = 6
NULL_LOG = -999.25


def _plain(lattice: Lattice) -> None:
    if lattice.rotation_deg or lattice.yflip:
        raise InvalidArgument("text grids are not rotated or flipped")


def _save(spark: SparkSession, head: list[str], lines: DataFrame, path: str, encoding: str = "utf-8") -> None:
    """head, then lines (n, value) in order of n, as one file in any store that Spark writes to. A file is one stream, so its
    lines come through the driver, a partition at a time; it is renamed when it is whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    whole, part = hadoop.Path(path), hadoop.Path(f"{path}.part")
    fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    held: list[str] = []

    def put(line: str | None) -> None:
        if line is not None:
            held.append(line + "\n")
        if line is None or len(held) >= 10_000:
            out.write(bytearray("".join(held).encode(encoding)))
            held.clear()

    try:
        for line in head:
            put(line)
        for r in lines.orderBy("n").select("value").toLocalIterator():
            put(r.value)
        put(None)
    finally:
        out.close()
    fs.delete(whole, False)
    fs.rename(part, whole)


def _text(path: str, encoding: str = "utf-8") -> list[str]:
    """The lines of one file, read by Spark."""
    return bytes(SparkSession.active().read.format("binaryFile").load(path).select("content").first().content).decode(encoding).splitlines()


def _wrapped(field: DataFrame, n: Column, negate: bool) -> DataFrame:
    """Values in order of n, six to a line."""
    v = -F.col("v") if negate else F.col("v")
    rows = field.select(n.cast("long").alias("n"), F.format_string("%.4f", v).alias("t"))
    packed = rows.groupBy(F.floor(F.col("n") / PER_LINE).alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("r"))
    return packed.select("n", F.array_join(F.col("r.t"), " ").alias("value"))


def write_irap_grid(field: DataFrame, lattice: Lattice, path: str, negate: bool = False) -> None:
    _plain(lattice)
    x1, y1 = lattice.xori + (lattice.ncol - 1) * lattice.xinc, lattice.yori + (lattice.nrow - 1) * lattice.yinc
    head = [f"-996 {lattice.nrow} {lattice.yinc} {lattice.xinc}", f"{lattice.xori} {x1} {lattice.yori} {y1}", f"{lattice.ncol} 0 {lattice.xori} {lattice.yori}", "0 0 0 0 0 0 0"]
    _save(field.sparkSession, head, _wrapped(field, F.col("j") * lattice.ncol + F.col("i"), negate), path)


def _xyz(field: DataFrame, lattice: Lattice, negate: bool) -> DataFrame:
    x, y = lattice.node_xy(F.col("i"), F.col("j"))
    v = -F.col("v") if negate else F.col("v")
    return field.select((F.col("i") * lattice.nrow + F.col("j")).cast("long").alias("n"), F.format_string("%.3f %.3f %.4f", x.cast("double"), y.cast("double"), v).alias("value"))


def write_irap_points(field: DataFrame, lattice: Lattice, path: str, negate: bool = True) -> None:
    _plain(lattice)
    _save(field.sparkSession, [], _xyz(field, lattice, negate), path)


def write_earthvision_grid(field: DataFrame, lattice: Lattice, path: str, negate: bool = True) -> None:
    _plain(lattice)
    head = ["# nodes of a lattice, by gridloom", f"# GRID_SIZE: {lattice.ncol} x {lattice.nrow}", "# GRID_SPACE: values stand at nodes", "# Null_value: 1.0e30"]
    _save(field.sparkSession, head, _xyz(field, lattice, negate), path)


def write_cps3_grid(field: DataFrame, lattice: Lattice, path: str, negate: bool = False) -> None:
    _plain(lattice)
    x1, y1 = lattice.xori + (lattice.ncol - 1) * lattice.xinc, lattice.yori + (lattice.nrow - 1) * lattice.yinc
    head = ["FSASCI 0 1 0 5 1.0E+30", f"FSLIMI {lattice.xori} {x1} {lattice.yori} {y1} -1.0E+04 1.0E+04", f"FSNROW {lattice.nrow} {lattice.ncol}", f"FSXINC {lattice.xinc} {lattice.yinc}", "->"]
    _save(field.sparkSession, head, _wrapped(field, (lattice.nrow - 1 - F.col("j")) * lattice.ncol + F.col("i"), negate), path)


def write_cps3_lines(rings: DataFrame, path: str) -> None:
    """rings (ring_id, seq, x, y)."""
    points = rings.select("ring_id", (F.col("seq") + 1).alias("s"), F.format_string("%.3f %.3f 0.0000", "x", "y").alias("value"))
    heads = rings.select("ring_id").distinct().select("ring_id", F.lit(0).alias("s"), F.format_string("-> %d", (F.col("ring_id") + 1).cast("long")).alias("value"))
    lines = points.unionByName(heads).select(F.struct("ring_id", "s").alias("n"), "value")
    _save(rings.sparkSession, ["FFLINE 0 1 0", "# closed rings, by gridloom"], lines, path)


def write_wellpath(traj: DataFrame, path: str, kb: float) -> None:
    """traj (seq, md, x, y, z, tvd, incl, azim) of one well."""
    first = traj.orderBy("seq").select("x", "y").first()
    head = [
        "# path of one well, by gridloom", f"# head x: {first.x:.3f} m", f"# head y: {first.y:.3f} m", f"# kelly bushing above mean sea level: {kb} m",
        "# positions in metres, in no particular projection", "# MD and TVD count from the kelly bushing", "==========", "MD X Y Z TVD DX DY AZIM_TN INCL DLS AZIM_GN",
    ]
    _save(traj.sparkSession, head, traj.select(F.col("seq").alias("n"), F.format_string("%.3f %.3f %.3f %.3f %.3f 0 0 %.3f %.3f 0 %.3f", "md", "x", "y", "z", "tvd", "azim", "incl", "azim").alias("value")), path)


def write_las2(curves: DataFrame, path: str, well: str, step: float, kb: float = 0.0, names: tuple[str, str, str] = ("PHIE", "NTG", "SW")) -> None:
    """curves (k, md, por, ntg, sw); undefined values are NULL_LOG."""
    ends = curves.agg(F.min("md"), F.max("md")).first()
    head = [
        "~Version", " VERS. 2.0 : CWLS LOG ASCII STANDARD - VERSION 2.0", " WRAP. NO  : ONE LINE PER DEPTH STEP", "~Well", f" STRT.M {ends[0]:.3f} : START DEPTH", f" STOP.M {ends[1]:.3f} : STOP DEPTH",
        f" STEP.M {step} : STEP", f" NULL. {NULL_LOG} : NULL VALUE", f" KB.M {kb} : KELLY BUSHING", f" WELL. {well} : WELL NAME", "~Curve", " DEPT.M : Measured depth",
        f" {names[0]}.v/v : Effective porosity", f" {names[1]}.v/v : Net to gross", f" {names[2]}.v/v : Water saturation", "~ASCII",
    ]
    defined = lambda c: F.when(F.isnan(c) | F.col(c).isNull(), NULL_LOG).otherwise(F.col(c).cast("double"))
    _save(curves.sparkSession, head, curves.select(F.col("k").alias("n"), F.format_string("%.3f %.4f %.4f %.4f", "md", defined("por"), defined("ntg"), defined("sw")).alias("value")), path)


def write_tops(picks: DataFrame, path: str) -> None:
    """picks (ord, x, y, tvdss, md, type, surface, well); Latin-1, as names may have its letters."""
    head = ["# tops, by gridloom", "VERSION 2", "BEGIN HEADER", "X", "Y", "Z", "TWT", "TWT2", "age", "MD", "PVD", "Type", "Surface", "Well", "END HEADER"]
    z = -F.col("tvdss")
    _save(picks.sparkSession, head, picks.select(F.col("ord").alias("n"), F.format_string('%.3f %.3f %.2f -999 -999 -999 %.4f %.2f %s "%s" "%s"', "x", "y", z, "md", z, "type", "surface", "well").alias("value")), path, "latin-1")


def _numbers(path: str, skip: int) -> tuple[list[list[str]], list[float]]:
    lines = _text(path)
    return [x.split() for x in lines[:skip]], [float(v) for x in lines[skip:] for v in x.split()]


def _field(spark: SparkSession, values: list[tuple[int, int, float]]) -> DataFrame:
    return spark.createDataFrame(values, "i int, j int, v double")


def read_irap_grid(spark: SparkSession, path: str) -> tuple[DataFrame, Lattice]:
    head, v = _numbers(path, 4)
    if head[0][0] != "-996":
        raise ParseFailure(f"{path} is no grid of this format")
    nrow, yinc, xinc, ncol = int(head[0][1]), float(head[0][2]), float(head[0][3]), int(head[2][0])
    lattice = Lattice(float(head[1][0]), float(head[1][2]), xinc, yinc, ncol, nrow)
    if len(v) != ncol * nrow:
        raise ParseFailure(f"{path} has {len(v)} values, not {ncol * nrow}")
    return _field(spark, [(n % ncol, n // ncol, x) for n, x in enumerate(v)]), lattice


def read_cps3_grid(spark: SparkSession, path: str) -> tuple[DataFrame, Lattice]:
    head, v = _numbers(path, 5)
    if head[0][0] != "FSASCI":
        raise ParseFailure(f"{path} is no grid of this format")
    nrow, ncol = int(head[2][1]), int(head[2][2])
    lattice = Lattice(float(head[1][1]), float(head[1][3]), float(head[3][1]), float(head[3][2]), ncol, nrow)
    return _field(spark, [(n % ncol, nrow - 1 - n // ncol, x) for n, x in enumerate(v)]), lattice


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Points and node lists: (x, y, z), comments left out."""
    lines = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#")))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(*[F.get(parts, F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])


def read_las2(path: str) -> tuple[dict[str, str], list[str], list[list[float]]]:
    """Well items, curve names and rows, NULL_LOG as NaN."""
    items, curves, rows, block = {}, [], [], ""
    for line in _text(path):
        if line.startswith("~"):
            block = line[1]
        elif block in "WV":
            name, _, rest = line.strip().partition(".")
            items[name] = rest.rpartition(":")[0].split(maxsplit=1)[-1].strip() if rest else ""
        elif block == "C":
            curves.append(line.strip().partition(".")[0])
        elif block == "A":
            rows.append([math.nan if float(v) == NULL_LOG else float(v) for v in line.split()])
    return items, curves, rows


def read_cps3_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ring_id, seq, x, y)."""
    rows, ring, seq = [], -1, 0
    for line in _text(path):
        if line.startswith("->"):
            ring, seq = int(line[2:]) - 1, 0
        elif line[:1] not in "#F":
            x, y, _ = map(float, line.split())
            rows.append((ring, seq, x, y))
            seq += 1
    return spark.createDataFrame(rows, "ring_id long, seq long, x double, y double")


def read_wellpath(spark: SparkSession, path: str) -> DataFrame:
    """(md, x, y, z, tvd, azim, incl)."""
    parts = F.split("value", " ")
    lines = spark.read.text(path).where(F.col("value").rlike("^-?[0-9]"))
    return lines.select(*[F.get(parts, F.lit(k)).cast("double").alias(c) for c, k in (("md", 0), ("x", 1), ("y", 2), ("z", 3), ("tvd", 4), ("azim", 7), ("incl", 8))])


def read_tops(spark: SparkSession, path: str) -> DataFrame:
    """(ord, x, y, tvdss, md, type, surface, well)."""
    lines = _text(path, "latin-1")
    rows = []
    for n, line in enumerate(lines[lines.index("END HEADER") + 1 :]):
        v, names = line.split(), re.findall('"([^"]*)"', line)
        rows.append((n, float(v[0]), float(v[1]), -float(v[2]), float(v[6]), v[8], *names))
    return spark.createDataFrame(rows, "ord long, x double, y double, tvdss double, md double, type string, surface string, well string")

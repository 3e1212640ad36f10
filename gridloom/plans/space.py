"""Queries of lattices, distance joins, gridding, variograms and kriging."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ieee import at_scale
from ..functions.lattice import Lattice
from ..operators import gridding, kriging, mincurv, simulate, spatial, synth, variogram
from ..queries import query, table
from .sql import POINTS, rounded

TURNED = Lattice(100.0, 200.0, 25.0, 50.0, 30, 20, 30.0, True)
TARGET = Lattice(1.0, 0.0, 4.0, 4.5, 12, 12)
MODEL = variogram.Variogram("spherical", 0.1, 1.0, 20.0)
OCTAGON = [(10.0, 5.0), (30.0, 2.0), (45.0, 15.0), (47.0, 30.0), (35.0, 45.0), (20.0, 48.0), (8.0, 35.0), (4.0, 20.0)]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, x, y, z): one for each (quantity, discount) of lineitem, the mean price in whole cents."""
    d = F.floor(F.col("l_discount") * 100 + 0.5)
    rows = table(spark, sf_dir, "lineitem").groupBy((F.floor("l_quantity") * 1000 + d).alias("pid"), F.col("l_quantity").alias("x"), (d * 5.0).alias("y"))
    return rows.agg((F.floor(F.avg("l_extendedprice") * 100 + 0.5) / 100).alias("z"))


def _r(*names: str, digits: int = 6):
    return [at_scale(F.col(n), digits).alias(n) for n in names]


_C, _S = math.cos(math.radians(30.0)), math.sin(math.radians(30.0))
_NODES = f"SELECT CAST(range // 20 AS INT) AS i, CAST(range % 20 AS INT) AS j FROM range(600)"


@query("lattice_nodes", f"SELECT i, j, {rounded(f'100.0 + i * 25.0 * {_C!r}::DOUBLE - j * -50.0 * {_S!r}::DOUBLE', 6)} AS x, {rounded(f'200.0 + i * 25.0 * {_S!r}::DOUBLE + j * -50.0 * {_C!r}::DOUBLE', 6)} AS y FROM ({_NODES})")
def lattice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TURNED.nodes(spark).select("i", "j", *_r("x", "y"))


@query(
    "lattice_inverse",
    f"WITH {POINTS} SELECT pid, {rounded(f'((x - 100.0) * {_C!r}::DOUBLE + (y - 200.0) * {_S!r}::DOUBLE) / 25.0', 6)} AS fi, {rounded(f'(-(x - 100.0) * {_S!r}::DOUBLE + (y - 200.0) * {_C!r}::DOUBLE) / -50.0', 6)} AS fj FROM pts",
)
def lattice_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fi, fj = TURNED.xy_to_ij(F.col("x"), F.col("y"))
    return points(spark, sf_dir).select("pid", at_scale(fi, 6).alias("fi"), at_scale(fj, 6).alias("fj"))


@query("snap_nodes", f"WITH {POINTS}, s AS (SELECT CAST(floor((x - 1.0) / 4.0 + 0.5) AS INT) AS i, CAST(floor(y / 4.5 + 0.5) AS INT) AS j, z FROM pts) SELECT i, j, count(*) AS n, {rounded('avg(z)', 4)} AS v FROM s WHERE i BETWEEN 0 AND 11 AND j BETWEEN 0 AND 11 GROUP BY i, j")
def snap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TARGET.snap(points(spark, sf_dir)).groupBy("i", "j").agg(F.count("*").alias("n"), at_scale(F.avg("z"), 4).alias("v"))


@query(
    "bilinear_footprint",
    f"""WITH {POINTS}, f AS (SELECT pid, (x - 1.0) / 4.0 AS fi, y / 4.5 AS fj FROM pts), g AS (SELECT pid, least(floor(fi), 10) AS i0, least(floor(fj), 10) AS j0, fi, fj FROM f WHERE fi BETWEEN 0 AND 11 AND fj BETWEEN 0 AND 11)
SELECT pid, CAST(i0 + a AS INT) AS i, CAST(j0 + b AS INT) AS j, {rounded('(CASE WHEN a = 1 THEN fi - i0 ELSE 1 - (fi - i0) END) * (CASE WHEN b = 1 THEN fj - j0 ELSE 1 - (fj - j0) END)', 6)} AS w FROM g, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)""",
)
def bilinear_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TARGET.footprint(points(spark, sf_dir)).select("pid", "i", "j", *_r("w"))


@query(
    "classify_samples",
    f"WITH {POINTS}, f AS (SELECT pid, (x - 1.0) / 4.0 AS fi, y / 4.5 AS fj FROM pts) SELECT pid, CASE WHEN abs(fi - floor(fi + 0.5)) <= 1e-9 AND abs(fj - floor(fj + 0.5)) <= 1e-9 AND floor(fi + 0.5) BETWEEN 0 AND 11 AND floor(fj + 0.5) BETWEEN 0 AND 11 THEN 'node' WHEN fi BETWEEN 0 AND 11 AND fj BETWEEN 0 AND 11 THEN 'off' ELSE 'skip' END AS kind FROM f",
)
def classify_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TARGET.classify(points(spark, sf_dir)).select("pid", "kind")


@query("dedup_coincident", f"SELECT min(pid) AS pid, x, y, {rounded('avg(z)', 3)} AS z, count(*) AS n FROM (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS pid, l_quantity + 0.0 AS x, floor(l_discount * 100 + 0.5) * 5.0 AS y, l_extendedprice AS z FROM lineitem) GROUP BY x, y")
def dedup_coincident(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"), F.col("l_quantity").alias("x"), (F.floor(F.col("l_discount") * 100 + 0.5) * 5.0).alias("y"), F.col("l_extendedprice").alias("z"))
    return spatial.merge_coincident(rows).select("pid", "x", "y", at_scale(F.col("z"), 3).alias("z"), "n")


_GRID = "nodes AS (SELECT CAST(range // 12 AS INT) AS i, CAST(range % 12 AS INT) AS j, 1.0 + (range // 12) * 4.0 AS nx, (range % 12) * 4.5 AS ny FROM range(144))"
_D2 = "((x - nx) * (x - nx) + (y - ny) * (y - ny))"


@query("grid_nearest", f"WITH {POINTS}, {_GRID} SELECT i, j, z AS v FROM nodes, pts QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY {_D2}, pid) = 1")
def grid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.grid_nearest(points(spark, sf_dir), TARGET)


@query("grid_idw", f"WITH {POINTS}, {_GRID}, d AS (SELECT i, j, pid, z, {_D2} AS d2 FROM nodes, pts) SELECT i, j, {rounded('coalesce(arg_min(z, pid) FILTER (d2 = 0), sum(z / d2) FILTER (d2 > 0) / sum(1 / d2) FILTER (d2 > 0))', 4)} AS v FROM d GROUP BY i, j")
def grid_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.grid_idw(points(spark, sf_dir), TARGET).select("i", "j", *_r("v", digits=4))


_SOURCE = Lattice(0.0, 0.0, 10.0, 10.0, 5, 5)
_FINE = Lattice(-5.0, 0.0, 3.5, 4.5, 14, 11)


def _source(spark: SparkSession) -> DataFrame:
    return _SOURCE.nodes(spark).select("i", "j", F.when((F.col("i") == 2) & (F.col("j") == 3), float("nan")).otherwise(3 + 0.5 * F.col("x") - 0.25 * F.col("y")).alias("v"))


_RESAMPLE = "src AS (SELECT CAST(range // 5 AS INT) AS ci, CAST(range % 5 AS INT) AS cj, CASE WHEN range = 13 THEN CAST('nan' AS DOUBLE) ELSE 3 + 0.5 * (range // 5) * 10.0 - 0.25 * (range % 5) * 10.0 END AS s FROM range(25)), t AS (SELECT CAST(range // 11 AS INT) AS i, CAST(range % 11 AS INT) AS j, (-5.0 + (range // 11) * 3.5) / 10.0 AS fi, (range % 11) * 4.5 / 10.0 AS fj FROM range(154))"
_NAN = "-9999.0"


@query("resample_nearest", f"WITH {_RESAMPLE} SELECT i, j, CASE WHEN s IS NULL OR isnan(s) OR fi < 0 OR fj < 0 OR fi > 4 OR fj > 4 THEN {_NAN} ELSE s END AS v FROM t LEFT JOIN src ON ci = floor(fi + 0.5) AND cj = floor(fj + 0.5)")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gridding.resample(_source(spark), _SOURCE, _FINE, "nearest")
    return out.select("i", "j", F.when(F.isnan("v"), float(_NAN)).otherwise(F.col("v")).alias("v"))


@query(
    "resample_bilinear",
    f"""WITH {_RESAMPLE}, c AS (SELECT i, j, fi, fj, floor(fi) + a AS ci, floor(fj) + b AS cj, (CASE WHEN a = 1 THEN fi - floor(fi) ELSE 1 - (fi - floor(fi)) END) * (CASE WHEN b = 1 THEN fj - floor(fj) ELSE 1 - (fj - floor(fj)) END) AS w
  FROM t, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b) WHERE fi BETWEEN 0 AND 4 AND fj BETWEEN 0 AND 4),
m AS (SELECT i, j, sum(w * s) FILTER (NOT isnan(s)) / sum(w) FILTER (NOT isnan(s)) AS v, bool_or(isnan(s) AND ci = floor(fi + 0.5) AND cj = floor(fj + 0.5)) AS hole FROM c JOIN src USING (ci, cj) WHERE w > 0 GROUP BY i, j)
SELECT i, j, coalesce({rounded(f'CASE WHEN hole THEN {_NAN} ELSE v END', 6)}, {_NAN}) AS v FROM t LEFT JOIN m USING (i, j)""",
)
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gridding.resample(_source(spark), _SOURCE, _FINE)
    return out.select("i", "j", at_scale(F.when(F.isnan("v"), float(_NAN)).otherwise(F.col("v")), 6).alias("v"))


@query(
    "knn_radius",
    """
WITH p AS (SELECT p_partkey AS pid, CAST(p_size AS DOUBLE) AS x, floor(p_retailprice) / 10.0 AS y FROM part),
s AS (SELECT s_suppkey AS tid, CAST(s_suppkey % 50 AS DOUBLE) AS tx, 90.0 + s_suppkey % 97 AS ty FROM supplier),
n AS (SELECT tid, pid, (x - tx) * (x - tx) + (y - ty) * (y - ty) AS d2 FROM s, p WHERE (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 64)
SELECT tid, pid, d2, CAST(row_number() OVER (PARTITION BY tid ORDER BY d2, pid) AS INT) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY tid ORDER BY d2, pid) <= 5
""",
)
def knn_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("double").alias("x"), (F.floor("p_retailprice") / 10.0).alias("y"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tid"), (F.col("s_suppkey") % 50).cast("double").alias("x"), (90.0 + F.col("s_suppkey") % 97).alias("y"))
    return spatial.knn_within(s, p, 8.0, 5, ["tid"]).select("t.tid", "p.pid", "d2", "rank")


_VARIOGRAM = f"""{POINTS}, e AS (SELECT CAST(least(floor(h / 2.5), 11) AS INT) AS bin, avg(h) AS lag, sum(dz * dz) / (2 * count(*)) / 1e6 AS gamma, count(*) AS n
  FROM (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h, a.z - b.z AS dz FROM pts a JOIN pts b ON a.pid < b.pid) WHERE h < 30.0 GROUP BY 1)"""


@query("experimental_variogram", f"WITH {_VARIOGRAM} SELECT bin, {rounded('lag', 6)} AS lag, {rounded('gamma', 6)} AS gamma, n FROM e")
def experimental_variogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = variogram.experimental(points(spark, sf_dir), 2.5, 12)
    return e.select("bin", *_r("lag"), at_scale(F.col("gamma") / 1e6, 6).alias("gamma"), "n")


@query(
    "variogram_fit",
    f"""WITH {_VARIOGRAM}, r AS (SELECT max(lag) AS h FROM e), ranges AS (SELECT range AS step, h / 50 + (h * 2 - h / 50) * range / 399 AS a FROM range(400), r),
s AS (SELECT step, a, sum(n) AS sw, sum(n * g) AS swg, sum(n * g * g) AS swgg, sum(n * gamma) AS swy, sum(n * g * gamma) AS swgy, sum(n * gamma * gamma) AS swyy
  FROM (SELECT step, a, CAST(n AS DOUBLE) AS n, gamma, CASE WHEN lag / a >= 1 THEN 1.0 ELSE 1.5 * (lag / a) - 0.5 * (lag / a) * (lag / a) * (lag / a) END AS g FROM ranges, e) GROUP BY step, a),
c AS (SELECT step, a, sw, swg, swgg, swy, swgy, swyy, unnest([{{'k': 0, 'c0': (swy * swgg - swg * swgy) / (sw * swgg - swg * swg), 'c': (sw * swgy - swg * swy) / (sw * swgg - swg * swg)}}, {{'k': 1, 'c0': 0.0, 'c': swgy / swgg}}, {{'k': 2, 'c0': swy / sw, 'c': 0.0}}]) AS x FROM s),
f AS (SELECT step, a, x.k AS k, x.c0 AS c0, x.c AS c, swyy + x.c0 * x.c0 * sw + x.c * x.c * swgg + 2 * x.c0 * x.c * swg - 2 * x.c0 * swy - 2 * x.c * swgy AS sse FROM c WHERE x.c0 >= 0 AND x.c >= 0)
SELECT {rounded('a', 3)} AS range, {rounded('c0', 3)} AS nugget, {rounded('c', 3)} AS sill FROM f ORDER BY sse, step, k LIMIT 1""",
)
def variogram_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = variogram.experimental(points(spark, sf_dir), 2.5, 12).withColumn("gamma", F.col("gamma") / 1e6)
    top = e.agg(F.max("lag")).first()[0]
    a, c0, c, _ = variogram.sweep(e, "spherical", top / 50, top * 2, 400)
    return spark.createDataFrame([(a, c0, c)], "range double, nugget double, sill double").select(*_r("range", "nugget", "sill", digits=3))


@query(
    "variogram_gamma",
    f"""WITH h AS (SELECT range * 0.5 AS h FROM range(100)) SELECT h, m AS model, {rounded("CASE WHEN h <= 0 THEN 0.0 ELSE 0.1 + CASE m WHEN 'nugget' THEN 0.0 WHEN 'spherical' THEN CASE WHEN h / 20 >= 1 THEN 1.0 ELSE 1.5 * (h / 20) - 0.5 * (h / 20) * (h / 20) * (h / 20) END WHEN 'exponential' THEN 1 - exp(-3.0 * (h / 20)) ELSE 1 - exp(-3.0 * (h / 20) * (h / 20)) END END", 6)} AS gamma
FROM h, (VALUES ('nugget'), ('spherical'), ('exponential'), ('gaussian')) t(m)""",
)
def variogram_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.range(100).select((F.col("id") * 0.5).alias("h"))
    found = F.array(*[F.struct(F.lit(m).alias("model"), at_scale(variogram.Variogram(m, 0.1, 1.0, 20.0).gamma(F.col("h")), 6).alias("gamma")) for m in ("nugget", "spherical", "exponential", "gaussian")])
    return h.select("h", F.explode(found).alias("g")).select("h", "g.model", "g.gamma")


_SIN, _COS = math.sin(math.radians(35.0)), math.cos(math.radians(35.0))
_ALONG, _ACROSS = f"(dx * {_SIN!r}::DOUBLE + dy * {_COS!r}::DOUBLE)", f"(dx * {_COS!r}::DOUBLE - dy * {_SIN!r}::DOUBLE)"


@query(
    "aniso_gamma",
    f"""WITH o AS (SELECT CAST(a.range AS DOUBLE) - 10 AS dx, CAST(b.range AS DOUBLE) - 10 AS dy FROM range(21) a, range(21) b), d AS (SELECT dx, dy, sqrt({_ALONG} / 25.0 * ({_ALONG} / 25.0) + {_ACROSS} / 8.0 * ({_ACROSS} / 8.0)) AS h FROM o)
SELECT dx, dy, {rounded('CASE WHEN h <= 0 THEN 0.0 ELSE 0.2 + 0.9 * (1 - exp(-3.0 * h)) END', 6)} AS gamma FROM d""",
)
def aniso_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = variogram.AnisotropicVariogram("exponential", 0.2, 0.9, 25.0, 8.0, 5.0, 395.0)
    at = spark.range(441).select((F.floor(F.col("id") / 21) - 10.0).alias("dx"), (F.col("id") % 21 - 10.0).alias("dy"))
    return at.select("dx", "dy", at_scale(model.gamma_offset(F.col("dx"), F.col("dy")), 6).alias("gamma"))


def _crosses() -> str:
    return " + ".join(f"CASE WHEN (({ay} > y) <> ({by} > y)) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END" for ax, ay, bx, by in spatial.ring_edges(OCTAGON) if ay != by)


@query("polygon_filter", f"WITH {POINTS} SELECT pid, x, y FROM pts WHERE ({_crosses()}) % 2 = 1")
def polygon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(spatial.in_polygon(F.col("x"), F.col("y"), OCTAGON)).select("pid", "x", "y")


_BOX = [(10.0, 10.0), (30.0, 10.0), (30.0, 30.0), (10.0, 30.0)]


@query("ring_filter", f"WITH {POINTS} SELECT pid, x, y FROM pts WHERE x BETWEEN 10 AND 30 AND y BETWEEN 10 AND 30")
def ring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(spatial.in_rings(F.col("x"), F.col("y"), [_BOX])).select("pid", "x", "y")


@query(
    "clip_lines",
    f"""WITH {POINTS}, s AS (SELECT pid // 1000 AS line_id, pid AS seq, x, y, lead(pid) OVER o AS s2, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM pts WINDOW o AS (PARTITION BY pid // 1000 ORDER BY pid)),
k AS (SELECT * FROM s WHERE s2 IS NOT NULL AND (x + x2) / 2 BETWEEN 10 AND 30 AND (y + y2) / 2 BETWEEN 10 AND 30),
g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY line_id ORDER BY seq) AS INT) AS part FROM (SELECT *, CASE WHEN lag(s2) OVER (PARTITION BY line_id ORDER BY seq) = seq THEN 0 ELSE 1 END AS b FROM k))
SELECT line_id, part, seq, x, y FROM g UNION SELECT line_id, part, s2, x2, y2 FROM g""",
)
def clip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = points(spark, sf_dir).select(F.floor(F.col("pid") / 1000).alias("line_id"), F.col("pid").alias("seq"), "x", "y")
    return spatial.clip_lines(vertices, [_BOX])


@query(
    "unique_edges",
    "WITH t AS (SELECT l_partkey % 300 AS a, l_suppkey % 300 + 300 AS b, l_orderkey % 300 + 600 AS c FROM lineitem) SELECT DISTINCT least(p, q) AS u, greatest(p, q) AS v FROM (SELECT a AS p, b AS q FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT c, a FROM t)",
)
def unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 300).alias("a"), (F.col("l_suppkey") % 300 + 300).alias("b"), (F.col("l_orderkey") % 300 + 600).alias("c"))
    return spatial.unique_edges(t)


@query(
    "ring_area",
    f"""WITH {POINTS}, v AS (SELECT pid // 1000 AS ring, pid AS seq, x, y, coalesce(lead(x) OVER o, first_value(x) OVER o) AS x2, coalesce(lead(y) OVER o, first_value(y) OVER o) AS y2 FROM (SELECT pid, x + (pid % 7) AS x, y FROM pts) WINDOW o AS (PARTITION BY pid // 1000 ORDER BY pid))
SELECT ring, {rounded('abs(sum(x * y2 - x2 * y) / 2)', 6)} AS area FROM v GROUP BY ring""",
)
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = points(spark, sf_dir).select(F.floor(F.col("pid") / 1000).alias("ring"), F.col("pid").alias("seq"), (F.col("x") + F.col("pid") % 7).alias("x"), "y")
    return spatial.ring_area(v, ["ring"]).select("ring", *_r("area"))


@query("local_kriging")
def local_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriging.local_kriging(points(spark, sf_dir), TARGET, MODEL, 12, 10.0)


@query("ordinary_kriging")
def ordinary_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriging.ordinary_kriging(points(spark, sf_dir), TARGET, MODEL)


@query("min_curvature")
def min_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surface for each third of the points."""
    return mincurv.grid_min_curvature(points(spark, sf_dir).withColumn("surface", F.col("pid") % 3), TARGET, ["surface"])


@query("min_curvature_horizons")
def min_curvature_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten horizons over one footprint, whose factor they share."""
    p = points(spark, sf_dir).select("pid", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("horizon"), "z").withColumn("z", F.col("z") / 1000 + F.col("horizon") * F.col("x"))
    return mincurv.grid_horizons(p, TARGET, "horizon")


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    layers = spark.range(4).select(F.col("id").alias("layer"))
    return points(spark, sf_dir).join(layers, F.pmod("pid", F.lit(4)) == F.col("layer")), layers.select("layer", (F.col("layer") * 7 + 5).alias("seed"))


@query("sgs")
def sgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, seeds = _layers(spark, sf_dir)
    return simulate.sgs(p, seeds, TARGET, MODEL, 8, 15.0)


@query("sgs_collocated")
def sgs_collocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, seeds = _layers(spark, sf_dir)
    beside = seeds.select("layer").join(TARGET.nodes(spark)).select("layer", "i", "j", (F.col("x") + F.col("y")).alias("v"))
    return simulate.sgs_collocated(p, beside, seeds, TARGET, MODEL, 0.6, 8, 15.0)


@query("sgs_unconditional")
def sgs_unconditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.sgs_unconditional(spark.range(4).select(F.col("id").alias("seed")), TARGET, MODEL, 10.0, 4.0, 8, 15.0)


DOME = Lattice(0.0, 0.0, 10.0, 10.0, 20, 20)
DOME_V = "100.0 * exp(-0.5 * ((x - 95.0) / 47.5 * ((x - 95.0) / 47.5) + (y - 95.0) / 47.5 * ((y - 95.0) / 47.5))) + 5.0 * (x / 190.0 - 0.5)"
DOME_SQL = f"f AS (SELECT i, j, x, y, {DOME_V} AS v FROM (SELECT CAST(range // 20 AS INT) AS i, CAST(range % 20 AS INT) AS j, (range // 20) * 10.0::DOUBLE AS x, (range % 20) * 10.0::DOUBLE AS y FROM range(400)))"


@query("dome_surface", f"WITH {DOME_SQL} SELECT i, j, {rounded('v', 6)} AS v FROM f")
def dome_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.dome_surface(spark, DOME, 100.0, 1.0, 5.0).select("i", "j", *_r("v"))


def _segment_sql() -> str:
    corners = {0: "a", 1: "b", 2: "c", 3: "d"}
    cross = lambda p, q, k: f"({p}.{k} + (50.0 - {p}.v) / ({q}.v - {p}.v) * ({q}.{k} - {p}.{k}))"
    edge = {"b": (0, 1), "r": (1, 2), "t": (2, 3), "l": (3, 0)}
    out = []
    for case, which in synth.CELL_EDGES.items():
        for part, pair in enumerate(which.split()):
            (p1, q1), (p2, q2) = edge[pair[0]], edge[pair[1]]
            values = [cross(corners[p1], corners[q1], "x"), cross(corners[p1], corners[q1], "y"), cross(corners[p2], corners[q2], "x"), cross(corners[p2], corners[q2], "y")]
            out.append(f"SELECT a.i, a.j, {part} AS part, {', '.join(f'{rounded(v, 4)} AS {n}' for v, n in zip(values, ('x1', 'y1', 'x2', 'y2'), strict=True))} FROM f a JOIN f b ON b.i = a.i + 1 AND b.j = a.j JOIN f c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN f d ON d.i = a.i AND d.j = a.j + 1 WHERE (CASE WHEN a.v > 50 THEN 1 ELSE 0 END + CASE WHEN b.v > 50 THEN 2 ELSE 0 END + CASE WHEN c.v > 50 THEN 4 ELSE 0 END + CASE WHEN d.v > 50 THEN 8 ELSE 0 END) = {case}")
    return f"WITH {DOME_SQL} " + " UNION ALL ".join(out)


@query("contour_segments", _segment_sql())
def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.contour_segments(synth.dome_surface(spark, DOME, 100.0, 1.0, 5.0), DOME, 50.0).select("i", "j", "part", *_r("x1", "y1", "x2", "y2", digits=4))


@query("surface_crest", f"WITH {DOME_SQL} SELECT i, j, {rounded('v', 6)} AS v FROM f ORDER BY f.v, i, j LIMIT 1")
def surface_crest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.crest(synth.dome_surface(spark, DOME, 100.0, 1.0, 5.0)).select("i", "j", *_r("v"))


@query("stacked_surfaces", f"WITH {DOME_SQL} SELECT CAST(k.range AS INT) AS ord, i, j, {rounded('v + 5.0 * (k.range + 1) + greatest(i - 10, 0) * (k.range * (k.range + 1) / 2)', 6)} AS v FROM f, range(3) k")
def stacked_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = synth.dome_surface(spark, DOME, 100.0, 1.0, 5.0)
    iso = spark.range(3).select(F.col("id").cast("int").alias("ord")).join(DOME.nodes(spark)).select("ord", "i", "j", (5.0 + F.greatest(F.col("i") - 10, F.lit(0)) * F.col("ord")).alias("v"))
    return synth.stacked_surfaces(top, iso).select("ord", "i", "j", *_r("v"))


@query(
    "tops_from_surface",
    f"WITH {DOME_SQL}, w AS (SELECT c_custkey AS well, (c_custkey * 37 % 1890) / 10.0 AS x, (c_custkey * 91 % 1890) / 10.0 AS y FROM customer), c AS (SELECT well, w.x, w.y, least(floor(w.x / 10), 18) + a AS i, least(floor(w.y / 10), 18) + b AS j, (CASE WHEN a = 1 THEN w.x / 10 - least(floor(w.x / 10), 18) ELSE 1 - (w.x / 10 - least(floor(w.x / 10), 18)) END) * (CASE WHEN b = 1 THEN w.y / 10 - least(floor(w.y / 10), 18) ELSE 1 - (w.y / 10 - least(floor(w.y / 10), 18)) END) AS wt FROM w, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)) SELECT well, c.x, c.y, {rounded('sum(wt * v)', 5)} AS top FROM c JOIN f USING (i, j) GROUP BY well, c.x, c.y",
)
def tops_from_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    wells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("well"), ((F.col("c_custkey") * 37 % 1890) / 10.0).alias("x"), ((F.col("c_custkey") * 91 % 1890) / 10.0).alias("y"))
    return synth.tops_from_surface(wells, synth.dome_surface(spark, DOME, 100.0, 1.0, 5.0), DOME, 0.0, 1).select("well", "x", "y", *_r("top", digits=5))


@query("isochore")
def isochore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.isochore(spark.range(3).select(F.col("id").alias("seed")), TARGET, 20.0, 6.0, MODEL)


@query("trend_map")
def trend_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.trend_map(spark, TARGET, MODEL, 3, (TARGET.nodes(spark).select("i", "j", (F.col("x") * 2 + F.col("y")).alias("v")), 0.7))

"""Queries of series: interpolation, scores, windows, wells, rankings, and the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ieee import at_scale
from ..functions.rng import normal_inverse, open_uniform
from ..operators import interp, simulate, synth
from ..queries import query, table
from .sql import NORMAL_INVERSE, UNIFORM, rounded

_NAN = "-9999.0"


def _knots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user's events are knots (seconds, value); a query every day and a half."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), "value")
    knots = e.select("user_id", (F.col("us") / 1e6).alias("x"), F.col("value").alias("y"))
    queries = e.groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    queries = queries.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("qid"), (F.col("a") / 1e6).alias("a"), (F.col("b") / 1e6).alias("b"))
    return knots, queries.select("user_id", "qid", F.floor(F.col("a") + (F.col("b") - F.col("a")) * (F.col("qid") - 1) / 10.0).cast("double").alias("q"))


_KNOT_SQL = """
WITH e AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS x, value AS y FROM events),
r AS (SELECT user_id, min(x) AS a, max(x) AS b FROM e GROUP BY user_id),
q AS (SELECT user_id, CAST(range AS INT) AS qid, CAST(floor(a + (b - a) * (range - 1) / 10.0) AS DOUBLE) AS q FROM r, range(13)),
p AS (SELECT q.user_id, qid, q, e.x AS px, e.y AS py FROM q ASOF LEFT JOIN e ON q.user_id = e.user_id AND q.q >= e.x),
n AS (SELECT p.*, e.x AS nx, e.y AS ny FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.q <= e.x)
"""
_METHODS = {
    "previous": "CASE WHEN px IS NULL OR nx IS NULL THEN NULL ELSE py END",
    "next": "CASE WHEN px IS NULL OR nx IS NULL THEN NULL ELSE ny END",
    "nearest": "CASE WHEN px IS NULL OR nx IS NULL THEN NULL WHEN q - px <= nx - q THEN py ELSE ny END",
    "linear": "CASE WHEN px IS NULL OR nx IS NULL THEN NULL WHEN px = nx THEN py ELSE py + (q - px) / (nx - px) * (ny - py) END",
    "previous_extrapolated": "coalesce(py, ny)",
}


def _interp(method: str, sql: str | None) -> None:
    @query(f"interp_{method}", sql and f"{_KNOT_SQL} SELECT user_id, qid, coalesce({rounded(sql, 5)}, {_NAN}) AS v FROM n")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        knots, queries = _knots(spark, sf_dir)
        name, _, extra = method.partition("_")
        out = interp.interp1d(knots, queries, ["user_id"], name, extrapolate=bool(extra))
        return out.select("user_id", "qid", at_scale(F.when(F.isnan("v"), float(_NAN)).otherwise(F.col("v")), 5).alias("v"))


for _name, _sql in [*_METHODS.items(), ("cubic", None)]:
    _interp(_name, _sql)


@query(
    "normal_score",
    f"""WITH r AS (SELECT o_orderpriority AS p, o_totalprice AS value, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY o_orderpriority) AS u FROM orders)
SELECT p AS o_orderpriority, value, {rounded(f"avg({NORMAL_INVERSE.format(p='u')})", 6)} AS score FROM r GROUP BY p, value""",
)
def normal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = simulate.normal_scores(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return s.select("o_orderpriority", "value", at_scale(F.col("score"), 6).alias("score"))


@query("ntg_window", f"SELECT event_id, {rounded('avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)', 6)} AS ntg FROM events")
def ntg_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = synth.ntg_curve(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") >= 100, 0.5, 5.0)
    return out.select("event_id", at_scale(F.col("ntg"), 6).alias("ntg"))


@query("lag1_autocorrelation", f"WITH d AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), n AS (SELECT user_id, d, lead(d) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM d) SELECT user_id, {rounded('sum(d * n) / sum(d * d)', 6)} AS r1 FROM n GROUP BY user_id")
def lag1_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.lag1_autocorrelation(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value").select("user_id", at_scale(F.col("r1"), 6).alias("r1"))


_BUILD = synth.WellProfile.build_hold(500.0, 4.0, 60.0, 395.0)
PROFILES = {"vertical": synth.WellProfile.vertical(), "build_hold": _BUILD, "build_hold_drop": _BUILD.with_drop(1500.0, 3.0, 40.0)}
_ANGLES = {
    "vertical": ("0.0", "0.0"),
    "build_hold": ("CASE WHEN md <= 500 THEN 0.0 WHEN md >= 950 THEN 60.0 ELSE (md - 500) * (4.0 / 30) END", "CASE WHEN md <= 500 THEN 0.0 ELSE 35.0 END"),
    "build_hold_drop": ("CASE WHEN md <= 1500 THEN CASE WHEN md <= 500 THEN 0.0 WHEN md >= 950 THEN 60.0 ELSE (md - 500) * (4.0 / 30) END WHEN md >= 1700 THEN 40.0 ELSE 60.0 - (md - 1500) * (3.0 / 30) END", "CASE WHEN md <= 500 THEN 0.0 ELSE 35.0 END"),
}


def station_sql(kind: str) -> str:
    incl, azim = _ANGLES[kind]
    return f"""WITH s AS (SELECT CAST(range AS INT) AS seq, least(range * 30.0, 2345.0)::DOUBLE AS md FROM range(80)),
a AS (SELECT seq, md, ({incl})::DOUBLE AS incl, ({azim})::DOUBLE AS azim FROM s),
l AS (SELECT *, radians(lag(incl) OVER w) AS i1, radians(lag(azim) OVER w) AS a1, radians(incl) AS i2, radians(azim) AS a2, md - lag(md) OVER w AS d FROM a WINDOW w AS (ORDER BY seq)),
t AS (SELECT *, acos(greatest(least(cos(i1) * cos(i2) + sin(i1) * sin(i2) * cos(a2 - a1), 1.0), -1.0)) AS dl FROM l),
h AS (SELECT *, d / 2 * CASE WHEN dl < 1e-9 THEN 1.0 ELSE tan(dl / 2) / (dl / 2) END AS h FROM t)
"""


SUMS = {"x": "1000.0 + coalesce(sum(h * (sin(i1) * sin(a1) + sin(i2) * sin(a2))) OVER w, 0)", "y": "2000.0 + coalesce(sum(h * (sin(i1) * cos(a1) + sin(i2) * cos(a2))) OVER w, 0)", "z": "25.0 - coalesce(sum(h * (cos(i1) + cos(i2))) OVER w, 0)", "tvd": "coalesce(sum(h * (cos(i1) + cos(i2))) OVER w, 0)"}


def _trajectory(kind: str) -> None:
    @query(f"trajectory_{kind}", f"{station_sql(kind)} SELECT seq, md, {', '.join(f'{rounded(v, 3)} AS {k}' for k, v in SUMS.items())}, {rounded('incl', 4)} AS incl, {rounded('azim', 4)} AS azim FROM h WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = synth.trajectory(spark, (1000.0, 2000.0), 25.0, 2345.0, 30.0, PROFILES[kind])
        return t.select("seq", "md", *[at_scale(F.col(c), 3).alias(c) for c in ("x", "y", "z", "tvd")], *[at_scale(F.col(c), 4).alias(c) for c in ("incl", "azim")])


for _kind in PROFILES:
    _trajectory(_kind)


@query("max_dogleg", f"{station_sql('build_hold_drop')} SELECT {rounded('max(degrees(dl) / d * 30)', 4)} AS dls FROM t")
def max_dogleg(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = synth.trajectory(spark, (1000.0, 2000.0), 25.0, 2345.0, 30.0, PROFILES["build_hold_drop"])
    return synth.max_dogleg_severity(t).select(at_scale(F.col("dls"), 4).alias("dls"))


@query(
    "first_crossing",
    f"""WITH e AS (SELECT user_id AS well, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, value FROM events), d AS (SELECT well, seq, seq * 10.0 AS md, 300.0 - seq * 10.0 - value / 10 AS d FROM e),
l AS (SELECT *, lag(d) OVER w AS d0, lag(md) OVER w AS md0 FROM d WINDOW w AS (PARTITION BY well ORDER BY seq))
SELECT well, {rounded('arg_min(CASE WHEN d0 IS NULL THEN md ELSE md0 + (md - md0) * d0 / (d0 - d) END, seq)', 4)} AS md FROM l WHERE (d0 > 0 AND d <= 0) OR (seq = 0 AND d = 0) GROUP BY well""",
)
def first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), seq.alias("seq"), "value")
    traj = e.select("well", "seq", (F.col("seq") * 10.0).alias("md"), (300.0 - F.col("seq") * 10.0).alias("z"))
    return synth.first_crossing(traj, e.select("well", "seq", (F.col("value") / 10).alias("surface"))).select("well", at_scale(F.col("md"), 4).alias("md"))


@query(
    "zone_of_samples",
    "WITH z AS (SELECT CAST(a.range AS BIGINT) AS well, CAST(b.range AS INT) AS zone, b.range * 60.0 + a.range AS top, (b.range + 1) * 60.0 + a.range AS base FROM range(200) a, range(6) b) SELECT event_id, zone FROM events LEFT JOIN z ON user_id = well AND value >= top AND value < base",
)
def zone_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = spark.range(1200).select(F.floor(F.col("id") / 6).alias("well"), (F.col("id") % 6).cast("int").alias("zone")).withColumns({"top": F.col("zone") * 60.0 + F.col("well"), "base": (F.col("zone") + 1) * 60.0 + F.col("well")})
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), "event_id", "value")
    return synth.zone_of(samples, zones, "value").select("event_id", "zone")


@query(
    "ar1_series",
    f"""WITH RECURSIVE e AS (SELECT w.range AS well, k.range AS k, {NORMAL_INVERSE.format(p='(' + UNIFORM.format(seed=9, stream="ar/' || w.range || '", k='k.range') + f' + {2.0**-54!r}::DOUBLE)')} AS e FROM range(5) w, range(100) k),
r AS (SELECT well, k, e AS z FROM e WHERE k = 0 UNION ALL SELECT e.well, e.k, {__import__('math').exp(-0.5 / 4.0)!r}::DOUBLE * z + sqrt(1 - {__import__('math').exp(-0.5 / 4.0)!r}::DOUBLE * {__import__('math').exp(-0.5 / 4.0)!r}::DOUBLE) * e.e FROM r JOIN e ON e.well = r.well AND e.k = r.k + 1)
SELECT CAST(well AS INT) AS well, k, {rounded('z', 5)} AS z FROM r""",
)
def ar1_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(500).select(F.floor(F.col("id") / 100).cast("int").alias("well"), (F.col("id") % 100).alias("k"))
    return synth.correlated_gaussian(rows, ["well"], "k", F.lit(synth.ar1_phi(0.5, 4.0)), 9).select("well", "k", at_scale(F.col("z"), 5).alias("z"))


@query("well_tops_draws", f"SELECT range AS k, {rounded(NORMAL_INVERSE.format(p='(' + UNIFORM.format(seed=3, stream='top', k='range') + f' + {2.0**-54!r}::DOUBLE)'), 6)} AS v FROM range(500)")
def well_tops_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(500).select(F.col("id").alias("k"), at_scale(normal_inverse(open_uniform(3, "top", F.col("id"))), 6).alias("v"))


@query("place_wells", f"SELECT range AS well, {rounded('100.0 + ' + UNIFORM.format(seed=5, stream='wx', k='range') + ' * 900.0', 6)} AS x, {rounded('50.0 + ' + UNIFORM.format(seed=5, stream='wy', k='range') + ' * 450.0', 6)} AS y FROM range(200)")
def place_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.place_wells(spark, 200, (100.0, 50.0, 1000.0, 500.0), 5).select("well", *[at_scale(F.col(c), 6).alias(c) for c in "xy"])

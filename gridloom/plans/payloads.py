"""Queries of charts, payloads, stores and window streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import payload
from ..functions.ieee import at_scale
from ..queries import query, table
from ..sources import lanes, sections
from ..sources.shared import fresh_path
from ..streaming.controls import windowed_ntg
from .sql import rounded


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("param"))
    return p.agg(F.floor(F.avg("p_retailprice") * 100).alias("a"), F.floor(F.max("p_retailprice")).alias("b")).select("param", (F.col("a") / 100).alias("out_lo"), F.col("b").cast("double").alias("out_hi"))


@query(
    "tornado_rank",
    """
WITH b AS (SELECT p_brand AS param, floor(avg(p_retailprice) * 100) / 100 AS out_lo, floor(max(p_retailprice)) AS out_hi FROM part GROUP BY p_brand),
r AS (SELECT *, abs(out_hi - out_lo) >= 0.005 * 1000 AS big, row_number() OVER (ORDER BY abs(out_hi - out_lo) >= 0.005 * 1000 DESC, abs(out_hi - out_lo) DESC, param) AS rank FROM b)
SELECT CAST(rank AS INT) AS rank, param, out_lo, CAST(out_hi AS DOUBLE) AS out_hi, 0::BIGINT AS folded FROM r WHERE big AND rank <= 8
UNION ALL SELECT CAST(min(rank) AS INT), count(*) || ' others', least(min(out_lo), min(out_hi)), greatest(max(out_lo), max(out_hi)), count(*) FROM r WHERE NOT (big AND rank <= 8) HAVING count(*) > 0
""",
)
def tornado_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.tornado(_bars(spark, sf_dir), 1000.0, 8)


@query("regression_trend", f"SELECT l_returnflag, {', '.join(f'{rounded(e, 5)} AS {n}' for n, e in (('slope', 'regr_slope(l_extendedprice, l_quantity)'), ('intercept', 'regr_intercept(l_extendedprice, l_quantity)'), ('r2', 'regr_r2(l_extendedprice, l_quantity)')))}, min(l_quantity) AS x0, max(l_quantity) AS x1 FROM lineitem GROUP BY l_returnflag")
def regression_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = payload.trend(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return t.select("l_returnflag", *[at_scale(F.col(c), 5).alias(c) for c in ("slope", "intercept", "r2")], "x0", "x1")


@query("tie_quality", f"SELECT user_id AS well, {rounded('avg(abs(value - 30) / 20)', 6)} AS mean_abs, CASE WHEN avg(abs(value - 30) / 20) <= 2 THEN 3 WHEN avg(abs(value - 30) / 20) <= 5 THEN 2 ELSE 1 END AS stars FROM events GROUP BY user_id")
def tie_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), ((F.col("value") - 30) / 20).alias("residual_m"))
    return payload.tie_quality(ties).select("well", at_scale(F.col("mean_abs"), 6).alias("mean_abs"), "stars")


@query("curve_range", "SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id")
def curve_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.curve_range(table(spark, sf_dir, "events"), "value", ["user_id"])


@query(
    "flatten_shift",
    f"WITH p AS (SELECT user_id, min(value) AS pick FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT event_id, {rounded('value - coalesce(pick, 0)', 6)} AS depth, pick IS NULL AS parked FROM events LEFT JOIN p USING (user_id)",
)
def flatten_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), "event_id", F.col("value").alias("tvd"), F.col("event_type").alias("horizon"))
    out = payload.flatten_shift(e.select("well", "event_id", "tvd"), e.select("well", "horizon", "tvd"), "click")
    return out.select("event_id", at_scale(F.col("depth"), 6).alias("depth"), "parked")


@query("stride_points", "WITH k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, ceil(count(*) OVER (PARTITION BY user_id) / 10.0) AS s FROM events) SELECT event_id, user_id FROM k WHERE k % s = 0")
def stride_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.stride_points(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 10, ["user_id"])


@query("cell_ijk", "SELECT l.k AS idx, CAST(l.k % 7 AS INT) AS i, CAST(l.k // 7 % 11 AS INT) AS j, CAST(l.k // 77 AS INT) AS k FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) l")
def cell_ijk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("idx")).distinct()
    return c.select("idx", payload.cell_ijk(F.col("idx"), 7, 11).alias("c")).select("idx", "c.i", "c.j", "c.k")


@query("visible_cells", "SELECT CAST(l_linenumber AS INT) AS i, CAST(l_quantity AS INT) AS j, CAST(l_partkey % 10 AS INT) AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_extendedprice >= 20000 AND l_returnflag IN ('A', 'N') AND l_linenumber BETWEEN 2 AND 5 AND CAST(l_quantity AS INT) BETWEEN 10 AND 40 AND l_partkey % 10 BETWEEN 0 AND 7 GROUP BY 1, 2, 3")
def visible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("int").alias("j"), (F.col("l_partkey") % 10).cast("int").alias("k"), (F.col("l_linestatus") == "O").alias("active"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("zone"))
    return payload.visible_cells(c, 20000.0, ["A", "N"], (2, 5, 10, 40, 0, 7)).groupBy("i", "j", "k").agg(F.count("*").alias("n"))


@query("csr_offsets", "SELECT o_orderkey, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return payload.csr_offsets(lines, "o_orderkey", "n")


def _ramp_sql() -> str:
    stops = payload.COLORMAPS["viridis"]
    table_ = ["[" + ", ".join(f"{s[k]}.0::DOUBLE" for s in stops) + "]" for k in range(3)]
    channel = [f"CAST(floor({t}[s + 1] + ({t}[s + 2] - {t}[s + 1]) * (t * 4 - s) + 0.5) AS INT)" for t in table_]
    return f"WITH v AS (SELECT DISTINCT l_quantity AS q, (l_quantity - 5) / 40 AS r FROM lineitem), c AS (SELECT q, least(greatest(r, 0.0), 1.0) AS t FROM v), s AS (SELECT q, t, CAST(least(floor(t * 4), 3) AS INT) AS s FROM c) SELECT q, {', '.join(f'{c} AS {n}' for c, n in zip(channel, ('red', 'green', 'blue'), strict=True))} FROM s"


@query("colour_ramp", _ramp_sql())
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q")).distinct()
    rgb = q.select("q", payload.ramp((F.col("q") - 5) / 40).alias("c"))
    return rgb.select("q", *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("red", "green", "blue"))])


@query("axis_domain", f"SELECT {rounded('min(value) FILTER (value > 0)', 6)} AS lo, {rounded('max(value)', 6)} AS hi FROM events")
def axis_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.axis_domain(table(spark, sf_dir, "events"), "value", log=True).select(*[at_scale(F.col(c), 6).alias(c) for c in ("lo", "hi")])


@query("exaggeration", "SELECT least(20.0, greatest(4.0, floor(greatest(max(l_quantity) - min(l_quantity), max(l_extendedprice) - min(l_extendedprice)) / (max(l_partkey) - min(l_partkey)) / 2.5 + 0.5)))::DOUBLE AS exaggeration FROM lineitem")
def exaggeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.exaggeration(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_partkey").cast("double").alias("z")))


@query("distinct_blocks", "SELECT len(embedding) AS n, count(*) AS blocks, CAST(sum(uses) AS BIGINT) AS uses FROM (SELECT embedding, count(*) AS uses FROM embeddings GROUP BY embedding) GROUP BY 1")
def distinct_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = payload.distinct_blocks(table(spark, sf_dir, "embeddings"), "embedding")
    return d.groupBy(F.col("n").cast("long").alias("n")).agg(F.count("*").alias("blocks"), F.sum("uses").alias("uses"))


@query("container_index", "SELECT kind, name, tags, version FROM (SELECT 'doc' AS kind, r_name AS name, 'regions' AS tags, 1 AS version, r_name AS payload FROM region) WHERE name <> 'ASIA'")
def container_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions written as sections, one of them filtered away byte for byte, and the index read back."""
    path = fresh_path(spark, "sections")
    r = table(spark, sf_dir, "region").select(F.lit("doc").alias("kind"), F.col("r_name").alias("name"), F.array(F.lit("regions")).alias("tags"), F.lit(1).alias("version"), F.col("r_name").cast("binary").alias("payload"))
    sections.write_sections(r, f"{path}/a.sections", {"made": "here"}, 3)
    sections.filter_to(spark, f"{path}/a.sections", f"{path}/b.sections", F.col("name") != "ASIA")
    return sections.entries(spark, f"{path}/b.sections").select("kind", "name", F.array_join("tags", ",").alias("tags"), "version")


@query("container_merge", "SELECT kind, name, max(version) AS version FROM (SELECT 'doc' AS kind, n_name AS name, 1 AS version FROM nation WHERE n_regionkey <= 2 UNION ALL SELECT 'doc', n_name, 2 FROM nation WHERE n_regionkey >= 2) GROUP BY kind, name")
def container_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.lit("doc").alias("kind"), F.col("n_name").alias("name"), "n_regionkey")
    a, b = n.where("n_regionkey <= 2").select("kind", "name", F.lit(1).alias("version")), n.where("n_regionkey >= 2").select("kind", "name", F.lit(2).alias("version"))
    return sections.merged(a, b)


@query("store_window", "SELECT vec_id AS slab, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE label = 3 AND vec_id >= 100 AND vec_id < 300")
def store_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as lanes by label; a window of one lane."""
    path = fresh_path(spark, "lanes")
    lanes.write_store(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("l"), F.col("label")).alias("lane"), F.col("vec_id").alias("slab"), F.col("embedding").alias("values")), path)
    return lanes.read_window(spark, path, "l3", 100, 300).select("slab", F.size("values").cast("long").alias("n"), F.round(F.get("values", F.lit(0)).cast("double"), 6).alias("first"))


@query("windowed_ntg", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, user_id, {rounded('avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END)', 6)} AS ntg, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed_ntg(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), 100.0)
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "user_id", at_scale(F.col("ntg"), 6).alias("ntg"), "n")


@query("well_log_bundle")
def well_log_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    md = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 0.5
    curves = e.select(F.col("user_id").alias("well"), F.col("event_type").alias("mnemonic"), md.alias("md"), F.col("value").alias("v"))
    tops = e.select(F.col("user_id").alias("well"), F.col("event_type").alias("horizon"), F.col("value").alias("tvd"))
    return payload.well_log_bundle(curves, tops)

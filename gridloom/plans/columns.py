"""Queries of formulas, units, statistics and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng, stats, units
from ..functions.formula import evaluate_formulas
from ..functions.ieee import at_scale
from ..queries import query, table
from .sql import NORMAL_CDF, NORMAL_INVERSE, UNIFORM, rounded

FORMULA = """
net = l_extendedprice * (1 - l_discount)
charge = net * (1 + $k * l_tax)
flag = if(l_quantity >= $cut, 1, 0)
"""


@query(
    "formula_block",
    f"""
WITH f AS (SELECT *, l_extendedprice * (1.0 - l_discount) AS net FROM lineitem),
     g AS (SELECT *, net * (1.0 + 0.5 * l_tax) AS charge, CASE WHEN l_quantity >= 25.0 THEN 1.0 ELSE 0.0 END AS flag FROM f)
SELECT l_returnflag, l_linestatus, count(*) AS n, {rounded('quantile_cont(net, 0.1)', 4)} AS p90, {rounded('quantile_cont(net, 0.5)', 4)} AS p50, {rounded('quantile_cont(net, 0.9)', 4)} AS p10,
       {rounded('avg(net)', 3)} AS mean, {rounded('sum(l_quantity * charge) / sum(l_quantity)', 3)} AS weighted_charge, {rounded('avg(flag)', 6)} AS flag_ratio
FROM g GROUP BY l_returnflag, l_linestatus
""",
)
def formula_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate_formulas(table(spark, sf_dir, "lineitem"), FORMULA, {"k": 0.5, "cut": 25.0}, keep=["l_returnflag", "l_linestatus", "l_quantity"])
    keys = ["l_returnflag", "l_linestatus"]
    plain = F.count("*").alias("n"), F.avg("net").alias("mean"), stats.weighted_mean(F.col("charge"), F.col("l_quantity")).alias("weighted_charge"), F.avg("flag").alias("flag_ratio")
    found = stats.with_percentiles(rows, "net", keys, {"p90": 10, "p50": 50, "p10": 90}, *plain)
    digits = {"p90": 4, "p50": 4, "p10": 4, "mean": 3, "weighted_charge": 3, "flag_ratio": 6}
    return found.select(*keys, "n", *[at_scale(F.col(c), k).alias(c) for c, k in digits.items()])


EDGES = """
inverse = x / l_tax
root = sqrt(x)
logs = log(x) + log10(x)
power = x ** 2 ** 0.5 + -2 ** 2
low = min(x, inverse)
cut = clip(inverse, -50, 50)
test = (x < 0) + 2 * (inverse >= 100) + 4 * (root != root)
pick = if(root, 1, 2)
"""


@query(
    "formula_ieee_edges",
    """
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity - 25.0 AS x, l_tax FROM lineitem),
c AS (SELECT *, x / l_tax AS inverse, CASE WHEN x < 0 THEN CAST('nan' AS DOUBLE) ELSE sqrt(x) END AS root,
             CASE WHEN x < 0 THEN CAST('nan' AS DOUBLE) WHEN x = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(x) + log10(x) END AS logs FROM b)
SELECT CASE WHEN isnan(inverse) THEN 'nan' WHEN isinf(inverse) THEN CASE WHEN inverse > 0 THEN 'inf' ELSE '-inf' END ELSE 'num' END AS inverse_kind,
       CASE WHEN isnan(logs) THEN 'nan' WHEN isinf(logs) THEN '-inf' ELSE 'num' END AS logs_kind,
       CASE WHEN isnan(pow(x, pow(2.0, 0.5))) THEN 'nan' ELSE 'num' END AS power_kind,
       CASE WHEN isnan(inverse) THEN 'nan' WHEN isinf(least(x, inverse)) THEN '-inf' ELSE 'num' END AS low_kind,
       CASE WHEN isnan(inverse) THEN -1000.0 ELSE floor(greatest(-50.0, least(50.0, inverse)) + 0.5) END AS cut,
       CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END + CASE WHEN NOT isnan(inverse) AND inverse >= 100 THEN 2.0 ELSE 0.0 END + CASE WHEN isnan(root) THEN 4.0 ELSE 0.0 END AS test,
       CASE WHEN NOT isnan(root) AND root <> 0 THEN 1.0 ELSE 2.0 END AS pick, count(*) AS n
FROM c GROUP BY ALL
""",
)
def formula_ieee_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25.0).alias("x"), "l_tax")
    rows = evaluate_formulas(base, EDGES)
    kind = lambda c: F.when(F.isnan(c), "nan").when(F.col(c) == float("inf"), "inf").when(F.col(c) == float("-inf"), "-inf").otherwise("num")
    cut = F.when(F.isnan("cut"), -1000.0).otherwise(F.floor(F.col("cut") + 0.5).cast("double"))
    return rows.groupBy(kind("inverse").alias("inverse_kind"), kind("logs").alias("logs_kind"), kind("power").alias("power_kind"), kind("low").alias("low_kind"), cut.alias("cut"), "test", "pick").agg(F.count("*").alias("n"))


@query(
    "describe_stats",
    f"""
SELECT l_returnflag, count(*) AS n, {rounded('avg(l_extendedprice)', 3)} AS mean, {rounded('var_samp(l_extendedprice) / 1000', 2)} AS variance_k, {rounded('stddev_samp(l_extendedprice)', 3)} AS std_dev,
       {rounded('quantile_cont(l_extendedprice, 0.25)', 4)} AS p25, {rounded('quantile_cont(l_extendedprice, 0.5)', 4)} AS median, {rounded('quantile_cont(l_extendedprice, 0.75)', 4)} AS p75
FROM lineitem GROUP BY l_returnflag
""",
)
def describe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return d.select("l_returnflag", "n", at_scale(F.col("mean"), 3).alias("mean"), at_scale(F.col("variance") / 1000, 2).alias("variance_k"), at_scale(F.col("std_dev"), 3).alias("std_dev"), *[at_scale(F.col(c), 4).alias(c) for c in ("p25", "median", "p75")])


@query(
    "weighted_stats",
    f"""
WITH m AS (SELECT l_returnflag, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mu FROM lineitem GROUP BY l_returnflag),
s AS (SELECT l_returnflag, any_value(mu) AS mu, sum(l_quantity * (l_extendedprice - mu) * (l_extendedprice - mu)) / (sum(l_quantity) - sum(l_quantity * l_quantity) / sum(l_quantity)) AS v FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag)
SELECT l_returnflag, {rounded('mu', 3)} AS weighted_mean, {rounded('v / 1000', 2)} AS weighted_variance_k, {rounded('sqrt(v)', 3)} AS weighted_std FROM s
""",
)
def weighted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stats.weighted_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return w.select("l_returnflag", at_scale(F.col("weighted_mean"), 3).alias("weighted_mean"), at_scale(F.col("weighted_variance") / 1000, 2).alias("weighted_variance_k"), at_scale(F.col("weighted_std"), 3).alias("weighted_std"))


@query(
    "weighted_percentile",
    f"""
WITH a AS (SELECT l_returnflag AS f, l_extendedprice AS v, l_quantity AS w FROM lineitem),
b AS (SELECT f, v, (sum(w) OVER (PARTITION BY f ORDER BY v, w ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY f) AS pos FROM a),
c AS (SELECT f, v, pos, lead(v) OVER o AS v2, lead(pos) OVER o AS pos2, lag(pos) OVER o AS pos0 FROM b WINDOW o AS (PARTITION BY f ORDER BY pos, v)),
d AS (SELECT f, p, CASE WHEN p / 100 <= pos OR v2 IS NULL THEN v ELSE v + CASE WHEN pos2 > pos THEN (p / 100 - pos) / (pos2 - pos) ELSE 0 END * (v2 - v) END AS r
      FROM c, (VALUES (10.0::DOUBLE), (50.0), (90.0)) t(p) WHERE (pos < p / 100 AND (pos2 IS NULL OR p / 100 <= pos2)) OR (pos0 IS NULL AND p / 100 <= pos))
SELECT f AS l_returnflag, p, {rounded('min(r)', 3)} AS v FROM d GROUP BY f, p
""",
)
def weighted_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.weighted_percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"], [10, 50, 90])
    return found.select("l_returnflag", "p", at_scale(F.col("v"), 3).alias("v"))


@query(
    "reservoir_summary",
    f"""SELECT o_orderpriority, {', '.join(f"{rounded(f'quantile_cont(o_totalprice, {q})', 4)} AS {n}" for n, q in (('p90', 0.1), ('p50', 0.5), ('p10', 0.9)))}, {rounded('avg(o_totalprice)', 3)} AS mean FROM orders GROUP BY o_orderpriority""",
)
def reservoir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.reservoir_summary(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return s.select("o_orderpriority", *[at_scale(F.col(c), 4).alias(c) for c in ("p90", "p50", "p10")], at_scale(F.col("mean"), 3).alias("mean"))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderpriority", (F.row_number().over(order) - 1).alias("trial"), F.col("o_totalprice").alias("v"))


def _aggregate_sql(rank: str) -> str:
    return f"""
WITH t AS (SELECT o_orderpriority AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS trial, o_totalprice AS v FROM orders),
c AS (SELECT s, v, {rank} AS trial FROM t WHERE trial < (SELECT min(n) FROM (SELECT count(*) AS n FROM t GROUP BY s)))
SELECT CAST(trial AS BIGINT) AS trial, {rounded('sum(v)', 3)} AS total FROM c GROUP BY trial"""


@query("aggregate_independent", _aggregate_sql("trial"))
def aggregate_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.aggregate(_trials(spark, sf_dir), "o_orderpriority", "trial", "v").select("trial", at_scale(F.col("total"), 3).alias("total"))


@query("aggregate_comonotonic", _aggregate_sql("row_number() OVER (PARTITION BY s ORDER BY v) - 1"))
def aggregate_comonotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.aggregate(_trials(spark, sf_dir), "o_orderpriority", "trial", "v", "comonotonic").select("trial", at_scale(F.col("total"), 3).alias("total"))


_CONVERSIONS = [*units.FACTORS, "degf_to_degr"]


def _unit_sql(name: str) -> str:
    if name == "degf_to_degr":
        return "q + 459.67::DOUBLE"
    times, over = units.FACTORS[name]
    return f"q * {times!r}::DOUBLE" if over == 1.0 else f"q / {over!r}::DOUBLE"


@query("units_all", f"SELECT q, {', '.join(f'{_unit_sql(n)} AS {n}' for n in _CONVERSIONS)} FROM (SELECT DISTINCT l_quantity AS q FROM lineitem)")
def units_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q")).distinct()
    return q.select("q", *[units.convert(n, F.col("q")).alias(n) for n in _CONVERSIONS])


@query(
    "format_volume",
    """
WITH v AS (SELECT DISTINCT p_size * m * 10.0 AS v FROM part, (VALUES (1.0), (100000.0), (100000000.0)) t(m))
SELECT v, CASE WHEN abs(v) >= 1e9 THEN printf('%.1f bcm', v / 1e9) WHEN abs(v) >= 1e6 THEN printf('%.1f mcm', v / 1e6) ELSE printf('%.1f m³', v) END AS label FROM (SELECT CAST(v AS DOUBLE) AS v FROM v)
""",
)
def format_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select(F.explode(F.array(*[F.lit(m) for m in (1.0, 1e5, 1e8)])).alias("m"), "p_size").select((F.col("p_size") * F.col("m") * 10.0).alias("v")).distinct()
    return v.select("v", units.format_volume(F.col("v")).alias("label"))


def _draws(name: str, sampler: rng.Sampler, sql: str) -> None:
    u = UNIFORM.format(seed=42, stream=name, k="k")

    @query(f"sampler_{name}", f"WITH d AS (SELECT range AS k, {u} + {2.0**-54!r}::DOUBLE AS u FROM range(2000)), z AS (SELECT k, u, {NORMAL_INVERSE.format(p='u')} AS z FROM d) SELECT k, {rounded(sql, 6)} AS v FROM z")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sampler.sample_n(spark, 2000, 42, name).select("k", at_scale(F.col("v"), 6).alias("v"))


_A, _B = NORMAL_CDF.format(x="((-1.0 - 0.5) / 2.0)::DOUBLE"), NORMAL_CDF.format(x="((3.0 - 0.5) / 2.0)::DOUBLE")
_draws("uniform", rng.Sampler.uniform(-2, 5), "-2.0 + u * 7.0")
_draws("normal", rng.Sampler.normal(10, 2.5), "10.0 + 2.5 * z")
_draws("lognormal", rng.Sampler.lognormal(0.2, 0.4), "exp(0.2 + 0.4 * z)")
_draws("triangular", rng.Sampler.triangular(0, 2, 6), "CASE WHEN u < 2.0::DOUBLE / 6.0 THEN 0.0 + sqrt(u * 12.0) ELSE 6.0 - sqrt((1.0 - u) * 24.0) END")
_draws("truncated_normal", rng.Sampler.truncated_normal(0.5, 2, -1, 3), f"least(greatest(0.5 + 2.0 * ({NORMAL_INVERSE.format(p=f'({_A} + u * ({_B} - {_A}))')}), -1.0), 3.0)")
_draws("clamped", rng.Sampler.normal(0, 1).clamped(-0.5, 0.75), "least(greatest(0.0 + 1.0 * z, -0.5), 0.75)")


@query(
    "histogram",
    "SELECT CAST(least(floor((o_totalprice - 0) / 25000), 19) AS INT) AS bin, least(floor((o_totalprice - 0) / 25000), 19) * 25000.0 AS lo, (least(floor((o_totalprice - 0) / 25000), 19) + 1) * 25000.0 AS hi, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1, 2, 3",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500000.0, 20)


@query(
    "exceedance",
    f"SELECT o_orderpriority, CAST(floor(o_totalprice / 1000) AS BIGINT) AS k, {rounded('sum(count(*)) OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 1000) DESC) / sum(count(*)) OVER (PARTITION BY o_orderpriority)', 6)} AS exceedance FROM orders GROUP BY o_orderpriority, floor(o_totalprice / 1000)",
)
def exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("k"))
    return stats.exceedance(rows, "k", ["o_orderpriority"]).withColumn("exceedance", at_scale(F.col("exceedance"), 6))

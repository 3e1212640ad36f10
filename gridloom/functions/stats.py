"""Statistics of groups: plain, weighted, of realisations. Inputs are columns of finite numbers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .ranges import ranged


def mean(x: Column) -> Column:
    return F.avg(x)


def variance(x: Column) -> Column:
    """Of a sample; 0 for a single value."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.var_samp(x))


def std_dev(x: Column) -> Column:
    return F.sqrt(variance(x))


def percentile(x: Column, p: float) -> Column:
    """Between the nearest ranks, linearly (type 7); p from 0 to 100."""
    if not 0 <= p <= 100:
        raise InvalidArgument("p must be in [0, 100]")
    return F.percentile(x, F.lit(p / 100))


def median(x: Column) -> Column:
    return percentile(x, 50)


def percentiles(df: DataFrame, value: str, keys: list[str], ps: list[float]) -> DataFrame:
    """(keys, p, v): as `percentile`, of groups of any size: no task holds a group's values."""
    return _between(df.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1.0).alias("_w")), keys, ps, False)


def with_percentiles(df: DataFrame, value: str, keys: list[str], names: dict[str, float], *plain: Column) -> DataFrame:
    """(keys, plain, names): aggregates and percentiles of groups."""
    found = percentiles(df, value, keys, list(names.values()))
    found = found.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(name) for name, p in names.items()])
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
    return df.groupBy(*keys).agg(*plain).join(found, same, "left").drop(*[f"_{k}" for k in keys])


def describe(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    x = F.col(value)
    return with_percentiles(df, value, keys, {"p25": 25, "median": 50, "p75": 75}, F.count(x).alias("n"), mean(x).alias("mean"), variance(x).alias("variance"), std_dev(x).alias("std_dev"))


def require_weights(df: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    """df, failing at run time at a weight that is null, not finite or negative."""
    w = F.col(weight)
    return df.withColumn(weight, F.when(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")), F.raise_error(F.lit("weights must be finite and not negative"))).otherwise(w))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def weighted_stats(df: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """weighted_mean, weighted_variance (reliability weights; 0 if one weight holds all), weighted_std by keys.

    One aggregation: values are shifted by a value of their group, so that the sums of squares do not cancel.
    """
    x, w = F.col(value).cast("double"), F.col(weight).cast("double")
    shifts = df.groupBy(*keys).agg(F.avg(x).alias("_shift"))
    rows = df.join(shifts, keys) if keys else df.crossJoin(shifts)
    d = x - F.col("_shift")
    sums = rows.groupBy(*keys).agg(F.sum(w).alias("_v1"), F.sum(w * w).alias("_v2"), F.sum(w * d).alias("_s"), F.sum(w * d * d).alias("_q"), F.first("_shift").alias("_shift"))
    v1, v2 = F.col("_v1"), F.col("_v2")
    centre = F.col("_s") / v1
    below = v1 - v2 / v1
    spread = F.when(below <= 1e-12 * v1, F.lit(0.0)).otherwise(F.greatest((F.col("_q") - v1 * centre * centre) / below, F.lit(0.0)))
    return sums.select(*keys, (F.col("_shift") + centre).alias("weighted_mean"), spread.alias("weighted_variance"), F.sqrt(spread).alias("weighted_std"))


def weighted_percentiles(df: DataFrame, value: str, weight: str, keys: list[str], ps: list[float]) -> DataFrame:
    """(keys, p, v): at the centres of the weights' intervals, between them linearly, clamped at the ends."""
    return _between(df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")), keys, ps, True)


def _between(rows: DataFrame, keys: list[str], ps: list[float], weighted: bool) -> DataFrame:
    """(keys, _v, _w) -> (keys, p, v): the places of values in order are the centres of their weights, as parts of all weight, or their ranks.

    Equal values become one, with its first and last place. Distinct ones are dealt in ranges; of these, one holds the place that is
    asked for, with the last value before it and the first after it. So a task has at most a range of a group.
    """
    for p in ps:
        if not 0 <= p <= 100:
            raise InvalidArgument("p must be in [0, 100]")
    counted = rows.where("_v is not null and _w is not null").groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"), F.min("_w").alias("_low"), F.max("_w").alias("_high"))
    values = ranged(counted, [*keys, "_v"], "values")
    value = F.struct("_v", "_w", "_low", "_high")
    parts = values.groupBy("_part", *keys).agg(F.sum("_w").alias("_sum"), F.min(value).alias("_first"), F.max(value).alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_part")
    before = F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.select("_part", *keys, before.alias("_before"), F.lag("_last").over(order).alias("_prior"), F.lead("_first").over(order).alias("_next"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("_all"))
    parts = parts.select("*", F.lead("_before").over(order).alias("_upto"))
    parts = parts.select("*", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p"))
    unit = F.col("_all") if weighted else F.lit(1.0)
    goal = F.col("p") / 100 if weighted else F.col("p") / 100 * (F.col("_all") - 1)
    goal_at = F.col("_before") / unit
    holds = ((goal_at < goal) | F.col("_prior").isNull()) & (F.col("_upto").isNull() | (F.col("_upto") / unit >= goal))
    wanted = parts.where(holds).select("_part", *[F.col(k).alias(f"_{k}") for k in keys], "p", goal.alias("_goal"), unit.alias("_unit"), "_before", "_prior", "_next")
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], values["_part"] == wanted["_part"])
    asked = ["p", "_goal", "_unit", "_before", "_prior"]
    inside = values.join(wanted, same).select(*keys, *asked, value.alias("_x"))
    beside = wanted.select(*[F.col(f"_{k}").alias(k) for k in keys], *asked, F.explode(F.array("_prior", "_next")).alias("_x")).where("_x is not null")
    line = inside.unionByName(beside).select(*keys, "p", "_goal", "_unit", (F.col("_before") - F.coalesce("_prior._w", F.lit(0.0))).alias("_before"), "_x.*")
    order = Window.partitionBy(*keys, "p").orderBy("_v")
    ahead = F.col("_before") + F.coalesce(F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = (ahead + F.col("_low") / 2) / F.col("_unit") if weighted else ahead
    last = (ahead + F.col("_w") - F.col("_high") / 2) / F.col("_unit") if weighted else ahead + F.col("_w") - 1
    line = line.select(*keys, "p", "_goal", "_v", first.alias("_at"), last.alias("_to"))
    line = line.select("*", F.lead("_v").over(order).alias("_v2"), F.lead("_at").over(order).alias("_at2"))
    share = F.when(F.col("_at2") > F.col("_to"), (F.col("_goal") - F.col("_to")) / (F.col("_at2") - F.col("_to"))).otherwise(0.0)
    v = F.when((F.col("_goal") <= F.col("_to")) | F.col("_v2").isNull(), F.col("_v")).otherwise(F.col("_v") + share * (F.col("_v2") - F.col("_v")))
    hit = (F.col("_at") < F.col("_goal")) & (F.col("_at2").isNull() | (F.col("_goal") <= F.col("_at2")))
    # what is below all centres goes to the first
    return line.groupBy(*keys, "p").agg(F.coalesce(F.min(F.when(hit, v)), F.min("_v")).alias("v"))


def reservoir_summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """p90, p50, p10 (the values exceeded with 90, 50 and 10 %) and mean."""
    return with_percentiles(df, value, keys, {"p90": 10, "p50": 50, "p10": 90}, mean(F.col(value)).alias("mean")).select(*keys, "p90", "p50", "p10", "mean")


def aggregate(df: DataFrame, segment: str, trial: str, value: str, correlation: str = "independent") -> DataFrame:
    """(trial, total): segments added up trial by trial, or rank by rank (comonotonic), cut to the shortest segment's trials.

    trial numbers the values of a segment from 0. The comonotonic ranks are of the values kept after the cut.
    """
    if correlation not in ("independent", "comonotonic"):
        raise InvalidArgument(f"unknown correlation {correlation!r}")
    shortest = df.groupBy(segment).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_n"))
    rows = df.join(shortest, F.col(trial) < F.col("_n"))
    if correlation == "comonotonic":
        rows = rows.withColumn(trial, F.row_number().over(Window.partitionBy(segment).orderBy(value)) - 1)
    return rows.groupBy(F.col(trial).cast("long").alias("trial")).agg(F.sum(value).alias("total"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, lo, hi, n); values outside are not counted, high belongs to the last bin."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    rows = df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return rows.select("bin", (F.lit(low) + F.col("bin") * width).alias("lo"), (F.lit(low) + (F.col("bin") + 1) * width).alias("hi"), "n")


def exceedance(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, exceedance): the part of a group's values that is not below each distinct one."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    after = Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return counted.select(*keys, value, (F.sum("_n").over(after) / F.sum("_n").over(Window.partitionBy(*keys))).alias("exceedance"))

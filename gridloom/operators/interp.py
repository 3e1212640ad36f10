"""One-dimensional interpolation of query points between the knots of their series.

Knots and queries are put in one relation and ordered once; the last knot before and the first after each query come from two
window functions over it. So a series is one sort, without a join of knots and queries. The cubic spline's second derivatives
are a tridiagonal system for each series, solved where the series' knots are grouped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument

METHODS = {
    "nearest": "nearest", "closest": "nearest", "nn": "nearest",
    "previous": "previous", "prev": "previous", "ffill": "previous", "pad": "previous",
    "next": "next", "bfill": "next", "backfill": "next",
    "linear": "linear",
    "cubic": "cubic", "spline": "cubic", "cubicspline": "cubic", "cubic_spline": "cubic", "natural": "cubic", "natural_cubic": "cubic",
}


def method_of(name: str) -> str:
    try:
        return METHODS[name.strip().lower()]
    except KeyError:
        raise InvalidArgument(f"unknown interpolation method {name!r}") from None


def second_derivatives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the natural cubic spline through the knots, by elimination along the three diagonals."""
    n = len(x)
    out = np.zeros(n)
    if n < 3:
        return out
    h = np.diff(x)
    below, above = h[:-1] / 6, h[1:] / 6
    middle = (h[:-1] + h[1:]) / 3
    right = np.diff(np.diff(y) / h)
    for k in range(1, n - 2):
        f = below[k] / middle[k - 1]
        middle[k] -= f * above[k - 1]
        right[k] -= f * right[k - 1]
    for k in range(n - 3, -1, -1):
        out[k + 1] = (right[k] - (above[k] * out[k + 2] if k < n - 3 else 0.0)) / middle[k]
    return out


def with_second_derivatives(knots: DataFrame, keys: list[str]) -> DataFrame:
    """knots (keys, x, y) with m. A series' knots meet in one task."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        part["m"] = second_derivatives(part["x"].to_numpy(), part["y"].to_numpy())
        return part

    fields = {f.name: f.dataType.simpleString() for f in knots.schema}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "x double", "y double", "m double"])
    return knots.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy(*keys).applyInPandas(solve, schema)


def checked_knots(knots: DataFrame, keys: list[str]) -> DataFrame:
    """knots, failing at run time where x does not ascend strictly or a number is not finite."""
    order = Window.partitionBy(*keys).orderBy("x")
    bad = (F.col("x") == F.lag("x").over(order)) | F.isnan("x") | F.isnan("y") | F.col("x").isNull() | F.col("y").isNull()
    return knots.withColumn("x", F.when(bad, F.raise_error(F.lit("knots must be finite and ascend strictly")).cast("double")).otherwise(F.col("x").cast("double")))


def interp1d(knots: DataFrame, queries: DataFrame, keys: list[str], method: str = "linear", extrapolate: bool = False, query_key: str = "qid") -> DataFrame:
    """knots (keys, x, y), queries (keys, query_key, q) -> (keys, query_key, q, v).

    NaN for a NaN query, in a series without knots, and beyond the knots; with extrapolate the end's value there (nearest,
    previous, next) or its line or polynomial. nearest takes the lower knot of two at one distance.
    """
    method = method_of(method)
    if method == "cubic":
        knots = with_second_derivatives(knots, keys)
    m = F.col("m") if method == "cubic" else F.lit(0.0)
    one = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), m.alias("m"))
    series = Window.partitionBy(*keys).orderBy("_at", "_kind")
    # a knot carries the interval that begins at it, the last one that which ends at it
    k = knots.select(*keys, F.col("x").cast("double").alias("_at"), F.lit(0).alias("_kind"), one.alias("_knot"))
    after, before = F.lead("_knot").over(series), F.lag("_knot").over(series)
    k = k.withColumn("_from", F.when(after.isNull(), F.coalesce(before, "_knot")).otherwise(F.col("_knot"))).withColumn("_to", F.coalesce(after, "_knot"))
    k = k.select(*keys, "_at", "_kind", F.struct("_knot", "_from", "_to").alias("_k"))
    fields = {f.name: f.dataType.simpleString() for f in queries.schema}
    k = k.withColumn(query_key, F.lit(None).cast(fields[query_key]))
    q = queries.select(*keys, F.col("q").cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(k.schema["_k"].dataType).alias("_k"), query_key)
    down = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_kind")
    both = k.unionByName(q).select(
        "*",
        F.last("_k", True).over(series.rowsBetween(Window.unboundedPreceding, 0)).alias("_p"),
        F.last("_k", True).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("_n"),
    )
    t, p, n = F.col("_at"), F.col("_p"), F.col("_n")
    if method == "previous":
        v = F.coalesce(p["_knot"]["y"], n["_knot"]["y"])
    elif method == "next":
        v = F.coalesce(n["_knot"]["y"], p["_knot"]["y"])
    elif method == "nearest":
        lower = n.isNull() | (t - p["_knot"]["x"] <= n["_knot"]["x"] - t)
        v = F.when(p.isNotNull() & lower, p["_knot"]["y"]).otherwise(n["_knot"]["y"])
    else:
        a, b = F.coalesce(p["_from"], n["_from"]), F.coalesce(p["_to"], n["_to"])
        h = b["x"] - a["x"]
        r = (t - a["x"]) / F.when(h > 0, h)
        if method == "linear":
            curve = a["y"] + r * (b["y"] - a["y"])
        else:
            s = (b["x"] - t) / F.when(h > 0, h)
            curve = s * a["y"] + r * b["y"] + ((s * s * s - s) * a["m"] + (r * r * r - r) * b["m"]) * h * h / 6
        v = F.coalesce(curve, a["y"])
    nan = F.lit(float("nan"))
    defined = (p.isNotNull() & n.isNotNull()) | (F.lit(extrapolate) & (p.isNotNull() | n.isNotNull()))
    out = F.when(defined & ~F.isnan(t), v).otherwise(nan)
    return both.where("_kind = 1").select(*keys, query_key, t.alias("q"), F.coalesce(out, nan).alias("v"))

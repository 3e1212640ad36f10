"""Columns with IEEE semantics. Undefined is NaN, never null; Spark's own operators differ for zero divisors, logs, NaN and nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def num(x) -> Column:
    """A number or column as DOUBLE; null becomes NaN."""
    c = x if isinstance(x, Column) else F.lit(float(x))
    return F.coalesce(c.cast("double"), F.lit(NAN))


def div(a: Column, b: Column) -> Column:
    """a / b with +-inf and NaN for a zero divisor."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def ln(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.log(x))


def log10(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.log10(x))


def compare(op: str, a: Column, b: Column) -> Column:
    """1.0 or 0.0; a comparison with NaN is false, but != is true."""
    test = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.when(F.isnan(a) | F.isnan(b), F.lit(1.0 if op == "!=" else 0.0)).otherwise(F.when(test, F.lit(1.0)).otherwise(F.lit(0.0)))


def minimum(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))


def clip(x: Column, low: Column, high: Column) -> Column:
    return minimum(maximum(x, low), high)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def truthy(x: Column) -> Column:
    """Finite and not zero."""
    return is_finite(x) & (x != 0)


def choose(test: Column, a: Column, b: Column) -> Column:
    return F.when(truthy(test), a).otherwise(b)


def at_scale(x: Column, digits: int = 6) -> Column:
    """A number cut to so many decimals by plain arithmetic, which other SQL engines repeat exactly."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)

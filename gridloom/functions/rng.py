"""Seeded draws that do not depend on partitioning.

A draw is a function of (seed, stream, number): the first 52 bits of the MD5 of their text. So a column of draws is the same
however the rows are dealt out, and other SQL engines compute the same. The normal distribution function is Hart's rational
approximation (G. West, 2005), its inverse Wichura's AS 241; both are plain arithmetic, so they stay in generated code.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument

# Wichura, Algorithm AS 241, PPND16; from the highest power down.
CENTRE_TOP = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
CENTRE_BELOW = (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
MIDDLE_TOP = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
MIDDLE_BELOW = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
FAR_TOP = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
FAR_BELOW = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)
# Hart's algorithm 5666 in West, "Better approximations to cumulative normal functions".
HART_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BELOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _polynomial(x: Column, coefficients) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def normal_inverse(p: Column) -> Column:
    """The standard normal quantile; -inf at 0, inf at 1, NaN outside."""
    q = p - F.lit(0.5)
    r = F.lit(0.180625) - q * q
    centre = q * _polynomial(r, CENTRE_TOP) / _polynomial(r, CENTRE_BELOW)
    tail = F.when(q < 0, p).otherwise(F.lit(1.0) - p)
    s = F.sqrt(-F.log(F.when(tail > 0, tail).otherwise(F.lit(0.5))))
    middle = _polynomial(s - F.lit(1.6), MIDDLE_TOP) / _polynomial(s - F.lit(1.6), MIDDLE_BELOW)
    far = _polynomial(s - F.lit(5.0), FAR_TOP) / _polynomial(s - F.lit(5.0), FAR_BELOW)
    outer = F.when(s <= 5.0, middle).otherwise(far)
    inside = F.when(F.abs(q) <= 0.425, centre).when(q < 0, -outer).otherwise(outer)
    return F.when(F.isnan(p) | (p < 0) | (p > 1), F.lit(math.nan)).when(p == 0, F.lit(-math.inf)).when(p == 1, F.lit(math.inf)).otherwise(inside)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function."""
    a = F.abs(x)
    e = F.exp(-a * a / F.lit(2.0))
    near = e * _polynomial(a, HART_TOP) / _polynomial(a, HART_BELOW)
    b = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + F.lit(k) / b
    far = e / b / F.lit(2.506628274631)
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def uniform(seed, stream, k) -> Column:
    """A number in [0, 1) from seed, stream and number; each a constant or a column."""
    parts = [x if isinstance(x, Column) else F.lit(str(x)) for x in (seed, stream, k)]
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def uniform_at(seed, stream, k) -> float:
    """The same number in Python."""
    return int(hashlib.md5(f"{seed}:{stream}:{k}".encode()).hexdigest()[:13], 16) / 2**52


def open_uniform(seed, stream, k) -> Column:
    """A number in (0, 1), for quantile functions."""
    return uniform(seed, stream, k) + F.lit(2.0**-54)


def mix_seed(seed: int, stream: int) -> int:
    """A seed for a stream of its own: the SplitMix64 finaliser, in Python as its products exceed a long."""
    z = (seed + (stream + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return z ^ (z >> 31)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidArgument(what)


@dataclass(frozen=True)
class Sampler:
    """A distribution as a column of draws; see the class methods."""

    kind: str
    parameters: tuple[float, ...]
    limits: tuple[float, float] | None = None

    @classmethod
    def uniform(cls, low: float, high: float) -> Sampler:
        _need(math.isfinite(low) and math.isfinite(high) and low < high, "uniform needs finite low < high")
        return cls("uniform", (low, high))

    @classmethod
    def normal(cls, mean: float, sd: float) -> Sampler:
        _need(math.isfinite(mean) and math.isfinite(sd) and sd >= 0, "normal needs finite mean, sd >= 0")
        return cls("normal", (mean, sd))

    @classmethod
    def lognormal(cls, mu: float, sigma: float) -> Sampler:
        """mu and sigma of the logarithm."""
        _need(math.isfinite(mu) and math.isfinite(sigma) and sigma >= 0, "lognormal needs finite mu, sigma >= 0")
        return cls("lognormal", (mu, sigma))

    @classmethod
    def triangular(cls, low: float, mode: float, high: float) -> Sampler:
        _need(all(map(math.isfinite, (low, mode, high))) and low <= mode <= high and low < high, "triangular needs low <= mode <= high, low < high")
        return cls("triangular", (low, mode, high))

    @classmethod
    def truncated_normal(cls, mean: float, sd: float, low: float, high: float) -> Sampler:
        _need(all(map(math.isfinite, (mean, sd, low, high))) and sd > 0 and low < high, "truncated normal needs sd > 0, low < high")
        return cls("truncated_normal", (mean, sd, low, high))

    def clamped(self, low: float, high: float) -> Sampler:
        _need(low <= high, "clamped needs low <= high")
        return Sampler(self.kind, self.parameters, (low, high))

    def column(self, u: Column) -> Column:
        """The quantile at u in (0, 1)."""
        p = [F.lit(float(x)) for x in self.parameters]
        if self.kind == "uniform":
            out = p[0] + u * (p[1] - p[0])
        elif self.kind == "normal":
            out = p[0] + p[1] * normal_inverse(u)
        elif self.kind == "lognormal":
            out = F.exp(p[0] + p[1] * normal_inverse(u))
        elif self.kind == "triangular":
            a, c, b = self.parameters
            cut = (c - a) / (b - a)
            out = F.when(u < cut, p[0] + F.sqrt(u * F.lit((b - a) * (c - a)))).otherwise(p[2] - F.sqrt((F.lit(1.0) - u) * F.lit((b - a) * (b - c))))
        else:
            mean, sd, low, high = self.parameters
            a, b = normal_cdf(F.lit((low - mean) / sd)), normal_cdf(F.lit((high - mean) / sd))
            drawn = F.least(F.greatest(p[0] + p[1] * normal_inverse(a + u * (b - a)), p[2]), p[3])
            out = F.when(b <= a, F.lit(min(max(mean, low), high))).otherwise(drawn)
        if self.limits:
            out = F.least(F.greatest(out, F.lit(float(self.limits[0]))), F.lit(float(self.limits[1])))
        return out

    def draw(self, seed, stream, k) -> Column:
        return self.column(open_uniform(seed, stream, k))

    def sample_n(self, spark: SparkSession, n: int, seed: int, stream: str = "s") -> DataFrame:
        """(k, v): n draws."""
        return spark.range(n).select(F.col("id").alias("k"), self.draw(seed, stream, F.col("id")).alias("v"))

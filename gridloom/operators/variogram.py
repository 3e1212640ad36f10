"""Variograms: models as columns, experimental ones as a binned self-join, fits as one aggregation over candidate ranges."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from . import spatial

MODELS = {"nugget": "nugget", "spherical": "spherical", "sph": "spherical", "exponential": "exponential", "exp": "exponential", "gaussian": "gaussian", "gauss": "gaussian"}


def model_of(name: str) -> str:
    try:
        return MODELS[name.strip().lower()]
    except KeyError:
        raise InvalidArgument(f"unknown variogram model {name!r}") from None


def structure(model: str, r: Column) -> Column:
    """The unit structure at distance / range."""
    if model == "nugget":
        return F.lit(0.0)
    if model == "spherical":
        return F.when(r >= 1, F.lit(1.0)).otherwise(1.5 * r - 0.5 * r * r * r)
    if model == "exponential":
        return 1 - F.exp(-3.0 * r)
    return 1 - F.exp(-3.0 * r * r)


@dataclass(frozen=True)
class Variogram:
    model: str
    nugget: float
    sill: float
    range: float

    def __post_init__(self):
        object.__setattr__(self, "model", model_of(self.model))
        if not all(map(math.isfinite, (self.nugget, self.sill, self.range))) or self.nugget < 0 or self.sill < 0 or self.range <= 0:
            raise InvalidArgument("a variogram needs finite nugget >= 0, sill >= 0 and range > 0")

    @property
    def total_sill(self) -> float:
        return self.nugget + self.sill

    def gamma(self, h: Column) -> Column:
        """0 at no distance."""
        return F.when(h <= 0, F.lit(0.0)).otherwise(self.nugget + (F.lit(0.0) if self.model == "nugget" else self.sill * structure(self.model, h / self.range)))

    def gamma_np(self, h):
        import numpy as np

        r = h / self.range
        if self.model == "nugget":
            s = np.zeros_like(r)
        elif self.model == "spherical":
            s = np.where(r >= 1, 1.0, 1.5 * r - 0.5 * r**3)
        elif self.model == "exponential":
            s = 1 - np.exp(-3 * r)
        else:
            s = 1 - np.exp(-3 * r * r)
        return np.where(h <= 0, 0.0, self.nugget + (0.0 if self.model == "nugget" else self.sill) * s)

    def between(self, dx, dy):
        """gamma of an offset, in numpy."""
        import numpy as np

        return self.gamma_np(np.hypot(dx, dy))


@dataclass(frozen=True)
class AnisotropicVariogram:
    """Ranges along the azimuth (clockwise from north), across it and vertically."""

    model: str
    nugget: float
    sill: float
    major: float
    minor: float
    vertical: float
    azimuth: float = 0.0

    def __post_init__(self):
        object.__setattr__(self, "model", model_of(self.model))
        if not all(map(math.isfinite, (self.nugget, self.sill, self.major, self.minor, self.vertical, self.azimuth))) or min(self.nugget, self.sill) < 0 or min(self.major, self.minor, self.vertical) <= 0:
            raise InvalidArgument("an anisotropic variogram needs finite values, nugget and sill >= 0 and ranges > 0")
        object.__setattr__(self, "azimuth", self.azimuth % 360)

    @classmethod
    def isotropic(cls, v: Variogram) -> AnisotropicVariogram:
        return cls(v.model, v.nugget, v.sill, v.range, v.range, v.range)

    @property
    def total_sill(self) -> float:
        return self.nugget + self.sill

    def _along_across(self, dx, dy):
        a = math.radians(self.azimuth)
        s, c = math.sin(a), math.cos(a)
        return dx * s + dy * c, dx * c - dy * s

    def distance(self, dx: Column, dy: Column, dz: Column | None = None) -> Column:
        """Distance in units of the ranges."""
        along, across = self._along_across(dx, dy)
        d2 = (along / self.major) * (along / self.major) + (across / self.minor) * (across / self.minor)
        if dz is not None:
            d2 = d2 + (dz / self.vertical) * (dz / self.vertical)
        return F.sqrt(d2)

    def gamma_offset(self, dx: Column, dy: Column, dz: Column | None = None) -> Column:
        return Variogram(self.model, self.nugget, self.sill, 1.0).gamma(self.distance(dx, dy, dz))

    def between(self, dx, dy):
        import numpy as np

        along, across = self._along_across(dx, dy)
        return Variogram(self.model, self.nugget, self.sill, 1.0).gamma_np(np.hypot(along / self.major, across / self.minor))


def experimental(points: DataFrame, lag: float, n_lags: int) -> DataFrame:
    """(bin, lag, gamma, n): mean distance, half the mean squared difference and number of the pairs of each bin that has some.

    Pairs at n_lags * lag or beyond are left out; the pairs are found by cells, and summed up where they are found.
    """
    if not (math.isfinite(lag) and lag > 0) or n_lags < 1:
        raise InvalidArgument("lag must be positive and finite, n_lags at least 1")
    pairs = spatial.pairs_within(points.select("pid", "x", "y", "z"), lag * n_lags)
    dz = F.col("a.z") - F.col("b.z")
    bin_ = F.least(F.floor(F.col("h") / lag), F.lit(n_lags - 1)).cast("int")
    sums = pairs.groupBy(bin_.alias("bin")).agg(F.avg("h").alias("lag"), (F.sum(dz * dz) / (2 * F.count("*"))).alias("gamma"), F.count("*").alias("n"))
    return sums.select("bin", "lag", "gamma", "n")


def _candidates(sums: DataFrame) -> DataFrame:
    """Sums of a range's weighted regression of gamma on the structure -> its best (c0, c), both not negative, and error."""
    det = F.col("sw") * F.col("swgg") - F.col("swg") * F.col("swg")
    free = F.struct(((F.col("swy") * F.col("swgg") - F.col("swg") * F.col("swgy")) / F.when(F.abs(det) > 1e-300, det)).alias("c0"), ((F.col("sw") * F.col("swgy") - F.col("swg") * F.col("swy")) / F.when(F.abs(det) > 1e-300, det)).alias("c"))
    no_nugget = F.struct(F.lit(0.0).alias("c0"), (F.col("swgy") / F.when(F.col("swgg") > 0, F.col("swgg"))).alias("c"))
    flat = F.struct((F.col("swy") / F.when(F.col("sw") > 0, F.col("sw"))).alias("c0"), F.lit(0.0).alias("c"))
    zero = F.struct(F.lit(0.0).alias("c0"), F.lit(0.0).alias("c"))
    rows = sums.select("*", F.posexplode(F.array(free, no_nugget, flat, zero)).alias("_k", "_c")).where("_c.c0 is not null and _c.c is not null and _c.c0 >= -1e-12 and _c.c >= -1e-12")
    c0, c = F.greatest("_c.c0", F.lit(0.0)), F.greatest("_c.c", F.lit(0.0))
    error = F.col("swyy") + c0 * c0 * F.col("sw") + c * c * F.col("swgg") + 2 * c0 * c * F.col("swg") - 2 * c0 * F.col("swy") - 2 * c * F.col("swgy")
    return rows.select("step", "range", c0.alias("c0"), c.alias("c"), F.greatest(error, F.lit(0.0)).alias("sse"), "_k")


def sweep(exp: DataFrame, model: str, low: float, high: float, steps: int) -> tuple[float, float, float, float]:
    """(range, nugget, sill, error) of the best of `steps` ranges: ranges x bins, five sums a range, one row back."""
    spark = exp.sparkSession
    ranges = spark.range(steps).select(F.col("id").alias("step"), (F.lit(low) + F.lit(high - low) * F.col("id") / (max(steps, 2) - 1)).alias("range")).where("range > 0")
    g = structure(model, F.col("lag") / F.col("range"))
    rows = exp.select("lag", "gamma", F.col("n").cast("double").alias("w")).join(ranges).select("step", "range", "w", g.alias("g"), F.col("gamma").alias("y"))
    w, gg, y = F.col("w"), F.col("g"), F.col("y")
    sums = rows.groupBy("step", "range").agg(F.sum(w).alias("sw"), F.sum(w * gg).alias("swg"), F.sum(w * gg * gg).alias("swgg"), F.sum(w * y).alias("swy"), F.sum(w * gg * y).alias("swgy"), F.sum(w * y * y).alias("swyy"))
    best = _candidates(sums).agg(F.min_by(F.struct("range", "c0", "c", "sse"), F.struct("sse", "step", "_k"))).first()[0]
    return best["range"], best["c0"], best["c"], best["sse"]


def fit(exp: DataFrame, model: str) -> Variogram:
    """The least squares fit, bins weighed by their pairs: 400 ranges, then 100 around the best."""
    model = model_of(model)
    top = exp.agg(F.max("lag"), F.sum(F.col("n") * F.col("gamma")) / F.sum("n")).first()
    if top[0] is None:
        raise InvalidArgument("an empty experimental variogram has no fit")
    if model == "nugget":
        return Variogram("nugget", top[1], 0.0, max(top[0], 1.0))
    low, high = top[0] / 50, top[0] * 2
    coarse = sweep(exp, model, low, high, 400)
    step = (high - low) / 399
    fine = sweep(exp, model, max(coarse[0] - step, top[0] / 100), coarse[0] + step, 100)
    best = fine if fine[3] < coarse[3] else coarse
    return Variogram(model, best[1], best[2], max(best[0], 1e-9))

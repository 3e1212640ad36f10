"""Synthetic logs, facies, petrophysics, surfaces, wells and outlines.

White noise is a column of counter-based draws, so it is the same under any partitioning. Only the autoregression needs a
series in order; it is a kernel for each series. All else is projections, windows and joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EmptyInput, InvalidArgument
from ..functions.lattice import Lattice
from ..functions.rng import mix_seed, normal_cdf, normal_inverse, open_uniform, uniform
from .simulate import NormalScore, sgs_unconditional_np
from .spatial import in_polygon
from .variogram import Variogram

NET_CUTOFF = 0.10
SAND, SHALE = 1, 0
NODES = 256
STANDARD = NormalDist()


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidArgument(what)


def _positive(x: float) -> bool:
    return math.isfinite(x) and x > 0


# --- series ---------------------------------------------------------------------------------------------------------------


def ar1_phi(step, length):
    """The lag-one correlation of samples `step` apart with this correlation length; 0 for a length that is not positive."""
    if isinstance(length, Column) or isinstance(step, Column):
        length = length if isinstance(length, Column) else F.lit(float(length))
        return F.when((length > 0) & (length < float("inf")), F.exp(-step / length)).otherwise(0.0)
    return math.exp(-step / length) if _positive(length) else 0.0


def correlated_np(noise: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """z[0] = noise[0], then phi * z before + sqrt(1 - phi ** 2) * noise."""
    out = np.empty(len(noise))
    z = 0.0
    fresh = np.sqrt(np.maximum(1 - phi * phi, 0)) * noise
    for k in range(len(noise)):
        z = noise[0] if k == 0 else phi[k] * z + fresh[k]
        out[k] = z
    return out


def correlated_gaussian(rows: DataFrame, keys: list[str], k: str, phi: Column, seed, stream: str = "ar") -> DataFrame:
    """rows with z: a standard normal series in order of k for each key, whose lag-one correlation at a row is phi."""
    noisy = rows.withColumn("_e", normal_inverse(open_uniform(seed, F.concat_ws("/", F.lit(stream), *keys), F.col(k)))).withColumn("_phi", phi.cast("double"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(k)
        part["z"] = correlated_np(part["_e"].to_numpy(float), part["_phi"].to_numpy(float))
        return part.drop(columns=["_e", "_phi"])

    return noisy.groupBy(*keys).applyInPandas(run, ", ".join([*fields, "z double"]))


def lag1_autocorrelation(df: DataFrame, keys: list[str], k: str, value: str) -> DataFrame:
    mean = F.avg(value).over(Window.partitionBy(*keys))
    rows = df.select(*keys, k, (F.col(value) - mean).alias("_d"))
    rows = rows.withColumn("_n", F.lead("_d").over(Window.partitionBy(*keys).orderBy(k)))
    return rows.groupBy(*keys).agg((F.sum(F.col("_d") * F.col("_n")) / F.sum(F.col("_d") * F.col("_d"))).alias("r1"))


# --- logit-normal transform -----------------------------------------------------------------------------------------------


def logistic(x):
    if isinstance(x, Column):
        return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


_quantiles = np.array([STANDARD.inv_cdf((k + 0.5) / NODES) for k in range(NODES)])


@dataclass(frozen=True)
class LogitNormal:
    """logistic(a + b z) of a standard normal z."""

    a: float
    b: float

    @classmethod
    def match(cls, mean: float, std: float) -> LogitNormal:
        """With this mean and deviation, by two nested bisections over NODES quantiles."""
        _need(math.isfinite(mean) and math.isfinite(std) and 0 < mean < 1 and std > 0, "need 0 < mean < 1 and std > 0")
        _need(std * std < mean * (1 - mean), f"std {std} is too large for mean {mean}: it must be below {math.sqrt(mean * (1 - mean)):.5f}")

        def centre(b: float) -> float:
            low, high = -40.0, 40.0
            for _ in range(80):
                a = (low + high) / 2
                low, high = (a, high) if logistic(a + b * _quantiles).mean() < mean else (low, a)
            return (low + high) / 2

        low, high = 1e-6, 60.0
        for _ in range(80):
            b = (low + high) / 2
            low, high = (b, high) if logistic(centre(b) + b * _quantiles).var() < std * std else (low, b)
        b = (low + high) / 2
        return cls(centre(b), b)

    def apply(self, z):
        return logistic(self.a + self.b * z)

    def lerp(self, other: LogitNormal, t: float) -> LogitNormal:
        t = min(max(t, 0.0), 1.0)
        return LogitNormal(self.a + (other.a - self.a) * t, self.b + (other.b - self.b) * t)


@dataclass(frozen=True)
class ZoneSpec:
    thickness_m: float
    mean: float
    std: float
    corr_length_m: float

    def __post_init__(self):
        _need(_positive(self.thickness_m) and _positive(self.corr_length_m), "a zone needs thickness and correlation length > 0")
        LogitNormal.match(self.mean, self.std)


def zone_sample_counts(zones: list[ZoneSpec], step: float) -> list[int]:
    return [max(1, math.floor(z.thickness_m / step + 0.5)) for z in zones]


def log_series(spark: SparkSession, zones: list[ZoneSpec], step: float, transition_beds: int, seed: int, wells: int = 1) -> DataFrame:
    """(well, k, zone, v): a curve through the zones for each well; within transition_beds of a boundary the transform goes over from one zone's to the next's."""
    if not zones:
        raise EmptyInput("no zones")
    _need(_positive(step), "the step must be > 0")
    counts = zone_sample_counts(zones, step)
    starts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    fits = [LogitNormal.match(z.mean, z.std) for z in zones]
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("zone") + 1)
    k = F.col("k")
    zone = F.lit(0)
    for s in starts[1:-1]:
        zone = zone + F.when(k >= s, 1).otherwise(0)
    rows = spark.range(wells * starts[-1]).select(F.floor(F.col("id") / starts[-1]).cast("int").alias("well"), (F.col("id") % starts[-1]).alias("k")).withColumn("zone", zone)
    rows = correlated_gaussian(rows, ["well"], "k", pick([ar1_phi(step, z.corr_length_m) for z in zones]), seed, "log")
    a, b = pick([f.a for f in fits]), pick([f.b for f in fits])
    for n in range(1, len(zones) if transition_beds > 0 else 0):
        low, high = max(0, starts[n] - transition_beds), min(starts[-1], starts[n] + transition_beds)
        within, t = (k >= low) & (k < high), (k - low) / (high - low)
        a = F.when(within, fits[n - 1].a + (fits[n].a - fits[n - 1].a) * t).otherwise(a)
        b = F.when(within, fits[n - 1].b + (fits[n].b - fits[n - 1].b) * t).otherwise(b)
    return rows.select("well", "k", "zone", logistic(a + b * F.col("z")).alias("v"))


def facies_series(spark: SparkSession, n: int, step: float, ntg: float, bed_scale_m: float, seed: int, wells: int = 1) -> DataFrame:
    """(well, k, facies): sand (1) where a correlated series exceeds the quantile of 1 - ntg, else shale (0)."""
    if n == 0:
        raise EmptyInput("no samples")
    _need(_positive(step) and _positive(bed_scale_m), "step and bed scale must be > 0")
    _need(0 < ntg < 1, "need 0 < ntg < 1")
    rows = spark.range(wells * n).select(F.floor(F.col("id") / n).cast("int").alias("well"), (F.col("id") % n).alias("k"))
    z = correlated_gaussian(rows, ["well"], "k", F.lit(ar1_phi(step, bed_scale_m)), seed, "facies")
    return z.select("well", "k", F.when(F.col("z") > STANDARD.inv_cdf(1 - ntg), SAND).otherwise(SHALE).alias("facies"))


def por_with_facies(facies: DataFrame, step: float, sand: tuple[float, float], shale: tuple[float, float], corr_length_m: float, seed: int) -> DataFrame:
    """facies with por: porosities of the facies' mean and deviation, from a stream of their own."""
    _need(_positive(step) and _positive(corr_length_m), "step and correlation length must be > 0")
    return _porosity(facies, LogitNormal.match(*sand), LogitNormal.match(*shale), step, corr_length_m, seed).withColumnRenamed("_por", "por")


def _porosity(facies: DataFrame, sand: LogitNormal, shale: LogitNormal, step: float, length: float, seed: int) -> DataFrame:
    z = correlated_gaussian(facies, ["well"], "k", F.lit(ar1_phi(step, length)), mix_seed(seed, 1), "por")
    return z.withColumn("_por", F.when(F.col("facies") == SAND, sand.apply(F.col("z"))).otherwise(shale.apply(F.col("z")))).drop("z")


@dataclass(frozen=True)
class PetroZoneSpec:
    """Targets: net-to-gross, and (mean, deviation) of net and non-net porosity."""

    ntg: float
    net_por: tuple[float, float]
    nonnet_por: tuple[float, float]
    bed_scale_m: float
    corr_length_m: float
    cutoff: float = NET_CUTOFF

    def __post_init__(self):
        _need(0 < self.cutoff < 1 and 0 < self.ntg < 1, "need 0 < cutoff < 1 and 0 < ntg < 1")
        _need(_positive(self.bed_scale_m) and _positive(self.corr_length_m), "bed scale and correlation length must be > 0")
        LogitNormal.match(*self.net_por)
        LogitNormal.match(*self.nonnet_por)


def exceedance_moments(f: LogitNormal, cutoff: float) -> tuple[float, float, float]:
    """P(x >= cutoff) and the parts of the first and second moment above it, by Simpson's rule up to 8 deviations."""
    z = (math.log(cutoff / (1 - cutoff)) - f.a) / f.b
    p = 1 - STANDARD.cdf(z)
    low = max(z, -8.0)
    if low >= 8:
        return p, 0.0, 0.0
    at = np.linspace(low, 8, 2001)
    w = np.where(np.arange(2001) % 2 == 1, 4.0, 2.0)
    w[[0, -1]] = 1
    w = w * np.exp(-at * at / 2) / math.sqrt(2 * math.pi) * (at[1] - at[0]) / 3
    x = f.apply(at)
    return p, float((w * x).sum()), float((w * x * x).sum())


def _net(sand: LogitNormal, shale: tuple[float, float, float], cutoff: float, ntg: float) -> tuple[float, float, float]:
    """Of a mix of sand and shale (its moments beyond the cutoff) whose part beyond the cutoff is ntg: the sand fraction, and the
    mean and deviation of what lies beyond."""
    p, q, r = exceedance_moments(sand, cutoff)
    fraction = (ntg - shale[0]) / (p - shale[0])
    mean = (fraction * q + (1 - fraction) * shale[1]) / ntg
    return fraction, mean, math.sqrt(max((fraction * r + (1 - fraction) * shale[2]) / ntg - mean * mean, 0.0))


def calibrate(spec: PetroZoneSpec) -> tuple[float, LogitNormal, LogitNormal]:
    """Sand fraction, sand and shale transforms that meet the targets of net rock.

    The net-to-gross gives the sand fraction for any sand, which leaves its location a and scale b. For a given b the net mean
    rises with a, from where all rock is sand; so a follows from the mean by bisection, and then b from the net deviation, which
    rises with b along those a.
    """
    shale = LogitNormal.match(*spec.nonnet_por)
    beyond = exceedance_moments(shale, spec.cutoff)
    _need(spec.ntg > beyond[0], f"ntg {spec.ntg} is not above {beyond[0]:.4f}, the part of shale beyond the cutoff")
    mean, sd = spec.net_por
    edge, deviate = math.log(spec.cutoff / (1 - spec.cutoff)), STANDARD.inv_cdf(spec.ntg)
    net = lambda a, b: _net(LogitNormal(a, b), beyond, spec.cutoff, spec.ntg)

    def location(b: float) -> float | None:
        """The a that meets the mean; None where all rock would be sand and the mean still too high."""
        low = edge + b * deviate
        low += 1e-9 * (1 + abs(low))
        if net(low, b)[1] > mean:
            return None
        high = low + 1.0
        while net(high, b)[1] < mean:
            _need(high < 60, f"the net mean {mean} cannot be reached at ntg {spec.ntg}")
            high += 2 * (high - low)
        for _ in range(80):
            middle = (low + high) / 2
            if middle in (low, high):
                break
            low, high = (middle, high) if net(middle, b)[1] < mean else (low, middle)
        return (low + high) / 2

    def too_wide(b: float) -> bool:
        a = location(b)
        return a is None or net(a, b)[2] > sd

    narrow, wide = 1e-3, 1.0
    _need(location(narrow) is not None, f"the net mean {mean} cannot be reached at ntg {spec.ntg}")
    _need(not too_wide(narrow), f"the net deviation {sd} is below what the shale beyond the cutoff makes alone")
    while not too_wide(wide):
        narrow, wide = wide, 2 * wide
        _need(wide <= 64, f"the net deviation {sd} cannot be reached")
    for _ in range(60):
        middle = (narrow + wide) / 2
        narrow, wide = (narrow, middle) if too_wide(middle) else (middle, wide)
    a = location(narrow)
    _need(a is not None, "the targets could not be met")
    fraction, found_mean, found_sd = net(a, narrow)
    _need(max(abs(found_mean - mean), abs(found_sd - sd)) < 1e-7 and 0 < fraction < 1, "the targets could not be met")
    return fraction, LogitNormal(a, narrow), shale


def petro_curves(spark: SparkSession, spec: PetroZoneSpec, step: float, n: int, seed: int, wells: int = 1) -> DataFrame:
    """(well, k, phie, net_flag): net_flag is phie >= cutoff."""
    fraction, sand, shale = calibrate(spec)
    facies = facies_series(spark, n, step, fraction, spec.bed_scale_m, seed, wells)
    por = _porosity(facies, sand, shale, step, spec.corr_length_m, seed)
    return por.select("well", "k", F.col("_por").alias("phie"), (F.col("_por") >= spec.cutoff).alias("net_flag"))


def ntg_curve(df: DataFrame, keys: list[str], k: str, flag: Column, step: float, window_m: float) -> DataFrame:
    """df with ntg: the mean flag of the rows within half a window either side, fewer at the ends."""
    _need(_positive(step) and _positive(window_m), "step and window must be > 0")
    half = max(1, math.floor(window_m / step + 0.5) // 2)
    return df.withColumn("ntg", F.avg(flag.cast("int")).over(Window.partitionBy(*keys).orderBy(k).rowsBetween(-half, half)))


# --- surfaces -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NoiseSpec:
    variance: float
    variogram: Variogram

    def __post_init__(self):
        _need(math.isfinite(self.variance) and self.variance >= 0, "the variance must be finite and not negative")


def search_of(lattice: Lattice, v: Variogram) -> tuple[int, float]:
    """Neighbours and radius of the noise's simulation."""
    return 24, max(1.5 * v.range, 4 * max(abs(lattice.xinc), abs(lattice.yinc)))


def noise_field(seeds: DataFrame, lattice: Lattice, mean: float, variance: float, variogram: Variogram) -> DataFrame:
    """seeds (seed) -> (seed, i, j, v): a group for each seed."""
    most, radius = search_of(lattice, variogram)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = sgs_unconditional_np(lattice, variogram, mean, variance, most, radius, int(key[0]))
        i, j = np.divmod(np.arange(v.size), lattice.nrow)
        return pd.DataFrame({"seed": int(key[0]), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": v.ravel()})

    return seeds.select(F.col("seed").cast("long").alias("seed")).groupBy("seed").applyInPandas(run, "seed long, i int, j int, v double")


def dome_surface(spark: SparkSession, lattice: Lattice, relief: float, aspect: float, tilt: float, noise: NoiseSpec | None = None, seed: int = 0) -> DataFrame:
    """(i, j, v): a Gaussian bell at the centre, a plane rising by `tilt` from west to east, and noise."""
    _need(math.isfinite(relief) and math.isfinite(tilt) and _positive(aspect), "relief and tilt must be finite, aspect > 0")
    x0, y0, x1, y1 = lattice.bbox()
    tiny = 2.2250738585072014e-308
    sx, sy = max((x1 - x0) / 4 * math.sqrt(aspect), tiny), max((y1 - y0) / 4 / math.sqrt(aspect), tiny)
    dx, dy = (F.col("x") - (x0 + x1) / 2) / sx, (F.col("y") - (y0 + y1) / 2) / sy
    v = relief * F.exp(-0.5 * (dx * dx + dy * dy)) + tilt * ((F.col("x") - x0) / max(x1 - x0, tiny) - 0.5)
    rows = lattice.nodes(spark).select("i", "j", v.alias("v"))
    if noise is None or noise.variance == 0:
        return rows
    eps = noise_field(spark.range(1).select(F.lit(seed).alias("seed")), lattice, 0.0, noise.variance, noise.variogram).select("i", "j", F.col("v").alias("_e"))
    return rows.join(eps, ["i", "j"]).select("i", "j", (F.col("v") + F.col("_e")).alias("v"))


def isochore(seeds: DataFrame, lattice: Lattice, mean: float, variability: float, variogram: Variogram) -> DataFrame:
    """(seed, i, j, v): thicknesses, not below 0."""
    _need(math.isfinite(mean) and math.isfinite(variability) and variability >= 0, "mean must be finite, variability not negative")
    return noise_field(seeds, lattice, mean, variability**2, variogram).withColumn("v", F.greatest("v", F.lit(0.0)))


def trend_map(spark: SparkSession, lattice: Lattice, variogram: Variogram, seed: int, correlate_with: tuple[DataFrame, float] | None = None) -> DataFrame:
    """(i, j, v) in (0, 1): the normal distribution function of noise, or of noise mixed with the scores of a field (i, j, v)."""
    g = noise_field(spark.range(1).select(F.lit(seed).alias("seed")), lattice, 0.0, 1.0, variogram).select("i", "j", "v")
    if correlate_with is not None:
        field, rho = correlate_with
        _need(-1 <= rho <= 1, "the correlation must be in [-1, 1]")
        scores = NormalScore(np.array([r.v for r in field.where(~F.isnan("v")).select("v").collect()]))  # a field has as many values as the lattice
        values, knots = [float(x) for x in scores.values], [float(x) for x in scores.scores]
        table = spark.createDataFrame(list(zip(values, knots, strict=True)), "v double, _y double")
        y = field.join(table, "v", "left").select("i", "j", F.coalesce("_y", F.lit(0.0)).alias("_y"))
        g = g.join(y, ["i", "j"]).select("i", "j", (rho * F.col("_y") + math.sqrt(max(1 - rho * rho, 0.0)) * F.col("v")).alias("v"))
    return g.withColumn("v", normal_cdf(F.col("v")))


def stacked_surfaces(top: DataFrame, isochores: DataFrame) -> DataFrame:
    """top (i, j, v), isochores (ord, i, j, v) -> (ord, i, j, v): each base is the top plus the thicknesses down to it."""
    down = Window.partitionBy("i", "j").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    added = isochores.select("ord", "i", "j", F.sum(F.greatest("v", F.lit(0.0))).over(down).alias("_t"))
    return added.join(top, ["i", "j"]).select("ord", "i", "j", (F.col("v") + F.col("_t")).alias("v"))


def drape(surface: DataFrame, offset: float) -> DataFrame:
    return surface.withColumn("v", F.col("v") + offset)


def crest(surface: DataFrame) -> DataFrame:
    """The shallowest (smallest) node."""
    return surface.where(~F.isnan("v")).agg(F.min(F.struct("v", "i", "j")).alias("_m")).select("_m.i", "_m.j", "_m.v")


# --- wells ----------------------------------------------------------------------------------------------------------------


def place_wells(spark: SparkSession, n: int, box: tuple[float, float, float, float], seed: int) -> DataFrame:
    """(well, x, y) anywhere in the box."""
    k = F.col("id")
    u, v = uniform(seed, "wx", k), uniform(seed, "wy", k)
    return spark.range(n).select(k.alias("well"), (box[0] + u * (box[2] - box[0])).alias("x"), (box[1] + v * (box[3] - box[1])).alias("y"))


def place_wells_in_polygon(spark: SparkSession, n: int, ring: list[tuple[float, float]], seed: int) -> DataFrame:
    """The first n draws that lie in the ring, of at most max(10 000, 10 000 n); fails at run time if there are too few."""
    xs, ys = zip(*ring, strict=True)
    budget, tries = max(10_000, 10_000 * n), max(64, 8 * n)
    while True:
        drawn = place_wells(spark, min(tries, budget), (min(xs), min(ys), max(xs), max(ys)), seed).where(in_polygon(F.col("x"), F.col("y"), ring))
        if tries >= budget or drawn.limit(n).count() == n:
            break
        tries *= 8
    if drawn.limit(n).count() < n:
        raise InvalidArgument("the polygon is too small for its box to place these wells")
    chosen = drawn.orderBy("well").limit(n)  # n wells are asked for
    return chosen.withColumn("well", F.row_number().over(Window.orderBy("well")) - 1)


def tops_from_surface(wells: DataFrame, field: DataFrame, lattice: Lattice, residual_sd: float, seed: int) -> DataFrame:
    """(well, x, y, top): the field at each well (bilinear; NaN if a corner is) plus a residual drawn for the well."""
    corners = lattice.footprint(wells.select("well", "x", "y")).join(field.withColumnRenamed("v", "_v"), ["i", "j"])
    at = corners.groupBy("well", "x", "y").agg(F.sum(F.when(F.col("w") == 0, 0.0).otherwise(F.col("w") * F.col("_v"))).alias("_t"), F.count("*").alias("_n"))
    drawn = residual_sd * normal_inverse(open_uniform(seed, "top", F.col("well")))
    return wells.select("well", "x", "y").join(at.select("well", "_t", "_n"), "well", "left").select("well", "x", "y", (F.coalesce(F.when(F.col("_n") == 4, F.col("_t")), F.lit(float("nan"))) + drawn).alias("top"))


@dataclass(frozen=True)
class WellProfile:
    """Vertical, build and hold, or build, hold and drop; rates are degrees in 30 m."""

    kickoff_md: float | None = None
    build_rate: float = 0.0
    hold_incl: float = 0.0
    azimuth: float = 0.0
    drop_start_md: float | None = None
    drop_rate: float = 0.0
    final_incl: float = 0.0

    MOST_RATE = 30.0

    @classmethod
    def vertical(cls) -> WellProfile:
        return cls()

    @classmethod
    def build_hold(cls, kickoff_md: float, build_rate: float, hold_incl: float, azimuth: float) -> WellProfile:
        _need(math.isfinite(kickoff_md) and kickoff_md >= 0, "kickoff must be finite and not negative")
        _need(math.isfinite(build_rate) and 0 < build_rate <= cls.MOST_RATE, f"the build rate must be in (0, {cls.MOST_RATE}]")
        _need(math.isfinite(hold_incl) and 0 < hold_incl < 90, "the inclination must be in (0, 90)")
        _need(math.isfinite(azimuth), "the azimuth must be finite")
        return cls(kickoff_md, build_rate, hold_incl, azimuth % 360)

    @property
    def build_end(self) -> float:
        return self.kickoff_md + self.hold_incl / (self.build_rate / 30)

    def with_drop(self, drop_start_md: float, drop_rate: float, final_incl: float) -> WellProfile:
        _need(drop_start_md >= self.build_end, "the drop must start after the build")
        _need(0 < drop_rate <= self.MOST_RATE and 0 <= final_incl < self.hold_incl, "the drop needs a rate and a smaller inclination")
        return WellProfile(self.kickoff_md, self.build_rate, self.hold_incl, self.azimuth, drop_start_md, drop_rate, final_incl)

    def angles(self, md: Column) -> tuple[Column, Column]:
        """Inclination and azimuth at a measured depth, in degrees."""
        if self.kickoff_md is None:
            return F.lit(0.0), F.lit(0.0)
        incl = F.when(md <= self.kickoff_md, 0.0).when(md >= self.build_end, self.hold_incl).otherwise((md - self.kickoff_md) * (self.build_rate / 30))
        if self.drop_start_md is not None:
            rate = self.drop_rate / 30
            end = self.drop_start_md + (self.hold_incl - self.final_incl) / rate
            incl = F.when(md <= self.drop_start_md, incl).when(md >= end, self.final_incl).otherwise(self.hold_incl - (md - self.drop_start_md) * rate)
        return incl.cast("double"), F.when(md <= self.kickoff_md, 0.0).otherwise(self.azimuth).cast("double")


def stations(spark: SparkSession, td: float, step: float) -> DataFrame:
    """(seq, md): every step from 0, and the total depth."""
    _need(_positive(td) and _positive(step), "total depth and step must be > 0")
    n = math.floor(td / step)
    last = [] if abs(n * step - td) <= 1e-9 else [n + 1]
    k = F.col("id")
    return spark.range(n + 1 + len(last)).select(k.cast("int").alias("seq"), F.when(k <= n, k * F.lit(float(step))).otherwise(F.lit(float(td))).alias("md"))


def _radians(x: Column) -> Column:
    return x * F.lit(math.pi / 180)


def _dogleg(i1: Column, a1: Column, i2: Column, a2: Column) -> Column:
    c = F.cos(i1) * F.cos(i2) + F.sin(i1) * F.sin(i2) * F.cos(a2 - a1)
    return F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))


def trajectory(spark: SparkSession, head: tuple[float, float], kb: float, td: float, step: float, profile: WellProfile, well: int = 0) -> DataFrame:
    """(well, seq, md, x, y, z, tvd, incl, azim) by the minimum-curvature method: lag() and running sums along the well."""
    _need(all(map(math.isfinite, (*head, kb))), "wellhead and kb must be finite")
    incl, azim = profile.angles(F.col("md"))
    rows = stations(spark, td, step).select(F.lit(well).alias("well"), "seq", "md", incl.alias("incl"), azim.alias("azim"))
    along = Window.partitionBy("well").orderBy("seq")
    lag = lambda c: F.lag(c).over(along)
    i2, a2, i1, a1 = _radians(F.col("incl")), _radians(F.col("azim")), _radians(lag("incl")), _radians(lag("azim"))
    turn = _dogleg(i1, a1, i2, a2)
    half = (F.col("md") - lag("md")) / 2 * F.when(turn < 1e-9, F.lit(1.0)).otherwise(F.tan(turn / 2) / (turn / 2))
    steps = rows.select("*", (half * (F.sin(i1) * F.sin(a1) + F.sin(i2) * F.sin(a2))).alias("_e"), (half * (F.sin(i1) * F.cos(a1) + F.sin(i2) * F.cos(a2))).alias("_n"), (half * (F.cos(i1) + F.cos(i2))).alias("_v"))
    total = lambda c: F.coalesce(F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return steps.select("well", "seq", "md", (head[0] + total("_e")).alias("x"), (head[1] + total("_n")).alias("y"), (kb - total("_v")).alias("z"), total("_v").alias("tvd"), "incl", "azim")


def max_dogleg_severity(traj: DataFrame) -> DataFrame:
    """(well, dls): the strongest turn between stations, degrees in 30 m."""
    along = Window.partitionBy("well").orderBy("seq")
    lag = lambda c: F.lag(c).over(along)
    turn = _dogleg(_radians(lag("incl")), _radians(lag("azim")), _radians(F.col("incl")), _radians(F.col("azim")))
    rows = traj.select("well", turn.alias("_t"), (F.col("md") - lag("md")).alias("_d"))
    return rows.groupBy("well").agg(F.coalesce(F.max(F.when(F.col("_d") > 0, F.degrees("_t") / F.col("_d") * 30)), F.lit(0.0)).alias("dls"))


def first_crossing(traj: DataFrame, depth: DataFrame) -> DataFrame:
    """traj (well, seq, md, z), depth (well, seq, surface z) -> (well, md): where the bore first goes through, between stations."""
    along = Window.partitionBy("well").orderBy("seq")
    rows = traj.join(depth, ["well", "seq"]).select("well", "seq", "md", (F.col("z") - F.col("surface")).alias("_d"))
    rows = rows.select("*", F.lag("_d").over(along).alias("_d0"), F.lag("md").over(along).alias("_md0")).where("_d0 > 0 and _d <= 0 or seq = 0 and _d = 0")
    at = F.when(F.col("_d0").isNull(), F.col("md")).otherwise(F.col("_md0") + (F.col("md") - F.col("_md0")) * F.col("_d0") / (F.col("_d0") - F.col("_d")))
    return rows.groupBy("well").agg(F.min_by(at, "seq").alias("md"))


def zone_of(samples: DataFrame, zones: DataFrame, depth: str) -> DataFrame:
    """samples (well, depth), zones (well, zone, top, base) -> samples with zone: top <= depth < base; null beyond."""
    s, z = samples.alias("s"), zones.alias("z")
    return s.join(z, (F.col("s.well") == F.col("z.well")) & (F.col(f"s.{depth}") >= F.col("z.top")) & (F.col(f"s.{depth}") < F.col("z.base")), "left").select("s.*", "z.zone")


# --- outlines -------------------------------------------------------------------------------------------------------------

#: Which edges a level crosses in a cell, by the corners above it (1 bottom left, 2 bottom right, 4 top right, 8 top left).
CELL_EDGES = {1: "lb", 2: "br", 3: "lr", 4: "rt", 5: "lb rt", 6: "bt", 7: "tl", 8: "tl", 9: "bt", 10: "br tl", 11: "rt", 12: "lr", 13: "br", 14: "lb"}


def contour_segments(field: DataFrame, lattice: Lattice, level: float) -> DataFrame:
    """(i, j, part, x1, y1, x2, y2): the level's pieces in the cells that have four values. A cell's corners meet by an equi-join on nodes."""
    x, y = lattice.node_xy(F.col("i"), F.col("j"))
    placed = field.where(~F.isnan("v")).withColumns({"x": x.cast("double"), "y": y.cast("double")})
    places = F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(k).alias("k")) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    rows = placed.select(F.struct("x", "y", "v").alias("c"), F.explode(places).alias("p"))
    cells = rows.groupBy("p.i", "p.j").agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("p.k") == k, F.col("c"))).alias(f"_{k}") for k in range(4)]).where("_n = 4")
    above = sum((F.when(F.col(f"_{k}.v") > level, 1 << k).otherwise(0) for k in range(4)), F.lit(0))
    flat = lambda a, b: F.abs(F.col(f"_{b}.v") - F.col(f"_{a}.v")) < 2.2250738585072014e-308

    def cross(a: int, b: int) -> Column:
        t = F.when(flat(a, b), F.lit(0.5)).otherwise((F.lit(level) - F.col(f"_{a}.v")) / F.when(flat(a, b), 1.0).otherwise(F.col(f"_{b}.v") - F.col(f"_{a}.v")))
        return F.struct(*[(F.col(f"_{a}.{c}") + t * (F.col(f"_{b}.{c}") - F.col(f"_{a}.{c}"))).alias(c) for c in "xy"])

    edges = {"b": cross(0, 1), "r": cross(1, 2), "t": cross(2, 3), "l": cross(3, 0)}
    pieces = None
    for case, which in CELL_EDGES.items():
        found = F.array(*[F.struct(edges[p[0]].alias("a"), edges[p[1]].alias("b")) for p in which.split()])
        pieces = F.when(F.col("_case") == case, found) if pieces is None else pieces.when(F.col("_case") == case, found)
    out = cells.withColumn("_case", above).select("i", "j", F.posexplode(pieces).alias("part", "_s"))
    return out.select("i", "j", "part", F.col("_s.a.x").alias("x1"), F.col("_s.a.y").alias("y1"), F.col("_s.b.x").alias("x2"), F.col("_s.b.y").alias("y2"))


def closure_outline(field: DataFrame, lattice: Lattice, spill: float) -> list[tuple[float, float]]:
    """The largest closed ring of the level; empty without one. Pieces are found by Spark; a ring is a chain, so it is put together here (pieces are bounded by the lattice's cells)."""
    pieces = [tuple(r) for r in contour_segments(field, lattice, spill).orderBy("i", "j", "part").select("x1", "y1", "x2", "y2").collect()]
    name = lambda x, y: (round(x * 1e6), round(y * 1e6))
    where, beside = {}, {}
    for n, (x1, y1, x2, y2) in enumerate(pieces):
        a, b = name(x1, y1), name(x2, y2)
        where.setdefault(a, (x1, y1))
        where.setdefault(b, (x2, y2))
        beside.setdefault(a, []).append((b, n))
        beside.setdefault(b, []).append((a, n))
    free, best, most = set(range(len(pieces))), [], 0.0
    for n, (x1, y1, x2, y2) in enumerate(pieces):
        if n not in free:
            continue
        free.discard(n)
        ring = [name(x1, y1), name(x2, y2)]
        while ring[-1] != ring[0]:
            onward = next(((b, k) for b, k in beside[ring[-1]] if k in free), None)
            if onward is None:
                break
            free.discard(onward[1])
            ring.append(onward[0])
        if ring[-1] == ring[0] and len(ring) > 3:
            points = [where[p] for p in ring[:-1]]
            area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], points[0]], strict=True))) / 2
            if area > most:
                best, most = points, area
    return best


def study_area_outline(box: tuple[float, float, float, float], corner_radius: float = 0.0, arc_steps: int = 0) -> list[tuple[float, float]]:
    """A box, its corners rounded where radius and steps are positive."""
    x0, y0, x1, y1 = box
    r = min(max(corner_radius, 0.0), max(min(x1 - x0, y1 - y0) / 2, 0.0))
    if r <= 0 or arc_steps == 0:
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    out = []
    for quarter, (cx, cy) in enumerate(((x1 - r, y0 + r), (x1 - r, y1 - r), (x0 + r, y1 - r), (x0 + r, y0 + r))):
        for s in range(arc_steps + 1):
            turn = (quarter - 1 + s / arc_steps) * math.pi / 2
            out.append((cx + r * math.cos(turn), cy + r * math.sin(turn)))
    return out

"""Normal scores and sequential Gaussian simulation.

A realisation is sequential, as each node conditions the next, so a realisation (or layer) is a group and groups run in
parallel. Paths and draws depend on the group's seed and the node alone, so results do not depend on partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmptyInput, InvalidArgument
from ..functions.lattice import Lattice
from ..functions.rng import normal_inverse
from .kriging import simple_kriging


def normal_scores(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, value, score): the knots of the normal-score transform, one for each distinct value.

    The score of rank k of n (from 0) is the normal quantile of (k + 0.5) / n; ties have the mean of theirs. Ranks within a
    group are one sort; for a table without groups give a coarse key, or use the quantiles of a summary.
    """
    keys = keys or []
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(value)) - 1
    rows = df.select(*keys, F.col(value).cast("double").alias("value"), ((rank + 0.5) / F.count("*").over(w)).alias("_p"))
    return rows.select(*keys, "value", normal_inverse(F.col("_p")).alias("_s")).groupBy(*keys, "value").agg(F.avg("_s").alias("score"))


class NormalScore:
    """The transform of one data set in numpy."""

    def __init__(self, data: np.ndarray):
        from statistics import NormalDist

        if len(data) == 0:
            raise EmptyInput("normal scores need data")
        inverse = NormalDist().inv_cdf
        n = len(data)
        self.values, often = np.unique(np.asarray(data, float), return_counts=True)
        scores = np.array([inverse((k + 0.5) / n) for k in range(n)])
        starts = np.cumsum(often) - often
        self.scores = np.add.reduceat(scores, starts) / often

    def forward(self, v):
        return np.interp(v, self.values, self.scores)

    def back(self, s):
        return np.interp(s, self.scores, self.values)

    def score_bounds(self) -> tuple[float, float]:
        return float(self.scores[0]), float(self.scores[-1])


class _Known:
    """Informed places in cells of the search radius."""

    def __init__(self, radius: float):
        self.radius, self.cells = radius, {}
        self.xy, self.v = np.zeros((1024, 2)), np.zeros(1024)
        self.n = 0

    def add(self, x: float, y: float, v: float) -> None:
        if self.n == len(self.v):
            self.xy, self.v = np.concatenate([self.xy, np.zeros_like(self.xy)]), np.concatenate([self.v, np.zeros_like(self.v)])
        self.xy[self.n], self.v[self.n] = (x, y), v
        self.cells.setdefault((math.floor(x / self.radius), math.floor(y / self.radius)), []).append(self.n)
        self.n += 1

    def near(self, x: float, y: float, k: int) -> np.ndarray:
        cx, cy = math.floor(x / self.radius), math.floor(y / self.radius)
        found = [m for a in (cx - 1, cx, cx + 1) for b in (cy - 1, cy, cy + 1) for m in self.cells.get((a, b), ())]
        if not found:
            return np.empty(0, np.int64)
        at = np.array(found)
        d = self.xy[at] - (x, y)
        d2 = (d * d).sum(axis=1)
        ok = d2 <= self.radius * self.radius
        at, d2 = at[ok], d2[ok]
        if len(at) > k:
            part = np.argpartition(d2, k - 1)[:k]
            limit = d2[part].max()
            close = d2 <= limit
            at, d2 = at[close], d2[close]
        return at[np.lexsort((at, d2))][:k]


def simulate_scores(lattice: Lattice, variogram, max_neighbours: int, radius: float, seed: int, fixed: list[tuple[int, int, float]], secondary: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    """A field of scores (ncol, nrow). Of data at one node the first informs its neighbours and the last is the node's value."""
    if max_neighbours < 1 or not radius > 0:
        raise InvalidArgument("simulation needs max_neighbours >= 1 and radius > 0")
    out = np.full((lattice.ncol, lattice.nrow), np.nan)
    known = _Known(radius)
    for i, j, s in fixed:
        if np.isnan(out[i, j]):
            known.add(*lattice.node_xy(i, j), s)
        out[i, j] = s
    rng = np.random.Generator(np.random.Philox(key=seed & (2**64 - 1)))
    path = np.argwhere(np.isnan(out))
    path = path[rng.permutation(len(path))]
    draws = rng.standard_normal(len(path))
    for (i, j), e in zip(path.tolist(), draws.tolist(), strict=True):
        x, y = lattice.node_xy(i, j)
        at = known.near(x, y, max_neighbours)
        xy = known.xy[at]
        beside = None
        if secondary is not None and math.isfinite(secondary[0][i, j]):
            beside = (float(secondary[0][i, j]), secondary[1])
        mean, var = simple_kriging(xy - (x, y), known.v[at], xy, variogram, beside)
        out[i, j] = mean + math.sqrt(var) * e
        known.add(x, y, out[i, j])
    return out


def _snap(points: np.ndarray, lattice: Lattice, scores: NormalScore) -> list[tuple[int, int, float]]:
    fi, fj = lattice.xy_to_ij(points[:, 0], points[:, 1])
    away = lambda v: np.where(v < 0, -np.floor(-v + 0.5), np.floor(v + 0.5))
    i, j = away(fi), away(fj)
    ok = (i >= 0) & (j >= 0) & (i < lattice.ncol) & (j < lattice.nrow)
    return list(zip(i[ok].astype(int).tolist(), j[ok].astype(int).tolist(), scores.forward(points[ok, 2]).tolist(), strict=True))


def sgs_np(points: np.ndarray, lattice: Lattice, variogram, max_neighbours: int, radius: float, seed: int, secondary: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    """Conditional simulation of points (n, 3); the variogram is of normal scores. secondary: a field, standardised here, and its correlation."""
    scores = NormalScore(points[:, 2])
    if secondary is not None:
        field = secondary[0]
        good = np.isfinite(field)
        sd = field[good].std()
        secondary = (np.where(good, (field - field[good].mean()) / sd if sd > 0 else 0.0, np.nan), secondary[1])
    return scores.back(simulate_scores(lattice, variogram, max_neighbours, radius, seed, _snap(points, lattice, scores), secondary))


def sgs_unconditional_np(lattice: Lattice, variogram, mean: float, variance: float, max_neighbours: int, radius: float, seed: int) -> np.ndarray:
    if variance < 0:
        raise InvalidArgument("the variance must not be negative")
    if variance == 0:
        return np.full((lattice.ncol, lattice.nrow), float(mean))
    return mean + math.sqrt(variance) * simulate_scores(lattice, variogram, max_neighbours, radius, seed, [])


def _field(values: np.ndarray, **keys) -> pd.DataFrame:
    i, j = np.divmod(np.arange(values.size), values.shape[1])
    return pd.DataFrame({**keys, "i": i.astype(np.int32), "j": j.astype(np.int32), "v": values.ravel()})


def sgs(points: DataFrame, seeds: DataFrame, lattice: Lattice, variogram, max_neighbours: int, radius: float) -> DataFrame:
    """points (layer, pid, x, y, z), seeds (layer, seed) -> (layer, seed, i, j, v): a realisation for each layer and seed."""
    rows = points.select("layer", "pid", "x", "y", "z").join(seeds, "layer")
    kind = points.schema["layer"].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pid")
        return _field(sgs_np(part[["x", "y", "z"]].to_numpy(float), lattice, variogram, max_neighbours, radius, int(key[1])), layer=key[0], seed=int(key[1]))

    return rows.groupBy("layer", "seed").applyInPandas(run, f"layer {kind}, seed long, i int, j int, v double")


def sgs_collocated(points: DataFrame, secondary: DataFrame, seeds: DataFrame, lattice: Lattice, variogram, correlation: float, max_neighbours: int, radius: float) -> DataFrame:
    """As sgs, with a secondary field (layer, i, j, v) that the scores correlate with."""
    if not -1 <= correlation <= 1:
        raise InvalidArgument("the correlation must be in [-1, 1]")
    data = points.select("layer", "pid", "x", "y", "z").join(seeds, "layer")
    beside = secondary.select("layer", "i", "j", "v").join(seeds, "layer").select(*[F.col(c).alias(c) for c in ("layer", "seed", "i", "j", "v")])
    kind = points.schema["layer"].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame, field: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pid")
        grid = np.full((lattice.ncol, lattice.nrow), np.nan)
        grid[field["i"], field["j"]] = field["v"]
        return _field(sgs_np(part[["x", "y", "z"]].to_numpy(float), lattice, variogram, max_neighbours, radius, int(key[1]), (grid, correlation)), layer=key[0], seed=int(key[1]))

    return data.groupBy("layer", "seed").cogroup(beside.groupBy("layer", "seed")).applyInPandas(run, f"layer {kind}, seed long, i int, j int, v double")


def sgs_unconditional(seeds: DataFrame, lattice: Lattice, variogram, mean: float, variance: float, max_neighbours: int, radius: float) -> DataFrame:
    """seeds (seed) -> (seed, i, j, v)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _field(sgs_unconditional_np(lattice, variogram, mean, variance, max_neighbours, radius, int(key[0])), seed=int(key[0]))

    return seeds.select(F.col("seed").cast("long").alias("seed")).groupBy("seed").applyInPandas(run, "seed long, i int, j int, v double")

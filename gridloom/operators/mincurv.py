"""Minimum curvature: a tensioned biharmonic surface through data, one coupled system for each surface.

Data at a node fix it; data between nodes pull on their four nodes (bilinear conditioning) or on the nearest (nearest-node).
The equations are assembled as arrays, boundaries folded by linear extrapolation, and solved by band elimination along the
shorter axis; ridge and relaxation stand behind it. The system does not depend on values, so surfaces over one footprint share
a factor. Surfaces run in parallel: one group each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyInput
from ..functions.lattice import ON_NODE, Lattice

TENSION = 0.25
DATA_WEIGHT = 1e5
LEAST_CONTROLS, RIDGE, PIVOT = 4, 1e-8, 1e-10
OMEGA, TOLERANCE, MOST_SWEEPS = 1.5, 1e-6, 20_000


def stencil() -> list[tuple[int, int, float]]:
    """The operator (1 - T) * biharmonic - T * Laplacian as offsets and coefficients."""
    t = TENSION
    near, corner, far = -(8 * (1 - t) + t), 2 * (1 - t), 1 - t
    ring = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    return [(0, 0, 20 * (1 - t) + 4 * t), *((a, b, near) for a, b in ring), *((a, b, corner) for a in (1, -1) for b in (1, -1)), *((2 * a, 2 * b, far) for a, b in ring)]


def _fold(k: int, n: int) -> list[tuple[int, float]]:
    """An index beyond an axis of n nodes as a line through the two nodes at its end."""
    if 0 <= k < n:
        return [(k, 1.0)]
    end, step = (0, 1) if k < 0 else (n - 1, -1)
    d = abs(k - end)
    return [(end, 1.0 + d), (end + step, -float(d))]


def _operator(nc: int, nr: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and coefficients of the stencil at every node; a node's index is i * nr + j."""
    rows, cols, values = [], [], []
    i, j = np.meshgrid(np.arange(nc), np.arange(nr), indexing="ij")
    for di, dj, c in stencil():
        # the folds of both axes are independent, so a corner's is their product
        fold_i = [_fold(k + di, nc) for k in range(nc)]
        fold_j = [_fold(k + dj, nr) for k in range(nr)]
        for a in range(2):
            ok_i = np.array([len(f) > a for f in fold_i])
            at_i = np.array([f[min(a, len(f) - 1)][0] for f in fold_i])
            w_i = np.array([f[min(a, len(f) - 1)][1] for f in fold_i])
            for b in range(2):
                ok_j = np.array([len(f) > b for f in fold_j])
                at_j = np.array([f[min(b, len(f) - 1)][0] for f in fold_j])
                w_j = np.array([f[min(b, len(f) - 1)][1] for f in fold_j])
                ok = ok_i[i] & ok_j[j]
                rows.append((i * nr + j)[ok])
                cols.append((at_i[i] * nr + at_j[j])[ok])
                values.append((c * w_i[i] * w_j[j])[ok])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def classify(xy: np.ndarray, lattice: Lattice, bilinear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kind (0 at a node, 1 between nodes, 2 beyond), node, four nodes and their weights, for each datum."""
    fi, fj = lattice.xy_to_ij(xy[:, 0], xy[:, 1])
    nc, nr = lattice.ncol, lattice.nrow
    away = lambda v: np.where(v < 0, -np.floor(-v + 0.5), np.floor(v + 0.5))
    ri, rj = away(fi), away(fj)
    inside = (ri >= 0) & (rj >= 0) & (ri < nc) & (rj < nr)
    within = (fi >= 0) & (fj >= 0) & (fi <= nc - 1) & (fj <= nr - 1)
    on = inside & ((np.abs(fi - ri) <= ON_NODE) & (np.abs(fj - rj) <= ON_NODE) | (not bilinear))
    kind = np.where(on, 0, np.where(within & bilinear & (nc > 1) & (nr > 1), 1, 2))
    i0 = np.clip(np.floor(fi), 0, max(nc - 2, 0)).astype(np.int64)
    j0 = np.clip(np.floor(fj), 0, max(nr - 2, 0)).astype(np.int64)
    t, u = fi - i0, fj - j0
    nodes = np.stack([i0 * nr + j0, (i0 + 1) * nr + j0, i0 * nr + j0 + 1, (i0 + 1) * nr + j0 + 1], axis=1)
    weights = np.stack([(1 - t) * (1 - u), t * (1 - u), (1 - t) * u, t * u], axis=1)
    return kind, (np.clip(ri, 0, nc - 1) * nr + np.clip(rj, 0, nr - 1)).astype(np.int64), nodes, weights


class BandLu:
    """Gaussian elimination without exchanges within a band; rows are stored by diagonal."""

    def __init__(self, n: int, width: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, ridge: float = 0.0):
        self.n, self.width = n, width
        self.band = np.zeros((n + width, 2 * width + 1))
        np.add.at(self.band, (rows, cols - rows + width), values)
        self.band[:n, width] += ridge
        self.scale = np.abs(self.band[:n, width]).max(initial=0.0)

    def factor(self) -> bool:
        w, band, n = self.width, self.band, self.n
        flat, stride = band.reshape(-1), band.shape[1]
        floor = PIVOT * self.scale
        for k in range(n):
            pivot = band[k, w]
            if not abs(pivot) > floor:
                return False
            # row k + r holds column k at offset w - r: a window of the rows below, sheared by their diagonals
            start = (k + 1) * stride + w - 1
            below = np.lib.stride_tricks.as_strided(flat[start:], (w, w + 1), ((stride - 1) * 8, 8))
            f = below[:, 0] / pivot
            below[:, 1:] -= f[:, None] * band[k, w + 1 :][None, :]
            below[:, 0] = f
        return bool(np.isfinite(band[:n]).all())

    def solve(self, b: np.ndarray) -> np.ndarray:
        """b: (n, surfaces)."""
        w, band, n = self.width, self.band, self.n
        x = np.zeros((n + w, b.shape[1]))
        x[:n] = b
        for k in range(n):
            m = min(w, n - 1 - k)
            if m:
                r = np.arange(1, m + 1)
                x[k + 1 : k + 1 + m] -= band[k + r, w - r][:, None] * x[k]
        for k in range(n - 1, -1, -1):
            x[k] = (x[k] - band[k, w + 1 :] @ x[k + 1 : k + 1 + w]) / band[k, w]
        return x[:n]


@dataclass
class MinCurvatureOperator:
    """A footprint's factor: solve() takes values at its data and returns fields."""

    lattice: Lattice
    xy: np.ndarray
    bilinear: bool = True
    lu: BandLu | None = field(default=None, repr=False)

    def __post_init__(self):
        nc, nr = self.lattice.ncol, self.lattice.nrow
        n = nc * nr
        self.kind, self.node, self.nodes, self.weights = classify(self.xy, self.lattice, self.bilinear)
        self.anchored = np.zeros(n, bool)
        self.anchored[self.node[self.kind == 0]] = True
        order = np.arange(n).reshape(nc, nr)
        order = (order.T if nc <= nr else order).ravel()
        self.free = order[~self.anchored[order]]
        at = np.full(n, -1)
        at[self.free] = np.arange(len(self.free))
        self.ready = nc >= 2 and nr >= 2
        if not self.ready:
            return
        rows, cols, values = _operator(nc, nr)
        off = np.flatnonzero(self.kind == 1)
        p, w = self.nodes[off], self.weights[off]
        rows = np.concatenate([rows, np.repeat(p, 4, axis=1).ravel()])
        cols = np.concatenate([cols, np.tile(p, (1, 4)).ravel()])
        values = np.concatenate([values, DATA_WEIGHT * (w[:, :, None] * w[:, None, :]).ravel()])
        keep = at[rows] >= 0
        rows, cols, values = rows[keep], cols[keep], values[keep]
        known = self.anchored[cols]
        self.to_anchor = (at[rows[known]], cols[known], values[known])
        r, c, v = at[rows[~known]], at[cols[~known]], values[~known]
        width = int(np.abs(r - c).max(initial=0))
        controls = len(off) + int(self.anchored.sum())
        if len(self.free) == 0:
            return
        top = np.abs(v[r == c]).max(initial=1.0)
        for ridge in (0.0, RIDGE * top) if controls >= LEAST_CONTROLS else (0.0,):
            lu = BandLu(len(self.free), width, r, c, v, ridge)
            if lu.factor():
                self.lu = lu
                break

    @property
    def sample_count(self) -> int:
        return len(self.xy)

    def _anchors(self, z: np.ndarray) -> np.ndarray:
        n = self.lattice.ncol * self.lattice.nrow
        on = self.kind == 0
        total, often = np.zeros((n, z.shape[1])), np.bincount(self.node[on], minlength=n)
        np.add.at(total, self.node[on], z[on])
        return total / np.maximum(often, 1)[:, None]

    def solve(self, z: np.ndarray) -> np.ndarray:
        """z: (samples, surfaces) -> (nodes, surfaces)."""
        out = self._anchors(z)
        if len(self.free) == 0:
            return out
        if self.lu is None:
            return np.stack([self._relax(out[:, k].copy(), z[:, k]) for k in range(z.shape[1])], axis=1)
        b = np.zeros((len(self.free), z.shape[1]))
        rows, cols, values = self.to_anchor
        np.add.at(b, rows, -values[:, None] * out[cols])
        at = np.full(len(out), -1)
        at[self.free] = np.arange(len(self.free))
        off = np.flatnonzero(self.kind == 1)
        for m in range(4):
            r = at[self.nodes[off, m]]
            ok = r >= 0
            np.add.at(b, r[ok], DATA_WEIGHT * self.weights[off, m][ok, None] * z[off][ok])
        out[self.free] = self.lu.solve(b)
        return out

    def _relax(self, v: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Where elimination fails: successive over-relaxation from an inverse-distance surface."""
        nc, nr = self.lattice.ncol, self.lattice.nrow
        i, j = np.divmod(np.arange(nc * nr), nr)
        x, y = self.lattice.node_xy(i, j)
        d2 = (x[:, None] - self.xy[None, :, 0]) ** 2 + (y[:, None] - self.xy[None, :, 1]) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            seed = (z / d2).sum(axis=1) / (1 / d2).sum(axis=1)
        hit = (d2 == 0).any(axis=1)
        seed[hit] = z[(d2[hit] == 0).argmax(axis=1)]
        v = np.where(self.anchored, v, seed)
        if not self.ready:
            return v
        rows, cols, values = _operator(nc, nr)
        off = np.flatnonzero(self.kind == 1)
        p, w = self.nodes[off], self.weights[off]
        rows = np.concatenate([rows, np.repeat(p, 4, axis=1).ravel()])
        cols = np.concatenate([cols, np.tile(p, (1, 4)).ravel()])
        values = np.concatenate([values, DATA_WEIGHT * (w[:, :, None] * w[:, None, :]).ravel()])
        right = np.zeros(nc * nr)
        np.add.at(right, p.ravel(), DATA_WEIGHT * (w * z[off][:, None]).ravel())
        o = np.lexsort((cols, rows))
        rows, cols, values = rows[o], cols[o], values[o]
        edges = np.searchsorted(rows, np.arange(nc * nr + 1))
        sweep = [(n, cols[a:b], values[a:b], values[a:b][cols[a:b] == n].sum()) for n in (i_ * nr + j_ for j_ in range(nr) for i_ in range(nc)) if not self.anchored[n] for a, b in [(edges[n], edges[n + 1])]]
        for _ in range(MOST_SWEEPS):
            most = 0.0
            for n, c, w_, diagonal in sweep:
                move = OMEGA * (right[n] - w_ @ v[c]) / diagonal
                v[n] += move
                most = max(most, abs(move))
            if most < TOLERANCE:
                break
        return v


def min_curvature_np(points: np.ndarray, lattice: Lattice, bilinear: bool = True) -> np.ndarray:
    """points (n, 3) -> field (ncol, nrow)."""
    if len(points) == 0:
        raise EmptyInput("min curvature needs data")
    return MinCurvatureOperator(lattice, points[:, :2], bilinear).solve(points[:, 2:])[:, 0].reshape(lattice.ncol, lattice.nrow)


def _rows(values: np.ndarray, lattice: Lattice) -> pd.DataFrame:
    i, j = np.divmod(np.arange(lattice.ncol * lattice.nrow), lattice.nrow)
    return pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": values.ravel()})


def grid_min_curvature(points: DataFrame, lattice: Lattice, keys: list[str] | None = None, conditioning: str = "bilinear") -> DataFrame:
    """points (keys, pid, x, y, z) -> (keys, i, j, v). A surface is one group, as its nodes are one system; surfaces run in parallel."""
    keys = keys or []
    fields = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "i int, j int, v double"])

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pid")
        out = _rows(min_curvature_np(part[["x", "y", "z"]].to_numpy(float), lattice, conditioning == "bilinear"), lattice)
        for n, v in enumerate(key[: len(keys)]):
            out.insert(n, keys[n], v)
        return out

    rows = points.select(*keys, F.lit(0).alias("_one"), "pid", "x", "y", "z")
    return rows.groupBy(*(keys or ["_one"])).applyInPandas(solve, schema)


def grid_horizons(points: DataFrame, lattice: Lattice, horizon: str, conditioning: str = "bilinear") -> DataFrame:
    """points (pid, x, y, horizon, z): horizons over one footprint -> (horizon, i, j, v). The footprint is factored once and
    broadcast (its band, nodes * shorter side, is known from the lattice); each horizon is a solve."""
    spark = points.sparkSession
    places = points.groupBy("pid").agg(F.first("x").alias("x"), F.first("y").alias("y")).orderBy("pid").toPandas()
    if not len(places):
        raise EmptyInput("min curvature needs data")
    operator = MinCurvatureOperator(lattice, places[["x", "y"]].to_numpy(float), conditioning == "bilinear")
    shared = spark.sparkContext.broadcast((operator, places["pid"].to_numpy()))
    kind = points.schema[horizon].dataType.simpleString()

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        operator, pids = shared.value
        z = part.set_index("pid")["z"].reindex(pids).to_numpy(float)
        out = _rows(operator.solve(z[:, None])[:, 0], lattice)
        out.insert(0, horizon, key[0])
        return out

    return points.select("pid", horizon, "z").groupBy(horizon).applyInPandas(solve, f"{horizon} {kind}, i int, j int, v double")

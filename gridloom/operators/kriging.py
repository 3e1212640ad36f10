"""Ordinary kriging, global and local.

Local: the neighbours of each node come from the cell join, are gathered in one array for each node, and whole batches of nodes
are solved at once, stacked by their number of neighbours. Global: the system of all data is factored once and broadcast; its
size, (n + 1) squared, is checked before that, and larger sets are for the local form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyInput, InvalidArgument
from ..functions.lattice import Lattice
from . import spatial
from .variogram import AnisotropicVariogram, Variogram

#: Most data of a global system: its inverse then takes 128 MB.
MOST_GLOBAL = 4_000


def solve_ordinary(xy: np.ndarray, z: np.ndarray, at: np.ndarray, variogram) -> tuple[np.ndarray, np.ndarray]:
    """Stacked systems: xy (m, n, 2), z (m, n), at (m, 2) -> estimates and variances (m,); NaN where a system is singular."""
    m, n = z.shape
    d = xy[:, :, None, :] - xy[:, None, :, :]
    a = np.ones((m, n + 1, n + 1))
    a[:, :n, :n] = variogram.between(d[..., 0], d[..., 1])
    a[:, n, n] = 0
    b = np.ones((m, n + 1))
    o = xy - at[:, None, :]
    b[:, :n] = variogram.between(o[..., 0], o[..., 1])
    try:
        w = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        w = np.full((m, n + 1), np.nan)
        for k in range(m):
            try:
                w[k] = np.linalg.solve(a[k], b[k])
            except np.linalg.LinAlgError:
                pass
    return (w[:, :n] * z).sum(axis=1), (w * b).sum(axis=1)


def local_kriging(points: DataFrame, lattice: Lattice, variogram: Variogram | AnisotropicVariogram, max_neighbours: int, radius: float) -> DataFrame:
    """(i, j, estimate, variance): by the nearest max_neighbours data within the radius; NaN without any. Coincident data are one."""
    if max_neighbours < 1:
        raise InvalidArgument("max_neighbours must be at least 1")
    nodes = lattice.nodes(points.sparkSession)
    data = spatial.merge_coincident(points.select("pid", "x", "y", "z")).select("pid", "x", "y", "z")
    near = spatial.knn_within(nodes, data, radius, max_neighbours, ["i", "j"])
    gathered = near.groupBy("t.i", "t.j", "t.x", "t.y").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.z").alias("z")))).alias("near"))
    rows = gathered.select("i", "j", "x", "y", F.col("near.x").alias("xs"), F.col("near.y").alias("ys"), F.col("near.z").alias("zs"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = part[["i", "j"]].copy()
            out["estimate"], out["variance"] = np.nan, np.nan
            sizes = part["xs"].map(len).to_numpy()
            for n in np.unique(sizes):
                chosen = np.flatnonzero(sizes == n)
                for k in range(0, len(chosen), 512):
                    at = chosen[k : k + 512]
                    xy = np.stack([np.stack(part["xs"].iloc[at]), np.stack(part["ys"].iloc[at])], axis=-1)
                    e, v = solve_ordinary(xy, np.stack(part["zs"].iloc[at]), part[["x", "y"]].to_numpy()[at], variogram)
                    out.iloc[at, 2], out.iloc[at, 3] = e, v
            yield out

    solved = rows.mapInPandas(solve, "i int, j int, estimate double, variance double")
    nan = F.lit(float("nan"))
    return nodes.select("i", "j").join(solved, ["i", "j"], "left").select("i", "j", F.coalesce("estimate", nan).alias("estimate"), F.coalesce("variance", nan).alias("variance"))


def ordinary_kriging(points: DataFrame, lattice: Lattice, variogram: Variogram | AnisotropicVariogram) -> DataFrame:
    """(i, j, estimate, variance) by all data, which must be at most MOST_GLOBAL places."""
    spark = points.sparkSession
    merged = spatial.merge_coincident(points.select("pid", "x", "y", "z"))
    data = merged.orderBy("pid").limit(MOST_GLOBAL + 1).collect()  # one more than may be, to tell
    if not data:
        raise EmptyInput("kriging needs data")
    if len(data) > MOST_GLOBAL:
        raise InvalidArgument(f"global kriging takes at most {MOST_GLOBAL} places; use local_kriging")
    xy = np.array([(r.x, r.y) for r in data])
    z = np.array([r.z for r in data])
    n = len(z)

    def invert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.ones((n + 1, n + 1))
        a[:n, :n] = variogram.between(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
        a[n, n] = 0
        for _ in parts:
            yield pd.DataFrame({"inverse": [np.linalg.inv(a).tobytes()]})

    # in a task, whose linear algebra keeps to the cores that Spark gives it
    inverse = spark.range(1, numPartitions=1).mapInPandas(invert, "inverse binary").first()[0]
    shared = spark.sparkContext.broadcast((xy, z, np.frombuffer(inverse).reshape(n + 1, n + 1)))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xy, z, inverse = shared.value
        for part in parts:
            for k in range(0, len(part), 256):
                rows = part.iloc[k : k + 256]
                at = rows[["x", "y"]].to_numpy()
                b = np.ones((len(at), len(z) + 1))
                b[:, :-1] = variogram.between(xy[None, :, 0] - at[:, 0, None], xy[None, :, 1] - at[:, 1, None])
                w = b @ inverse.T
                yield pd.DataFrame({"i": rows["i"], "j": rows["j"], "estimate": w[:, :-1] @ z, "variance": np.maximum((w * b).sum(axis=1), 0.0)})

    return lattice.nodes(spark).mapInPandas(solve, "i int, j int, estimate double, variance double")


def simple_kriging(offsets: np.ndarray, values: np.ndarray, positions: np.ndarray, variogram, secondary: tuple[float, float] | None = None) -> tuple[float, float]:
    """Mean and variance of a standard normal score given neighbours; (0, 1) without them or if singular.

    Correlations are 1 - gamma / total sill. secondary: (score, correlation), a collocated datum under the Markov model.
    """
    n, extra = len(values), int(secondary is not None)
    if n + extra == 0:
        return 0.0, 1.0
    s = variogram.total_sill
    a = np.ones((n + extra, n + extra))
    b = np.ones(n + extra)
    if n:
        d = positions[:, None, :] - positions[None, :, :]
        a[:n, :n] = 1 - variogram.between(d[..., 0], d[..., 1]) / s
        b[:n] = 1 - variogram.between(offsets[:, 0], offsets[:, 1]) / s
    if extra:
        a[:n, n] = a[n, :n] = secondary[1] * b[:n]
        b[n] = secondary[1]
    try:
        w = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return 0.0, 1.0
    known = np.append(values, secondary[0]) if extra else values
    return float(w @ known), max(float(1 - w @ b), 0.0)

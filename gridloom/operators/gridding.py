"""Gridding by nearest point and inverse distances, and resampling of fields, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.lattice import Lattice
from . import spatial

SNAP = 1e-9
IDW_POWER = 2


def grid_nearest(points: DataFrame, lattice: Lattice, first_radius: float | None = None) -> DataFrame:
    """(i, j, v): the value of the nearest point (pid breaks ties) at each node."""
    radius = first_radius or 2 * max(abs(lattice.xinc), abs(lattice.yinc))
    found = spatial.nearest(lattice.nodes(points.sparkSession), points.select("pid", "x", "y", "z"), ["i", "j"], radius)
    return found.select("i", "j", F.col("p.z").alias("v"))


def grid_idw(points: DataFrame, lattice: Lattice, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, v): sum(z / d2) / sum(1 / d2) over all points of a set; at a point its value (of the smallest pid).

    Every node needs every point: the lattice's nodes, whose number the caller states, are the side that Spark broadcasts if it
    is below the threshold; the points stream past them and are summed up before any shuffle. So shuffled rows are nodes times
    tasks, not nodes times points.
    """
    keys = keys or []
    nodes = lattice.nodes(points.sparkSession).withColumnsRenamed({"x": "_nx", "y": "_ny"})
    d2 = (F.col("x") - F.col("_nx")) * (F.col("x") - F.col("_nx")) + (F.col("y") - F.col("_ny")) * (F.col("y") - F.col("_ny"))
    rows = points.join(nodes).select(*keys, "i", "j", "pid", "z", d2.alias("_d2"))
    away = F.col("_d2") > 0
    sums = rows.groupBy(*keys, "i", "j").agg(
        F.sum(F.when(away, F.col("z") / F.col("_d2"))).alias("_zw"),
        F.sum(F.when(away, 1 / F.col("_d2"))).alias("_w"),
        F.min(F.when(~away, F.struct("pid", "z"))).alias("_hit"),
    )
    return sums.select(*keys, "i", "j", F.coalesce(F.col("_hit.z"), F.col("_zw") / F.col("_w")).alias("v"))


def _snapped(f):
    return F.when(F.abs(f - F.round(f)) <= SNAP, F.round(f)).otherwise(f)


def resample(field: DataFrame, source: Lattice, target: Lattice, method: str = "bilinear", keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, v) of one lattice -> of another. NaN beyond the source's extent and where the nearest node is NaN.

    bilinear: the mean of the finite corners by their weights. A join on whole node indices and one aggregation.
    """
    if method not in ("bilinear", "nearest"):
        raise InvalidArgument(f"unknown method {method!r}")
    keys = keys or []
    fi, fj = source.xy_to_ij(F.col("x"), F.col("y"))
    at = target.nodes(field.sparkSession).select("i", "j", _snapped(fi).alias("_fi"), _snapped(fj).alias("_fj"))
    inside = (F.col("_fi") >= 0) & (F.col("_fj") >= 0) & (F.col("_fi") <= source.ncol - 1) & (F.col("_fj") <= source.nrow - 1)
    near_i, near_j = F.round("_fi").cast("int"), F.round("_fj").cast("int")
    values = field.select(*keys, F.col("i").alias("_ci"), F.col("j").alias("_cj"), F.col("v").alias("_v"))
    sets = field.select(*keys).distinct() if keys else None
    everything = at.join(sets) if keys else at
    if method == "nearest":
        hit = at.where(inside).select("i", "j", near_i.alias("_ci"), near_j.alias("_cj")).join(values, ["_ci", "_cj"]).select(*keys, "i", "j", F.col("_v").alias("v"))
    else:
        i0, j0 = F.floor("_fi").cast("int"), F.floor("_fj").cast("int")
        t, u = F.col("_fi") - i0, F.col("_fj") - j0
        corner = lambda a, b: F.struct((i0 + a).alias("ci"), (j0 + b).alias("cj"), ((t if a else 1 - t) * (u if b else 1 - u)).alias("w"))
        rows = at.where(inside).select("i", "j", near_i.alias("_ni"), near_j.alias("_nj"), F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))).alias("_c"))
        rows = rows.select("i", "j", "_ni", "_nj", F.col("_c.ci").alias("_ci"), F.col("_c.cj").alias("_cj"), F.col("_c.w").alias("_w")).where("_w > 0 or (_ci = _ni and _cj = _nj)")
        rows = rows.join(values, ["_ci", "_cj"])
        good = ~F.isnan("_v")
        sums = rows.groupBy(*keys, "i", "j").agg(
            F.sum(F.when(good, F.col("_w") * F.col("_v"))).alias("_s"),
            F.sum(F.when(good, F.col("_w"))).alias("_t"),
            F.max(F.when((F.col("_ci") == F.col("_ni")) & (F.col("_cj") == F.col("_nj")), F.isnan("_v"))).alias("_hole"),
        )
        hit = sums.select(*keys, "i", "j", F.when(F.col("_hole"), F.lit(float("nan"))).otherwise(F.col("_s") / F.col("_t")).alias("v"))
    return everything.select(*keys, "i", "j").join(hit, [*keys, "i", "j"], "left").select(*keys, "i", "j", F.coalesce("v", F.lit(float("nan"))).alias("v"))


def standardise(field: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """v less its mean over its population deviation; finite values only, 0 where all are equal."""
    w = Window.partitionBy(*(keys or []))
    good = F.when(~F.isnan("v"), F.col("v"))
    sd = F.stddev_pop(good).over(w)
    return field.withColumn("v", F.when(F.isnan("v"), F.col("v")).otherwise(F.when(sd > 0, (F.col("v") - F.avg(good).over(w)) / sd).otherwise(0.0)))


def anchor_average(points: DataFrame, lattice: Lattice, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, v): the mean of the points that snap to a node."""
    return lattice.snap(points).groupBy(*(keys or []), "i", "j").agg(F.avg("z").alias("v"))


def upsert_controls(controls: DataFrame, new: DataFrame) -> DataFrame:
    """(i, j, v, seq): new controls replace those of their node; the highest seq stays."""
    both = controls.unionByName(new)
    return both.groupBy("i", "j").agg(F.max(F.struct("seq", "v")).alias("_last")).select("i", "j", F.col("_last.v").alias("v"), F.col("_last.seq").alias("seq"))


def grid(points: DataFrame, lattice: Lattice, method: str = "idw", **options) -> DataFrame:
    """(i, j, v) by `nearest`, `idw` or `min_curvature`."""
    if method == "nearest":
        return grid_nearest(points, lattice, **options)
    if method == "idw":
        return grid_idw(points, lattice, **options)
    if method == "min_curvature":
        from .mincurv import grid_min_curvature

        return grid_min_curvature(points, lattice, **options)
    raise InvalidArgument(f"unknown method {method!r}")

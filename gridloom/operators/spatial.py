"""Joins by distance, as equi-joins on square cells.

A pair within a radius lies in cells that touch, so one side is dealt to its cell and the other to the nine around it; Spark
joins on the cell and filters by distance. Nothing is compared with everything, and a side is broadcast only where Spark finds it
below the session's threshold. A cell that holds very many points is split by Spark's skew join, as these are plain joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..sources.shared import stored


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def _around(c: Column) -> Column:
    return F.explode(F.array(c - 1, c, c + 1))


def distance2(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return dx * dx + dy * dy


def within(targets: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(t, p, d2): structs of all pairs with d2 <= radius ** 2, the boundary included. Both sides have x and y."""
    if not (math.isfinite(radius) and radius > 0):
        raise InvalidArgument("the radius must be finite and positive")
    left = targets.select(F.struct(*targets.columns).alias("t"), cell(F.col("x"), radius).alias("_cx"), cell(F.col("y"), radius).alias("_cy"))
    right = points.select(F.struct(*points.columns).alias("p"), cell(F.col("x"), radius).alias("_x"), cell(F.col("y"), radius).alias("_y"))
    right = right.select("p", _around(F.col("_x")).alias("_cx"), "_y").select("p", "_cx", _around(F.col("_y")).alias("_cy"))
    d2 = distance2("t", "p")
    return left.join(right, ["_cx", "_cy"]).select("t", "p", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def knn_within(targets: DataFrame, points: DataFrame, radius: float, k: int, target_key: list[str], tie: str = "pid") -> DataFrame:
    """`within`, the k nearest of each target, with rank from 1; equal distances go by `tie`.

    Pairs are of places, not of rows: of the points at one place the first k by `tie` come before the others for every target, and
    targets at one place have the same neighbours. So rows that repeat places add none to the pairs.
    """
    here = Window.partitionBy("x", "y").orderBy(tie)
    first = points.withColumn("_rank", F.row_number().over(here)).where(F.col("_rank") <= k).drop("_rank")
    near = within(targets.select("x", "y").distinct(), first, radius)
    place = Window.partitionBy("t.x", "t.y").orderBy("d2", f"p.{tie}")
    near = near.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= k).select(F.col("t.x").alias("_x"), F.col("t.y").alias("_y"), "p", "d2")
    pairs = targets.select(F.struct(*targets.columns).alias("t")).join(near, (F.col("t.x") == F.col("_x")) & (F.col("t.y") == F.col("_y"))).select("t", "p", "d2")
    order = Window.partitionBy(*[F.col(f"t.{c}") for c in target_key]).orderBy("d2", F.col(f"p.{tie}"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(targets: DataFrame, points: DataFrame, target_key: list[str], first_radius: float, tie: str = "pid", most_rounds: int = 40) -> DataFrame:
    """(target_key, p, d2): the nearest point of each target, however far.

    Rings grow: targets with a point within the radius are done, the others go on with twice the radius. A round costs a join of
    those left; it is written, so that the plan of the next one begins with it.
    """
    left, found, radius = targets, None, first_radius
    for _ in range(most_rounds):
        near = stored(knn_within(left, points, radius, 1, target_key, tie).select(*[F.col(f"t.{c}").alias(c) for c in target_key], "p", "d2"), "nearest")
        found = near if found is None else found.unionByName(near)
        left = stored(left.join(near.select(*target_key), target_key, "left_anti"), "left")
        if left.isEmpty():
            return found
        radius *= 2
    raise InvalidArgument("points are too far from targets for this first radius")


def pairs_within(points: DataFrame, most: float, key: str = "pid") -> DataFrame:
    """(a, b, h): each pair of points once, with 0 <= h < most (exclusive), a.key < b.key."""
    pairs = within(points, points, most).where(F.col(f"t.{key}") < F.col(f"p.{key}"))
    return pairs.select(F.col("t").alias("a"), F.col("p").alias("b"), F.sqrt("d2").alias("h")).where(F.col("h") < most)


def merge_coincident(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pid, x, y, z, n): points at one place become one with the mean z and the first pid. -0 and 0 are one place."""
    keys = keys or []
    rows = points.select(*keys, "pid", (F.col("x") + F.lit(0.0)).alias("x"), (F.col("y") + F.lit(0.0)).alias("y"), "z")
    return rows.groupBy(*keys, "x", "y").agg(F.min("pid").alias("pid"), F.avg("z").alias("z"), F.count("*").alias("n")).select(*keys, "pid", "x", "y", "z", "n")


def ring_edges(ring: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray casting with strict comparisons; points on an edge may fall either way."""
    odd = F.lit(0)
    for ax, ay, bx, by in ring_edges(ring):
        if ay == by:
            continue
        crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (F.lit(bx) - ax) * (y - ay) / (F.lit(by) - ay) + ax)
        odd = odd + F.when(crosses, 1).otherwise(0)
    return odd % 2 == 1


def on_edge(x: Column, y: Column, ring: list[tuple[float, float]], tolerance: float = 1e-9) -> Column:
    out = F.lit(False)
    for ax, ay, bx, by in ring_edges(ring):
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        out = out | ((F.abs(cross) <= tolerance) & (x >= min(ax, bx) - tolerance) & (x <= max(ax, bx) + tolerance) & (y >= min(ay, by) - tolerance) & (y <= max(ay, by) + tolerance))
    return out


def in_rings(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """In any of the rings, their edges included."""
    out = F.lit(False)
    for ring in rings:
        out = out | on_edge(x, y, ring) | in_polygon(x, y, ring)
    return out


def clip_lines(vertices: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """(line_id, seq, x, y) -> (line_id, part, seq, x, y): the runs of segments whose middle is in the rings.

    Segments by lead(), runs by a running count of breaks, all within a line.
    """
    line = Window.partitionBy("line_id").orderBy("seq")
    ends = vertices.select("*", F.lead("x").over(line).alias("_x2"), F.lead("y").over(line).alias("_y2"), F.lead("seq").over(line).alias("_seq2")).where("_seq2 is not null")
    kept = ends.where(in_rings((F.col("x") + F.col("_x2")) / 2, (F.col("y") + F.col("_y2")) / 2, rings))
    new = F.coalesce(F.lag("_seq2").over(line) != F.col("seq"), F.lit(True)).cast("int")
    kept = kept.withColumn("_new", new).withColumn("part", F.sum("_new").over(line))
    points = kept.select("line_id", "part", F.explode(F.array(F.struct("seq", "x", "y"), F.struct(F.col("_seq2").alias("seq"), F.col("_x2").alias("x"), F.col("_y2").alias("y")))).alias("_p"))
    return points.select("line_id", F.col("part").cast("int").alias("part"), "_p.seq", "_p.x", "_p.y").distinct()


def unique_edges(triangles: DataFrame) -> DataFrame:
    """(a, b, c) node ids -> undirected edges (u, v), u < v, each once."""
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    return triangles.select(sides.alias("_e")).select("_e.u", "_e.v").distinct()


def ring_area(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, x, y) -> (keys, area): the shoelace formula, positive either way round."""
    order = Window.partitionBy(*keys).orderBy("seq")
    whole = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = {c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in ("x", "y")}
    rows = vertices.select(*keys, "x", "y", following["x"].alias("_x"), following["y"].alias("_y"))
    return rows.groupBy(*keys).agg(F.abs(F.sum(F.col("x") * F.col("_y") - F.col("_x") * F.col("y")) / 2).alias("area"))

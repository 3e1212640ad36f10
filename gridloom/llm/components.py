"""Connected components of a graph that no single machine holds, by alternating star contractions.

A large-star step links every larger neighbour of a node to its smallest neighbour, a small-star step every smaller one. Both
keep components and shorten paths; when a round changes nothing, every node hangs on the smallest of its component. Only a
count and a checksum of the links come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with v < u. The smallest neighbours are a table, so that links meet them in a plain join, of which Spark can split a hub's part."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    moved = both.join(least, "u").where("v > u" if large else "v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return stored(moved.distinct(), "links")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node, component): the smallest node reachable, for every node with a link to another.

    Links may repeat and go either way; links of a node to itself and links with nulls are left out. Rounds grow with the
    logarithm of the longest path; beyond most_rounds it raises instead of returning half-joined components.
    """
    now = stored(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(),
        "links",
    )
    mark = _mark(now)
    for _ in range(most_rounds):
        now = _star(_star(now, large=True), large=False)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())

"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations alone.

A document's place is a hash of its id, so a source is thinned without sorting: sum the sizes by source and first digit group of
the place, find the group in which the budget runs out, refine only that boundary group by the next digits, and filter. The
documents of the last boundary cell, those that share all digits, take equal shares of what is left. Budgets are nested: with
a larger target every document keeps at least what it had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, source_key, stored

WEIGHTS = (1, 2, 3)
MOST = 3
#: Hexadecimal digits of a histogram's cell: 4096 cells, refined once to 4096 more.
DIGITS = 3


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source key, size (words) and the two digit groups of the place; what else is asked for comes first."""
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        *more,
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source")).alias("_source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(place, 1, DIGITS).alias("_first"),
        F.substring(place, 1 + DIGITS, DIGITS).alias("_next"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_source, source_size, target. Sources share the sum of all sizes by weight; a target stops at `most` times its source's size.

    Reshared until none is above, the targets are min(most * size, level * weight). With sources in order of most * size /
    weight, the level is (total - caps so far) / (weights left) at the first source whose cap is not below it; it falls from
    there on, so the first is the largest. The windows are over the table of sources, one row each.
    """
    by = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    # 'n' is the null source and comes last; the others begin with 'v' and are in order of their bytes, which is that of code points
    order = Window.orderBy(F.col("_source") == "n", "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    by = by.select("_source", "source_size", weight.alias("_w"), (F.col("source_size") * most).alias("_cap"))
    ratio = F.col("_cap").cast("double") / F.col("_w").cast("double")
    before = Window.orderBy("_ratio", "_source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    by = by.withColumn("_ratio", ratio).select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_left"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_weights"),
    )
    level = F.col("_left").cast("double") / F.col("_weights").cast("double")
    level = F.max(F.when(level <= F.col("_ratio"), level)).over(everything)
    by = by.withColumn("_level", level)
    target = F.when(F.col("_ratio") < F.col("_level"), F.col("_cap").cast("double")).otherwise(F.col("_level") * F.col("_w"))
    return by.select("_source", "source_size", target.alias("target"))


def _boundary(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """cells: keys, cell, _words and _budget -> for each key its boundary cell, the words it holds and the budget left for it."""
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    summed = cells.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    inside = (F.col("_before") <= F.col("_budget")) & (F.col("_budget") < F.col("_before") + F.col("_words"))
    return summed.where(inside).select(*keys, F.col(cell).alias(f"_at{cell}"), F.col("_words").alias(f"_in{cell}"), (F.col("_budget") - F.col("_before")).alias(f"_left{cell}"))


def _thresholds(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row for each source: its target, whole repeats, and the boundary cells of what is left."""
    goal = stored(
        targets(sized, weights, most).select(
            "*",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_whole"),
        ).withColumn("_budget", F.floor(F.col("target")) - F.col("_whole") * F.col("source_size")),
        "targets",
    )
    cells = sized.groupBy("_source", "_first").agg(F.sum("size").alias("_words"))
    cut = _boundary(cells.join(goal.select("_source", "_budget"), "_source"), ["_source"], "_first")
    inner = sized.join(cut.select("_source", F.col("_at_first").alias("_first"), F.col("_left_first").alias("_budget")), ["_source", "_first"])
    inner = inner.groupBy("_source", "_budget", "_next").agg(F.sum("size").alias("_words"))
    finer = _boundary(inner, ["_source"], "_next")
    return stored(goal.join(cut, "_source", "left").join(finer, "_source", "left"), "thresholds")


def _taken(in_words: bool = True) -> Column:
    """The words that the mix takes of a row of sizes joined with its source's thresholds; as a share of a word may be left, floored or not."""
    share: Column = F.col("size") * F.col("_left_next") / F.col("_in_next")
    share = F.floor(share).cast("long") if in_words else share
    extra = (
        F.when(F.col("_at_first").isNull() | (F.col("_first") < F.col("_at_first")), F.when(F.col("_budget") > 0, F.col("size")).otherwise(0))
        .when(F.col("_first") > F.col("_at_first"), 0)
        .when(F.col("_next") < F.col("_at_next"), F.col("size"))
        .when(F.col("_next") > F.col("_at_next"), 0)
        .otherwise(share)
    )
    return F.col("_whole") * F.col("size") + extra


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken.

    taken is whole repeats of the document for the whole part of target / source_size and, for the rest, the document again
    if its place is below the source's threshold; documents of the boundary cell take a share of what is left. Null texts
    have size 0, a null source is a source of its own, rows that repeat a doc_id share a place, a null doc_id has the place of
    an empty text. A source without words has target 0. An empty table gives none; other columns are not read.
    """
    sized = stored(sizes(docs), "sizes")
    return sized.join(_thresholds(sized, weights, most), "_source").select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs as often as the mix takes them, to whole documents (half a document or more counts as one); all columns.

    The copies of a row follow from its own size and share, whether its doc_id is null or comes again. Rows without a doc_id
    have one place and so one share: of it, each counts as one more by a hash of its text, or all or none of them would. Rows
    without words are never taken.
    """
    goal = _thresholds(stored(sizes(docs), "sizes"), weights, most)
    hashed = F.pmod(F.xxhash64(F.col("_row.text").cast("string")), F.lit(1_000_003)) / 1_000_003
    rows = sizes(docs, F.struct(*[docs[c] for c in docs.columns]).alias("_row")).where("size > 0").join(goal, "_source")
    times = F.floor(F.when(F.col("doc_id").isNull(), _taken(False) / F.col("size") + hashed).otherwise(_taken() / F.col("size") + 0.5)).cast("int")
    rows = rows.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times")))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


#: The same result as SQL; thresholds are written as running sums over all cells at once.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('v' || source, 'n') AS s,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS f, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 4, 3) AS g
  FROM documents),
by_source AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY s),
weighed AS (
  SELECT s, source_size, CAST([1, 2, 3][CAST((row_number() OVER (ORDER BY s = 'n', s) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w, source_size * 3 AS cap FROM by_source),
ratios AS (SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS r FROM weighed),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS l
  FROM ratios WINDOW b AS (ORDER BY r, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT s, source_size, CASE WHEN r < level THEN CAST(cap AS DOUBLE) ELSE level * w END AS target
  FROM (SELECT *, max(CASE WHEN l <= r THEN l END) OVER () AS level FROM levels)),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goal),
cells AS (
  SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS budget,
         CAST(coalesce(sum(words) OVER (PARTITION BY s ORDER BY f, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM (SELECT s, f, g, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY s, f, g) JOIN budgets USING (s))
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN before + words <= budget THEN size WHEN before >= budget THEN 0
            ELSE floor(CAST(size * (budget - before) AS DOUBLE) / words) END AS BIGINT) AS taken
FROM sized JOIN cells USING (s, f, g)
"""

"""Orders over whole tables, without one task that holds them: ranges of the order, and what lies before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, stored, with _part: the number of a range of `order`, ascending. Rows equal in `order` are in one range."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def running(df: DataFrame, order: str, amount: Column, into: str) -> DataFrame:
    """df with the sum of `amount` over all rows before, in the order of a column: within a range by its task, of ranges by their sums."""
    rows = ranged(df, [order], "running")
    parts = rows.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(parts, "_part").select(*df.columns, (F.col("_before") + F.coalesce(F.sum(amount).over(here), F.lit(0))).alias(into))

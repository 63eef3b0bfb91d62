"""Positions, running sums and values carried along a total order, without gathering rows in one task.

Rows are dealt out by ranges of the order; within a range a window does the work, and between ranges only one
summary row each (as many as there are partitions) is added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """`df` with part_ and at_: its range, and its place in the range. Written, so that both passes see the same ranges."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    return cut(ranged.withColumn("part_", F.shiftright("at_", 33).cast("int")).withColumn("at_", F.col("at_").bitwiseAND((1 << 33) - 1)))


def _with_before(ranged: DataFrame, summary: Column, zero: Column) -> DataFrame:
    """`ranged` with before_: the sum of `summary` over all earlier ranges."""
    parts = ranged.groupBy("part_").agg(summary.alias("own_"))  # a row for each range
    before = F.sum("own_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(parts.select("part_", F.coalesce(before, zero).alias("before_"))), "part_")


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` with `name`: the row's position from 0 in the order of the columns `order`, which should be a total one."""
    both = _with_before(_ranged(df, order), F.count(F.lit(1)), F.lit(0).cast("long"))
    return both.withColumn(name, F.col("before_") + F.col("at_")).drop("part_", "at_", "before_")


def running_sum(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """`df` with `name`: the sum of `value` over all rows before this one."""
    both = _with_before(_ranged(df.withColumn("value_", value), order), F.sum("value_"), F.lit(0).cast("long"))
    within = F.sum("value_").over(Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn(name, (F.col("before_") + F.coalesce(within, F.lit(0))).cast("long")).drop("part_", "at_", "before_", "value_")


def carry_last(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """`df` with `name`: the last value that isn't null among this row and those before it."""
    ranged = _ranged(df, order)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("at_")))
    parts = ranged.groupBy("part_").agg(last.alias("own_"))
    before = F.last("own_", ignorenulls=True).over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    both = ranged.join(F.broadcast(parts.select("part_", before.alias("before_"))), "part_")
    within = F.last(value, ignorenulls=True).over(Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, F.coalesce(within, F.col("before_"))).drop("part_", "at_", "before_")

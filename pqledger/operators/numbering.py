"""Positions of rows in an order without a window over all of them: range partitions, their counts, and prefix sums.

Neither one key nor the whole table meets in one task, whatever the order's keys are: rows are dealt by ranges of the whole
order, numbered within their partition, and only one count for each partition is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Row numbers within a partition, as Spark's increasing ids hold them: the lower 33 bits.
ROW_BITS = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "position") -> DataFrame:
    """df with each row's position in the order, from 1. The dealt rows are written before they are counted, so numbers
    don't change when a task runs again; rows that are equal in the order get different numbers, in no stated order."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    rows = scratch.store(dealt.withColumns({"_part": F.spark_partition_id(), "_own": own}), "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_part", "_own", "_before")  # a row for each partition


def numbered_within(df: DataFrame, group: list[str], order: list[Column], scratch: Scratch, name: str = "position") -> DataFrame:
    """df with each row's position within its group, from 1: its position among all rows, less the group's first one. A
    group with most of the rows spans many tasks; groups must not have null keys."""
    rows = numbered(df, [*[F.col(c) for c in group], *order], scratch, "_at")
    first = rows.groupBy(*group).agg(F.min("_at").alias("_first"))
    return rows.join(first, group).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")

"""Dealing distinct values into ranges that follow their number, and counting what lies before each.

Order statistics and ranks over a whole table are the same two steps: distinct values with their
counts are stored in ranges of about equal size, and a range needs only the count before it, so each
is worked on by itself. There are as many ranges as the distinct values ask for; no table is small
or large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

SLICE_ROWS = 100_000


def sliced(counted: DataFrame, by: list[str], rows: int = SLICE_ROWS) -> DataFrame:
    """The stored rows of `counted`, distinct in `by`, with the number of their range in that order as `slice`."""
    counted = cut(counted)
    count = -(-max(1, counted.count()) // rows)
    # Stored with the number of the partition they were ranged into, so it holds however they are read.
    return cut(counted.repartitionByRange(count, *by).withColumn("slice", F.spark_partition_id()))


def before(rows: DataFrame, weight: str, keys: list[str] = (), descending: bool = False) -> DataFrame:
    """(keys, slice, size, before): the weight of every range and of the ranges before it, per key."""
    sizes = rows.groupBy(*keys, "slice").agg(F.sum(weight).alias("size"))
    order = F.desc("slice") if descending else F.asc("slice")
    # One row per range: a hundred-thousandth of the distinct values.
    earlier = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))

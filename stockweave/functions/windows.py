"""Row-based windows over a daily series.

A series is one (outlet, product) pair with at most one row per calendar day, so a window
partition is bounded by the number of days on record (365 rows a year) whatever the size
of the table: a large outlet adds series, never rows to a series. `quality.unique_key`
reports inputs that break this.

Every helper uses the same partitioning and ordering, so a chain of them is planned as one
exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .exprs import ColumnLike, as_col

SERIES = ("outlet_id", "product_id")
DAY_KEY = (*SERIES, "date")

START = Window.unboundedPreceding


def series(keys=SERIES, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def guarded(value: ColumnLike, aggregate, frame: WindowSpec, min_rows: int) -> Column:
    """An aggregate over a frame, NULL while fewer than `min_rows` values are in it."""
    column = as_col(value)
    if aggregate is median:
        return median(column, frame, min_rows)
    return F.when(F.count(column).over(frame) >= min_rows, aggregate(column).over(frame))


def rolling(value: ColumnLike, rows: int, aggregate=F.avg, min_rows: int | None = None,
            keys=SERIES, include_today: bool = False) -> Column:
    """Aggregate over the last `rows` rows, by default those before the current one."""
    frame = series(keys)
    frame = frame.rowsBetween(1 - rows, 0) if include_today else frame.rowsBetween(-rows, -1)
    return guarded(value, aggregate, frame, rows if min_rows is None else min_rows)


def expanding(value: ColumnLike, aggregate=F.avg, min_rows: int = 1, keys=SERIES,
              include_today: bool = False) -> Column:
    """Aggregate over everything before the current row."""
    frame = series(keys).rowsBetween(START, 0 if include_today else -1)
    return guarded(value, aggregate, frame, min_rows)


def lagged(value: ColumnLike, rows: int = 1, keys=SERIES) -> Column:
    return F.lag(as_col(value), rows).over(series(keys))


def running_count(condition: Column, keys=SERIES) -> Column:
    """How often a condition has held so far, the current row included."""
    frame = series(keys).rowsBetween(START, 0)
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)).over(frame), F.lit(0))


def median(value: ColumnLike, frame: WindowSpec, min_rows: int = 1) -> Column:
    """Exact median over a frame, NULL while fewer than `min_rows` values are in it.

    The frame's values are gathered in one array, which a series keeps short, and sorted; a
    percentile would build a table of counts for every row.
    """
    ordered = F.sort_array(F.collect_list(as_col(value)).over(frame))

    def middle(values: Column) -> Column:
        n = F.size(values)
        low, high = F.get(values, ((n - 1) / 2).cast("int")), F.get(values, (n / 2).cast("int"))
        return F.when(n >= max(min_rows, 1), low + (high - low) * 0.5)

    return F.get(F.transform(F.array(ordered), middle), 0)

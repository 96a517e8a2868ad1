"""Exact order statistics and linear quantiles of whole columns, many columns and ranks at once.

Thresholds are linearly interpolated quantiles, so a sketch is not enough; but a `percentile` over
a whole table gathers every distinct value in one task. Here the distinct values of all columns are
counted in one pass and stored in ranges (`slices`); the counts before each range say which one
holds a rank, and the rank is found inside it. The number of jobs depends neither on the columns nor
on the ranks, and only the values found reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ColumnLike, as_col
from .slices import SLICE_ROWS, before, sliced

Ranks = Callable[[int], list[int]]


def select_ranks(long: DataFrame, ranks: Ranks | Mapping[str, Ranks], rows: int = SLICE_ROWS) -> dict[str, tuple[int, dict[int, float]]]:
    """{feature: (number of values, {rank: value})} of a (feature, value) table.

    `ranks(n)` says which 0-based ranks are wanted of a feature with n values, for all features or
    for each. NULL values are not counted, and a feature without values is not in the result.
    """
    counted = (long.select("feature", F.col("value").cast("double").alias("value")).filter("value IS NOT NULL")
               .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    parts = sliced(counted, ["feature", "value"], rows)
    totals = {r["feature"]: r["n"] for r in parts.groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # one row per column
    wanted = [(f, r) for f, n in totals.items() for r in sorted(set((ranks if callable(ranks) else ranks[f])(n)))]
    found: dict[str, dict[int, float]] = {f: {} for f in totals}
    if wanted:
        # As many rows as ranks are asked for.
        asked = F.broadcast(long.sparkSession.createDataFrame(wanted, "feature string, rank long"))
        held = before(parts, "n", ["feature"]).join(asked, "feature").filter("rank >= before AND rank < before + size")
        inside = held.groupBy("feature", "slice", "before").agg(F.collect_set("rank").alias("ranks"))
        upto = Window.partitionBy("feature", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ends = parts.join(inside, ["feature", "slice"]).withColumn("end", F.col("before") + F.sum("n").over(upto))
        hits = F.filter("ranks", lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end")))
        for row in ends.select("feature", "value", F.explode(hits).alias("rank")).collect():
            found[row["feature"]][row["rank"]] = row["value"]
    return {f: (n, found[f]) for f, n in totals.items()}


def as_long(df: DataFrame, columns: Mapping[str, ColumnLike]) -> DataFrame:
    """(feature, value) of several columns, from one scan."""
    pairs = [F.struct(F.lit(name).alias("feature"), as_col(c).cast("double").alias("value")) for name, c in columns.items()]
    return df.select(F.inline(F.array(*pairs)))


def order_statistics(df: DataFrame, value: ColumnLike, ranks: Ranks, rows: int = SLICE_ROWS) -> tuple[int, dict[int, float]]:
    """(number of values, {rank: value}) for the 0-based ranks that `ranks(n)` asks for."""
    return select_ranks(as_long(df, {"value": value}), ranks, rows).get("value", (0, {}))


def quantile_ranks(probabilities) -> Ranks:
    return lambda n: [r for p in probabilities for r in (floor(p * (n - 1)), ceil(p * (n - 1)))]


def interpolate(found: dict[int, float], n: int, probability: float) -> float:
    position = probability * (n - 1)
    low, high = floor(position), ceil(position)
    return found[low] + (found[high] - found[low]) * (position - low)


def feature_quantiles(long: DataFrame, probabilities, rows: int = SLICE_ROWS) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of every feature of a (feature, value) table that has a value."""
    found = select_ranks(long, quantile_ranks(probabilities), rows)
    return {f: [interpolate(values, n, p) for p in probabilities] for f, (n, values) in found.items()}


def column_quantiles(df: DataFrame, columns: Mapping[str, ColumnLike], probabilities, rows: int = SLICE_ROWS) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns; None for each of a column without a value."""
    found = feature_quantiles(as_long(df, columns), probabilities, rows)
    return {name: found.get(name, [None] * len(probabilities)) for name in columns}


def exact_quantiles(df: DataFrame, value: ColumnLike, probabilities: list[float], rows: int = SLICE_ROWS) -> list[float | None]:
    """Linearly interpolated quantiles of a column; None for each when it has no value."""
    return column_quantiles(df, {"value": value}, probabilities, rows)["value"]

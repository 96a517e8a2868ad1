"""Chronological splits. The distinct days of a table are bounded by the calendar, so their
sorted list is the one thing gathered here."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_days(df: DataFrame, day: str = "date") -> list[date]:
    rows = df.select(F.col(day).cast("date").alias("day")).filter("day IS NOT NULL").distinct().collect()
    return sorted(r["day"] for r in rows)


def _label(df: DataFrame, second: date, third: date, names, day: str) -> DataFrame:
    d = F.col(day).cast("date")
    return df.withColumn("split", F.when(d >= F.lit(third), names[2]).when(d >= F.lit(second), names[1])
                         .when(d.isNotNull(), names[0]))


def last_days_split(df: DataFrame, validation_days: int = 30, test_days: int = 30, day: str = "date",
                    names=("train", "validation", "test")) -> DataFrame:
    """Label rows by the last N distinct days: train, validation, test."""
    days = distinct_days(df, day)
    if len(days) <= validation_days + test_days:
        raise ValueError("not enough days for the requested validation and test windows")
    return _label(df, days[-(validation_days + test_days)], days[-test_days], names, day)


def fraction_split(df: DataFrame, first: float = 0.70, second: float = 0.85, day: str = "date",
                   names=("train", "calibration", "evaluation")) -> DataFrame:
    """Label rows by the position of their day among the distinct days."""
    days = distinct_days(df, day)
    a, b = int(len(days) * first), int(len(days) * second)
    if not 0 < a < b < len(days):
        raise ValueError("not enough days for a three-way split")
    return _label(df, days[a], days[b], names, day)


def before(df: DataFrame, cutoff: date, day: str = "date") -> DataFrame:
    return df.filter(F.col(day) < F.lit(cutoff))


def keep_last(df: DataFrame, newer: DataFrame, keys) -> DataFrame:
    """Union in which a row of the newer frame replaces the older one with the same key."""
    both = df.withColumn("_age", F.lit(1)).unionByName(newer.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    row = F.struct(*[c for c in both.columns if c not in (*keys, "_age")])
    # An aggregate, not a window: repeated rows of a key are reduced before the shuffle.
    return both.groupBy(*keys).agg(F.min_by(row, "_age").alias("_row")).select(*keys, "_row.*")

"""Series summaries and the choice of demonstration series from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import SERIES

TINY = 1e-6


def series_summary(df: DataFrame, demand: str = "quantity_sold", stockout: str | None = "stockout", recent: int = 28) -> DataFrame:
    """Level, spread, growth, peak and stockout share of every series in one aggregation."""
    back = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("date")))
    x, last = F.col(demand), F.col("_back") <= recent
    out = F.col(stockout).cast("double") if stockout and stockout in df.columns else F.lit(0.0)
    one = df.withColumn("_back", back).groupBy(*SERIES).agg(
        F.avg(x).alias("mean_demand"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std_demand"),
        F.max(x).alias("max_demand"), F.min(x).alias("min_demand"), F.count(x).alias("observations"),
        F.avg(F.when(last, x)).alias("recent_mean"), F.avg(F.when(~last, x)).alias("historical_mean"),
        F.max(F.when(last, x)).alias("recent_max"),
        F.coalesce(F.avg(F.when(last, out)), F.lit(0.0)).alias("recent_stockout"))
    one = one.withColumns({
        "recent_mean": F.coalesce("recent_mean", "mean_demand"),
        "historical_mean": F.coalesce("historical_mean", "mean_demand"),
        "cv": F.col("std_demand") / F.greatest("mean_demand", F.lit(TINY)),
    })
    base = F.greatest("historical_mean", F.lit(TINY))
    return one.withColumns({
        "recent_growth": (F.col("recent_mean") - F.col("historical_mean")) / base,
        "spike_ratio": F.col("recent_max") / base,
    })


def _first(summary: DataFrame, preferred, order, fallback_order=None, min_history: int = 35) -> DataFrame:
    """Best preferred series, or the best one with enough history when none qualifies.

    Preference is the leading sort key, so one top-1 pass decides both.
    """
    wanted = F.coalesce(preferred, F.lit(False))
    fallback_order = fallback_order if fallback_order is not None else order
    key = F.when(wanted, order).otherwise(fallback_order)
    return (summary.filter(F.col("observations") >= min_history)
            .orderBy(F.desc(wanted.cast("int")), F.desc(F.round(key, 9)), *SERIES).limit(1))


def normal_series(summary: DataFrame, min_history: int = 35) -> DataFrame:
    calm = (F.col("cv").between(0.05, 0.35) & (F.abs("recent_growth") <= 0.10) & (F.col("recent_stockout") <= 0.05))
    score = F.abs(F.col("cv") - 0.18) + F.abs("recent_growth")
    return _first(summary, calm, -score, min_history=min_history)


def spike_series(summary: DataFrame, min_history: int = 35) -> DataFrame:
    return _first(summary, F.col("spike_ratio") >= 1.25, F.col("spike_ratio"), min_history=min_history)


def shortage_series(summary: DataFrame, min_history: int = 35) -> DataFrame:
    fallback = F.col("cv") + F.greatest("recent_growth", F.lit(0.0))
    return _first(summary, F.col("recent_stockout") > 0, F.col("recent_stockout"), fallback, min_history)


def growth_series(summary: DataFrame, min_history: int = 35) -> DataFrame:
    return _first(summary, F.col("recent_growth") >= 0.15, F.col("recent_growth"), min_history=min_history)


def low_demand_series(summary: DataFrame, min_history: int = 35) -> DataFrame:
    return _first(summary, F.lit(True), -F.col("mean_demand"), min_history=min_history)


def longest_series(df: DataFrame, limit: int) -> DataFrame:
    """The series with most rows (a report, not a cost limit)."""
    return (df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("rows"))
              .orderBy(F.desc("rows"), *SERIES).limit(limit))


def long_series(df: DataFrame, minimum_rows: int) -> DataFrame:
    """Every series with at least so many rows."""
    return df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= minimum_rows)


def only_series(df: DataFrame, chosen: DataFrame) -> DataFrame:
    return df.join(chosen.select(*SERIES).distinct(), list(SERIES), "left_semi")


def best_demo_series(summary: DataFrame, min_history: int = 60) -> DataFrame:
    score = 0.5 * F.col("mean_demand") + 0.5 * F.col("recent_mean")
    return (summary.filter(F.col("observations") >= min_history).withColumn("selection_score", score)
            .orderBy(F.desc(F.round("selection_score", 9)), *SERIES).limit(1))

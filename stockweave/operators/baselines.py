"""Baseline forecasts and their backtest, for every series at once.

The state of a series is an array of its last few values; no rectangular input is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import SERIES

METHODS = ("naive", "seasonal_naive", "moving_average")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def forecast_value(method: str, tail: Column, step: Column, season: int = 7, window: int = 7) -> Column:
    """One baseline value from the tail of a history (oldest first); never negative."""
    last = F.try_element_at(tail, F.lit(-1))
    if method == "naive":
        value = last
    elif method == "seasonal_naive":
        cycle = F.slice(tail, -season, season)
        value = F.when(F.size(tail) >= season, F.get(cycle, (step - 1) % season)).otherwise(last)
    elif method == "moving_average":
        value = _mean(F.slice(tail, -F.least(F.size(tail), F.lit(window)), F.lit(window)))
    else:
        raise ValueError(f"method must be one of {METHODS}")
    return F.greatest(value, F.lit(0.0))


def _from_end(df: DataFrame, keys) -> DataFrame:
    return df.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date"))))


def _tail(target: str, skip: int, length: int) -> Column:
    """The `length` values before the last `skip`, oldest first, inside a groupBy."""
    kept = F.when((F.col("_back") > skip) & (F.col("_back") <= skip + length),
                  F.struct((-F.col("_back")).alias("order"), F.col(target).cast("double").alias("value")))
    return F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["value"])


def baseline_forecast(history: DataFrame, horizon: int, methods=METHODS, target: str = "quantity_sold",
                      keys=SERIES, season: int = 7, window: int = 7) -> DataFrame:
    """(keys, date, horizon, method, prediction) for the days after each series' last one."""
    tails = _from_end(history, keys).groupBy(*keys).agg(
        F.max("date").alias("_last"), _tail(target, 0, max(season, window)).alias("_tail"))
    steps = tails.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    made = F.array(*[
        F.struct(F.lit(m).alias("method"),
                 forecast_value(m, F.col("_tail"), F.col("horizon"), season, window).alias("prediction"))
        for m in methods])
    return (steps.withColumn("_made", F.explode(made))
                 .select(*keys, F.date_add("_last", F.col("horizon")).alias("date"), "horizon", "_made.*"))


def backtest_forecasts(df: DataFrame, horizon: int = 7, methods=METHODS, target: str = "quantity_sold",
                       keys=SERIES, season: int = 7, window: int = 7) -> DataFrame:
    """Hold out the last `horizon` rows of a series and forecast them from the rest.

    Train tail and held-out values come from the same grouping, so no join is needed. Series
    without a training row are left out.
    """
    cut = _from_end(df, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        _tail(target, horizon, max(season, window)).alias("_tail"),
        _tail(target, 0, horizon).alias("_actual")).filter(F.col("_rows") > horizon)
    steps = cut.select(*keys, "_tail", F.posexplode("_actual").alias("_at", "actual"))
    steps = steps.withColumn("horizon", F.col("_at") + 1)
    made = F.array(*[
        F.struct(F.lit(m).alias("model_name"),
                 forecast_value(m, F.col("_tail"), F.col("horizon"), season, window).alias("predicted"))
        for m in methods])
    return steps.withColumn("_made", F.explode(made)).select(*keys, "horizon", "actual", "_made.*")


def horizon_summary(forecasts: DataFrame, horizons=(1, 3, 7)) -> DataFrame:
    """Rows, total and mean per nested horizon; a day belongs to every horizon that covers it."""
    covered = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: h >= F.col("step"))
    return (forecasts.withColumnRenamed("horizon", "step").withColumn("horizon", F.explode(covered))
            .groupBy("horizon").agg(F.count(F.lit(1)).alias("rows"), F.sum("prediction").alias("total_forecast"),
                                    F.avg("prediction").alias("mean_forecast")))


def pivot_horizon(forecasts: DataFrame, keys=SERIES, steps: int = 7) -> DataFrame:
    """One column per forecast day: d1 .. d7. The values are named, so no extra job finds them."""
    wide = forecasts.groupBy(*keys).pivot("horizon", list(range(1, steps + 1))).agg(F.first("prediction"))
    return wide.withColumnsRenamed({str(h): f"d{h}" for h in range(1, steps + 1)})

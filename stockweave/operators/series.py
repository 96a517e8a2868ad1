"""Lag, rolling, trend and relation features of a daily series.

Everything about the current day's target is excluded: frames end one row before it. All
windows of one operator share the (outlet, product) partitioning, so a chain of operators
costs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio, require_columns, to_number
from ..functions.windows import SERIES, expanding, lagged, rolling, series
from ..plans.lineage import cut
from . import calendar

TARGET = "quantity_sold"
LAGS = (1, 2, 3, 7, 14, 28)
WINDOWS = (3, 7, 14, 28)
EPS = 1e-6

# The 16 inputs of the compact forecasting contract, in model order.
COMPACT_FEATURES = (
    "lag_1", "lag_2", "lag_3", "lag_7", "lag_14", "lag_28",
    "rolling_mean_3", "rolling_mean_7", "rolling_mean_14", "rolling_mean_28",
    "rolling_std_7", "rolling_std_28",
    "day_of_week", "month", "day_of_month", "is_weekend",
)


def lag_features(df: DataFrame, target: str = TARGET, keys=SERIES, lags=LAGS) -> DataFrame:
    return df.withColumns({f"lag_{k}": lagged(target, k, keys) for k in lags})


def rolling_features(df: DataFrame, target: str = TARGET, keys=SERIES) -> DataFrame:
    made = {}
    for n in WINDOWS:
        made[f"rolling_mean_{n}"] = rolling(target, n, F.avg, keys=keys)
        made[f"rolling_std_{n}"] = rolling(target, n, F.stddev_samp, keys=keys)
    return df.withColumns(made)


def trend_features(df: DataFrame, target: str = TARGET, keys=SERIES) -> DataFrame:
    one, two, seven, fourteen = (lagged(target, k, keys) for k in (1, 2, 7, 14))
    return df.withColumns({
        "trend_1d": one - two,
        "trend_7d": one - seven,
        "trend_14d": one - fourteen,
        "trend_ratio_7d": ratio(one, seven),
        "trend_ratio_14d": ratio(one, fourteen),
        "trend_acceleration": (one - seven) - (one - fourteen),
    })


def volatility_features(df: DataFrame, target: str = TARGET, keys=SERIES) -> DataFrame:
    made = {}
    for n in WINDOWS:
        spread = rolling(target, n, F.stddev_samp, keys=keys)
        made[f"volatility_{n}"] = spread
        made[f"coefficient_variation_{n}"] = ratio(spread, rolling(target, n, F.avg, keys=keys))
    return df.withColumns(made)


def order_velocity(df: DataFrame, target: str = TARGET, keys=SERIES) -> DataFrame:
    mean = {n: rolling(target, n, F.avg, keys=keys) for n in (3, 7, 14)}
    made: dict[str, Column] = {f"order_velocity_{n}d": c for n, c in mean.items()}
    made["order_velocity_change"] = mean[3] - mean[14]
    return df.withColumns(made)


def _from_base() -> dict[str, Column]:
    """Trend, volatility and velocity as plain expressions over lag and rolling columns."""
    one, seven, fourteen = (F.col(f"lag_{k}") for k in (1, 7, 14))
    mean = {n: F.col(f"rolling_mean_{n}") for n in WINDOWS}
    out = {
        "trend_1d": one - F.col("lag_2"),
        "trend_7d": one - seven,
        "trend_14d": one - fourteen,
        "trend_ratio_7d": ratio(one, seven),
        "trend_ratio_14d": ratio(one, fourteen),
        "trend_acceleration": (one - seven) - (one - fourteen),
    }
    for n in WINDOWS:
        out[f"volatility_{n}"] = F.col(f"rolling_std_{n}")
        out[f"coefficient_variation_{n}"] = ratio(f"rolling_std_{n}", mean[n])
    out |= {f"order_velocity_{n}d": mean[n] for n in (3, 7, 14)}
    out["order_velocity_change"] = mean[3] - mean[14]
    return out


def model_features(df: DataFrame, target: str = TARGET, keys=SERIES, date: str = "date") -> DataFrame:
    """The full feature set of the boosted-tree forecaster: calendar, series, context.

    Lags and rolling statistics are computed once; the other series features are expressions
    over them, equal to what their own operators give.
    """
    df = calendar.time_features(df, date)
    if target in df.columns and set(keys) <= set(df.columns):
        df = df.transform(lag_features, target, keys).transform(rolling_features, target, keys)
        df = df.withColumns(_from_base())
    return calendar.context_features(calendar.seasonality(df))


# Names `model_features` adds that a model may read (51 with a full context table).
TIME_FEATURES = ("year", "month", "day", "day_of_week", "week_of_year", "day_of_year", "quarter",
                 "is_weekend", "dow_sin", "dow_cos", "month_sin", "month_cos")
SERIES_FEATURES = (
    *(f"lag_{k}" for k in LAGS),
    *(f"rolling_{s}_{n}" for n in WINDOWS for s in ("mean", "std")),
    "trend_1d", "trend_7d", "trend_14d", "trend_ratio_7d", "trend_ratio_14d", "trend_acceleration",
    *(f"{s}_{n}" for n in WINDOWS for s in ("volatility", "coefficient_variation")),
    "order_velocity_3d", "order_velocity_7d", "order_velocity_14d", "order_velocity_change",
)
SEASON_FEATURES = ("dow_sin_2", "dow_cos_2", "month_sin_2", "month_cos_2", "quarter_sin",
                   "quarter_cos", "weekend_month_interaction")
MODEL_FEATURES = (*TIME_FEATURES, *SERIES_FEATURES, *SEASON_FEATURES)


def compact_features(df: DataFrame, target: str = TARGET, keys=SERIES) -> DataFrame:
    """The 16-feature contract: means start with one value, deviations with two."""
    require_columns(df, [*keys, "date", target], "compact_features")
    made: dict[str, Column] = {f"lag_{k}": lagged(target, k, keys) for k in LAGS}
    for n in WINDOWS:
        made[f"rolling_mean_{n}"] = rolling(target, n, F.avg, 1, keys)
    for n in (7, 28):
        made[f"rolling_std_{n}"] = rolling(target, n, F.stddev_samp, 2, keys)
    made |= {
        "day_of_week": F.weekday("date"),
        "month": F.month("date"),
        "day_of_month": F.dayofmonth("date"),
        "is_weekend": (F.weekday("date") >= 5).cast("int"),
    }
    return df.withColumns(made)


def demand_dynamics(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Differences, ratios, momentum, persistence, intermittency and variation."""
    require_columns(df, [*SERIES, "date", target], "demand_dynamics")
    df = df.withColumns({
        **{f"advanced_demand_lag_{k}": lagged(target, k) for k in (1, 2, 7, 14, 28)},
        **{f"advanced_mean_{n}": rolling(target, n, F.avg, 1) for n in WINDOWS},
        **{f"advanced_std_{n}": rolling(target, n, F.stddev_samp, 2) for n in (7, 14, 28)},
        # The first, empty history slot counts as a row of the 28-row window.
        "advanced_nonzero_rate_28":
            rolling(F.when(F.col(target) > 0, 1.0).when(F.col(target).isNotNull(), 0.0), 28, F.sum, 1)
            / F.least(F.row_number().over(series()), F.lit(28)),
    })
    lag = {k: F.col(f"advanced_demand_lag_{k}") for k in (1, 2, 7, 14, 28)}
    mean = {n: F.col(f"advanced_mean_{n}") for n in WINDOWS}
    made: dict[str, Column] = {}
    for k, other in ((1, 2), (7, 7), (14, 14), (28, 28)):
        made[f"advanced_demand_diff_{k}"] = lag[1] - lag[other]
    for a, b in ((1, 7), (1, 14), (1, 28), (7, 14), (14, 28)):
        made[f"advanced_lag_ratio_{a}_{b}"] = ratio(lag[a], lag[b])
    for a, b in ((3, 7), (7, 14), (14, 28)):
        made[f"advanced_momentum_{a}_{b}"] = mean[a] - mean[b]
    made["advanced_acceleration"] = (mean[3] - mean[7]) - (mean[7] - mean[14])
    for n in (7, 14):
        made[f"advanced_persistence_{n}"] = lag[1] / (F.abs(mean[n]) + EPS)
        made[f"advanced_intensity_{n}"] = mean[n] / (F.abs(mean[28]) + EPS)
    made["advanced_persistence"] = made["advanced_persistence_7"]
    made["advanced_intermittency_28"] = 1.0 - F.col("advanced_nonzero_rate_28")
    for n in (7, 14, 28):
        made[f"advanced_cv_{n}"] = F.col(f"advanced_std_{n}") / (F.abs(mean[n]) + EPS)
    return df.withColumns(made)


def outlet_product_features(df: DataFrame, target: str = TARGET) -> DataFrame:
    """How a pair relates to its outlet and to its product, from lagged demand only.

    Outlet-day and product-day totals are aggregated first (partial aggregation keeps a
    dominant outlet or product from landing in one task) and their running statistics are
    computed on those small tables, then joined back. The rows with their lag are stored once,
    since all three branches read them.
    """
    require_columns(df, [*SERIES, "date", target], "outlet_product_features")
    df = cut(df.withColumns({
        "_history": lagged(target).cast("double"),
        "advanced_pair_mean": expanding(target, F.avg, 1),
        "advanced_pair_std": expanding(target, F.stddev_samp, 2),
    }))

    def level(key: str, name: str) -> DataFrame:
        daily = df.groupBy(key, "date").agg(
            F.coalesce(F.sum("_history"), F.lit(0.0)).alias(f"_{name}_total"))
        return daily.withColumns({
            f"advanced_{name}_mean": expanding(f"_{name}_total", F.avg, 1, (key,), include_today=True),
            f"advanced_{name}_std": expanding(f"_{name}_total", F.stddev_samp, 2, (key,), include_today=True),
        })

    df = (df.join(level("outlet_id", "outlet"), ["outlet_id", "date"], "left")
            .join(level("product_id", "product"), ["product_id", "date"], "left"))
    pair, outlet, product = (F.col(f"advanced_{n}_mean") for n in ("pair", "outlet", "product"))
    df = df.withColumns({
        "advanced_pair_cv": F.col("advanced_pair_std") / (F.abs(pair) + EPS),
        "advanced_outlet_mean_demand": outlet,
        "advanced_product_mean_demand": product,
        "advanced_outlet_relative_demand": pair / (F.abs(outlet) + EPS),
        "advanced_product_relative_demand": pair / (F.abs(product) + EPS),
        "advanced_product_share_of_outlet": F.col("_history") / (F.abs("_outlet_total") + EPS),
        "advanced_outlet_share_of_product": F.col("_history") / (F.abs("_product_total") + EPS),
        "advanced_pair_vs_outlet": pair - outlet,
        "advanced_pair_vs_product": pair - product,
        "advanced_pair_intensity": pair / (F.abs(product) + EPS),
        "advanced_outlet_product_affinity": pair / (F.abs(outlet * product) + EPS),
    })
    return df.drop("_history", "_outlet_total", "_product_total")


def history_calendar(date: str = "date") -> dict[str, Column]:
    """Calendar parts in the naming of the two history feature sets."""
    return {
        "calendar_dow": F.weekday(date),
        "calendar_month": F.month(date),
        "calendar_day": F.dayofmonth(date),
        "calendar_week": F.weekofyear(date),
        "calendar_quarter": F.quarter(date),
        "calendar_day_of_year": F.dayofyear(date),
        "calendar_weekend": (F.weekday(date) >= 5).cast("int"),
    }


HISTORY_LAGS = (1, 2, 3, 7, 14, 21, 28)


def temporal_features(df: DataFrame, target: str = TARGET) -> DataFrame:
    """History features of the context ablation; statistics start with two values."""
    require_columns(df, [*SERIES, "date", target], "temporal_features")
    df = df.withColumn(target, to_number(target)).dropna(subset=[*SERIES, "date", target])
    made: dict[str, Column] = {f"history_lag_{k}": lagged(target, k) for k in HISTORY_LAGS}
    for n in WINDOWS:
        made[f"history_mean_{n}"] = rolling(target, n, F.avg, 2)
        made[f"history_std_{n}"] = rolling(target, n, F.stddev_samp, 2)
    df = df.withColumns(made)
    dow = calendar.cycle(F.weekday("date"), 7)
    month = calendar.cycle(F.month("date"), 12)
    made = {f"history_trend_{k}": F.col("history_lag_1") / (F.col(f"history_lag_{k}") + EPS) for k in (7, 28)}
    for n in (7, 28):
        made[f"history_volatility_{n}"] = F.col(f"history_std_{n}") / (F.col(f"history_mean_{n}") + EPS)
    made |= history_calendar()
    made |= {"calendar_dow_sin": dow[0], "calendar_dow_cos": dow[1],
             "calendar_month_sin": month[0], "calendar_month_cos": month[1]}
    return df.withColumns(made)


def historical_features(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Lags, rolling mean, deviation and maximum, ratios and calendar; missing reads as 0."""
    require_columns(df, [*SERIES, "date", target], "historical_features")
    made: dict[str, Column] = {f"lag_{k}": lagged(target, k) for k in HISTORY_LAGS}
    for n in WINDOWS:
        made[f"rolling_mean_{n}"] = rolling(target, n, F.avg, 1)
        made[f"rolling_std_{n}"] = rolling(target, n, F.stddev_samp, 2)
        made[f"rolling_max_{n}"] = rolling(target, n, F.max, 1)
    df = df.withColumns(made)
    second = {f"trend_{a}_{b}": ratio(f"rolling_mean_{a}", f"rolling_mean_{b}") for a, b in ((7, 28), (3, 14))}
    second |= {f"volatility_{n}": ratio(f"rolling_std_{n}", f"rolling_mean_{n}") for n in (7, 28)}
    df = df.withColumns(second)
    dow = calendar.cycle(F.weekday("date"), 7)
    month = calendar.cycle(F.month("date"), 12)
    filled = {name: F.coalesce(F.col(name), F.lit(0.0)) for name in (*made, *second)}
    return df.withColumns(filled | history_calendar() | {
        "dow_sin": dow[0], "dow_cos": dow[1], "month_sin": month[0], "month_cos": month[1]})


def history_prediction(df: DataFrame) -> DataFrame:
    """Reference forecast from history only: yesterday, else the 7-row, else the 28-row mean."""
    usable = [F.when(F.col(c) >= 0, F.col(c)) for c in ("lag_1", "rolling_mean_7", "rolling_mean_28")]
    return df.withColumn("prediction", F.coalesce(*usable, F.lit(0.0)))


def recent_state(df: DataFrame, target: str = TARGET, length: int = 28) -> DataFrame:
    """For every row the previous `length` values, oldest first; NULL while incomplete."""
    frame = series().rowsBetween(-length, -1)
    values = F.collect_list(target).over(frame)
    return df.withColumn("sequence", F.when(F.size(values) == length, values))

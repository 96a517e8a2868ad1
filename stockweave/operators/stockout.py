"""Stockout runs, demand reconstruction behind them, and how far sales were censored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, count_where, first_rule, flag, ratio, require_columns, share
from ..functions.windows import (DAY_KEY, SERIES, START, expanding, lagged, median, rolling,
                                 running_count, series)

FLOOR = 1e-9


def _with_inventory(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Left join on the day key, one inventory row per sales row."""
    require_columns(sales, [*DAY_KEY, "quantity_sold"], "sales")
    require_columns(inventory, [*DAY_KEY, "closing_stock", "stockout"], "inventory")
    stock = inventory.select(*DAY_KEY, "closing_stock", "stockout")
    return sales.drop("closing_stock", "stockout").join(stock, list(DAY_KEY), "left")


def estimate_true_demand(sales: DataFrame, inventory: DataFrame, lookback_days: int = 28,
                         min_history: int = 7) -> DataFrame:
    """On a stockout day demand is at least the recent average of sales."""
    if not 0 < min_history <= lookback_days:
        raise ValueError("min_history must lie in 1..lookback_days")
    sold = F.col("quantity_sold").cast("double")
    df = _with_inventory(sales, inventory).withColumn("stockout", flag(F.col("stockout")))
    df = df.withColumn(
        "historical_demand_estimate",
        F.coalesce(rolling("quantity_sold", lookback_days, F.avg, min_history), sold))
    df = df.withColumn(
        "true_demand",
        F.when(F.col("stockout"), F.greatest(sold, "historical_demand_estimate")).otherwise(sold))
    return df.withColumns({
        "lost_demand": clip(F.col("true_demand") - sold, 0.0),
        "fulfillment_rate": share(sold, "true_demand", 1.0),
        "demand_constrained": F.col("true_demand") > sold,
    })


def demand_summary(df: DataFrame) -> DataFrame:
    """One row of totals over an `estimate_true_demand` result."""
    totals = df.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum("true_demand"), F.lit(0.0)).alias("true_demand"),
        F.coalesce(F.sum("quantity_sold"), F.lit(0.0)).alias("observed_sales"),
        F.coalesce(F.sum("lost_demand"), F.lit(0.0)).alias("lost_demand"),
        count_where(F.col("stockout")).alias("stockout_records"),
    )
    return totals.withColumns({
        "stockout_rate": F.coalesce(ratio("stockout_records", "records"), F.lit(0.0)),
        "overall_fulfillment_rate":
            F.when(F.col("true_demand") > 0, ratio("observed_sales", "true_demand")).otherwise(1.0),
    })


def stockout_signals(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Run start, running length and recovery of stockouts.

    A run's length so far is the row's position minus the position of the last clean row.
    """
    df = _with_inventory(sales, inventory).withColumns({
        "closing_stock": F.coalesce(F.col("closing_stock").cast("double"), F.lit(0.0)),
        "stockout": flag(F.col("stockout")),
        "quantity_sold": F.greatest(F.coalesce(F.col("quantity_sold").cast("double"), F.lit(0.0)), F.lit(0.0)),
    })
    so_far = series().rowsBetween(START, 0)
    position = F.row_number().over(series())
    df = df.withColumns({
        "previous_stockout": flag(lagged("stockout")),
        "_position": position,
    })
    last_clean = F.max(F.when(~F.col("stockout"), F.col("_position"))).over(so_far)
    df = df.withColumns({
        "stockout_start": F.col("stockout") & ~F.col("previous_stockout"),
        "stockout_duration": F.col("_position") - F.coalesce(last_clean, F.lit(0)),
        "post_stockout_recovery": ~F.col("stockout") & F.col("previous_stockout"),
        "available": (~F.col("stockout")).cast("int"),
    })
    return df.drop("_position")


def clean_reference(df: DataFrame, lookback_days: int = 56, minimum_clean_days: int = 7) -> DataFrame:
    """What the series sells on days with stock: recent mean and median, weekday and overall mean."""
    df = df.withColumns({
        "clean_sales": F.when(~F.col("stockout"), F.col("quantity_sold")),
        "day_of_week": F.weekday("date"),
    })
    df = df.withColumns({
        "recent_clean_mean": rolling("clean_sales", lookback_days, F.avg, minimum_clean_days),
        "recent_clean_median": rolling("clean_sales", lookback_days, median, minimum_clean_days),
        "all_clean_mean": expanding("clean_sales", F.avg, minimum_clean_days),
    })
    # The weekday frame partitions more finely than the exchange above, so it only re-sorts.
    weekday = (*SERIES, "day_of_week")
    before = series(weekday).rowsBetween(START, -1)
    df = df.withColumns({
        "dow_clean_sum": expanding("clean_sales", F.sum, 1, weekday),
        "dow_clean_count": F.count("clean_sales").over(before),
    })
    return df.withColumn("dow_clean_mean", ratio("dow_clean_sum", "dow_clean_count"))


BLEND = (("recent_clean_mean", 0.45), ("recent_clean_median", 0.25), ("dow_clean_mean", 0.20),
         ("all_clean_mean", 0.10))


def reconstruct_demand(df: DataFrame) -> DataFrame:
    """Blend the references on stockout days; a long run raises them by up to 10 %."""
    parts = [F.col(name) for name, _ in BLEND]
    known = sum((c.isNotNull().cast("int") for c in parts), F.lit(0))
    row_mean = sum((F.coalesce(c, F.lit(0.0)) for c in parts), F.lit(0.0)) / F.nullif(known, F.lit(0))
    blended = sum((F.lit(w) * F.coalesce(F.col(name), row_mean) for name, w in BLEND), F.lit(0.0))
    single = F.coalesce(*parts, F.col("quantity_sold"))
    run = F.greatest(F.coalesce(F.col("stockout_duration"), F.lit(0)) - 1.0, F.lit(0.0))
    reference = (F.when(known >= 2, blended).otherwise(single)
                 * F.least(1.0 + 0.025 * run, F.lit(1.10)))
    sold = F.col("quantity_sold")
    df = df.withColumn(
        "deconstrained_demand",
        F.greatest(F.when(F.col("stockout"), F.greatest(sold, reference)).otherwise(sold), F.lit(0.0)))
    demand = F.col("deconstrained_demand")
    return df.withColumns({
        "estimated_lost_demand": clip(demand - sold, 0.0),
        "estimated_fulfillment_rate": share(sold, demand, 1.0),
        "demand_constrained_estimated": demand > sold,
    })


DECONSTRAINED_COLUMNS = (*DAY_KEY, "quantity_sold", "closing_stock", "stockout", "stockout_duration",
                         "deconstrained_demand", "estimated_lost_demand", "estimated_fulfillment_rate",
                         "demand_constrained_estimated")


def deconstrain(sales: DataFrame, inventory: DataFrame, lookback_days: int = 56,
                minimum_clean_days: int = 7) -> DataFrame:
    """Sales and inventory to demand without stockouts, in eleven columns."""
    if lookback_days < 7 or not 1 <= minimum_clean_days <= lookback_days:
        raise ValueError("lookback_days >= 7 and 1 <= minimum_clean_days <= lookback_days are required")
    return (stockout_signals(sales, inventory)
            .transform(clean_reference, lookback_days, minimum_clean_days)
            .transform(reconstruct_demand)
            .select(*DECONSTRAINED_COLUMNS))


# --- censoring ---------------------------------------------------------------------------

EVENT_INPUT = (*DAY_KEY, "quantity_sold", "deconstrained_demand", "estimated_lost_demand", "stockout")


def stockout_events(df: DataFrame) -> DataFrame:
    """Number the stockout events of a series and the days inside each."""
    require_columns(df, EVENT_INPUT, "stockout_events")
    df = df.withColumn("stockout", flag(F.col("stockout")))
    df = df.withColumn("stockout_event_start", F.col("stockout") & ~flag(lagged("stockout")))
    df = df.withColumn(
        "stockout_event_id",
        F.when(F.col("stockout"), running_count(F.col("stockout_event_start"))).otherwise(0))
    inside = series((*SERIES, "stockout_event_id"))
    return df.withColumns({
        "stockout_event_active": F.col("stockout_event_id") > 0,
        "stockout_event_day": F.when(F.col("stockout"), F.row_number().over(inside)).otherwise(0),
    })


def censoring_signals(df: DataFrame, pre_window: int = 7) -> DataFrame:
    """How strongly a stockout day hides demand, 0 to 1."""
    df = stockout_events(df).withColumns({
        "pre_stockout_demand": rolling("deconstrained_demand", pre_window, F.avg, 1),
        "pre_stockout_sales": rolling("quantity_sold", pre_window, F.avg, 1),
    })
    demand = F.greatest(F.col("deconstrained_demand"), F.lit(FLOOR))
    gap = clip(F.col("deconstrained_demand") - F.col("quantity_sold"), 0.0)
    pressure = F.col("pre_stockout_demand") / F.greatest(F.col("pre_stockout_sales"), F.lit(FLOOR))
    no_history = F.col("pre_stockout_demand").isNull() | F.col("pre_stockout_sales").isNull()
    df = df.withColumns({
        "sales_demand_gap": gap,
        "censoring_ratio": clip(gap / demand, 0.0, 1.0),
        "pre_stockout_demand_pressure":
            F.when(no_history, 1.0).otherwise(clip(pressure, 0.0, 5.0)),
    })
    lost = F.col("estimated_lost_demand")
    strength = (0.50 * F.col("censoring_ratio") + 0.30 * clip(lost / demand, 0.0, 1.0)
                + 0.20 * clip(F.col("pre_stockout_demand_pressure") - 1.0, 0.0, 1.0))
    return df.withColumns({
        "censored_demand_flag": F.col("stockout") & ((lost > 0) | (F.col("censoring_ratio") > 0)),
        "censoring_strength": F.when(F.col("stockout"), clip(strength, 0.0, 1.0)).otherwise(0.0),
    })


def classify_censoring(df: DataFrame) -> DataFrame:
    strength = F.col("censoring_strength")
    return df.withColumn("censoring_class", first_rule([
        (~F.col("stockout"), "not_censored"),
        (strength >= 0.75, "strong"),
        (strength >= 0.50, "moderate"),
        (strength >= 0.25, "weak"),
    ], "minimal"))


def stockout_recovery(df: DataFrame, recovery_window: int = 7) -> DataFrame:
    """Demand on the first day with stock again, against the clean median before it."""
    df = df.withColumn("stockout", flag(F.col("stockout")))
    previous = lagged("stockout")
    df = df.withColumns({
        "recovery_event": flag(previous) & ~F.col("stockout"),
        "_state": running_count(previous.isNull() | (previous != F.col("stockout"))),
        "clean_reference_demand":
            rolling(F.when(~F.col("stockout"), F.col("deconstrained_demand")), recovery_window, median, 1),
    })
    reference = F.col("clean_reference_demand")
    raw = F.col("deconstrained_demand") / F.greatest(reference, F.lit(FLOOR))
    df = df.withColumns({
        "stockout_end": F.col("recovery_event"),
        "days_since_stockout": F.row_number().over(series((*SERIES, "_state"))) - 1,
        "recovery_ratio": F.when(reference.isNull(), 1.0).otherwise(clip(raw, 0.0, 5.0)),
    })
    return df.withColumns({
        "post_stockout_recovery_flag": F.col("recovery_event") & (F.col("recovery_ratio") > 1.10),
        "recovery_strength":
            F.when(F.col("recovery_event"), clip(F.col("recovery_ratio") - 1.0, 0.0, 1.0)).otherwise(0.0),
    }).drop("_state")


def censoring_analysis(df: DataFrame, pre_window: int = 7, recovery_window: int = 7) -> DataFrame:
    return (df.transform(censoring_signals, pre_window)
              .transform(classify_censoring)
              .transform(stockout_recovery, recovery_window))


def _event_measures():
    return [
        F.min("date").alias("event_start"),
        F.max("date").alias("event_end"),
        F.count("date").alias("event_duration_days"),
        F.sum("estimated_lost_demand").alias("event_lost_demand"),
        F.sum("deconstrained_demand").alias("event_demand"),
        F.sum("quantity_sold").alias("event_sales"),
    ]


def _event_rates(df: DataFrame) -> DataFrame:
    demand = F.greatest(F.col("event_demand"), F.lit(FLOOR))
    return df.withColumns({
        "event_loss_rate": clip(F.col("event_lost_demand") / demand, 0.0, 1.0),
        "event_fulfillment_rate": clip(F.col("event_sales") / demand, 0.0, 1.0),
    })


def event_summary(df: DataFrame) -> DataFrame:
    """One row per stockout event."""
    return (stockout_events(df).filter("stockout")
            .groupBy(*SERIES, "stockout_event_id").agg(*_event_measures())
            .transform(_event_rates))


def censoring_event_summary(df: DataFrame) -> DataFrame:
    """Event summary with strength features, in the same single aggregation."""
    return (censoring_analysis(df).filter("stockout")
            .groupBy(*SERIES, "stockout_event_id")
            .agg(*_event_measures(),
                 F.avg("censoring_strength").alias("average_censoring_strength"),
                 F.max("censoring_strength").alias("max_censoring_strength"),
                 count_where(F.col("censoring_class") == "strong").alias("strong_censoring_days"),
                 count_where(F.col("censoring_class") == "moderate").alias("moderate_censoring_days"))
            .transform(_event_rates))


def censoring_rollup(df: DataFrame, key: str) -> DataFrame:
    """Counters per outlet or product; the outlet form also counts strong recoveries."""
    measures = [
        F.count("date").alias("records"),
        count_where(F.col("stockout")).alias("stockout_days"),
        count_where(F.col("censored_demand_flag")).alias("censored_days"),
        F.avg("censoring_strength").alias("average_censoring_strength"),
        count_where(F.col("censoring_class") == "strong").alias("strong_censoring_days"),
        count_where(F.col("recovery_event")).alias("recovery_events"),
    ]
    if key == "outlet_id":
        measures.append(count_where(F.col("post_stockout_recovery_flag")).alias("strong_recovery_events"))
    return censoring_analysis(df).groupBy(key).agg(*measures)


def recovery_summary(df: DataFrame) -> DataFrame:
    """Recoveries per pair, from a `stockout_recovery` result."""
    return df.filter("recovery_event").groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("recovery_events"),
        count_where(F.col("post_stockout_recovery_flag")).alias("strong_recovery_events"),
        F.avg("recovery_ratio").alias("average_recovery_ratio"),
        F.max("recovery_ratio").alias("max_recovery_ratio"),
    )


def top_censored(df: DataFrame, limit: int = 20) -> DataFrame:
    """The report of the most valuable censored days (a top-k, not a cap on the analysis)."""
    priority = (F.col("estimated_lost_demand") * (1.0 + F.col("censoring_strength"))
                * (1.0 + F.col("stockout_event_day") / 7.0))
    return (censoring_analysis(df).filter("censored_demand_flag")
            .withColumn("censoring_priority", priority)
            .orderBy(F.desc(F.round("censoring_priority", 9)), *DAY_KEY).limit(limit))

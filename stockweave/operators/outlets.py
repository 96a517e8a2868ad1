"""Outlet profiles, behaviour and performance.

Facts are first aggregated to (outlet, day) and (outlet, product), so a dominant outlet is
reduced inside its map tasks. What follows runs on one row per outlet and day, a size bounded
by the calendar; its windows and the final grouping share one exchange on outlet_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import clip, count_where, first_rule, flag, require_columns, to_number
from ..plans.lineage import cut
from ..plans.quantiles import column_quantiles
from ..plans.ranks import rank_all

STATIC = ("outlet_type", "country", "region", "city", "location_type", "cuisine", "capacity",
          "delivery_available", "takeaway_available", "bar_available", "kitchen_type",
          "tourism_level", "business_area", "residential_area", "student_area")
TINY = 1e-12


def per_outlet() -> WindowSpec:
    return Window.partitionBy("outlet_id")


def safe_ratio(numerator, denominator) -> Column:
    """Ratio that is 0 for a denominator near zero."""
    n, d = (F.col(c) if isinstance(c, str) else c for c in (numerator, denominator))
    return F.coalesce(F.when(F.abs(d) > TINY, n / F.nullif(d.cast("double"), F.lit(0.0))), F.lit(0.0))


def _numbers(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.coalesce(to_number(c), F.lit(0.0)) for c in columns})


def _trend(first: Column, last: Column, days: Column, shortest: int = 14) -> Column:
    """Relative change between two period means; 0 for a short series or an empty start."""
    change = F.when(F.abs(first) > TINY, (last - first) / F.nullif(first, F.lit(0.0)))
    return F.when(days < shortest, 0.0).otherwise(F.coalesce(change, F.lit(0.0)))


def _day_positions(daily: DataFrame) -> DataFrame:
    return daily.withColumns({
        "_day": F.row_number().over(per_outlet().orderBy("date")),
        "_days": F.count(F.lit(1)).over(per_outlet()),
    })


def half_split_trend(demand: Column) -> Column:
    """Mean of the second half of days over the first half, minus 1, inside a groupBy."""
    half = F.greatest(F.lit(1), F.floor(F.col("_days") / 2))
    first = F.avg(F.when(F.col("_day") <= half, demand))
    last = F.avg(F.when(F.col("_day") > half, demand))
    return _trend(first, last, F.count(F.lit(1)))


def quarter_trend(demand: Column) -> Column:
    """Mean of the last quarter (at least 7 days) over the first one, minus 1."""
    window = F.greatest(F.lit(7), F.floor(F.col("_days") / 4))
    first = F.avg(F.when(F.col("_day") <= window, demand))
    last = F.avg(F.when(F.col("_day") > F.col("_days") - window, demand))
    rising = F.when(first > 0, (last - first) / F.nullif(first, F.lit(0.0))).otherwise(0.0)
    return F.when(F.count(F.lit(1)) < 14, 0.0).otherwise(rising)


# --- profiles ----------------------------------------------------------------------------------

def outlet_profiles(outlets: DataFrame, demand: DataFrame) -> DataFrame:
    """Demand, stockout, weekday, breadth and trend profile with tercile classes and static columns."""
    require_columns(outlets, ["outlet_id", *(c for c in STATIC if c != "cuisine")], "outlets")
    require_columns(demand, ["outlet_id", "product_id", "date", "quantity_sold", "deconstrained_demand",
                             "estimated_lost_demand", "stockout"], "demand")
    facts = _numbers(demand, ["quantity_sold", "deconstrained_demand", "estimated_lost_demand"])
    facts = facts.withColumns({
        "outlet_id": F.col("outlet_id").cast("string"),
        "stockout": flag(F.col("stockout")),
        "deconstrained_demand": F.greatest("deconstrained_demand", F.lit(0.0)),
        "estimated_lost_demand": F.greatest("estimated_lost_demand", F.lit(0.0)),
    }).filter(F.col("outlet_id").isNotNull())
    # Read twice (days and breadth), so what led to it runs once.
    facts = cut(facts.select("outlet_id", "product_id", "date", "quantity_sold", "deconstrained_demand",
                             "estimated_lost_demand", "stockout"))
    daily = facts.groupBy("outlet_id", "date").agg(
        F.sum("quantity_sold").alias("observed"),
        F.sum("deconstrained_demand").alias("demand"),
        F.sum("estimated_lost_demand").alias("lost"),
        count_where(F.col("stockout")).alias("out_products"),
        F.count_distinct("product_id").alias("products"))
    d = F.col("demand")
    weekend = F.weekday("date") >= 5
    profile = _day_positions(daily).groupBy("outlet_id").agg(
        F.count(F.lit(1)).alias("active_days"),
        F.avg(d).alias("average_daily_demand"),
        F.sum(d).alias("total_demand"),
        F.sum("observed").alias("total_observed_sales"),
        F.sum("lost").alias("total_lost_demand"),
        F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("demand_std"),
        F.min(d).alias("demand_min"),
        F.max(d).alias("demand_max"),
        count_where(F.col("out_products") > 0).alias("stockout_affected_days"),
        F.sum("out_products").alias("stockout_product_days"),
        F.sum("products").alias("total_product_days"),
        F.avg(clip(safe_ratio("observed", "demand"), 0.0, 1.0)).alias("average_fulfillment_rate"),
        F.coalesce(F.avg(F.when(~weekend, d)), F.lit(0.0)).alias("weekday_average_demand"),
        F.coalesce(F.avg(F.when(weekend, d)), F.lit(0.0)).alias("weekend_average_demand"),
        half_split_trend(d).alias("demand_trend"))
    breadth = facts.groupBy("outlet_id").agg(F.count_distinct("product_id").alias("active_product_count"))
    profile = profile.join(breadth, "outlet_id", "left").withColumns({
        "stockout_product_day_rate": safe_ratio("stockout_product_days", "total_product_days"),
        "stockout_affected_day_rate": safe_ratio("stockout_affected_days", "active_days"),
        "stockout_rate": safe_ratio("stockout_product_days", "total_product_days"),
        "demand_cv": safe_ratio("demand_std", "average_daily_demand"),
        "lost_demand_rate": safe_ratio("total_lost_demand", "total_demand"),
        "weekend_weekday_ratio": safe_ratio("weekend_average_demand", "weekday_average_demand"),
    })
    profile = cut(profile)
    volume, spread = column_quantiles(profile, {c: c for c in ("average_daily_demand", "demand_cv")}, [0.33, 0.66]).values()
    if volume[0] is None:
        volume = spread = [0.0, 0.0]
    mean, cv = F.col("average_daily_demand"), F.col("demand_cv")
    weekly, trend = F.col("weekend_weekday_ratio"), F.col("demand_trend")
    out, lost = F.col("stockout_product_day_rate"), F.col("lost_demand_rate")
    profile = profile.withColumns({
        "demand_volume_class": first_rule([(mean <= volume[0], "low"), (mean <= volume[1], "medium")], "high"),
        "demand_stability_class": first_rule([(cv <= spread[0], "stable"), (cv <= spread[1], "moderate")], "volatile"),
        "weekend_behavior": first_rule([(weekly >= 1.20, "weekend_heavy"), (weekly <= 0.85, "weekday_heavy")], "balanced"),
        "demand_trend_class": first_rule([(trend >= 0.10, "growing"), (trend <= -0.10, "declining")], "stable"),
        "stockout_risk_class": first_rule([(out >= 0.20, "high"), (out >= 0.10, "moderate")], "low"),
        "lost_demand_risk_class": first_rule([(lost >= 0.15, "high"), (lost >= 0.05, "moderate")], "low"),
        "operational_risk_class": first_rule([
            ((lost >= 0.15) | (out >= 0.20), "high"), ((lost >= 0.05) | (out >= 0.10), "moderate")], "low"),
    }).withColumn("outlet_behavior_class",
                  F.concat_ws("_", "demand_volume_class", "demand_stability_class"))
    static = outlets.select(F.col("outlet_id").cast("string").alias("outlet_id"),
                            *[c for c in STATIC if c in outlets.columns]).dropDuplicates(["outlet_id"])
    return profile.join(static, "outlet_id", "left")


# --- behaviour -----------------------------------------------------------------------------------

def outlet_behavior(demand: DataFrame) -> DataFrame:
    """Shape of an outlet's daily demand: spread, peaks, weekends, concentration, trend."""
    require_columns(demand, ["outlet_id", "product_id", "date", "deconstrained_demand"], "demand")
    facts = demand.select(
        F.col("outlet_id").cast("string").alias("outlet_id"), F.col("product_id").cast("string").alias("product_id"),
        "date", F.greatest(F.coalesce(to_number("deconstrained_demand"), F.lit(0.0)), F.lit(0.0)).alias("demand"))
    # Read by days and by products, so what led to it runs once.
    facts = cut(facts)
    daily = facts.groupBy("outlet_id", "date").agg(F.sum("demand").alias("demand"))
    d = F.col("demand")
    marks = F.percentile(d, F.array(*[F.lit(p) for p in (0.10, 0.90)])).over(per_outlet())
    weekend = F.weekday("date") >= 5
    shape = _day_positions(daily).withColumn("_marks", marks).groupBy("outlet_id").agg(
        F.count(F.lit(1)).alias("behavior_days"),
        F.avg(d).alias("behavior_average_daily_demand"),
        F.percentile(d, F.lit(0.5)).alias("behavior_median_daily_demand"),
        F.stddev_pop(d).alias("behavior_std_daily_demand"),
        F.min(d).alias("behavior_min_daily_demand"),
        F.max(d).alias("behavior_max_daily_demand"),
        F.percentile(d, F.lit(0.25)).alias("behavior_q25_daily_demand"),
        F.percentile(d, F.lit(0.75)).alias("behavior_q75_daily_demand"),
        F.coalesce(F.avg(F.when(~weekend, d)), F.lit(0.0)).alias("behavior_weekday_average"),
        F.coalesce(F.avg(F.when(weekend, d)), F.lit(0.0)).alias("behavior_weekend_average"),
        F.avg((d >= F.get("_marks", F.lit(1))).cast("double")).alias("behavior_high_demand_day_rate"),
        F.avg((d <= F.get("_marks", F.lit(0))).cast("double")).alias("behavior_low_demand_day_rate"),
        half_split_trend(d).alias("behavior_trend"))
    product = facts.groupBy("outlet_id", "product_id").agg(F.sum("demand").alias("product_demand"))
    totals = product.groupBy("outlet_id").agg(
        F.sum("product_demand").alias("_total"), F.count(F.lit(1)).alias("behavior_product_count"))
    # The rank filter is pushed below the shuffle, so at most 5 rows per outlet and task move.
    position = F.row_number().over(per_outlet().orderBy(F.desc("product_demand"), "product_id"))
    best = (product.withColumn("_position", position).filter("_position <= 5").groupBy("outlet_id").agg(
        F.sum(F.when(F.col("_position") <= 3, F.col("product_demand"))).alias("_top3"),
        F.sum("product_demand").alias("_top5")))
    mean = F.col("behavior_average_daily_demand")
    shape = shape.join(totals, "outlet_id").join(best, "outlet_id").withColumns({
        "behavior_interquartile_range": F.col("behavior_q75_daily_demand") - F.col("behavior_q25_daily_demand"),
        "behavior_coefficient_variation": safe_ratio("behavior_std_daily_demand", mean),
        "behavior_peak_intensity": safe_ratio("behavior_max_daily_demand", mean),
        "behavior_weekend_weekday_ratio": safe_ratio("behavior_weekend_average", "behavior_weekday_average"),
        "behavior_top_3_product_share": safe_ratio("_top3", "_total"),
        "behavior_top_5_product_share": safe_ratio("_top5", "_total"),
    }).withColumn("behavior_consistency_ratio",
                  safe_ratio("behavior_interquartile_range", "behavior_median_daily_demand"))
    top, peak, cv, weekly, trend = (F.col(f"behavior_{c}") for c in (
        "top_3_product_share", "peak_intensity", "coefficient_variation", "weekend_weekday_ratio", "trend"))
    return shape.withColumns({
        "demand_concentration_class": first_rule([
            (top >= 0.50, "highly_concentrated"), (top >= 0.30, "concentrated"), (top >= 0.15, "balanced")],
            "highly_distributed"),
        "peak_intensity_class": first_rule([
            (peak >= 1.75, "very_high"), (peak >= 1.40, "high"), (peak >= 1.15, "moderate")], "low"),
        "demand_consistency_class": first_rule([
            (cv <= 0.15, "highly_consistent"), (cv <= 0.30, "consistent"), (cv <= 0.50, "variable")],
            "highly_variable"),
        "demand_shape_class": first_rule([
            ((cv >= 0.50) & (peak >= 1.40), "volatile_peak_driven"), (weekly >= 1.20, "weekday_driven"),
            (weekly <= 0.85, "weekend_driven"), (peak >= 1.40, "peak_driven"), (cv <= 0.15, "stable")],
            "balanced_variable"),
        "trend_class": first_rule([(trend >= 0.10, "growing"), (trend <= -0.10, "declining")], "stable"),
    }).drop("_total", "_top3", "_top5")


# --- performance -----------------------------------------------------------------------------------

def _positive_ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(
        F.when(denominator > 0, numerator / F.nullif(denominator.cast("double"), F.lit(0.0))), F.lit(0.0))


def performance_rows(demand: DataFrame) -> DataFrame:
    """Per outlet: fulfilment, loss and stockout rates, variation, trend and three 0-100 scores."""
    require_columns(demand, ["outlet_id", "date", "quantity_sold", "deconstrained_demand",
                             "estimated_lost_demand", "estimated_fulfillment_rate", "stockout"], "demand")
    facts = _numbers(demand, ["quantity_sold", "deconstrained_demand", "estimated_lost_demand"])
    daily = facts.filter(F.col("outlet_id").isNotNull()).groupBy("outlet_id", "date").agg(
        F.sum("quantity_sold").alias("sold"), F.sum("deconstrained_demand").alias("demand"),
        F.sum("estimated_lost_demand").alias("lost"), F.count(F.lit(1)).alias("rows"),
        count_where(F.col("stockout")).alias("out"))
    d = F.col("demand")
    q90 = F.percentile(d, F.lit(0.9)).over(per_outlet())
    df = _day_positions(daily).withColumn("_q90", q90).groupBy("outlet_id").agg(
        F.count(F.lit(1)).alias("performance_days"),
        F.sum("sold").alias("total_observed_demand"),
        F.sum(d).alias("total_deconstrained_demand"),
        F.sum("lost").alias("total_estimated_lost_demand"),
        F.sum("out").alias("stockout_product_days"),
        F.sum("rows").alias("_rows"),
        count_where(F.col("out") > 0).alias("stockout_days"),
        F.avg(d).alias("average_daily_demand"),
        F.stddev_pop(d).alias("demand_std"),
        F.max(d).alias("_peak"),
        F.avg((d >= F.col("_q90")).cast("double")).alias("high_demand_day_rate"),
        quarter_trend(d).alias("demand_growth_rate"))
    total = F.col("total_deconstrained_demand")
    mean = F.col("average_daily_demand")
    df = df.withColumns({
        "fulfillment_rate": _positive_ratio(F.col("total_observed_demand"), total),
        "lost_demand_rate": _positive_ratio(F.col("total_estimated_lost_demand"), total),
        "stockout_product_day_rate": _positive_ratio(F.col("stockout_product_days"), F.col("_rows")),
        "stockout_affected_day_rate": _positive_ratio(F.col("stockout_days"), F.col("performance_days")),
        "coefficient_variation": _positive_ratio(F.col("demand_std"), mean),
        "peak_intensity": _positive_ratio(F.col("_peak"), mean),
    })
    lost, out, cv = (F.col(c) for c in ("lost_demand_rate", "stockout_product_day_rate", "coefficient_variation"))
    growth = clip((F.col("demand_growth_rate") + 0.2) / 0.4, 0.0, 1.0)
    capped_out = F.least(out / 0.25, F.lit(1.0))
    score = {
        "performance_score": 0.50 * F.col("fulfillment_rate") + 0.20 * growth
                             + 0.15 * (1.0 - F.least(cv, F.lit(1.0))) + 0.15 * (1.0 - capped_out),
        "opportunity_score": 0.55 * lost + 0.25 * capped_out + 0.20 * growth,
        "operational_risk_score": 0.45 * F.least(lost / 0.25, F.lit(1.0)) + 0.35 * capped_out
                                  + 0.20 * F.least(cv / 0.5, F.lit(1.0)),
    }
    df = df.withColumns({name: clip(raw, 0.0, 1.0) * 100.0 for name, raw in score.items()})
    return df.withColumn("performance_class", first_rule([
        (F.col("performance_score") / 100.0 >= 0.75, "high"),
        (F.col("performance_score") / 100.0 >= 0.45, "moderate")], "low")).drop("_rows", "_peak")


def performance_indices(demand: DataFrame) -> DataFrame:
    """`performance_rows`, stored, with indices relative to all outlets and their classes."""
    df = cut(performance_rows(demand))
    scaled = ("total_estimated_lost_demand", "opportunity_score", "operational_risk_score")
    spans = df.agg(*[f(c).alias(f"{n}_{c}") for c in scaled for n, f in (("low", F.min), ("high", F.max))]).first()

    def position(c: str) -> Column:
        low, high = spans[f"low_{c}"], spans[f"high_{c}"]
        if low is None or high <= low:
            return F.lit(0.5)
        return (F.col(c) - low) / (high - low)

    loss = position("total_estimated_lost_demand")
    df = df.withColumns({
        "opportunity_index": 100.0 * (0.6 * loss + 0.4 * position("opportunity_score")),
        "risk_index": 100.0 * (0.6 * position("operational_risk_score") + 0.4 * loss),
    })
    for index, name in (("opportunity_index", "opportunity_class"), ("risk_index", "operational_risk_class")):
        df = df.withColumn(name, first_rule([(F.col(index) >= 75.0, "high"), (F.col(index) >= 45.0, "moderate")], "low"))
    return df


def outlet_performance(demand: DataFrame) -> DataFrame:
    """`performance_indices` with three ranks."""
    df = cut(performance_indices(demand))
    for by, name in (("performance_score", "performance_rank"), ("opportunity_index", "opportunity_rank"),
                     ("risk_index", "risk_rank")):
        df = rank_all(df, by, name, method="min", stored=True)
    return df


# --- reports -----------------------------------------------------------------------------------------

def top_risk_outlets(profiles: DataFrame, limit: int = 20) -> DataFrame:
    severity = F.when(F.col("operational_risk_class") == "high", 2).when(
        F.col("operational_risk_class") == "moderate", 1).otherwise(0)
    return profiles.orderBy(severity.desc(), F.desc("lost_demand_rate"), F.desc("stockout_rate"),
                            "outlet_id").limit(limit)


def top_behavioral_outlets(behavior: DataFrame, limit: int = 20) -> DataFrame:
    return behavior.orderBy(F.desc("behavior_peak_intensity"), F.desc("behavior_coefficient_variation"),
                            "outlet_id").limit(limit)


def top_outlets(performance: DataFrame, by: str, limit: int = 20) -> DataFrame:
    """Top outlets by performance_score, opportunity_index or risk_index."""
    return performance.orderBy(F.desc(by), "outlet_id").limit(limit)

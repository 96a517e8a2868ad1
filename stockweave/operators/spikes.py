"""Demand spikes: detection, severity, drivers, persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, column_or, count_where, first_rule, flag, require_columns, to_number
from ..functions.windows import DAY_KEY, SERIES, START, lagged, median, rolling, running_count, series
from ..plans.quantiles import exact_quantiles

EPS = 1e-6
CONTEXT = (("holiday", "holiday_active"), ("promotion", "promotion_active"),
           ("event", "event_active"), ("weather", "is_rainy"))


def detect_spikes(df: DataFrame, demand_column: str = "quantity_sold", baseline_window: int = 28,
                  minimum_history: int = 7, causal: bool = False) -> DataFrame:
    """Compare a day with the mean and deviation of its recent window.

    The window ends with the day itself; `causal=True` ends it one day earlier.
    """
    require_columns(df, [*DAY_KEY, demand_column], "detect_spikes")
    if baseline_window < 2 or minimum_history < 1:
        raise ValueError("baseline_window >= 2 and minimum_history >= 1 are required")
    df = df.withColumn("_demand", F.greatest(F.coalesce(to_number(demand_column), F.lit(0.0)), F.lit(0.0)))

    def window(aggregate, rows=minimum_history):
        return rolling("_demand", baseline_window, aggregate, rows, include_today=not causal)

    df = df.withColumns({
        "spike_baseline_mean": window(F.avg),
        "spike_baseline_std": window(F.stddev_samp),
        "spike_baseline_median": window(median),
        "spike_history_count": F.coalesce(window(F.count, 0), F.lit(0)),
    })
    demand = F.col("_demand")
    baseline = F.coalesce(F.col("spike_baseline_mean"), F.col("spike_baseline_median"))
    std = F.col("spike_baseline_std")
    df = df.withColumns({
        "spike_baseline": baseline,
        "spike_absolute_lift": demand - baseline,
        "spike_ratio": demand / (F.abs(baseline) + EPS),
        "spike_percentage_lift": (demand - baseline) / (F.abs(baseline) + EPS),
        "spike_z_score": (demand - baseline) / (F.abs(std) + EPS),
        "spike_robust_score": F.abs(demand - baseline) / (F.abs(F.coalesce(std, F.lit(0.0))) + EPS),
        "spike_history_ready": F.col("spike_history_count") >= minimum_history,
    })
    lift, times, z = (F.col(c) for c in ("spike_absolute_lift", "spike_ratio", "spike_z_score"))
    return df.withColumns({
        "is_demand_spike": flag(F.col("spike_history_ready") & (lift > 0) & (times >= 1.5) & (z >= 2.0)),
        "spike_score": clip(0.5 * clip(times - 1.0, 0.0, 3.0) + 0.5 * clip(z / 4.0, 0.0, 3.0), 0.0, 3.0),
        "demand_deviation_direction": first_rule(
            [(lift > 0, "above_baseline"), (lift < 0, "below_baseline")], "at_baseline"),
    }).drop("_demand")


def spike_severity(df: DataFrame) -> DataFrame:
    require_columns(df, ["spike_score", "spike_ratio", "spike_z_score", "is_demand_spike"], "spike_severity")
    score, times, z = (F.coalesce(to_number(c), F.lit(0.0))
                       for c in ("spike_score", "spike_ratio", "spike_z_score"))
    spike = F.col("is_demand_spike")
    df = df.withColumn("spike_severity", first_rule([
        (spike & ((score >= 2.0) | (times >= 3.0) | (z >= 5.0)), "extreme"),
        (spike & ((score >= 1.25) | (times >= 2.0) | (z >= 3.0)), "major"),
        (spike, "moderate"),
    ], "none"))
    severity = F.col("spike_severity")
    return df.withColumns({
        "spike_severity_score":
            F.when(severity == "extreme", 3).when(severity == "major", 2)
             .when(severity == "moderate", 1).otherwise(0),
        "spike_priority": first_rule([
            (severity == "extreme", "critical"), (severity == "major", "high"),
            (severity == "moderate", "watch")], "normal"),
    })


def spike_drivers(df: DataFrame) -> DataFrame:
    """Which context was active on a spike day; temperature extremes are those of the table."""
    require_columns(df, ["is_demand_spike"], "spike_drivers")
    has_temperature = "temperature" in df.columns
    df = df.withColumns({
        column: clip(F.coalesce(to_number(column_or(df, column, 0.0)), F.lit(0.0)), 0.0, 1.0)
        for _, column in CONTEXT
    } | {"temperature": to_number("temperature") if has_temperature else F.lit(None).cast("double")})
    extreme = F.lit(False)
    if has_temperature:
        low, high = exact_quantiles(df, "temperature", [0.10, 0.90])
        if low is not None:
            extreme = flag((F.col("temperature") <= low) | (F.col("temperature") >= high))
    spike = F.col("is_demand_spike")
    df = df.withColumns({f"spike_{name}_signal": (F.col(c) > 0) & spike for name, c in CONTEXT})
    signals = sum((F.col(f"spike_{name}_signal").cast("int") for name, _ in CONTEXT), F.lit(0))
    strongest = F.greatest(*[F.col(c) for _, c in CONTEXT])
    df = df.withColumns({
        "spike_context_signal_count": signals,
        "spike_context_intensity": sum((F.col(c) for _, c in CONTEXT), F.lit(0.0)) / 4.0,
        "spike_primary_context": first_rule(
            [(strongest <= 0, "none")] + [(F.col(c) == strongest, name) for name, c in CONTEXT], "none"),
        "spike_multi_context": signals >= 2,
        "spike_temperature_available": F.col("temperature").isNotNull(),
        "spike_temperature_extreme": extreme,
    })
    return df.withColumn("spike_driver_class", first_rule([
        (~spike, "none"),
        (F.col("spike_multi_context"), "multiple_contexts"),
        (F.col("spike_context_signal_count") == 1, "single_context"),
        (F.col("spike_temperature_extreme"), "weather_temperature"),
    ], "unexplained"))


def spike_persistence(df: DataFrame) -> DataFrame:
    """Episodes of consecutive spike rows, their full length and what follows them."""
    require_columns(df, [*DAY_KEY, "is_demand_spike"], "spike_persistence")
    spike = F.col("is_demand_spike")
    before = series().rowsBetween(START, -1)
    df = df.withColumns({
        "days_since_previous_spike": F.datediff("date", F.max(F.when(spike, F.col("date"))).over(before)),
        "_was": flag(lagged("is_demand_spike")),
        "spike_followed_by_spike": spike & flag(F.lead("is_demand_spike").over(series())),
    })
    df = df.withColumn(
        "spike_episode_id", F.when(spike, running_count(spike & ~F.col("_was"))).otherwise(0))
    episode = F.count(F.lit(1)).over(series((*SERIES, "spike_episode_id")).rowsBetween(START, -START))
    df = df.withColumn("spike_episode_length", F.when(spike, episode).otherwise(0))
    length = F.col("spike_episode_length")
    return df.withColumns({
        "spike_pattern": first_rule([
            (~spike, "normal"), (length >= 3, "persistent"), (length == 2, "repeated")], "isolated"),
        "spike_recovery_day": ~spike & F.col("_was"),
        "post_spike_demand_ratio":
            to_number("spike_ratio") if {"spike_baseline", "spike_ratio"} <= set(df.columns)
            else F.lit(None).cast("double"),
    }).drop("_was")


def spike_analysis(df: DataFrame, demand_column: str = "quantity_sold", baseline_window: int = 28,
                   minimum_history: int = 7) -> DataFrame:
    return (df.transform(detect_spikes, demand_column, baseline_window, minimum_history)
              .transform(spike_severity).transform(spike_drivers).transform(spike_persistence))


def spike_summary(df: DataFrame) -> DataFrame:
    severity, pattern = F.col("spike_severity"), F.col("spike_pattern")
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(F.col("is_demand_spike")).alias("spikes"),
        *[count_where(severity == s).alias(f"{s}_spikes") for s in ("moderate", "major", "extreme")],
        *[count_where(pattern == p).alias(f"{p}_spikes") for p in ("persistent", "repeated", "isolated")],
        count_where(F.col("spike_recovery_day")).alias("recovery_days"),
    )
    rate = F.coalesce(F.col("spikes") / F.nullif(F.col("rows"), F.lit(0)), F.lit(0.0))
    return counts.withColumn("spike_rate", rate)

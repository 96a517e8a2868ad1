"""Output validators: the rules every stage result must satisfy, each set counted in one pass.

A result is (rule, violations). Schema rules are decided without reading data.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_where
from ..functions.windows import DAY_KEY
from .quality import unique_key

SCHEMA = "rule string, violations bigint"
TRUTH_COLUMNS = ("true_demand", "lost_demand_truth", "demand_truth", "actual_demand", "future_demand")


def _applies(df: DataFrame, rule: Column) -> bool:
    """Whether a rule's columns are in the schema; decided by analysis, no data is read."""
    try:
        df.select(rule)
        return True
    except AnalysisException:
        return False


def count_rules(df: DataFrame, rules: dict[str, Column], required=(), forbidden=(), key=None) -> DataFrame:
    """Count the rows that break each rule; add schema rules and, on request, key uniqueness."""
    spark = df.sparkSession
    schema_rows = [(f"missing column {c}", 1) for c in required if c not in df.columns]
    schema_rows += [(f"forbidden column {c}", 1) for c in forbidden if c in df.columns]
    if [c for c in required if c not in df.columns]:
        return spark.createDataFrame(schema_rows, SCHEMA)
    schema_rows += [(f"not applicable: {n}", 1) for n, c in rules.items() if not _applies(df, c)]
    rules = {n: c for n, c in rules.items() if (f"not applicable: {n}", 1) not in schema_rows}
    counters = {"empty": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)} | {n: count_where(F.coalesce(c, F.lit(True))) for n, c in rules.items()}
    one = df.agg(*[c.cast("bigint").alias(f"_{i}") for i, c in enumerate(counters.values())])
    out = one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(counters)])))
    if key:
        out = out.unionByName(unique_key(df, key).select(F.lit("duplicate key").alias("rule"), "violations"))
    return out.unionByName(spark.createDataFrame(schema_rows, SCHEMA)) if schema_rows else out


def passed(report: DataFrame) -> bool:
    return report.filter("violations > 0").isEmpty()


def _negative(*columns: str) -> dict[str, Column]:
    """NULL breaks the rule as well: count_rules reads an unknown outcome as a violation."""
    return {f"{c} negative or missing": F.col(c) < 0 for c in columns}


def _outside(low: float, high: float, *columns: str) -> dict[str, Column]:
    return {f"{c} outside [{low:g}, {high:g}]": ~F.col(c).between(low, high) for c in columns}


def _missing(*columns: str) -> dict[str, Column]:
    return {f"{c} missing": F.col(c).isNull() for c in columns}


def profile_rules(profiles: DataFrame) -> DataFrame:
    return count_rules(profiles, {}, ["outlet_id"], key=["outlet_id"])


def behavior_rules(behavior: DataFrame) -> DataFrame:
    names = ("behavior_average_daily_demand", "behavior_coefficient_variation", "behavior_peak_intensity")
    return count_rules(behavior, _negative(*names), ["outlet_id", *names], key=["outlet_id"])


def performance_rules(performance: DataFrame) -> DataFrame:
    rates = ("fulfillment_rate", "lost_demand_rate", "stockout_product_day_rate", "stockout_affected_day_rate")
    scores = ("performance_score", "opportunity_score", "operational_risk_score", "opportunity_index", "risk_index")
    sold, demand = F.col("total_observed_demand"), F.col("total_deconstrained_demand")
    rules = _outside(0, 1, *rates) | _outside(0, 100, *scores) | {
        "observed above demand": sold > demand + 1e-6,
        "fulfilment does not reconcile":
            F.abs(F.col("fulfillment_rate") - F.coalesce(sold / F.nullif(demand, F.lit(0.0)), F.lit(0.0))) > 1e-6,
    }
    return count_rules(performance, rules, ["outlet_id", *rates, *scores], key=["outlet_id"])


def segment_rules(segments: DataFrame) -> DataFrame:
    """Clusters are labelled and their declared size is the counted one.

    Counted by grouping, then compared: a large cluster is never one window partition.
    """
    sizes = segments.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("cluster_size").alias("low"), F.max("cluster_size").alias("high"))
    wrong = sizes.agg(count_where(F.coalesce((F.col("low") != F.col("n")) | (F.col("high") != F.col("n")), F.lit(True))).alias("violations"))
    basic = count_rules(segments, _missing("cluster_id", "segment_name"), ["outlet_id", "cluster_id", "cluster_size", "segment_name"])
    return basic.unionByName(wrong.select(F.lit("cluster size differs").alias("rule"), "violations"))


def same_outlets(**layers: DataFrame) -> DataFrame:
    """Outlets that are missing from a layer although another layer has them."""
    names = list(layers)
    union = None
    for name, df in layers.items():
        ids = df.select("outlet_id").distinct().withColumn("layer", F.lit(name))
        union = ids if union is None else union.unionByName(ids)
    seen = union.groupBy("outlet_id").agg(F.collect_set("layer").alias("layers"))
    absent = seen.agg(*[count_where(~F.array_contains("layers", n)).alias(n) for n in names])
    return absent.select(F.inline(F.array(*[
        F.struct(F.lit(f"outlets missing from {n}").alias("rule"), F.col(n).alias("violations")) for n in names])))


def outlet_rules(profiles: DataFrame, behavior: DataFrame, performance: DataFrame, segments: DataFrame) -> DataFrame:
    parts = {"profile": profile_rules(profiles), "behavior": behavior_rules(behavior),
             "performance": performance_rules(performance), "segments": segment_rules(segments),
             "cross_layer": same_outlets(profiles=profiles, behavior=behavior, performance=performance, segments=segments)}
    out = None
    for name, df in parts.items():
        df = df.withColumn("layer", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


SPIKE_NUMBERS = ("spike_history_count", "spike_severity_score", "spike_context_signal_count", "spike_context_intensity",
                 "spike_episode_id", "spike_episode_length")


def spike_rules(df: DataFrame, minimum_history: int = 7) -> DataFrame:
    spike = F.col("is_demand_spike")
    rules = _negative(*SPIKE_NUMBERS) | {
        "unknown severity": ~F.col("spike_severity").isin("none", "moderate", "major", "extreme"),
        "severity without a spike": ~spike & (F.col("spike_severity") != "none"),
        "negative score": F.coalesce(F.col("spike_score") < 0, F.lit(False)),
        "ready flag inconsistent": (F.col("spike_history_count") >= minimum_history) != F.col("spike_history_ready"),
    }
    required = (*DAY_KEY, "spike_baseline", "spike_ratio", "spike_z_score", "spike_score", "is_demand_spike", "spike_severity",
                "spike_priority", "spike_driver_class", "spike_pattern", "spike_recovery_day", "days_since_previous_spike")
    report = count_rules(df, rules, required, key=DAY_KEY)
    flags = ("is_demand_spike", "spike_history_ready", "spike_multi_context", "spike_recovery_day")
    kinds = dict(df.dtypes)
    wrong = [(f"{c} is not boolean", 1) for c in flags if kinds.get(c) != "boolean"]
    return report.unionByName(df.sparkSession.createDataFrame(wrong, SCHEMA)) if wrong else report


def supply_rules(df: DataFrame) -> DataFrame:
    target, position, short, order = (F.col(c) for c in ("target_inventory", "inventory_position", "shortage", "recommended_order_quantity"))
    expected = F.greatest(target - position, F.lit(0.0))
    rules = _negative("required_supply", "current_inventory", "incoming_stock", "lead_time_demand", "safety_stock", "target_inventory",
                      "inventory_position", "shortage", "recommended_order_quantity") | _outside(0, 1, "supply_risk_ratio") | {
        "unknown risk": ~F.col("supply_risk").isin("low", "moderate", "high"),
        "order flag inconsistent": (order > 0) != F.col("order_required"),
        "shortage inconsistent": F.abs(short - expected) > 1e-8,
        "order below shortage": order + 1e-9 < expected,
        "order without need": (position >= target) & (order > 1e-9),
        "target inconsistent": F.abs(target - F.col("lead_time_demand") - F.col("safety_stock")) > 1e-8,
        "position inconsistent": F.abs(position - F.col("current_inventory") - F.col("incoming_stock")) > 1e-8,
    } | _missing("outlet_id", "supply_product_id", "date")
    return count_rules(df, rules, ["outlet_id", "date", "supply_product_id", "order_required"], TRUTH_COLUMNS)


def cultural_rules(df: DataFrame) -> DataFrame:
    bounded = ("holiday_importance", "religious_importance", "event_importance", "religious_population_share", "cultural_context_score")
    others = ("demand", "historical_demand_reference", "cultural_demand_pressure", "religious_context_exposure", "tourism_context_exposure")
    rules = _outside(0, 1, *bounded) | _negative(*others) | _missing(*DAY_KEY)
    return count_rules(df, rules, (*DAY_KEY, *bounded, *others), TRUTH_COLUMNS, key=DAY_KEY)


def scenario_rules(df: DataFrame) -> DataFrame:
    rules = _negative("baseline_demand", "scenario_demand") | {
        "multiplier not positive": F.col("scenario_multiplier") <= 0,
        "percentage missing": F.col("percentage_change").isNull(),
        "change does not reconcile":
            F.abs(F.col("absolute_change") - (F.col("scenario_demand") - F.col("baseline_demand"))) > 1e-8,
    }
    return count_rules(df, rules, ["scenario_name", "absolute_change"], TRUTH_COLUMNS)


def action_rules(actions: DataFrame) -> DataFrame:
    """Rules of nested daily actions."""
    d1, d3, d7 = (F.col(f"forecast.{c}") for c in ("d1", "d3", "d7"))
    rules = {
        "negative forecast": (d1 < 0) | (d3 < 0) | (d7 < 0),
        "horizons not ordered": ~((d1 <= d3) & (d3 <= d7)),
        "negative shortage": F.col("inventory.shortage") < 0,
        # Without enough history there is no order.
        "negative order": F.when(F.col("recommendation.action") == "HISTORY_REQUIRED", F.col("supply.recommended_order").isNotNull())
                           .otherwise(F.col("supply.recommended_order") < 0),
        "confidence outside [0, 1]": ~F.col("model_confidence").between(0, 1),
        "inventory missing": F.col("inventory.current_inventory").isNull() | F.col("inventory.required_inventory").isNull(),
        "unknown action": ~F.col("recommendation.action").isin("HOLD", "REPLENISH", "REVIEW_REQUIRED", "HISTORY_REQUIRED"),
    }
    return count_rules(actions, rules, ["outlet", "product", "forecast", "inventory", "supply"])


def decision_rules(df: DataFrame) -> DataFrame:
    rules = _missing("outlet_id", "product_id", "adjusted_forecast", "lead_time_demand") | _negative("recommended_order") \
        | _outside(0, 1, "demand_confidence") | {"health error": F.size("health.errors") > 0}
    return count_rules(df, rules, ["outlet_id", "product_id", "governance"])


def ranking_rules(df: DataFrame, keys=()) -> DataFrame:
    """Benchmark rows: metrics in range, one row per model, ranks starting at 1."""
    rules = _negative("mae", "rmse", "smape", "high_demand_mae", "prediction_cost") | _outside(0, 1, "spike_recall", "stability") \
        | _missing("bias", "score") | {"rank below 1": F.col("rank") < 1}
    return count_rules(df, rules, ["model_name", "rank"], TRUTH_COLUMNS, key=[*keys, "model_name"])


def ensemble_rules(forecast: DataFrame, weights: DataFrame, keys, horizon: int) -> DataFrame:
    """Every blended forecast is complete and its weights are a distribution."""
    complete = forecast.groupBy(*keys).agg(F.count("predicted").alias("n"), F.min("predicted").alias("low"))
    sums = weights.groupBy(*keys).agg(F.sum("weight").alias("total"), F.min("weight").alias("low"), F.max("confidence").alias("c"))
    return count_rules(complete, {"wrong length": F.col("n") != horizon, "negative forecast": F.col("low") < 0}).unionByName(
        count_rules(sums, {"weights do not sum to 1": F.abs(F.col("total") - 1) > 1e-6, "negative weight": F.col("low") < 0,
                           "confidence outside [0, 1]": ~F.col("c").between(0, 1)}))


def hybrid_rules(df: DataFrame) -> DataFrame:
    rules = _negative("mae", "rmse") | {"bias missing": F.col("bias").isNull()}
    return count_rules(df, rules, ["model_name", "mae", "rmse", "smape", "bias", "high_demand_mae", "spike_recall"], key=["model_name"])


def ablation_rules(df: DataFrame, modes=("history", "numeric", "numeric_text", "numeric_visual", "multimodal")) -> DataFrame:
    rules = _negative("test_mae", "test_rmse") | {"unknown mode": ~F.col("mode").isin(*modes)}
    return count_rules(df, rules, ["mode", "test_mae", "test_rmse"], key=["mode"])


def drift_rules(df: DataFrame) -> DataFrame:
    return count_rules(df, _negative("psi", "mean_shift") | _missing("reference_mean", "current_mean"), ["feature", "drifted"], key=["feature"])


def series_benchmark_rules(weighted: DataFrame, best: DataFrame, models) -> DataFrame:
    """Aggregate and per-series results of a comparison: metrics finite, known winners, rank sequence."""
    expected = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("mae", "rmse", "model_name"))
    weighted = weighted.withColumn("_expected", expected)
    rules = _negative("mae", "rmse", "smape") | {"rank out of sequence": F.col("rank") != F.col("_expected"),
                                                 "unknown model": ~F.col("model_name").isin(*models)}
    return count_rules(weighted, rules, ["model_name", "rank"], key=["model_name"]).unionByName(
        count_rules(best, {"unknown best model": ~F.col("best_model").isin(*models)} | _negative("best_mae"), ["best_model"]))


def fusion_rules(df: DataFrame) -> DataFrame:
    features = [c for c in df.columns if c.startswith("mm_")]
    return count_rules(df, _missing(*features) | _outside(0, 1, "mm_text_quality", "mm_visual_quality", "mm_quality_score", "mm_fusion_score"),
                       ["mm_fusion_score", "mm_modality_count"])

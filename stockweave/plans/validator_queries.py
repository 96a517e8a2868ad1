"""Queries of the output validators, each on a result some of whose rows were damaged on purpose.

A damage is (condition, {column: value}), in SQL that both engines read; a condition decides on the
columns as they were. The oracle counts the rows under the conditions that break a rule and expects
none for every other rule, so a validator that counts nothing, or too much, differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines, cultural, ensemble, metrics, outlets, spikes, splits, supply, validators
from ..sources import demand_tables as src
from . import decision_queries, forecast_queries, metric_queries, outlet_queries, supply_queries, text_queries
from .demand_queries import cultural_inputs, demand, spike_input
from .lineage import cut
from .registry import cte, query

cte("outlet_keys", "SELECT DISTINCT outlet_id FROM facts", "facts")
cte("series_keys", "SELECT DISTINCT outlet_id, product_id FROM backtest", "backtest")
cte("supply_days", "SELECT DISTINCT outlet_id, date, supply_product_id FROM facts JOIN bom USING (product_id)", "facts", "bom")


def damage(df: DataFrame, *damages: tuple[str, dict[str, str]], twice: str | None = None) -> DataFrame:
    """Put other values where a condition holds; rows under `twice` come a second time."""
    if twice:
        df = df.unionByName(df.filter(twice))
    changed: dict[str, str] = {}
    for condition, values in damages:
        for column, value in values.items():
            changed[column] = f"CASE WHEN {condition} THEN {value} ELSE {changed.get(column, column)} END"
    return df.withColumns({column: F.expr(case) for column, case in changed.items()})


def counts(rows: str, broken: dict[str, str | None]) -> str:
    """SQL of (rule, violations) over the rows a result has; a rule without a condition is never broken."""
    return "\nUNION ALL ".join(
        f"SELECT '{rule}' AS rule, " + (f"count(*) FILTER ({condition}) AS violations FROM {rows}" if condition else "0 AS violations")
        for rule, condition in broken.items())


def missing(*columns: str) -> list[str]:
    return [f"{c} missing" for c in columns]


def negative(*columns: str) -> list[str]:
    return [f"{c} negative or missing" for c in columns]


def outside(low: int, high: int, *columns: str) -> list[str]:
    return [f"{c} outside [{low}, {high}]" for c in columns]


def none(*rules: str) -> dict[str, None]:
    return dict.fromkeys(rules)


RULES = "rule violations:i"


def length(n: int) -> str:
    return f"length(outlet_id) = {n}"


def day(*days: int) -> str:
    return f"day(date) IN ({', '.join(map(str, days))})"


# --- outlets -----------------------------------------------------------------------------------------

@query("profile_rules", RULES, counts("outlet_keys", none("empty") | {"duplicate key": length(5)}), "outlet_keys")
def _(spark, sf):
    return validators.profile_rules(damage(outlet_queries.profiles(spark, sf), twice=length(5)))


BEHAVIOR = ("behavior_average_daily_demand", "behavior_coefficient_variation", "behavior_peak_intensity")


@query("behavior_rules", RULES, counts("outlet_keys", none("empty") | dict(zip(negative(*BEHAVIOR), map(length, (5, 6, 7)), strict=True))
                                       | {"duplicate key": length(8)}), "outlet_keys")
def _(spark, sf):
    made = outlets.outlet_behavior(demand(spark, sf))
    return validators.behavior_rules(damage(
        made, (length(5), {BEHAVIOR[0]: "-1"}), (length(6), {BEHAVIOR[1]: "NULL"}), (length(7), {BEHAVIOR[2]: "-0.5"}), twice=length(8)))


RATES = ("fulfillment_rate", "lost_demand_rate", "stockout_product_day_rate", "stockout_affected_day_rate")
SCORES = ("performance_score", "opportunity_score", "operational_risk_score", "opportunity_index", "risk_index")


@query("performance_rules", RULES, counts(
    "outlet_keys", none("empty") | dict(zip(outside(0, 1, *RATES), map(length, (4, 5, 6, 7)), strict=True))
    | dict(zip(outside(0, 100, *SCORES), map(length, (5, 6, 7, 8, 9)), strict=True))
    | {"observed above demand": length(10), "fulfilment does not reconcile": "length(outlet_id) IN (4, 10)", "duplicate key": length(12)}),
    "outlet_keys")
def _(spark, sf):
    made = outlets.outlet_performance(demand(spark, sf))
    return validators.performance_rules(damage(
        made, *[(length(n), {c: "2"}) for n, c in zip((4, 5, 6, 7), RATES)],
        *[(length(n), {c: "100.5"}) for n, c in zip((5, 6, 7, 8, 9), SCORES)],
        (length(10), {"total_observed_demand": "2 * total_deconstrained_demand"}), twice=length(12)))


def regions_as_segments(spark, sf) -> DataFrame:
    """Regions play the clusters, so that their sizes are known to SQL."""
    made = src.outlets(spark, sf).select("outlet_id", F.col("region").alias("cluster_id"), F.col("region").alias("segment_name"))
    return made.join(made.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size")), "cluster_id")


SEGMENTS = none("empty") | {"cluster_id missing": None, "segment_name missing": length(5)}
SIZE_SQL = "SELECT 'cluster size differs' AS rule, count(DISTINCT region) FILTER (region LIKE 'A%') AS violations FROM outlets"


def damaged_segments(spark, sf) -> DataFrame:
    return damage(regions_as_segments(spark, sf), (length(5), {"segment_name": "NULL"}), ("cluster_id LIKE 'A%'", {"cluster_size": "cluster_size + 1"}))


@query("segment_rules", RULES, counts("outlets", SEGMENTS) + "\nUNION ALL " + SIZE_SQL, "outlets")
def _(spark, sf):
    return validators.segment_rules(damaged_segments(spark, sf))


@query("outlet_layer_rules", "layer " + RULES, f"""
SELECT 'profile' AS layer, rule, 0 AS violations FROM (VALUES ('empty'), ('duplicate key')) v(rule)
UNION ALL SELECT 'behavior', rule, violations FROM ({counts("outlet_keys", none("empty", *negative(*BEHAVIOR), "duplicate key"))}) b
UNION ALL SELECT 'performance', rule, violations FROM ({counts("outlet_keys", none(
    "empty", *outside(0, 1, *RATES), *outside(0, 100, *SCORES), "observed above demand", "fulfilment does not reconcile", "duplicate key"))}) p
UNION ALL SELECT 'segments', rule, violations FROM ({counts("outlets", SEGMENTS)} UNION ALL {SIZE_SQL}) s
UNION ALL SELECT 'cross_layer', 'outlets missing from ' || name, count(*) FILTER (length(outlet_id) = without)
FROM (SELECT outlet_id FROM outlet_keys UNION SELECT outlet_id FROM outlets) o,
  (VALUES ('profiles', 0), ('behavior', 6), ('performance', 7), ('segments', 0)) l(name, without) GROUP BY name""", ("outlet_keys", "outlets"))
def _(spark, sf):
    facts = demand(spark, sf)
    return validators.outlet_rules(
        outlet_queries.profiles(spark, sf), outlets.outlet_behavior(facts).filter(f"NOT {length(6)}"),
        outlets.outlet_performance(facts).filter(f"NOT {length(7)}"), damaged_segments(spark, sf))


# --- rows per day -------------------------------------------------------------------------------------

SPIKES = validators.SPIKE_NUMBERS


@query("spike_rules", RULES, counts("facts", none("empty") | dict(zip(negative(*SPIKES), map(day, range(1, 7)), strict=True)) | {
    "unknown severity": day(8), "severity without a spike": day(9), "negative score": day(10), "ready flag inconsistent": day(11),
    "duplicate key": day(12)}), "facts")
def _(spark, sf):
    made = damage(spikes.spike_analysis(spike_input(spark, sf)),
                  *[(day(i), {c: "-1"}) for i, c in enumerate(SPIKES, 1)], (day(1), {"spike_history_ready": "false"}),
                  (day(8), {"spike_severity": "'other'", "is_demand_spike": "true"}),
                  (day(9), {"spike_severity": "'major'", "is_demand_spike": "false"}), (day(10), {"spike_score": "-1"}),
                  (day(11), {"spike_history_ready": "spike_history_count < 7"}), twice=day(12))
    return validators.spike_rules(made)


SUPPLY = ("required_supply", "current_inventory", "incoming_stock", "lead_time_demand", "safety_stock", "target_inventory",
          "inventory_position", "shortage", "recommended_order_quantity")
EMPTY_STOCK = {"current_inventory": "0", "incoming_stock": "0", "inventory_position": "0", "lead_time_demand": "10", "safety_stock": "0",
               "target_inventory": "10", "shortage": "10", "recommended_order_quantity": "5", "order_required": "true"}
FULL_STOCK = EMPTY_STOCK | {"current_inventory": "10", "inventory_position": "10", "lead_time_demand": "0", "target_inventory": "0", "shortage": "0"}
# Below zero throughout, yet target and position add up.
BELOW = dict.fromkeys(SUPPLY, "-1") | {"target_inventory": "-2", "inventory_position": "-2", "order_required": "false"}


@query("supply_rules", RULES, counts("supply_days", none("empty") | dict.fromkeys(negative(*SUPPLY), day(20)) | {
    "supply_risk_ratio outside [0, 1]": day(1), "unknown risk": day(2), "order flag inconsistent": day(3),
    "shortage inconsistent": day(4, 20), "order below shortage": day(5, 20), "order without need": day(6),
    "target inconsistent": day(7), "position inconsistent": day(8), "outlet_id missing": None,
    "supply_product_id missing": day(9), "date missing": None}), "supply_days")
def _(spark, sf):
    made = supply_queries.recommendations(spark, sf)
    return validators.supply_rules(damage(
        made, (day(1), {"supply_risk_ratio": "1.5"}), (day(2), {"supply_risk": "'other'"}), (day(3), {"order_required": "NOT order_required"}),
        (day(4), {"shortage": "shortage + 1"}), (day(5), EMPTY_STOCK), (day(6), FULL_STOCK), (day(7), {"safety_stock": "safety_stock + 1"}),
        (day(8), {"incoming_stock": "incoming_stock + 1"}), (day(9), {"supply_product_id": "NULL"}), (day(20), BELOW)))


BOUNDED = ("holiday_importance", "religious_importance", "event_importance", "religious_population_share", "cultural_context_score")
OTHERS = ("demand", "historical_demand_reference", "cultural_demand_pressure", "religious_context_exposure", "tourism_context_exposure")


@query("cultural_rules", RULES, counts("facts", none("empty") | dict(zip(outside(0, 1, *BOUNDED), map(day, range(1, 6)), strict=True))
                                       | dict(zip(negative(*OTHERS), map(day, range(6, 11)), strict=True))
                                       | none(*missing("outlet_id", "product_id", "date")) | {"duplicate key": day(12)}), "facts")
def _(spark, sf):
    made = cultural.cultural_effects(*cultural_inputs(spark, sf))
    return validators.cultural_rules(damage(made, *[(day(i), {c: "1.5"}) for i, c in enumerate(BOUNDED, 1)],
                                            *[(day(i), {c: "NULL"}) for i, c in enumerate(OTHERS, 6)], twice=day(12)))


@query("scenario_rules", RULES, counts("scenario_rows", none("empty") | dict.fromkeys(negative("baseline_demand", "scenario_demand"), day(1)) | {
    "multiplier not positive": day(2), "percentage missing": day(3), "change does not reconcile": day(4)}), "scenario_rows")
def _(spark, sf):
    return validators.scenario_rules(damage(
        supply_queries.compared(spark, sf), (day(1), {"baseline_demand": "-1", "scenario_demand": "-1", "absolute_change": "0"}),
        (day(2), {"scenario_multiplier": "0"}), (day(3), {"percentage_change": "NULL"}), (day(4), {"absolute_change": "absolute_change + 1"})))


@query("action_rules", RULES, counts("actions", none("empty") | {
    "negative forecast": length(5), "horizons not ordered": length(6), "negative shortage": length(7), "negative order": length(8),
    "confidence outside [0, 1]": length(9), "inventory missing": length(10), "unknown action": length(12)}), "actions")
def _(spark, sf):
    made = decision_queries.report(spark, sf, include_normal=True)
    parts = ((5, "forecast", {"d1": -3.0, "d3": -2.0, "d7": -1.0}), (6, "forecast", {"d1": 2.0, "d3": 1.0, "d7": 3.0}),
             (7, "inventory", {"shortage": -1.0}), (8, "supply", {"recommended_order": -1.0}),
             (10, "inventory", {"required_inventory": None}), (12, "recommendation", {"action": "OTHER"}))
    for n, part, fields in parts:
        hit = F.length("outlet.outlet_id") == n
        for field, value in fields.items():
            old = F.col(f"{part}.{field}")
            made = made.withColumn(part, F.col(part).withField(field, F.when(hit, F.lit(value)).otherwise(old)))
    return validators.action_rules(made.withColumn(
        "model_confidence", F.when(F.length("outlet.outlet_id") == 9, 1.5).otherwise(F.col("model_confidence"))))


# --- models ----------------------------------------------------------------------------------------------

PAIR = ["outlet_id", "product_id"]
ERRORS = ("mae", "rmse", "smape", "high_demand_mae", "prediction_cost")


@query("ranking_rules", RULES, counts("scored", none("empty") | dict(zip(negative(*ERRORS), map(length, (4, 5, 6, 6, 8)), strict=True))
                                      | {"spike_recall outside [0, 1]": length(9), "stability outside [0, 1]": length(10),
                                         "bias missing": length(12), "score missing": length(13), "rank below 1": length(14),
                                         "duplicate key": length(7)}), "scored")
def _(spark, sf):
    made = damage(ensemble.rank_models(forecast_queries.scores(spark, sf), PAIR), *[(length(n), {c: "-1"}) for n, c in zip((4, 5, 6, 6, 8), ERRORS)],
                  (length(9), {"spike_recall": "1.5"}), (length(10), {"stability": "-0.5"}), (length(12), {"bias": "NULL"}),
                  (length(13), {"score": "NULL"}), (length(14), {"rank": "0"}), twice=length(7))
    return validators.ranking_rules(made, PAIR)


_FEATURE = [f"feature = '{f}'" for f in metric_queries.FEATURES]
cte("drift_features", "SELECT DISTINCT feature FROM (SELECT unnest([" + ", ".join(f"'{f}'" for f in metric_queries.FEATURES)
    + "]) AS feature FROM facts) f", "facts")


@query("drift_rules", RULES, counts("drift_features", none("empty") | dict(zip(
    [*negative("psi", "mean_shift"), *missing("reference_mean", "current_mean")], [*_FEATURE, _FEATURE[0]], strict=True))
    | {"duplicate key": _FEATURE[2]}), "drift_features")
def _(spark, sf):
    a, b, c = _FEATURE
    report = cut(metric_queries.drifted(spark, sf))
    damaged = damage(report, (a, {"psi": "-1", "current_mean": "NULL"}), (b, {"mean_shift": "NULL"}), (c, {"reference_mean": "NULL"}))
    return validators.drift_rules(damaged.unionByName(report.filter(c)))


@query("ensemble_rules", RULES, counts("series_keys", none("empty") | {"wrong length": length(5), "negative forecast": length(6)})
       + "\nUNION ALL " + counts("series_keys", none("empty") | {
           "weights do not sum to 1": "length(outlet_id) IN (7, 8)", "negative weight": length(8), "confidence outside [0, 1]": length(9)}),
       "series_keys")
def _(spark, sf):
    rows = cut(baselines.backtest_forecasts(src.daily_facts(spark, sf), 7))
    weights = cut(ensemble.model_weights(metrics.model_scores(rows), PAIR, horizon=7))
    blended = damage(ensemble.combine(rows, weights, PAIR, ["horizon"]), (f"{length(5)} AND horizon = 7", {"predicted": "NULL"}),
                     (f"{length(6)} AND horizon = 1", {"predicted": "-1"}))
    return validators.ensemble_rules(blended, damage(
        weights, (length(7), {"weight": "2 * weight"}), (length(8), {"weight": "-1"}), (length(9), {"confidence": "1.5"})), PAIR, 7)


METHOD = [f"model_name = '{m}'" for m in baselines.METHODS]
cte("method_names", "SELECT DISTINCT model_name FROM scored", "scored")


@query("series_benchmark_rules", RULES, counts("method_names", none("empty") | {
    "mae negative or missing": None, "rmse negative or missing": METHOD[0], "smape negative or missing": METHOD[1],
    "rank out of sequence": METHOD[2], "unknown model": None, "duplicate key": None}) + "\nUNION ALL " + counts("series_keys", none("empty") | {
        "unknown best model": length(5), "best_mae negative or missing": length(6)}), ("method_names", "series_keys"))
def _(spark, sf):
    made = cut(forecast_queries.cut_scores(spark, sf))
    return validators.series_benchmark_rules(
        damage(metrics.weighted_by_model(made), (METHOD[0], {"rmse": "-1"}), (METHOD[1], {"smape": "NULL"}), (METHOD[2], {"rank": "rank + 1"})),
        damage(metrics.best_models(made), (length(5), {"best_model": "'other'"}), (length(6), {"best_mae": "NULL"})), baselines.METHODS)


HYBRID = [f"model_name = '{m}'" for m in forecast_queries.MODELS]
cte("hybrid_names", "SELECT unnest([" + ", ".join(f"'{m}'" for m in forecast_queries.MODELS) + "]) AS model_name")


@query("hybrid_rules", RULES, counts("hybrid_names", none("empty") | {
    "mae negative or missing": HYBRID[0], "rmse negative or missing": HYBRID[1], "bias missing": HYBRID[2], "duplicate key": None}), "hybrid_names")
def _(spark, sf):
    made = ensemble.hybrid_evaluation(splits.last_days_split(cut(forecast_queries.predictions(spark, sf))), forecast_queries.MODELS)
    return validators.hybrid_rules(damage(made, (HYBRID[0], {"mae": "-1"}), (HYBRID[1], {"rmse": "NULL"}), (HYBRID[2], {"bias": "NULL"})))


MM_BROKEN = {"mm_has_text missing": "doc_id % 7 = 1", "mm_fusion_score missing": "doc_id % 7 = 2", "mm_text_quality outside [0, 1]": "doc_id % 7 = 3",
             "mm_visual_quality outside [0, 1]": None, "mm_quality_score outside [0, 1]": None, "mm_fusion_score outside [0, 1]": "doc_id % 7 = 2"}
MM_REST = 25 - len(MM_BROKEN)


@query("fusion_rules", RULES, counts("documents", MM_BROKEN)
       + f"\nUNION ALL SELECT 'the other {MM_REST} rules' AS rule, 0 AS violations")
def _(spark, sf):
    report = validators.fusion_rules(damage(
        text_queries.fused(spark, sf), ("doc_id % 7 = 1", {"mm_has_text": "NULL"}), ("doc_id % 7 = 2", {"mm_fusion_score": "NULL"}),
        ("doc_id % 7 = 3", {"mm_text_quality": "2"})))
    shown = F.col("rule").isin(*MM_BROKEN)
    rest = report.filter(~shown).agg(F.concat(F.lit("the other "), F.count(F.lit(1)), F.lit(" rules")).alias("rule"), F.sum("violations").alias("violations"))
    return report.filter(shown).unionByName(rest)

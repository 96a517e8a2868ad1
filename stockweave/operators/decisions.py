"""Replenishment decisions with health and governance gates, one row per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import column_or, first_rule, gate, require_columns

DEFAULTS = {"current_inventory": 0.0, "lead_time_days": 1.0, "safety_stock": 0.0, "minimum_order_quantity": 0.0,
            "order_multiple": 1.0, "scenario_multiplier": 1.0, "demand_confidence": 1.0}
FLAGS = {"high_risk": False, "data_available": True, "model_available": True, "feature_contract_valid": True,
         "drift_signal": False}


def request_errors(df: DataFrame) -> Column:
    """The contract violations of a request row, as an array of messages."""
    numbers = ["forecast_demand", *DEFAULTS]
    rules = {f"{c} must be a number": F.col(c).isNull() | F.isnan(c) for c in numbers}
    rules |= {f"{c} must not be negative": F.col(c) < 0
              for c in ("forecast_demand", "current_inventory", "safety_stock")}
    rules |= {f"{c} must be positive": F.col(c) <= 0 for c in ("lead_time_days", "scenario_multiplier")}
    rules["demand_confidence must lie in [0, 1]"] = ~F.col("demand_confidence").between(0, 1)
    return F.array_compact(F.array(*[F.when(rule, F.lit(text)) for text, rule in rules.items()]))


def requests(df: DataFrame) -> DataFrame:
    """Fill absent request fields with their defaults."""
    require_columns(df, ["outlet_id", "product_id", "forecast_demand"], "requests")
    return df.withColumns(
        {"forecast_demand": F.col("forecast_demand").cast("double")}
        | {c: column_or(df, c, v).cast("double") for c, v in DEFAULTS.items()}
        | {c: F.coalesce(column_or(df, c, v).cast("boolean"), F.lit(v)) for c, v in FLAGS.items()})


def decide(df: DataFrame) -> DataFrame:
    """Order, risk and action of each request; a request that breaks its contract fails every action."""
    df = requests(df)
    errors = request_errors(df)
    df = gate(df, F.size(errors) > 0, F.array_join(errors, "; "))
    df = df.withColumn("adjusted_forecast", F.greatest(F.col("forecast_demand") * F.col("scenario_multiplier"), F.lit(0.0)))
    df = df.withColumns({
        "lead_time_demand": F.col("adjusted_forecast") * F.greatest("lead_time_days", F.lit(1.0)),
        "inventory_position": F.col("current_inventory"),
    }).withColumn("target_inventory", F.col("lead_time_demand") + F.col("safety_stock"))
    position, target, lead = (F.col(c) for c in ("inventory_position", "target_inventory", "lead_time_demand"))
    shortage = F.greatest(target - position, F.lit(0.0))
    step = F.greatest("order_multiple", F.lit(1.0))
    wanted = F.greatest(shortage, F.col("minimum_order_quantity"))
    df = df.withColumns({
        "shortage": shortage,
        "recommended_order": F.when(shortage > 0, F.ceil(wanted / step) * step).otherwise(0.0),
        "risk": first_rule([(position <= 0, "critical"), (position < lead, "high"), (position < target, "moderate")],
                           "low"),
    })
    risk = F.col("risk")
    return df.withColumn("action", first_rule([
        (risk == "critical", "URGENT_REPLENISHMENT"), (risk == "high", "REPLENISH"),
        (risk == "moderate", "MONITOR_AND_REPLENISH")], "NO_REPLENISHMENT"))


def health(df: DataFrame, prediction: str = "adjusted_forecast") -> DataFrame:
    value = F.col(prediction)
    finite = F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")) & (value >= 0), F.lit(False))
    checks = {"data_unavailable": F.col("data_available"), "model_unavailable": F.col("model_available"),
              "feature_contract_invalid": F.col("feature_contract_valid"), "prediction_invalid": finite}
    return df.withColumn("health", F.struct(
        "data_available", "model_available", "feature_contract_valid", finite.alias("prediction_valid"),
        "drift_signal",
        F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()])).alias("errors")))


# Outcome of each governance gate, first match wins.
GATES = {
    "health": ("HOLD", False, "System health gate failed.", "critical"),
    "confidence": ("REVIEW_REQUIRED", False, "Forecast confidence is below the autonomous-action threshold.", "high"),
    "drift": ("REVIEW_REQUIRED", False, "Drift signal detected; autonomous commercial action is held.", "high"),
    "risk": ("REVIEW_REQUIRED", False, "High-risk commercial decision requires review.", "high"),
    "covered": ("NO_REPLENISHMENT", True, "Inventory position satisfies current target.", "low"),
    "passed": (None, True, "Health, confidence and governance gates passed.", "moderate"),
}


def governance(df: DataFrame) -> DataFrame:
    gates = {
        "health": F.size("health.errors") > 0,
        "confidence": F.col("demand_confidence") < 0.5,
        "drift": F.col("drift_signal"),
        "risk": F.col("high_risk"),
        "covered": F.col("action") == "NO_REPLENISHMENT",
    }

    def outcome(name: str) -> Column:
        action, allowed, reason, level = GATES[name]
        return F.struct((F.lit(action) if action else F.col("action")).alias("action"), F.lit(allowed).alias("allowed"),
                        F.lit(reason).alias("reason"), F.lit(level).alias("risk_level"))

    chain = None
    for name, condition in gates.items():
        chain = F.when(condition, outcome(name)) if chain is None else chain.when(condition, outcome(name))
    return df.withColumn("governance", chain.otherwise(outcome("passed")))


def autonomous_decisions(df: DataFrame) -> DataFrame:
    """Decision, health, governance and an explanation for every request row."""
    df = df.transform(decide).transform(health).transform(governance)
    return df.withColumns({
        "commercial_action":
            F.when(F.col("governance.allowed"), F.col("action")).otherwise(F.col("governance.action")),
        "explanation": F.format_string(
            "Forecast=%.2f; lead-time demand=%.2f; inventory=%.2f; shortage=%.2f; recommended order=%.2f; "
            "risk=%s; governance=%s",
            "adjusted_forecast", "lead_time_demand", "inventory_position", "shortage", "recommended_order",
            "risk", "governance.reason"),
    })

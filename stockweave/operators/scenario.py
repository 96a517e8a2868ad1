"""What-if scenarios: multipliers on a baseline forecast."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clip, column_or, gate, ratio, require_columns, to_number

MULTIPLIERS = ("holiday_multiplier", "promotion_multiplier", "event_multiplier", "weather_multiplier",
               "tourism_multiplier", "demographic_multiplier", "cultural_multiplier")
LOW, HIGH = 0.5, 2.0


def checked_multiplier(value: float, low: float = LOW, high: float = HIGH) -> float:
    value = float(value)
    if not isfinite(value) or not low <= value <= high:
        raise ValueError(f"a scenario multiplier must lie within [{low}, {high}]")
    return value


def combined_multiplier(multipliers: dict[str, float]) -> float:
    product = 1.0
    for value in multipliers.values():
        product *= checked_multiplier(value)
    return product


def scenario(name: str, metadata: dict[str, str] | None = None, **multipliers: float) -> dict:
    """One checked scenario definition; absent multipliers are 1."""
    unknown = set(multipliers) - set(MULTIPLIERS)
    if unknown:
        raise ValueError(f"unknown multipliers {sorted(unknown)}")
    row = {m: checked_multiplier(multipliers.get(m, 1.0)) for m in MULTIPLIERS}
    return {"scenario_name": name, **row, "metadata": metadata or {}}


def scenario_table(spark: SparkSession, scenarios: list[dict]) -> DataFrame:
    if not scenarios:
        raise ValueError("at least one scenario is required")
    schema = ", ".join(["scenario_name string", *(f"{m} double" for m in MULTIPLIERS),
                        "metadata map<string,string>"])
    return spark.createDataFrame(scenarios, schema)


def apply_scenario(df: DataFrame, baseline: str = "baseline_demand") -> DataFrame:
    """Demand under the multipliers of each row."""
    require_columns(df, [baseline], "scenario")
    for m in MULTIPLIERS:
        if m in df.columns:
            df = gate(df, to_number(m).isNull(), f"{m} is not a number")
    df = df.withColumns({m: clip(to_number(column_or(df, m, 1.0)), LOW, HIGH) for m in MULTIPLIERS})
    product = F.lit(1.0)
    for m in MULTIPLIERS:
        product = product * F.col(m)
    df = df.withColumn("scenario_multiplier", product)
    df = df.withColumns({
        "scenario_demand": clip(to_number(baseline) * F.col("scenario_multiplier"), 0.0),
        "baseline_demand": clip(to_number(baseline), 0.0),
    })
    change = F.col("scenario_demand") - F.col("baseline_demand")
    return df.withColumns({
        "absolute_change": change,
        "percentage_change": F.coalesce(ratio(change, "baseline_demand") * 100.0, F.lit(0.0)),
    })


def compare_scenarios(forecast: DataFrame, scenarios: list[dict], baseline: str = "baseline_demand") -> DataFrame:
    """Every scenario on every forecast row.

    The scenarios are a hand-written list, so they travel as an array literal that is
    exploded on each row: no join and no shuffle.
    """
    if not scenarios:
        raise ValueError("at least one scenario is required")
    rows = [F.struct(F.lit(s["scenario_name"]).alias("scenario_name"),
                     *[F.lit(checked_multiplier(s[m])).alias(m) for m in MULTIPLIERS]) for s in scenarios]
    df = forecast.drop("scenario_name", *MULTIPLIERS)
    df = df.withColumn("_scenario", F.explode(F.array(*rows))).select("*", "_scenario.*").drop("_scenario")
    return apply_scenario(df, baseline)


def run_scenario(forecast: DataFrame, one: dict, baseline: str = "baseline_demand") -> DataFrame:
    return compare_scenarios(forecast, [one], baseline)


def scenario_summary(result: DataFrame) -> DataFrame:
    require_columns(result, ["scenario_name", "baseline_demand", "scenario_demand", "absolute_change"], "scenario result")
    sums = result.groupBy("scenario_name").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("baseline_demand", "scenario_demand", "absolute_change")])
    return sums.withColumn("percentage_change",
                           F.coalesce(ratio("absolute_change", "baseline_demand") * 100.0, F.lit(0.0)))

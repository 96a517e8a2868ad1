"""Model ranking and validation-weighted ensembles. Weights are computed per key (a series, or
nothing for one global decision) over one row per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import exact_quantiles
from .metrics import basic_metrics

# Weight of each criterion and whether more is better.
CRITERIA = (("mae", 0.30, False), ("rmse", 0.20, False), ("smape", 0.15, False), ("high_demand_mae", 0.10, False),
            ("spike_recall", 0.10, True), ("stability", 0.05, True), ("prediction_cost", 0.10, False))


def _among(keys) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


def minmax_score(value: str, higher_is_better: bool, keys) -> Column:
    """Position between the worst (0) and the best (1) model; 1 for all when they are equal."""
    w = _among(keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    span = high - low
    position = (F.col(value) - low) / F.nullif(span, F.lit(0.0))
    return F.when(span <= 1e-12, 1.0).otherwise(position if higher_is_better else 1.0 - position)


def rank_models(scores: DataFrame, keys) -> DataFrame:
    parts = {name: weight * minmax_score(name, up, keys) for name, weight, up in CRITERIA}
    df = scores.withColumns({
        "error_score": parts["mae"] + parts["rmse"] + parts["smape"] + parts["high_demand_mae"],
        "behavior_score": parts["spike_recall"] + parts["stability"],
        "cost_score": parts["prediction_cost"],
    })
    df = df.withColumn("score", F.col("error_score") + F.col("behavior_score") + F.col("cost_score"))
    # Equal models differ in the last bits of a sum, so ties are decided on 9 digits.
    return df.withColumn("rank", F.rank().over(_among(keys).orderBy(F.desc(F.round("score", 9)))))


def model_weights(scores: DataFrame, keys=(), horizon: int = 1, minimum_weight: float = 0.05,
                  error_power: float = 1.0, stability_power: float = 0.25) -> DataFrame:
    """Weights from validation error and stability; models below the minimum are dropped.

    Adds weight, selected_model and confidence; dropped models keep weight 0.
    """
    w = _among(keys)
    error = F.greatest("mae", F.lit(1e-8)) * max(1.0, float(horizon) ** 0.15)
    raw = F.pow(F.greatest("stability", F.lit(1e-6)), F.lit(stability_power)) / F.pow(error, F.lit(error_power))
    df = scores.withColumn("_raw", raw)
    df = df.withColumn("_share", F.col("_raw") / F.sum("_raw").over(w))
    kept = F.col("_share") >= minimum_weight
    df = df.withColumns({
        "_kept": F.when(kept, F.col("_share")).otherwise(0.0),
        "_none": F.max(kept.cast("int")).over(w) == 0,
        "_best": F.row_number().over(w.orderBy("mae", "model_name")) == 1,
    })
    df = df.withColumn("weight", F.when(F.col("_none"), F.col("_best").cast("double"))
                       .otherwise(F.col("_kept") / F.nullif(F.sum("_kept").over(w), F.lit(0.0))))
    weight = F.col("weight")
    used = F.sum((weight > 0).cast("int")).over(w)
    entropy = F.sum(F.when(weight > 0, -weight * F.log(F.greatest(weight, F.lit(1e-12)))).otherwise(0.0)).over(w)
    spread = F.when(used > 1, entropy / F.log(F.greatest(used, F.lit(2)).cast("double"))).otherwise(0.0)
    confidence = 0.7 * F.max(weight).over(w) + 0.3 * (1.0 - spread)
    return df.withColumns({
        "selected_model": F.max_by("model_name", F.struct("weight", -F.col("mae"))).over(w),
        "confidence": F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)),
    }).drop("_raw", "_share", "_kept", "_none", "_best")


def combine(forecasts: DataFrame, weights: DataFrame, keys, at, value: str = "predicted") -> DataFrame:
    """Weighted mean of aligned forecasts (long form), never negative.

    `keys` identify a weight set, `at` the forecast points inside it.
    """
    joined = forecasts.join(weights.select(*keys, "model_name", "weight"), [*keys, "model_name"])
    return joined.groupBy(*keys, *at).agg(
        F.greatest(F.sum(F.col(value) * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(0.0)).alias(value))


def hybrid_evaluation(df: DataFrame, models, actual: str = "actual", horizon: int = 1) -> DataFrame:
    """Weights from the validation rows, metrics of every model and of the blend on the test rows.

    `df` is wide: split, actual and one column per model. Only the few weights and two
    quantiles of the test actuals pass through the driver.
    """
    validation, test = df.filter("split = 'validation'"), df.filter("split = 'test'")
    one = validation.agg(*[F.avg(F.abs(F.col(m) - F.col(actual))).alias(m) for m in models])
    scores = one.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("model_name"), F.col(m).alias("mae"), F.lit(1.0).alias("stability")) for m in models])))
    weights = {r["model_name"]: r["weight"] for r in model_weights(scores, (), horizon).collect()}
    blend = sum((F.col(m) * F.lit(weights[m]) for m in models), F.lit(0.0))
    test = test.withColumn("hybrid", F.greatest(blend, F.lit(0.0)))
    q75, q90 = exact_quantiles(test, actual, [0.75, 0.90])
    a = F.col(actual)
    made = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(m).alias("predicted")) for m in (*models, "hybrid")])
    long = test.select(a.alias("actual"), F.inline(made))
    a, p = F.col("actual"), F.col("predicted")
    result = long.groupBy("model_name").agg(
        *basic_metrics(variant="zero"),
        F.avg(F.when(a >= F.lit(q75), F.abs(p - a))).alias("high_demand_mae"),
        F.avg(F.when(a >= F.lit(q90), (p >= F.lit(q75)).cast("double"))).alias("spike_recall"))
    w = Window.partitionBy(F.lit(1))
    best = F.min(F.when(F.col("model_name") != "hybrid", F.col("mae"))).over(w)
    blended = F.max(F.when(F.col("model_name") == "hybrid", F.col("mae"))).over(w)
    weight = F.coalesce(*[F.when(F.col("model_name") == m, F.lit(v)) for m, v in weights.items()], F.lit(1.0))
    return result.withColumns({
        "weight": weight,
        "improvement_vs_best_individual_pct": (best - F.col("mae")) / F.greatest(best, F.lit(1e-12)) * 100.0,
        "hybrid_beats_all": blended < best,
    })


def adoption_decision(results: DataFrame, candidate: str = "multimodal", baseline: str = "history",
                      gain: float = 2.0) -> DataFrame:
    """Adopt the candidate mode only for a test gain of at least `gain` percent."""
    one = results.agg(F.max(F.when(F.col("mode") == candidate, F.col("test_mae"))).alias("candidate_mae"),
                      F.max(F.when(F.col("mode") == baseline, F.col("test_mae"))).alias("baseline_mae"))
    better = (F.col("baseline_mae") - F.col("candidate_mae")) / F.greatest("baseline_mae", F.lit(1e-8)) * 100.0
    one = one.withColumn("improvement_pct", better)
    return one.withColumn("decision", F.when(F.col("candidate_mae").isNull() | F.col("baseline_mae").isNull(), "REJECT")
                          .when(F.col("improvement_pct") >= gain, "ADOPT").otherwise("KEEP_OPTIONAL"))

"""Distribution drift and the decisions that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_col, count_where, to_number
from ..plans.lineage import cut
from ..plans.quantiles import feature_quantiles

FLOOR = 1e-6


def _long(reference: DataFrame, current: DataFrame, features) -> DataFrame:
    """(part, feature, value) of both samples; one scan each whatever the number of features."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), to_number(f).alias("value")) for f in features])
    parts = [df.select(F.lit(name).alias("part"), F.inline(rows)) for df, name in
             ((reference, "reference"), (current, "current"))]
    return parts[0].unionByName(parts[1]).filter("value IS NOT NULL")


def drift_report(reference: DataFrame, current: DataFrame, features, bins: int = 10,
                 psi_threshold: float = 0.25, shift_threshold: float = 0.20) -> DataFrame:
    """Means, relative shift, population stability index and verdict per shared feature."""
    shared = [f for f in features if f in reference.columns and f in current.columns]
    if not shared:
        raise ValueError("no feature is present in both samples")
    long = cut(_long(reference, current, shared))
    bin_of = F.lit(0)
    found = feature_quantiles(long, [i / bins for i in range(bins + 1)])
    for feature in shared:
        inner = sorted(set(found.get(feature, ())))[1:-1]
        place = sum(((F.col("value") >= F.lit(e)).cast("int") for e in inner), F.lit(0))
        bin_of = F.when(F.col("feature") == feature, place).otherwise(bin_of)
    is_reference = F.col("part") == "reference"
    binned = long.groupBy("feature", bin_of.alias("bin")).agg(
        count_where(is_reference).alias("r"), count_where(~is_reference).alias("c"),
        F.sum(F.when(is_reference, F.col("value"))).alias("r_sum"), F.sum(F.when(~is_reference, F.col("value"))).alias("c_sum"))
    totals = binned.groupBy("feature").agg(
        F.sum("r").alias("r_rows"), F.sum("c").alias("c_rows"),
        F.coalesce(F.sum("r_sum") / F.nullif(F.sum("r"), F.lit(0)), F.lit(0.0)).alias("reference_mean"),
        F.coalesce(F.sum("c_sum") / F.nullif(F.sum("c"), F.lit(0)), F.lit(0.0)).alias("current_mean"))
    shares = binned.join(totals, "feature")
    r, c = (F.greatest(F.col(n) / F.greatest(F.col(f"{n}_rows"), F.lit(1)), F.lit(FLOOR)) for n in ("r", "c"))
    both = (F.col("r_rows") > 0) & (F.col("c_rows") > 0)
    out = shares.groupBy("feature", "reference_mean", "current_mean").agg(
        F.greatest(F.sum(F.when(both, (c - r) * F.log(c / r)).otherwise(0.0)), F.lit(0.0)).alias("psi"))
    shift = F.abs(F.col("current_mean") - F.col("reference_mean")) / F.greatest(F.abs("reference_mean"), F.lit(FLOOR))
    out = out.withColumn("mean_shift", shift)
    return out.withColumn("drifted", (F.col("psi") >= psi_threshold) | (F.col("mean_shift") >= shift_threshold))


def error_degradation(reference: DataFrame, current: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    """Relative change of the MAE between two samples, in one row."""
    gap = F.avg(F.abs(as_col(actual) - as_col(predicted)))
    one = reference.agg(gap.alias("reference_mae")).join(F.broadcast(current.agg(gap.alias("current_mae"))), F.lit(True))
    old, new = F.col("reference_mae"), F.col("current_mae")
    change = F.when(old <= 1e-12, F.when(new <= 1e-12, 0.0).otherwise(1.0)).otherwise((new - old) / F.nullif(old, F.lit(0.0)))
    return one.withColumn("error_degradation", change)


def retraining_decision(report: DataFrame, new_rows: int, error_degradation: float = 0.0, scheduled: bool = False,
                        min_new_rows: int = 500, min_drifted: int = 1, max_degradation: float = 0.10) -> DataFrame:
    """Whether to retrain, with every reason that applies."""
    one = report.agg(count_where(F.col("drifted")).alias("drifted"),
                     F.array_sort(F.collect_set(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"))
    reasons = F.array_compact(F.array(
        F.when(F.col("drifted") >= min_drifted, F.concat(F.lit("significant_drift:"), F.col("drifted").cast("string"))),
        F.when(F.lit(error_degradation >= max_degradation), F.lit(f"error_degradation:{error_degradation:.4f}")),
        F.when(F.lit(new_rows >= min_new_rows), F.lit(f"new_data:{new_rows}")),
        F.when(F.lit(bool(scheduled)), F.lit("scheduled_retraining"))))
    return one.withColumn("reasons", reasons).withColumn("should_retrain", F.size("reasons") > 0)


def candidate_evaluation(df: DataFrame, champion: str, candidate: str, actual: str = "actual",
                         min_improvement_pct: float = 2.0, max_bias_worsening: float = 1.0,
                         min_rows: int = 1) -> DataFrame:
    """Champion against candidate on the rows both predict: gain, bias change and verdict."""
    known = df.filter(F.col(actual).isNotNull() & F.col(champion).isNotNull() & F.col(candidate).isNotNull())
    measures = [F.count(F.lit(1)).alias("rows")]
    for name, c in (("champion", champion), ("candidate", candidate)):
        e = F.col(c) - F.col(actual)
        measures += [F.avg(F.abs(e)).alias(f"{name}_mae"), F.sqrt(F.avg(e * e)).alias(f"{name}_rmse"), F.avg(e).alias(f"{name}_bias")]
    one = known.agg(*measures)
    one = one.withColumns({
        "improvement_pct": (F.col("champion_mae") - F.col("candidate_mae")) / F.greatest("champion_mae", F.lit(1e-12)) * 100.0,
        "bias_change": F.abs("candidate_bias") - F.abs("champion_bias"),
    })
    reasons = F.array_compact(F.array(
        F.when(F.col("rows") < min_rows, F.lit("insufficient_common_rows")),
        F.when(F.col("improvement_pct") < min_improvement_pct, F.lit("insufficient_improvement")),
        F.when(F.col("bias_change") > max_bias_worsening, F.lit("bias_worsened"))))
    return one.withColumn("reasons", reasons).withColumn("passes", (F.size("reasons") == 0) & (F.col("rows") > 0))


def training_eligibility(packages: DataFrame, minimum_rows: int = 1000, require_real_data: bool = True,
                         training_enabled: bool = True) -> DataFrame:
    """Ordered gates for every package row (rows, valid, is_real_client_data)."""
    rows = F.col("rows")
    reason = (F.when(F.lit(not training_enabled), "TRAINING_DISABLED")
               .when(F.lit(require_real_data) & ~F.col("is_real_client_data"), "REAL_CLIENT_DATA_REQUIRED")
               .when(~F.col("valid"), "VALIDATION_FAILED")
               .when(rows < minimum_rows, F.concat(F.lit("INSUFFICIENT_DATA:"), rows.cast("string"), F.lit(f"<{minimum_rows}")))
               .otherwise("TRAINING_ELIGIBLE"))
    return packages.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "TRAINING_ELIGIBLE")

"""Queries: diagnostics, intervals, uncertainty, drift, validation against the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, intervals, metrics, splits, stockout
from ..sources import demand_tables as src
from .demand_queries import demand, stock
from .forecast_queries import METRICS_SQL, predictions
from .lineage import cut
from .registry import cte, query


@query("forecast_metrics", "count:i mae:6 rmse:6 smape:6 bias:6",
       f"SELECT count(*) AS count, {METRICS_SQL} FROM predictions", "predictions")
def _(spark, sf):
    return metrics.evaluate(predictions(spark, sf))


_VARIANTS = {
    "zero": "avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) * 100",
    "epsilon": "avg(2 * abs(actual - predicted) / (abs(actual) + abs(predicted) + 1e-6)) * 100",
    "threshold": "avg(CASE WHEN abs(actual) + abs(predicted) > 1e-12 THEN 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) ELSE 0 END) * 100",
}


@query("smape_variants", "zero:6 epsilon:6 threshold:6",
       "SELECT " + ", ".join(f"{s} AS {n}" for n, s in _VARIANTS.items()) + " FROM predictions", "predictions")
def _(spark, sf):
    return predictions(spark, sf).agg(
        *[(F.avg(metrics.smape_term("actual", "predicted", v)) * 100.0).alias(v) for v in _VARIANTS])


@query("row_errors", "outlet_id product_id date:d error:6 absolute_error:6 squared_error:5", """
SELECT *, predicted - actual AS error, abs(predicted - actual) AS absolute_error, (predicted - actual) ** 2 AS squared_error
FROM predictions""", "predictions")
def _(spark, sf):
    return metrics.row_errors(predictions(spark, sf))


@query("bias_analysis", "mean_bias:6 overforecast_rate:6 underforecast_rate:6 max_overforecast:6 max_underforecast:6", """
SELECT avg(predicted - actual) AS mean_bias, avg(CAST(predicted > actual AS DOUBLE)) AS overforecast_rate,
  avg(CAST(predicted < actual AS DOUBLE)) AS underforecast_rate, max(predicted - actual) AS max_overforecast,
  min(predicted - actual) AS max_underforecast FROM predictions""", "predictions")
def _(spark, sf):
    return metrics.bias_analysis(predictions(spark, sf))


@query("high_demand_metrics", "threshold:6 count:i mae:6 rmse:6 smape:6 bias:6", f"""
SELECT (SELECT quantile_cont(actual, 0.9) FROM predictions) AS threshold, count(*) AS count, {METRICS_SQL}
FROM predictions WHERE actual >= (SELECT quantile_cont(actual, 0.9) FROM predictions)""", "predictions")
def _(spark, sf):
    return metrics.high_demand(cut(predictions(spark, sf)))


@query("spike_recall", "spike_recall:6", """
SELECT avg(CAST(predicted >= (SELECT quantile_cont(predicted, 0.9) FROM predictions) AS DOUBLE)) AS spike_recall
FROM predictions WHERE actual >= (SELECT quantile_cont(actual, 0.9) FROM predictions)""", "predictions")
def _(spark, sf):
    return metrics.spike_recall(cut(predictions(spark, sf)))


def _by(name: str, key: str):
    @query(name, f"{key} count:i mae:6 rmse:6 smape:6 bias:6",
           f"SELECT {key}, count(*) AS count, {METRICS_SQL} FROM predictions GROUP BY 1", "predictions")
    def _(spark, sf):
        return metrics.group_diagnostics(predictions(spark, sf), key)


_by("outlet_diagnostics", "outlet_id")
_by("product_diagnostics", "product_id")


_REPORT = {
    "overall": {"count": "count(*)", "mae": "avg(abs(e))", "rmse": "sqrt(avg(e * e))", "smape": "coalesce(avg(2 * abs(e) / nullif(abs(actual) + abs(predicted), 0)), 0) * 100", "bias": "avg(e)"},
    "bias": {"mean_bias": "avg(e)", "overforecast_rate": "avg(CAST(e > 0 AS DOUBLE))", "underforecast_rate": "avg(CAST(e < 0 AS DOUBLE))",
             "max_overforecast": "max(e)", "max_underforecast": "min(e)"},
    "high_demand": {"threshold": "max(a90)", "count": "count(*) FILTER (actual >= a90)", "mae": "avg(abs(e)) FILTER (actual >= a90)",
                    "rmse": "sqrt(avg(e * e) FILTER (actual >= a90))", "bias": "avg(e) FILTER (actual >= a90)"},
    "spikes": {"recall": "avg(CAST(predicted >= p90 AS DOUBLE)) FILTER (actual >= a90)"},
}
_ROWS = """(SELECT *, predicted - actual AS e FROM predictions,
  (SELECT quantile_cont(actual, 0.9) AS a90, quantile_cont(predicted, 0.9) AS p90 FROM predictions) q) r"""
_PARTS = [f"SELECT '{section}' AS section, '' AS item, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {_ROWS}"
          for section, measures in _REPORT.items() for m, e in measures.items()]
_PARTS += [f"SELECT '{g}', {g}, '{m}', CAST({e} AS DOUBLE) FROM {_ROWS} GROUP BY {g}" for g in ("outlet_id", "product_id") for m, e in _REPORT["overall"].items()]


@query("diagnostic_report", "section item metric value:6", " UNION ALL ".join(_PARTS), "predictions")
def _(spark, sf):
    return metrics.diagnostic_report(predictions(spark, sf))


@query("ablation_metrics", "mae:6 rmse:6 smape:6 bias:6 high_demand_mae:6 spike_recall:6", f"""
SELECT {METRICS_SQL}, avg(abs(predicted - actual)) FILTER (actual >= q75) AS high_demand_mae,
  avg(CAST(predicted >= q90 AS DOUBLE)) FILTER (actual >= q90) AS spike_recall
FROM predictions, (SELECT quantile_cont(actual, 0.75) AS q75, quantile_cont(actual, 0.9) AS q90 FROM predictions) q""", "predictions")
def _(spark, sf):
    return metrics.ablation_metrics(cut(predictions(spark, sf)))


# --- intervals -----------------------------------------------------------------------------------

cte("cal", "SELECT *, actual - predicted AS r FROM split_parts WHERE split = 'calibration'", "split_parts")
cte("ev", "SELECT * FROM split_parts WHERE split = 'evaluation'", "split_parts")
cte("radius", """
SELECT s AS radius FROM (SELECT abs(r) AS s, row_number() OVER (ORDER BY abs(r)) AS k, count(*) OVER () AS n FROM cal) a
WHERE k = greatest(1, least(CAST(ceil(round((n + 1) * 0.9::DOUBLE, 9)) AS BIGINT), n))""", "cal")
cte("shifts", "SELECT " + ", ".join(f"quantile_cont(r, {q}) AS s{round(q * 100):02d}" for q in intervals.DISTRIBUTION)
    + ", avg(r) AS m, stddev_samp(r) AS sd, avg(CAST(r > 0 AS DOUBLE)) AS r_pos, avg(CAST(r < 0 AS DOUBLE)) AS r_neg FROM cal", "cal")
cte("probabilistic", """
SELECT ev.*, radius, greatest(predicted - radius, 0) AS lower, greatest(predicted + radius, 0) AS upper,
  greatest(predicted + s10, 0) AS asymmetric_lower, greatest(predicted + s90, 0) AS asymmetric_upper,
  greatest(predicted + s10, 0) AS p10, greatest(predicted + s25, 0) AS p25, greatest(predicted, 0) AS p50,
  greatest(predicted + s75, 0) AS p75, greatest(predicted + s90, 0) AS p90
FROM ev, radius, shifts""", "ev", "radius", "shifts")


def parts(spark, sf):
    df = splits.fraction_split(cut(predictions(spark, sf)))
    return df.filter("split = 'evaluation'"), df.filter("split = 'calibration'")


@query("probabilistic_forecast", "outlet_id product_id date:d p10:6 p25:6 p50:6 p75:6 p90:6 lower:6 upper:6 "
       "asymmetric_lower:6 asymmetric_upper:6", "SELECT * FROM probabilistic", "probabilistic")
def _(spark, sf):
    return intervals.probabilistic_forecast(*parts(spark, sf))


@query("conformal_interval", "outlet_id product_id date:d lower:6 upper:6 radius:6", "SELECT * FROM probabilistic", "probabilistic")
def _(spark, sf):
    evaluation, calibration = parts(spark, sf)
    radius = intervals.conformal_radius(calibration)
    return intervals.conformal_interval(evaluation, radius).withColumn("radius", F.lit(radius))


@query("asymmetric_interval", "outlet_id product_id date:d asymmetric_lower:6 asymmetric_upper:6",
       "SELECT * FROM probabilistic", "probabilistic")
def _(spark, sf):
    evaluation, calibration = parts(spark, sf)
    low, high = intervals.residual_quantiles(calibration, [0.10, 0.90])
    return intervals.asymmetric_interval(evaluation, low, high)


@query("predictive_distribution", "outlet_id product_id date:d p05:6 p10:6 p25:6 p50:6 p75:6 p90:6 p95:6 predictive_mean:6 "
       "predictive_std:6 predictive_width_90:6 predictive_width_80:6 residual_positive_probability:6 "
       "residual_negative_probability:6", """
SELECT *, predicted + m AS predictive_mean, sd AS predictive_std, p95 - p05 AS predictive_width_90, p90 - p10 AS predictive_width_80,
  r_pos AS residual_positive_probability, r_neg AS residual_negative_probability
FROM (SELECT ev.*, m, sd, r_pos, r_neg, """ + ", ".join(
    f"greatest(predicted + s{n}, 0) AS p{n}" for n in ("05", "10", "25", "50", "75", "90", "95")) + " FROM ev, shifts) a", ("ev", "shifts"))
def _(spark, sf):
    return intervals.predictive_distribution(*parts(spark, sf))


_LOSS = "\nUNION ALL ".join(
    f"""SELECT 'p{q}' AS name, {q / 100} AS quantile, avg(greatest({q / 100} * (actual - p{q}), ({q / 100} - 1) * (actual - p{q}))) AS pinball_loss,
  avg(CAST(actual < p{q} AS DOUBLE)) AS below_rate, -1.0 AS coverage, -1.0 AS mean_width FROM probabilistic""" for q in (10, 25, 50, 75, 90))


@query("calibration_report", "name quantile:6 pinball_loss:6 below_rate:6 coverage:6 mean_width:6", f"""{_LOSS}
UNION ALL SELECT 'conformal_90', -1.0, -1.0, -1.0, avg(CAST(actual BETWEEN lower AND upper AS DOUBLE)), avg(upper - lower) FROM probabilistic
UNION ALL SELECT 'asymmetric_80', -1.0, -1.0, -1.0, avg(CAST(actual BETWEEN asymmetric_lower AND asymmetric_upper AS DOUBLE)),
  avg(asymmetric_upper - asymmetric_lower) FROM probabilistic""", "probabilistic")
def _(spark, sf):
    report = intervals.calibration_report(intervals.probabilistic_forecast(*parts(spark, sf)))
    return report.fillna(-1.0)


@query("error_profile", "count:i mean_error:6 std_error:6 mae:6 p50_absolute_error:6 p75_absolute_error:6 p90_absolute_error:6 "
       "p95_absolute_error:6 p99_absolute_error:6", """
SELECT count(*) AS count, avg(r) AS mean_error, stddev_samp(r) AS std_error, avg(abs(r)) AS mae, """ + ", ".join(
    f"quantile_cont(abs(r), {q / 100}) AS p{q}_absolute_error" for q in (50, 75, 90, 95, 99)) + " FROM cal", "cal")
def _(spark, sf):
    return intervals.error_profile(parts(spark, sf)[1])


cte("uncertain", """
SELECT *, 1 / (1 + (upper_bound - lower_bound) / greatest(abs(predicted), 1)) AS confidence
FROM (SELECT ev.*, greatest(predicted + s10, 0) AS lower_bound, greatest(predicted + s90, 0) AS upper_bound FROM ev, shifts) a""",
    "ev", "shifts")


def uncertain(spark, sf):
    evaluation, calibration = parts(spark, sf)
    return intervals.uncertainty(evaluation, *intervals.residual_quantiles(calibration, [0.10, 0.90]))


@query("prediction_uncertainty", "outlet_id product_id date:d lower_bound:6 upper_bound:6 confidence:6 confidence_label", """
SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_label
FROM uncertain""", "uncertain")
def _(spark, sf):
    return uncertain(spark, sf)


@query("interval_reliability", "coverage:6 mean_interval_width:6 median_interval_width:6", """
SELECT avg(CAST(actual BETWEEN lower_bound AND upper_bound AS DOUBLE)) AS coverage, avg(upper_bound - lower_bound) AS mean_interval_width,
  quantile_cont(upper_bound - lower_bound, 0.5) AS median_interval_width FROM uncertain""", "uncertain")
def _(spark, sf):
    return intervals.reliability(uncertain(spark, sf))


@query("forecast_violations", "p10_above_p25:i p25_above_p50:i p50_above_p75:i p75_above_p90:i lower_above_upper:i p50_missing:i", """
SELECT count(*) FILTER (p10 > p25 + 1e-9) AS p10_above_p25, count(*) FILTER (p25 > p50 + 1e-9) AS p25_above_p50,
  count(*) FILTER (p50 > p75 + 1e-9) AS p50_above_p75, count(*) FILTER (p75 > p90 + 1e-9) AS p75_above_p90,
  count(*) FILTER (lower > upper + 1e-9) AS lower_above_upper, count(*) FILTER (p50 IS NULL) AS p50_missing FROM probabilistic""",
       "probabilistic")
def _(spark, sf):
    return intervals.forecast_violations(intervals.probabilistic_forecast(*parts(spark, sf)))


# --- drift --------------------------------------------------------------------------------------------

FEATURES = ("quantity_sold", "discount", "closing_stock")
cte("drift_base", "SELECT *, CASE WHEN date < DATE '1999-01-01' THEN 'r' ELSE 'c' END AS part FROM facts", "facts")
for _f in FEATURES:
    cte(f"edges_{_f}", f"""SELECT list_sort(list_distinct(quantile_cont({_f}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
FROM drift_base""", "drift_base")
    cte(f"psi_{_f}", f"""
SELECT '{_f}' AS feature, greatest(sum((c - r) * ln(c / r)), 0) AS psi
FROM (SELECT greatest(count(*) FILTER (part = 'r') / (SELECT count(*) FROM drift_base WHERE part = 'r'), 1e-6) AS r,
        greatest(count(*) FILTER (part = 'c') / (SELECT count(*) FROM drift_base WHERE part = 'c'), 1e-6) AS c
      FROM drift_base, edges_{_f} GROUP BY len(list_filter(e[2:-2], lambda x: {_f} >= x))) a""", "drift_base", f"edges_{_f}")
    cte(f"drift_{_f}", f"""
SELECT *, psi >= 0.25 OR mean_shift >= 0.2 AS drifted
FROM (SELECT *, abs(current_mean - reference_mean) / greatest(abs(reference_mean), 1e-6) AS mean_shift
FROM psi_{_f}, (SELECT avg({_f}) FILTER (part = 'r') AS reference_mean, avg({_f}) FILTER (part = 'c') AS current_mean FROM drift_base) m) z""",
        f"psi_{_f}", "drift_base")
DRIFT_SQL = " UNION ALL ".join(f"SELECT * FROM drift_{f}" for f in FEATURES)
DRIFT_NEEDS = tuple(f"drift_{f}" for f in FEATURES)


def drifted(spark, sf):
    facts = cut(src.daily_facts(spark, sf))
    old, new = (facts.filter(c) for c in ("date < DATE '1999-01-01'", "date >= DATE '1999-01-01'"))
    return drift.drift_report(old, new, FEATURES)


@query("drift_report", "feature reference_mean:6 current_mean:6 mean_shift:6 psi:6 drifted:b", DRIFT_SQL, DRIFT_NEEDS)
def _(spark, sf):
    return drifted(spark, sf)


@query("retraining_decision", "drifted:i features reasons should_retrain:b", f"""
SELECT d AS drifted, features, CASE WHEN d >= 1 THEN 'significant_drift:' || d || '; new_data:900' ELSE 'new_data:900' END AS reasons,
  true AS should_retrain
FROM (SELECT count(*) FILTER (drifted) AS d, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (drifted), '') AS features
      FROM ({DRIFT_SQL}) x) a""", DRIFT_NEEDS)
def _(spark, sf):
    made = drift.retraining_decision(drifted(spark, sf), new_rows=900)
    return made.select("drifted", F.array_join("drifted_features", ",").alias("features"),
                       F.array_join("reasons", "; ").alias("reasons"), "should_retrain")


@query("error_degradation", "reference_mae:6 current_mae:6 error_degradation:6", """
SELECT *, (current_mae - reference_mae) / reference_mae AS error_degradation
FROM (SELECT avg(abs(actual - predicted)) FILTER (date < DATE '1999-01-01') AS reference_mae,
        avg(abs(actual - predicted)) FILTER (date >= DATE '1999-01-01') AS current_mae FROM predictions) a""", "predictions")
def _(spark, sf):
    df = predictions(spark, sf)
    return drift.error_degradation(df.filter("date < DATE '1999-01-01'"), df.filter("date >= DATE '1999-01-01'"))


@query("candidate_evaluation", "rows:i champion_mae:6 candidate_mae:6 champion_rmse:6 candidate_rmse:6 champion_bias:6 "
       "candidate_bias:6 improvement_pct:6 bias_change:6 passes:b", """
SELECT *, improvement_pct >= 2 AND bias_change <= 1 AS passes
FROM (SELECT *, (champion_mae - candidate_mae) / champion_mae * 100 AS improvement_pct, abs(candidate_bias) - abs(champion_bias) AS bias_change
FROM (SELECT count(*) AS rows, avg(abs(naive - actual)) AS champion_mae, avg(abs(moving - actual)) AS candidate_mae,
  sqrt(avg((naive - actual) ** 2)) AS champion_rmse, sqrt(avg((moving - actual) ** 2)) AS candidate_rmse,
  avg(naive - actual) AS champion_bias, avg(moving - actual) AS candidate_bias FROM predictions) a) b""", "predictions")
def _(spark, sf):
    return drift.candidate_evaluation(predictions(spark, sf), "naive", "moving")


@query("candidate_metrics", "count:i mae:6 rmse:6 bias:6", f"SELECT count(*) AS count, {METRICS_SQL} FROM predictions", "predictions")
def _(spark, sf):
    return metrics.candidate_metrics(predictions(spark, sf))


# One "package" per outlet: its rows, and whether it sold anything at a discount of 10 or more.
@query("training_eligibility", "package_id rows:i reason eligible:b", """
SELECT *, reason = 'TRAINING_ELIGIBLE' AS eligible
FROM (SELECT outlet_id AS package_id, count(*) AS rows, CASE WHEN NOT (length(outlet_id) > 8) THEN 'REAL_CLIENT_DATA_REQUIRED'
  WHEN NOT (max(discount) >= 9) THEN 'VALIDATION_FAILED' WHEN count(*) < 600 THEN 'INSUFFICIENT_DATA:' || count(*) || '<600'
  ELSE 'TRAINING_ELIGIBLE' END AS reason FROM facts GROUP BY 1) a""", "facts")
def _(spark, sf):
    packages = src.daily_facts(spark, sf).groupBy(F.col("outlet_id").alias("package_id")).agg(
        F.count(F.lit(1)).alias("rows"), (F.max("discount") >= 9).alias("valid"),
        (F.length(F.first("outlet_id")) > 8).alias("is_real_client_data"))
    return drift.training_eligibility(packages, minimum_rows=600)


# --- estimate against a truth: the plain estimator plays the truth ------------------------------------------

cte("joined_truth", """
SELECT d.*, t.true_demand, t.lost_demand FROM decon d JOIN true_demand t USING (outlet_id, product_id, date)""", "decon", "true_demand")


def truth(spark, sf):
    made = stockout.estimate_true_demand(*stock(spark, sf))
    return made.withColumn("observed_sales", F.col("quantity_sold"))


cte("validated", """
SELECT count(*) AS rows_compared, avg(abs(d - t)) AS demand_mae, sqrt(avg((d - t) ** 2)) AS demand_rmse, avg(d - t) AS demand_bias,
  1 - sum(abs(t - d)) / sum(abs(t)) AS demand_recovery, avg(abs(e - l)) AS lost_demand_mae, sqrt(avg((e - l) ** 2)) AS lost_demand_rmse,
  avg(e - l) AS lost_demand_bias, 1 - sum(abs(l - e)) / sum(abs(l)) AS lost_demand_recovery,
  avg(CAST(demand_constrained_estimated = (l > 1e-9) AS DOUBLE)) AS constraint_accuracy,
  avg(abs(least(greatest(quantity_sold / greatest(t, 1e-9), 0), 1) - estimated_fulfillment_rate)) AS fulfillment_mae,
  count(*) FILTER (stockout) AS stockout_rows, avg(abs(d - t)) FILTER (stockout) AS stockout_demand_mae,
  sqrt(avg((d - t) ** 2) FILTER (stockout)) AS stockout_demand_rmse, avg(d - t) FILTER (stockout) AS stockout_demand_bias,
  avg(abs(e - l)) FILTER (stockout) AS stockout_lost_demand_mae,
  1 - sum(abs(l - e)) FILTER (stockout) / sum(abs(l)) FILTER (stockout) AS stockout_lost_demand_recovery
FROM (SELECT *, deconstrained_demand AS d, true_demand AS t, estimated_lost_demand AS e, lost_demand AS l FROM joined_truth) a""",
    "joined_truth")


@query("estimate_validation", "rows_compared:i demand_mae:6 demand_rmse:6 demand_bias:6 demand_recovery:6 lost_demand_mae:6 "
       "lost_demand_rmse:6 lost_demand_bias:6 lost_demand_recovery:6 constraint_accuracy:6 fulfillment_mae:6 stockout_rows:i "
       "stockout_demand_mae:6 stockout_demand_rmse:6 stockout_demand_bias:6 stockout_lost_demand_mae:6 "
       "stockout_lost_demand_recovery:6", "SELECT * FROM validated", "validated")
def _(spark, sf):
    return metrics.estimate_validation(demand(spark, sf), truth(spark, sf))


@query("truth_relations", "rows:i true_demand_ge_observed:b lost_demand_nonnegative:b stockout_has_lost_demand:b max_accounting_error:6", """
SELECT count(*) AS rows, bool_and(true_demand >= quantity_sold - 1e-9) AS true_demand_ge_observed,
  bool_and(lost_demand >= -1e-9) AS lost_demand_nonnegative, bool_and(NOT stockout OR lost_demand > -1e-9) AS stockout_has_lost_demand,
  max(abs(true_demand - quantity_sold - lost_demand)) AS max_accounting_error FROM true_demand""", "true_demand")
def _(spark, sf):
    return metrics.truth_relations(truth(spark, sf))


@query("output_integrity", "rows:i null_demand:i null_lost_demand:i demand_below_observed:i negative_lost_demand:i "
       "invalid_censoring_strength:i stockout_records:i censored_records:i", """
SELECT count(*) AS rows, 0 AS null_demand, 0 AS null_lost_demand,
  count(*) FILTER (deconstrained_demand < quantity_sold - 1e-9) AS demand_below_observed,
  count(*) FILTER (estimated_lost_demand < -1e-9) AS negative_lost_demand,
  count(*) FILTER (censoring_strength NOT BETWEEN -1e-9 AND 1 + 1e-9) AS invalid_censoring_strength,
  count(*) FILTER (stockout) AS stockout_records, count(*) FILTER (censored_demand_flag) AS censored_records FROM censored""", "censored")
def _(spark, sf):
    return metrics.output_integrity(stockout.censoring_analysis(demand(spark, sf)))


@query("demand_acceptance", "truth_accounting:b censoring_strength_valid:b demand_recovery_positive:b lost_demand_recovery_positive:b passed:b", """
SELECT true AS truth_accounting, true AS censoring_strength_valid, demand_recovery > 0 AS demand_recovery_positive,
  lost_demand_recovery > 0 AS lost_demand_recovery_positive, demand_recovery > 0 AND lost_demand_recovery > 0 AS passed FROM validated""",
       "validated")
def _(spark, sf):
    found, made = truth(spark, sf), demand(spark, sf)
    return metrics.acceptance(metrics.truth_relations(found),
                              metrics.output_integrity(stockout.censoring_analysis(made)),
                              metrics.estimate_validation(made, found))

"""Queries: splits, baselines, backtests, model comparison, ensembles, series selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import lagged, rolling
from ..operators import baselines, ensemble, metrics, selection, splits
from ..sources import demand_tables as src
from .lineage import cut
from .oracle_parts import lag, roll
from .registry import cte, query

SERIES = "PARTITION BY outlet_id, product_id"
MODELS = ("naive", "seasonal", "moving")


def predictions(spark, sf, table=None):
    """Facts with the actual value and three causal predictions per day."""
    facts = table if table is not None else src.daily_facts(spark, sf)
    made = facts.select("outlet_id", "product_id", "date", F.col("quantity_sold").alias("actual")).withColumns({
        "naive": lagged("actual"), "seasonal": lagged("actual", 7), "moving": rolling("actual", 7, F.avg, 1)})
    return made.filter("seasonal IS NOT NULL").withColumn("predicted", F.col("moving"))


cte("predictions", f"""
SELECT *, moving AS predicted FROM (
  SELECT outlet_id, product_id, date, quantity_sold AS actual, {lag("quantity_sold", 1)} AS naive,
    {lag("quantity_sold", 7)} AS seasonal, {roll("quantity_sold", 7, "avg", 1)} AS moving FROM facts) a
WHERE seasonal IS NOT NULL""", "facts")

# --- splits ------------------------------------------------------------------------------------

cte("split_days", """
SELECT *, CASE WHEN back <= 30 THEN 'test' WHEN back <= 60 THEN 'validation' ELSE 'train' END AS split
FROM predictions JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM predictions) d) b
  USING (date)""", "predictions")
cte("split_parts", """
SELECT *, CASE WHEN pos >= floor(n * 0.85) THEN 'evaluation' WHEN pos >= floor(n * 0.70) THEN 'calibration' ELSE 'train' END AS split
FROM predictions JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n
  FROM (SELECT DISTINCT date FROM predictions) d) b USING (date)""", "predictions")


@query("split_last_days", "split rows:i first_day:d last_day:d", """
SELECT split, count(*) AS rows, min(date) AS first_day, max(date) AS last_day FROM split_days GROUP BY 1""", "split_days")
def _(spark, sf):
    return splits.last_days_split(cut(predictions(spark, sf))).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("split_fractions", "split rows:i first_day:d last_day:d", """
SELECT split, count(*) AS rows, min(date) AS first_day, max(date) AS last_day FROM split_parts GROUP BY 1""", "split_parts")
def _(spark, sf):
    return splits.fraction_split(cut(predictions(spark, sf))).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("keep_last_union", "outlet_id product_id date:d quantity_sold:6", """
SELECT outlet_id, product_id, date, CASE WHEN day(date) <= 10 THEN quantity_sold + 1 ELSE quantity_sold END AS quantity_sold
FROM facts""", "facts")
def _(spark, sf):
    facts = src.sales(src.daily_facts(spark, sf))
    newer = facts.filter(F.dayofmonth("date") <= 10).withColumn("quantity_sold", F.col("quantity_sold") + 1)
    return splits.keep_last(facts, newer, ["outlet_id", "product_id", "date"])


# --- baselines -----------------------------------------------------------------------------------

cte("tails", f"""
SELECT outlet_id, product_id, max(date) AS last_day, list(quantity_sold ORDER BY date) FILTER (back <= 7) AS t
FROM (SELECT *, row_number() OVER ({SERIES} ORDER BY date DESC) AS back FROM event_series) a GROUP BY 1, 2""", "event_series")
cte("baseline_rows", """
SELECT outlet_id, product_id, last_day + h::INTEGER AS date, h AS horizon, method, greatest(CASE method WHEN 'naive' THEN t[-1]
  WHEN 'seasonal_naive' THEN CASE WHEN len(t) >= 7 THEN t[(h - 1) % 7 + 1] ELSE t[-1] END
  ELSE list_avg(t) END, 0) AS prediction
FROM tails, range(1, 8) r(h), (VALUES ('naive'), ('seasonal_naive'), ('moving_average')) m(method)""", "tails")


@query("baseline_forecasts", "outlet_id product_id date:d horizon:i method prediction:6", "SELECT * FROM baseline_rows", "baseline_rows")
def _(spark, sf):
    return baselines.baseline_forecast(src.event_series(spark, sf), 7)


@query("horizon_totals", "horizon:i rows:i total_forecast:4 mean_forecast:6", """
SELECT k AS horizon, count(*) AS rows, sum(prediction) AS total_forecast, avg(prediction) AS mean_forecast
FROM baseline_rows, (VALUES (1), (3), (7)) n(k) WHERE method = 'moving_average' AND horizon <= k GROUP BY 1""", "baseline_rows")
def _(spark, sf):
    return baselines.horizon_summary(baselines.baseline_forecast(src.event_series(spark, sf), 7, ["moving_average"]))


@query("horizon_pivot", "outlet_id product_id d1:6 d2:6 d3:6 d4:6 d5:6 d6:6 d7:6", """
SELECT outlet_id, product_id, """ + ", ".join(f"max(prediction) FILTER (horizon = {h}) AS d{h}" for h in range(1, 8)) + """
FROM baseline_rows WHERE method = 'seasonal_naive' GROUP BY 1, 2""", "baseline_rows")
def _(spark, sf):
    return baselines.pivot_horizon(baselines.baseline_forecast(src.event_series(spark, sf), 7, ["seasonal_naive"]))


cte("held_out", f"""
SELECT outlet_id, product_id, list(quantity_sold ORDER BY date) FILTER (back BETWEEN 8 AND 14) AS t,
  list(quantity_sold ORDER BY date) FILTER (back <= 7) AS y
FROM (SELECT *, row_number() OVER ({SERIES} ORDER BY date DESC) AS back FROM facts) a
GROUP BY 1, 2 HAVING count(*) > 7""", "facts")
cte("backtest", """
SELECT outlet_id, product_id, h AS horizon, y[h] AS actual, model_name, greatest(CASE model_name WHEN 'naive' THEN t[-1]
  WHEN 'seasonal_naive' THEN CASE WHEN len(t) >= 7 THEN t[(h - 1) % 7 + 1] ELSE t[-1] END ELSE list_avg(t) END, 0) AS predicted
FROM held_out, range(1, 8) r(h), (VALUES ('naive'), ('seasonal_naive'), ('moving_average')) m(model_name)""", "held_out")

METRICS_SQL = """avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse,
  coalesce(avg(2 * abs(actual - predicted) / nullif(abs(actual) + abs(predicted), 0)), 0) * 100 AS smape, avg(predicted - actual) AS bias"""


@query("backtest_forecasts", "outlet_id product_id horizon:i model_name actual:6 predicted:6", "SELECT * FROM backtest", "backtest")
def _(spark, sf):
    return baselines.backtest_forecasts(src.daily_facts(spark, sf), 7)


@query("backtest_metrics", "outlet_id product_id model_name count:i mae:6 rmse:6 smape:6 bias:6", f"""
SELECT outlet_id, product_id, model_name, count(*) AS count, {METRICS_SQL} FROM backtest GROUP BY 1, 2, 3""", "backtest")
def _(spark, sf):
    rows = baselines.backtest_forecasts(src.daily_facts(spark, sf), 7)
    return metrics.evaluate(rows, by=["outlet_id", "product_id", "model_name"])


@query("horizon_evaluation", "horizon:i count:i mae:6 rmse:6 smape:6 bias:6", f"""
SELECT horizon, count(*) AS count, {METRICS_SQL}
FROM (SELECT horizon, actual, predicted FROM backtest WHERE model_name = 'moving_average') a GROUP BY 1""", "backtest")
def _(spark, sf):
    from pyspark.sql import Window
    facts = cut(src.daily_facts(spark, sf).select("outlet_id", "product_id", "date", "quantity_sold"))
    back = F.row_number().over(Window.partitionBy("outlet_id", "product_id").orderBy(F.desc("date")))
    days = facts.withColumn("_back", back).filter("_back <= 7").select(
        "outlet_id", "product_id", "date", (8 - F.col("_back")).alias("horizon"))
    rows = baselines.backtest_forecasts(facts, 7, ["moving_average"]).withColumnRenamed("predicted", "prediction")
    forecasts = rows.join(days, ["outlet_id", "product_id", "horizon"])
    return metrics.horizon_evaluation(facts, forecasts)


# --- comparison of models --------------------------------------------------------------------------

GROUP = "PARTITION BY outlet_id, product_id, model_name"
cte("scored", f"""
SELECT *, CASE WHEN n < 2 OR scale <= 1e-12 THEN 1.0 ELSE 1 / (1 + vol / scale) END AS stability, 0.0 AS prediction_cost
FROM (SELECT outlet_id, product_id, model_name, count(*) AS n,
    avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse,
    avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) * 100 AS smape,
    avg(predicted - actual) AS bias, avg(abs(predicted - actual)) FILTER (actual >= a90) AS high_demand_mae,
    avg(predicted - actual) FILTER (actual >= a90) AS high_demand_bias,
    avg(CAST(predicted >= p90 AS DOUBLE)) FILTER (actual >= a90) AS spike_recall, stddev_pop(step) AS vol, avg(abs(predicted)) AS scale
  FROM (SELECT *, quantile_cont(actual, 0.9) OVER ({GROUP}) AS a90, quantile_cont(predicted, 0.9) OVER ({GROUP}) AS p90,
          predicted - lag(predicted) OVER ({GROUP} ORDER BY horizon) AS step FROM backtest) a
  GROUP BY 1, 2, 3) b""", "backtest")
SCORES = "mae:6 rmse:6 smape:6 bias:6 high_demand_mae:6 high_demand_bias:6 spike_recall:6 stability:6 prediction_cost:6"


def scores(spark, sf):
    return metrics.model_scores(baselines.backtest_forecasts(src.daily_facts(spark, sf), 7))


@query("model_scores", f"outlet_id product_id model_name test_rows:i {SCORES}", "SELECT *, n AS test_rows FROM scored", "scored")
def _(spark, sf):
    return scores(spark, sf)


def _minmax(c: str, up: bool) -> str:
    w = "PARTITION BY outlet_id, product_id"
    low, high = f"min({c}) OVER ({w})", f"max({c}) OVER ({w})"
    part = f"({c} - {low}) / ({high} - {low})"
    return f"CASE WHEN {high} - {low} <= 1e-12 THEN 1.0 ELSE {part if up else '1 - ' + part} END"


cte("criteria", "SELECT *, " + ", ".join(f"{w} * ({_minmax(c, up)}) AS w_{c}" for c, w, up in ensemble.CRITERIA) + " FROM scored", "scored")


@query("model_ranking", "outlet_id product_id model_name error_score:6 behavior_score:6 cost_score:6 score:6 rank:i", """
SELECT *, rank() OVER (PARTITION BY outlet_id, product_id ORDER BY round(score, 9) DESC) AS rank
FROM (SELECT *, w_mae + w_rmse + w_smape + w_high_demand_mae AS error_score, w_spike_recall + w_stability AS behavior_score,
  w_prediction_cost AS cost_score, w_mae + w_rmse + w_smape + w_high_demand_mae + w_spike_recall + w_stability + w_prediction_cost AS score
  FROM criteria) a""", "criteria")
def _(spark, sf):
    return ensemble.rank_models(scores(spark, sf), ["outlet_id", "product_id"])


@query("minmax_scores", "outlet_id product_id model_name position:6",
       f"SELECT *, {_minmax('stability', True)} AS position FROM scored", "scored")
def _(spark, sf):
    return scores(spark, sf).withColumn("position", ensemble.minmax_score("stability", True, ["outlet_id", "product_id"]))


cte("cut_scores", """
SELECT outlet_id, product_id, model_name, count(*) AS n_test, avg(abs(predicted - actual)) AS mae,
  sqrt(avg((predicted - actual) ** 2)) AS rmse, avg(2 * abs(actual - predicted) / (abs(actual) + abs(predicted) + 1e-6)) * 100 AS smape,
  avg(predicted - actual) AS bias, coalesce(avg(abs(predicted - actual)) FILTER (actual >= q90), 0) AS high_demand_mae,
  coalesce(avg(predicted - actual) FILTER (actual >= q90), 0) AS high_demand_bias,
  coalesce(avg(CAST(predicted >= q95 AS DOUBLE)) FILTER (actual >= q95), 0) AS spike_recall
FROM backtest JOIN (SELECT outlet_id, product_id, quantile_cont(quantity_sold, 0.9) AS q90, quantile_cont(quantity_sold, 0.95) AS q95
  FROM facts GROUP BY 1, 2) q USING (outlet_id, product_id) GROUP BY 1, 2, 3""", "backtest", "facts")
CUT = "n_test:i mae:6 rmse:6 smape:6 bias:6 high_demand_mae:6 high_demand_bias:6 spike_recall:6"


def cut_scores(spark, sf):
    facts = src.daily_facts(spark, sf)
    return metrics.train_threshold_scores(baselines.backtest_forecasts(facts, 7), facts, "quantity_sold")


@query("train_threshold_scores", f"outlet_id product_id model_name {CUT}", "SELECT * FROM cut_scores", "cut_scores")
def _(spark, sf):
    return cut_scores(spark, sf)


_WEIGHTED = ", ".join(f"sum({c} * n_test) / sum(n_test) AS {c}" for c in metrics.WEIGHTED)


@query("weighted_model_metrics", "model_name series_count:i test_observations:i mae:6 rmse:6 smape:6 bias:6 high_demand_mae:6 "
       "high_demand_bias:6 spike_recall:6 rank:i winner:b", f"""
SELECT *, row_number() OVER (ORDER BY mae, rmse, model_name) AS rank, row_number() OVER (ORDER BY mae, rmse, model_name) = 1 AS winner
FROM (SELECT model_name, count(*) AS series_count, sum(n_test) AS test_observations, {_WEIGHTED} FROM cut_scores GROUP BY 1) a""",
       "cut_scores")
def _(spark, sf):
    return metrics.weighted_by_model(cut_scores(spark, sf))


@query("best_models", "outlet_id product_id best_mae:6 best_model", """
SELECT outlet_id, product_id, min(mae) AS best_mae, arg_min(model_name, (round(mae, 9), model_name)) AS best_model
FROM scored GROUP BY 1, 2""", "scored")
def _(spark, sf):
    rounded = scores(spark, sf).withColumn("mae", F.round("mae", 9))
    return metrics.best_models(rounded)


@query("model_mae_pivot", "outlet_id product_id naive:6 seasonal_naive:6 moving_average:6 best_mae:6", """
SELECT outlet_id, product_id, max(mae) FILTER (model_name = 'naive') AS naive,
  max(mae) FILTER (model_name = 'seasonal_naive') AS seasonal_naive,
  max(mae) FILTER (model_name = 'moving_average') AS moving_average, min(mae) AS best_mae FROM scored GROUP BY 1, 2""", "scored")
def _(spark, sf):
    return metrics.pivot_models(scores(spark, sf), baselines.METHODS)


@query("model_switch_decision", "champion_mae:6 challenger_mae:6 improvement:6 series_win_rate:6 recommendation", """
SELECT *, CASE WHEN improvement >= 0.02 AND series_win_rate >= 0.5 THEN 'SWITCH' ELSE 'KEEP' END AS recommendation
FROM (SELECT *, (champion_mae - challenger_mae) / greatest(champion_mae, 1e-9) AS improvement
FROM (SELECT sum(o * n) / sum(n) AS champion_mae, sum(w * n) / sum(n) AS challenger_mae, avg(CAST(w < o AS DOUBLE)) AS series_win_rate
FROM (SELECT max(mae) FILTER (model_name = 'naive') AS o, max(mae) FILTER (model_name = 'moving_average') AS w, max(n_test) AS n
      FROM cut_scores GROUP BY outlet_id, product_id) a) b) c""", "cut_scores")
def _(spark, sf):
    return metrics.switch_decision(cut_scores(spark, sf), "naive", "moving_average")


# --- ensembles ----------------------------------------------------------------------------------------

PAIR = "PARTITION BY outlet_id, product_id"
cte("weights", f"""
SELECT *, arg_max(model_name, (weight, -mae)) OVER ({PAIR}) AS selected_model,
  least(greatest(0.7 * max(weight) OVER ({PAIR}) + 0.3 * (1 - CASE WHEN used > 1 THEN entropy / ln(used) ELSE 0 END), 0), 1) AS confidence
FROM (SELECT *, sum(CAST(weight > 0 AS INTEGER)) OVER ({PAIR}) AS used,
        sum(CASE WHEN weight > 0 THEN -weight * ln(greatest(weight, 1e-12)) ELSE 0 END) OVER ({PAIR}) AS entropy
FROM (SELECT *, CASE WHEN max(kept) OVER ({PAIR}) = 0 THEN CAST(row_number() OVER ({PAIR} ORDER BY mae, model_name) = 1 AS DOUBLE)
        ELSE kept / sum(kept) OVER ({PAIR}) END AS weight
FROM (SELECT *, CASE WHEN raw / sum(raw) OVER ({PAIR}) >= 0.05 THEN raw / sum(raw) OVER ({PAIR}) ELSE 0 END AS kept
FROM (SELECT *, greatest(stability, 1e-6) ** 0.25 / (greatest(mae, 1e-8) * 7 ** 0.15) AS raw FROM scored) a) b) c) d""", "scored")


@query("model_weights", "outlet_id product_id model_name weight:6 confidence:6", "SELECT * FROM weights", "weights")
def _(spark, sf):
    return ensemble.model_weights(scores(spark, sf), ["outlet_id", "product_id"], horizon=7)


@query("ensemble_forecast", "outlet_id product_id horizon:i predicted:6", """
SELECT outlet_id, product_id, horizon, greatest(sum(predicted * weight) / sum(weight), 0) AS predicted
FROM backtest JOIN weights USING (outlet_id, product_id, model_name) GROUP BY 1, 2, 3""", ("backtest", "weights"))
def _(spark, sf):
    rows = baselines.backtest_forecasts(src.daily_facts(spark, sf), 7)
    weights = ensemble.model_weights(metrics.model_scores(rows), ["outlet_id", "product_id"], horizon=7)
    return ensemble.combine(rows, weights, ["outlet_id", "product_id"], ["horizon"])


cte("global_weights", """
SELECT model_name, kept / sum(kept) OVER () AS weight
FROM (SELECT *, CASE WHEN raw / sum(raw) OVER () >= 0.05 THEN raw / sum(raw) OVER () ELSE 0 END AS kept
FROM (SELECT model_name, 1 / greatest(avg(abs(p - actual)), 1e-8) AS raw
FROM (UNPIVOT (SELECT actual, naive, seasonal, moving FROM split_days WHERE split = 'validation') ON naive, seasonal, moving
      INTO NAME model_name VALUE p) a GROUP BY 1) b) c""", "split_days")
cte("hybrid_rows", """
SELECT actual, model_name, predicted FROM (
  UNPIVOT (SELECT *, greatest(naive * (SELECT weight FROM global_weights WHERE model_name = 'naive')
      + seasonal * (SELECT weight FROM global_weights WHERE model_name = 'seasonal')
      + moving * (SELECT weight FROM global_weights WHERE model_name = 'moving'), 0) AS hybrid
    FROM (SELECT actual, naive, seasonal, moving FROM split_days WHERE split = 'test') x)
  ON naive, seasonal, moving, hybrid INTO NAME model_name VALUE predicted) u""", "split_days", "global_weights")


@query("hybrid_evaluation", "model_name mae:6 rmse:6 smape:6 bias:6 high_demand_mae:6 spike_recall:6 weight:6 "
       "improvement_vs_best_individual_pct:6 hybrid_beats_all:b", """
SELECT *, (best - mae) / greatest(best, 1e-12) * 100 AS improvement_vs_best_individual_pct, blend < best AS hybrid_beats_all
FROM (SELECT m.*, coalesce(weight, 1.0) AS weight, min(mae) FILTER (m.model_name <> 'hybrid') OVER () AS best,
        max(mae) FILTER (m.model_name = 'hybrid') OVER () AS blend
FROM (SELECT model_name, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse,
  avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) * 100 AS smape,
  avg(predicted - actual) AS bias, avg(abs(predicted - actual)) FILTER (actual >= q75) AS high_demand_mae,
  avg(CAST(predicted >= q75 AS DOUBLE)) FILTER (actual >= q90) AS spike_recall
FROM hybrid_rows, (SELECT quantile_cont(actual, 0.75) AS q75, quantile_cont(actual, 0.9) AS q90 FROM split_days WHERE split = 'test') q
GROUP BY 1) m LEFT JOIN global_weights g ON g.model_name = m.model_name) z""", ("hybrid_rows", "global_weights"))
def _(spark, sf):
    return ensemble.hybrid_evaluation(splits.last_days_split(cut(predictions(spark, sf))), MODELS)


@query("adoption_decision", "candidate_mae:6 baseline_mae:6 improvement_pct:6 decision", """
SELECT *, CASE WHEN improvement_pct >= 2 THEN 'ADOPT' ELSE 'KEEP_OPTIONAL' END AS decision
FROM (SELECT *, (baseline_mae - candidate_mae) / greatest(baseline_mae, 1e-8) * 100 AS improvement_pct
FROM (SELECT avg(abs(moving - actual)) AS candidate_mae, avg(abs(naive - actual)) AS baseline_mae FROM split_days WHERE split = 'test') a) b""",
       "split_days")
def _(spark, sf):
    test = splits.last_days_split(cut(predictions(spark, sf))).filter("split = 'test'")
    modes = F.array(F.struct(F.lit("multimodal").alias("mode"), F.col("moving").alias("p")),
                    F.struct(F.lit("history").alias("mode"), F.col("naive").alias("p")))
    rows = test.select("actual", F.inline(modes)).groupBy("mode").agg(F.avg(F.abs(F.col("p") - F.col("actual"))).alias("test_mae"))
    return ensemble.adoption_decision(rows)


# --- series summaries ------------------------------------------------------------------------------------

cte("summary", f"""
SELECT *, (recent_mean - historical_mean) / greatest(historical_mean, 1e-6) AS recent_growth,
  recent_max / greatest(historical_mean, 1e-6) AS spike_ratio, std_demand / greatest(mean_demand, 1e-6) AS cv
FROM (SELECT outlet_id, product_id, avg(quantity_sold) AS mean_demand, coalesce(stddev_samp(quantity_sold), 0) AS std_demand,
  max(quantity_sold) AS max_demand, min(quantity_sold) AS min_demand, count(*) AS observations,
  avg(quantity_sold) FILTER (back <= 28) AS recent_mean,
  coalesce(avg(quantity_sold) FILTER (back > 28), avg(quantity_sold)) AS historical_mean,
  max(quantity_sold) FILTER (back <= 28) AS recent_max, avg(CAST(stockout AS DOUBLE)) FILTER (back <= 28) AS recent_stockout
FROM (SELECT *, row_number() OVER ({SERIES} ORDER BY date DESC) AS back FROM stocked) a GROUP BY 1, 2) b""", "stocked")
SUMMARY = ("outlet_id product_id mean_demand:6 std_demand:6 max_demand:6 min_demand:6 observations:i recent_mean:6 "
           "historical_mean:6 recent_max:6 recent_stockout:6 cv:6 recent_growth:6 spike_ratio:6")


def summary(spark, sf):
    return selection.series_summary(src.daily_facts(spark, sf).withColumn("stockout", F.col("closing_stock") == 0))


@query("series_summary", SUMMARY, "SELECT * FROM summary", "summary")
def _(spark, sf):
    return summary(spark, sf)


def _pick(name: str, operator, preferred: str, order: str, fallback: str | None = None):
    key = f"CASE WHEN {preferred} THEN {order} ELSE {fallback or order} END"

    @query(name, SUMMARY, f"""SELECT * FROM summary WHERE observations >= 35
ORDER BY CAST({preferred} AS INTEGER) DESC, round({key}, 9) DESC, outlet_id, product_id LIMIT 1""", "summary")
    def _(spark, sf):
        return operator(summary(spark, sf))


_pick("normal_series", selection.normal_series,
      "(cv BETWEEN 0.05 AND 0.35 AND abs(recent_growth) <= 0.1 AND recent_stockout <= 0.05)", "-(abs(cv - 0.18) + abs(recent_growth))")
_pick("spike_series", selection.spike_series, "(spike_ratio >= 1.25)", "spike_ratio")
_pick("shortage_series", selection.shortage_series, "(recent_stockout > 0)", "recent_stockout", "cv + greatest(recent_growth, 0)")
_pick("growth_series", selection.growth_series, "(recent_growth >= 0.15)", "recent_growth")
_pick("low_demand_series", selection.low_demand_series, "true", "-mean_demand")


@query("best_demo_series", "outlet_id product_id selection_score:6", """
SELECT *, 0.5 * mean_demand + 0.5 * recent_mean AS selection_score FROM summary WHERE observations >= 60
ORDER BY round(0.5 * mean_demand + 0.5 * recent_mean, 9) DESC, outlet_id, product_id LIMIT 1""", "summary")
def _(spark, sf):
    return selection.best_demo_series(summary(spark, sf))


@query("longest_series", "outlet_id product_id rows:i", """
SELECT outlet_id, product_id, count(*) AS rows FROM facts GROUP BY 1, 2 ORDER BY rows DESC, outlet_id, product_id LIMIT 24""", "facts")
def _(spark, sf):
    return selection.longest_series(src.daily_facts(spark, sf), 24)


@query("facts_of_longest_series", "outlet_id product_id date:d quantity_sold:6", """
SELECT * FROM facts WHERE (outlet_id, product_id) IN (SELECT (outlet_id, product_id) FROM
  (SELECT outlet_id, product_id, count(*) AS rows FROM facts GROUP BY 1, 2 ORDER BY rows DESC, outlet_id, product_id LIMIT 24) t)""", "facts")
def _(spark, sf):
    facts = src.daily_facts(spark, sf)
    return selection.only_series(facts, selection.longest_series(facts, 24))


@query("facts_of_long_series", "outlet_id product_id date:d quantity_sold:6", """
SELECT * FROM facts WHERE (outlet_id, product_id) IN (SELECT (outlet_id, product_id) FROM facts GROUP BY outlet_id, product_id HAVING count(*) >= 300)""", "facts")
def _(spark, sf):
    """All series that are long enough, however many there are."""
    facts = src.daily_facts(spark, sf)
    return selection.only_series(facts, selection.long_series(facts, 300))

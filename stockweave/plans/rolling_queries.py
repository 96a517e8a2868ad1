"""Queries: rolling-origin comparison of baselines and trees."""

from __future__ import annotations

from ..operators import ensemble, metrics, rolling
from ..sources import demand_tables as src
from .forecast_queries import METRICS_SQL
from .lineage import cut
from .registry import cte, query

PAIR = ("outlet_id", "product_id")
ORIGINS = 3

cte("origins", f"""
SELECT outlet_id, product_id, o AS origin, list(quantity_sold ORDER BY date) FILTER (back BETWEEN (o + 1) * 7 + 1 AND (o + 2) * 7) AS t,
  list(quantity_sold ORDER BY date) FILTER (back BETWEEN o * 7 + 1 AND (o + 1) * 7) AS y, list(date ORDER BY date) FILTER (back BETWEEN o * 7 + 1 AND (o + 1) * 7) AS days
FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id, product_id ORDER BY date DESC) AS back FROM facts) a, range(0, {ORIGINS}) r(o)
GROUP BY 1, 2, 3 HAVING count(*) > (o + 1) * 7""", "facts")
cte("rolled", """
SELECT outlet_id, product_id, origin, h AS horizon, days[h] AS date, y[h] AS actual, model_name, greatest(CASE model_name WHEN 'naive' THEN t[-1]
  WHEN 'seasonal_naive' THEN CASE WHEN len(t) >= 7 THEN t[(h - 1) % 7 + 1] ELSE t[-1] END ELSE list_avg(t) END, 0) AS predicted
FROM origins, range(1, 8) r(h), (VALUES ('naive'), ('seasonal_naive'), ('moving_average')) m(model_name)""", "origins")


def facts(spark, sf):
    return src.daily_facts(spark, sf).select(*PAIR, "date", "quantity_sold")


@query("rolling_baselines", "outlet_id product_id origin:i horizon:i date:d model_name actual:6 predicted:6", "SELECT * FROM rolled", "rolled")
def _(spark, sf):
    return rolling.baseline_folds(rolling.folds(facts(spark, sf), ORIGINS))


@query("rolling_origin_metrics", "origin:i model_name count:i mae:6 rmse:6 smape:6 bias:6", f"""
SELECT origin, model_name, count(*) AS count, {METRICS_SQL} FROM rolled GROUP BY 1, 2""", "rolled")
def _(spark, sf):
    return metrics.evaluate(rolling.baseline_folds(rolling.folds(facts(spark, sf), ORIGINS)), by=["origin", "model_name"])


@query("rolling_model_ranking", "outlet_id product_id model_name mae:6 score:6 rank:i")
def _(spark, sf):
    """Every series' ranking of three baselines and the trees over all folds; the trees have no SQL."""
    rows = rolling.in_order(cut(rolling.compare(facts(spark, sf), 2)))
    return ensemble.rank_models(metrics.model_scores(rows, PAIR, "step"), PAIR)

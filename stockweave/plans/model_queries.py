"""Queries: client actions, boosted trees, segments, text matrix. Trained results have no SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..operators import baselines, client, daily, metrics, models, outlets, segments, series, splits
from ..operators.text_matrix import TextMatrix
from ..sources import demand_tables as src
from .decision_queries import outlook
from .demand_queries import demand
from .lineage import cut
from .registry import cte, query

# --- client actions on a baseline forecast ------------------------------------------------------------

cte("client_base", """
SELECT t.*, baseline, deviation, inv.*, o.name AS outlet_name, p.name AS product_name
FROM (SELECT outlet_id, product_id, list(prediction ORDER BY horizon) AS f FROM fact_forecast GROUP BY 1, 2) t
JOIN (SELECT outlet_id, product_id, avg(quantity_sold) AS baseline, coalesce(stddev_samp(quantity_sold), 0) AS deviation
      FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id, product_id ORDER BY date DESC) AS back FROM facts) a
      WHERE back <= 28 GROUP BY 1, 2) l USING (outlet_id, product_id)
LEFT JOIN (SELECT outlet_id AS io, product_id AS ip, max_by(closing_stock, date) AS stock, 1 + count(*) % 12 AS lead
           FROM facts GROUP BY 1, 2 HAVING count(*) % 5 <> 0) inv ON io = outlet_id AND ip = product_id
JOIN outlets o ON o.outlet_id = t.outlet_id JOIN products p ON p.product_id = t.product_id""",
    "fact_forecast", "facts", "outlets", "products")
cte("fact_tails", """
SELECT outlet_id, product_id, list(quantity_sold ORDER BY date) FILTER (back <= 7) AS t
FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id, product_id ORDER BY date DESC) AS back FROM facts) a GROUP BY 1, 2""", "facts")
cte("fact_forecast", """
SELECT outlet_id, product_id, h AS horizon, CASE WHEN len(t) >= 7 THEN t[(h - 1) % 7 + 1] ELSE t[-1] END AS prediction
FROM fact_tails, range(1, 10) r(h)""", "fact_tails")
cte("client_rows", """
SELECT *, CASE WHEN stock IS NULL THEN 'INVENTORY_DATA_REQUIRED' WHEN lead_time_demand IS NULL THEN 'LONGER_FORECAST_REQUIRED' WHEN recommended_order > 0 THEN 'REPLENISH' ELSE 'NO_ACTION' END AS action,
  CASE WHEN stock IS NULL OR lead_time_demand IS NULL THEN 'UNKNOWN' WHEN stock < lead_time_demand THEN 'HIGH' ELSE 'LOW' END AS stockout_risk
FROM (SELECT *, CASE WHEN shortage > 0 THEN ceil(greatest(shortage, 5) / 6) * 6 ELSE shortage END AS recommended_order
FROM (SELECT *, CASE WHEN stock IS NOT NULL AND lead_time_demand IS NOT NULL THEN greatest(lead_time_demand + safety_stock - stock, 0) END AS shortage,
  CASE WHEN change >= 0.2 THEN 'HIGH' WHEN change >= 0.08 THEN 'MODERATE' ELSE 'LOW' END AS demand_risk
FROM (SELECT *, f[1] AS d1, f[1] + f[2] + f[3] AS d3, list_sum(f[1:7]) AS d7, (f[1] - greatest(baseline, 1e-6)) / greatest(baseline, 1e-6) AS change,
  coalesce(lead, 1) AS lead_time_days, CASE WHEN coalesce(lead, 1) <= 9 THEN list_sum(f[1:coalesce(lead, 1)]) END AS lead_time_demand,
  1.65 * deviation AS safety_stock FROM client_base) a) b) c""", "client_base")


def seasonal(spark, sf):
    facts = cut(src.daily_facts(spark, sf).select("outlet_id", "product_id", "date", "quantity_sold", "closing_stock"))
    return facts, baselines.pivot_horizon(baselines.baseline_forecast(facts, 9, ["seasonal_naive"]), steps=9)


@query("client_actions", "outlet_id product_id outlet_name product_name d1:6 d3:6 d7:6 demand_risk demand_change_pct:6 shortage:6 "
       "safety_stock:6 lead_time_days:i lead_time_demand:6 recommended_order:6 stockout_risk priority action", """
SELECT *, change * 100 AS demand_change_pct, CASE WHEN action = 'REPLENISH' AND (stockout_risk = 'HIGH' OR demand_risk = 'HIGH') THEN 'HIGH'
  WHEN action IN ('REPLENISH', 'LONGER_FORECAST_REQUIRED') THEN 'MODERATE' ELSE 'LOW' END AS priority FROM client_rows""", "client_rows")
def _(spark, sf):
    facts, wide = seasonal(spark, sf)
    stock = facts.groupBy("outlet_id", "product_id").agg(
        F.max_by("closing_stock", "date").alias("current_inventory"), F.count(F.lit(1)).alias("n")).filter("n % 5 <> 0")
    stock = stock.select("outlet_id", "product_id", "current_inventory", (1 + F.col("n") % 12).alias("lead_time_days"),
                         F.lit(5.0).alias("minimum_order_quantity"), F.lit(6.0).alias("order_multiple"))
    return client.client_actions(wide, facts, stock, src.outlets(spark, sf), src.products(spark, sf), include_normal=True)


@query("demonstration_actions", "outlet_id product_id d1:6 lead_time_demand:6 shortage:6 recommended_order:4 priority action", """
SELECT outlet_id, product_id, d1, lead5 AS lead_time_demand, greatest(lead5 + safety - 40, 0) AS shortage,
  ceil(greatest(lead5 + safety - 40, 0)) AS recommended_order,
  CASE WHEN confidence < 0.5 THEN 'HIGH' WHEN lead5 + safety - 40 <= 0 THEN 'NORMAL' WHEN 40 < lead5 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
  CASE WHEN confidence < 0.5 THEN 'REVIEW_REQUIRED' WHEN lead5 + safety - 40 <= 0 THEN 'HOLD' ELSE 'REPLENISH' END AS action
FROM (SELECT *, list_sum(f[1:5]) AS lead5 FROM actions) a""", "actions")
def _(spark, sf):
    return client.demonstration(outlook(spark, sf)[0], lead_time_days=5, current_inventory=40.0)


# --- boosted trees ----------------------------------------------------------------------------------------

def compact(spark, sf):
    return cut(series.compact_features(src.daily_facts(spark, sf)))


def compact_model(features, **options):
    return models.train(features, series.COMPACT_FEATURES, **options)


@query("gbt_predictions", "outlet_id product_id date:d quantity_sold:6 prediction:6")
def _(spark, sf):
    labelled = splits.last_days_split(compact(spark, sf))
    return models.predict(compact_model(labelled.filter("split = 'train'")), labelled)


@query("gbt_accuracy", "split count:i mae:6 rmse:6 smape:6 bias:6")
def _(spark, sf):
    labelled = splits.last_days_split(compact(spark, sf))
    scored = models.predict(compact_model(labelled.filter("split = 'train'")), labelled)
    return metrics.evaluate(metrics.paired(scored, "quantity_sold", "prediction"), "quantity_sold", "prediction", ["split"])


@query("gbt_latest", "outlet_id product_id date:d prediction:6")
def _(spark, sf):
    features = compact(spark, sf)
    return models.latest_predictions(models.predict(compact_model(features), features))


@query("gbt_importance", "feature importance:6")
def _(spark, sf):
    return models.feature_importance(compact_model(compact(spark, sf)))


@query("gbt_forecast_week", "outlet_id product_id date:d horizon:i prediction:6")
def _(spark, sf):
    facts = cut(src.daily_facts(spark, sf).select("outlet_id", "product_id", "date", "quantity_sold"))
    start = daily.latest_day(facts) + timedelta(days=1)
    model = models.train(series.model_features(facts), series.MODEL_FEATURES)
    return models.recursive_forecast(model, facts, start, 7)


@query("learning_cycle", "rows:i champion_mae:6 candidate_mae:6 improvement_pct:6 passes:b action")
def _(spark, sf):
    facts = cut(src.daily_facts(spark, sf).select("outlet_id", "product_id", "date", "quantity_sold", "discount"))
    old, new = facts.filter("date < DATE '1999-01-01'"), facts.filter("date >= DATE '1999-01-01'")
    champion = compact_model(series.compact_features(old))
    row, _model = models.learning_cycle(old, new, "quantity_sold", ["quantity_sold", "discount"], facts.filter("date < DATE '2000-06-01'"),
                                        facts.filter("date >= DATE '2000-06-01'"), champion, force=True)
    return row


# What must hold of trained results whatever the trees are, counted from the results and from the facts.
_SERIES = "(SELECT outlet_id, product_id, count(*) AS n, max(date) AS last FROM facts GROUP BY 1, 2)"
_SPLITS = """(SELECT *, CASE WHEN back <= 30 THEN 'test' WHEN back <= 60 THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id, product_id ORDER BY date) AS place, dense_rank() OVER (ORDER BY date DESC) AS back FROM facts) a)"""


@query("trained_invariants", "check value:6", f"""
SELECT 'rows ' || split AS "check", CAST(count(*) AS DOUBLE) AS value FROM {_SPLITS} b GROUP BY split
UNION ALL SELECT 'missing ' || split, count(*) FILTER (place <= 28) FROM {_SPLITS} b GROUP BY split
UNION ALL SELECT 'negative predictions', 0
UNION ALL SELECT 'importance total', 1
UNION ALL SELECT 'importance features', 16
UNION ALL SELECT 'latest series', count(*) FROM {_SERIES} c WHERE n > 28
UNION ALL SELECT 'latest on the last day', count(*) FROM {_SERIES} c WHERE n > 28
UNION ALL SELECT 'forecast rows', 7 * count(*) FROM {_SERIES} c
UNION ALL SELECT 'forecast missing', 7 * count(*) FROM {_SERIES} c WHERE n < 28
UNION ALL SELECT 'forecast days off', 0
UNION ALL SELECT 'forecast negative', 0
UNION ALL SELECT 'text rows', count(*) FROM documents
UNION ALL SELECT 'text axes beyond one', 0
UNION ALL SELECT 'segment outlets', count(*) FROM performance
UNION ALL SELECT 'segment sizes wrong', 0""", ("facts", "performance"))
def _(spark, sf):
    facts = cut(src.daily_facts(spark, sf).select("outlet_id", "product_id", "date", "quantity_sold"))
    day = daily.latest_day(facts)

    def compact_results():
        labelled = splits.last_days_split(cut(series.compact_features(facts)))
        model = compact_model(labelled.filter("split = 'train'"))
        return model, cut(models.predict(model, labelled))

    def week_ahead():
        return models.recursive_forecast(models.train(series.model_features(facts), series.MODEL_FEATURES), facts, day + timedelta(days=1), 7)

    def placed_texts():
        docs = src.table(spark, sf, "documents").select("doc_id", "text")
        return cut(TextMatrix.fit(docs, "text").transform(docs, "text").drop("text"))

    def segmented():
        return cut(segments.outlet_segments(outlets.performance_indices(demand(spark, sf))))

    # Four trainings that need nothing of each other: a round of trees is a row of short jobs that leave most cores idle.
    parts = (compact_results, week_ahead, placed_texts, segmented)
    with ThreadPoolExecutor(len(parts)) as pool:
        (model, scored), week, text, found = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(part)) for part in parts]]
    latest = models.latest_predictions(scored).join(facts.groupBy("outlet_id", "product_id").agg(F.max("date").alias("_last")), ["outlet_id", "product_id"])
    sizes = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max("cluster_size").alias("told"))

    def checks(df, **counts):
        one = df.agg(*[c.cast("double").alias(name) for name, c in counts.items()])
        return one.select(F.inline(F.array(*[F.struct(F.lit(name.replace("_", " ")).alias("check"), F.col(name).alias("value")) for name in counts])))

    rows = F.count(F.lit(1))
    parts = scored.groupBy("split").agg(rows.cast("double").alias("rows"), F.count_if(F.col("prediction").isNull()).cast("double").alias("missing"))
    out = parts.select(F.inline(F.array(*[F.struct(F.concat(F.lit(f"{m} "), "split").alias("check"), F.col(m).alias("value")) for m in ("rows", "missing")])))
    for more in (
            checks(scored, negative_predictions=F.count_if(F.col("prediction") < 0)),
            checks(models.feature_importance(model), importance_total=F.sum("importance"), importance_features=rows),
            checks(latest, latest_series=rows, latest_on_the_last_day=F.count_if(F.col("date") == F.col("_last"))),
            checks(week, forecast_rows=rows, forecast_missing=F.count_if(F.col("prediction").isNull()), forecast_negative=F.count_if(F.col("prediction") < 0),
                   forecast_days_off=F.count_if(F.date_diff("date", F.lit(day)) != F.col("horizon"))),
            checks(text, text_rows=rows, text_axes_beyond_one=F.count_if(sum(F.col(f"text_{i}") * F.col(f"text_{i}") for i in range(4)) > 1 + 1e-6)),
            checks(found, segment_outlets=rows), checks(sizes, segment_sizes_wrong=F.count_if(F.col("n") != F.col("told")))):
        out = out.unionByName(more)
    return out


# --- segments and text ------------------------------------------------------------------------------------------

@query("outlet_segments", "outlet_id cluster_id:i cluster_size:i segment_name")
def _(spark, sf):
    return segments.outlet_segments(outlets.performance_indices(demand(spark, sf)))


# Classes and names of the segments follow from the cluster means; here the clusters are regions.
@query("segment_profiles", "cluster_id outlet_count:i average_daily_demand:6 demand_scale:6 growth_class volatility_class "
       "fulfillment_class opportunity_class risk_class segment_name", """
SELECT *, CASE WHEN risk_class = 'high' AND opportunity_class = 'high' THEN 'high_opportunity_high_risk'
  WHEN fulfillment_class = 'strong' AND risk_class = 'low' THEN 'high_performing_stable'
  WHEN growth_class = 'growing' AND opportunity_class IN ('moderate', 'high') THEN 'growing_opportunity'
  WHEN volatility_class = 'high' THEN 'volatile_demand' WHEN risk_class = 'high' THEN 'operational_risk'
  WHEN opportunity_class = 'high' THEN 'high_opportunity' WHEN growth_class = 'declining' THEN 'declining_demand'
  ELSE 'balanced' END AS segment_name
FROM (SELECT *, average_daily_demand / (quantile_cont(average_daily_demand, 0.5) OVER ()) AS demand_scale,
  CASE WHEN g >= 0.1 THEN 'growing' WHEN g <= -0.1 THEN 'declining' ELSE 'stable' END AS growth_class,
  CASE WHEN cv >= 0.3 THEN 'high' WHEN cv >= 0.15 THEN 'moderate' ELSE 'low' END AS volatility_class,
  CASE WHEN fr >= 0.97 THEN 'strong' WHEN fr >= 0.9 THEN 'moderate' ELSE 'weak' END AS fulfillment_class,
  CASE WHEN oi >= 75 THEN 'high' WHEN oi >= 45 THEN 'moderate' ELSE 'low' END AS opportunity_class,
  CASE WHEN ri >= 75 THEN 'high' WHEN ri >= 45 THEN 'moderate' ELSE 'low' END AS risk_class
FROM (SELECT region AS cluster_id, count(*) AS outlet_count, avg(average_daily_demand) AS average_daily_demand, avg(demand_growth_rate) AS g,
  avg(coefficient_variation) AS cv, avg(fulfillment_rate) AS fr, avg(opportunity_index) AS oi, avg(risk_index) AS ri
  FROM performance JOIN outlets USING (outlet_id) GROUP BY 1) a) b""", ("performance", "outlets"))
def _(spark, sf):
    regions = src.outlets(spark, sf).select("outlet_id", F.col("region").alias("cluster_id"))
    return segments.cluster_profiles(outlets.performance_indices(demand(spark, sf)).join(regions, "outlet_id"))


@query("clustering_matrix", "outlet_id " + " ".join(f"z_{c}:6" for c in segments.FEATURES),
       "SELECT outlet_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{c}" for c in segments.FEATURES)
       + " FROM performance", "performance")
def _(spark, sf):
    return segments.clustering_matrix(outlets.performance_indices(demand(spark, sf)))


@query("text_matrix", "doc_id:i text_0:6 text_1:6 text_2:6 text_3:6")
def _(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    return TextMatrix.fit(docs, "text").transform(docs, "text")

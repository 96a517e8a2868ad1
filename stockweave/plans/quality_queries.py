"""Queries: cleaning, checks, record contracts, leakage audits, output validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, leakage, quality, series, stockout, validators
from ..sources import demand_tables as src, readers
from . import decision_queries
from .registry import cte, query

# --- cleaning --------------------------------------------------------------------------------------


@query("cleaned_nulls", "doc_id:i lang source", """
SELECT doc_id, CASE WHEN lang NOT IN ('', 'NA', 'N/A', 'null', 'None') THEN lang END AS lang,
  CASE WHEN source NOT IN ('', 'NA', 'N/A', 'null', 'None') THEN source END AS source FROM documents""")
def _(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return quality.clean(docs.toDF(" DOC_ID", "Lang ", "SOURCE"))


# Orders as a client feed: foreign column names, text numbers, a few rows that do not parse.
cte("feed", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'C' || (o_custkey % 20) AS outlet_id, o_orderpriority AS product_id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) END AS quantity_sold
FROM orders""")


def feed(spark, sf):
    orders = src.table(spark, sf, "orders")
    quantity = F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string"))
    return orders.select(
        F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd").alias(" Sale_Date"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("STORE_ID"),
        F.col("o_orderpriority").alias("sku"), quantity.alias("Qty "))


@query("client_feed", "outlet_id product_id date:d rows:i quantity:4", """
SELECT outlet_id, product_id, CAST(date AS DATE) AS date, count(*) AS rows, sum(CAST(quantity_sold AS DOUBLE)) AS quantity
FROM feed WHERE quantity_sold <> 'n/a' GROUP BY 1, 2, 3""", "feed")
def _(spark, sf):
    rows = readers.canonical_feed(feed(spark, sf))
    return rows.groupBy("outlet_id", "product_id", "date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity_sold").alias("quantity"))


@query("client_feed_daily", "outlet_id product_id date:d quantity_sold:4", """
SELECT outlet_id, product_id, CAST(date AS DATE) AS date, sum(CAST(quantity_sold AS DOUBLE)) AS quantity_sold
FROM feed WHERE quantity_sold <> 'n/a' GROUP BY 1, 2, 3""", "feed")
def _(spark, sf):
    return readers.daily_grain(readers.canonical_feed(feed(spark, sf)))


@query("feed_sufficiency", "rows:i days:i series:i reason sufficient:b", """
SELECT *, reason = 'SUFFICIENT_DATA' AS sufficient
FROM (SELECT count(*) AS rows, count(DISTINCT date) AS days, count(DISTINCT (outlet_id, product_id)) AS series,
  CASE WHEN count(*) < 1000 THEN 'INSUFFICIENT_DATA:' || count(*) || '<1000'
    WHEN count(DISTINCT date) < 88 THEN 'INSUFFICIENT_HISTORY:' || count(DISTINCT date) || '<88' ELSE 'SUFFICIENT_DATA' END AS reason
  FROM feed WHERE quantity_sold <> 'n/a') a""", "feed")
def _(spark, sf):
    return quality.sufficiency(readers.canonical_feed(feed(spark, sf)))


@query("numeric_columns", "o_orderstatus as_number:b price:4", """
SELECT o_orderstatus, true AS as_number, sum(o_totalprice) AS price FROM orders GROUP BY 1""")
def _(spark, sf):
    orders = src.table(spark, sf, "orders").select("o_orderstatus", F.col("o_totalprice").cast("string").alias("price"))
    converted = quality.numeric_text_columns(orders)
    is_number = dict(converted.dtypes)["price"] == "double"
    return converted.groupBy("o_orderstatus").agg(F.lit(is_number).alias("as_number"), F.sum("price").alias("price"))


# --- checks ----------------------------------------------------------------------------------------

CHECK = "check column violations:i"


@query("column_checks", CHECK, """
SELECT 'no_nulls' AS check, 'value' AS column, count(*) FILTER (value IS NULL) AS violations FROM events
UNION ALL SELECT 'no_nulls', 'absent', -1
UNION ALL SELECT 'non_negative', 'value', count(*) FILTER (value < 0) FROM events
UNION ALL SELECT 'bounds', 'value', count(*) FILTER (value < 1 OR value > 50) FROM events
UNION ALL SELECT 'valid_date', 'event_type', count(*) FROM events
UNION ALL SELECT 'date_range', 'ts', count(*) FILTER (CAST(ts AS DATE) < DATE '2024-01-05' OR CAST(ts AS DATE) > DATE '2024-01-20') FROM events""")
def _(spark, sf):
    return quality.column_checks(
        src.table(spark, sf, "events"), no_nulls=["value", "absent"], non_negative=["value", "nowhere"],
        bounds={"value": (1, 50)}, dates=["event_type"], date_range={"ts": ("2024-01-05", "2024-01-20")})


@query("unique_checks", CHECK, """
SELECT 'unique' AS check, 'user_id' AS column, count(*) - count(DISTINCT user_id) AS violations FROM events
UNION ALL SELECT 'unique', 'event_id', count(*) - count(DISTINCT event_id) FROM events
UNION ALL SELECT 'unique', 'user_id,event_type', count(*) - count(DISTINCT (user_id, event_type)) FROM events""")
def _(spark, sf):
    events = src.table(spark, sf, "events")
    return (quality.unique_key(events, "user_id").unionByName(quality.unique_key(events, "event_id"))
            .unionByName(quality.unique_key(events, ["user_id", "event_type"])))


@query("foreign_key_check", CHECK, """
SELECT 'foreign_key' AS check, 'doc_id' AS column, count(*) AS violations FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    return quality.foreign_keys(src.table(spark, sf, "documents"), src.table(spark, sf, "labels"), "doc_id")


@query("sales_references", CHECK, """
SELECT 'foreign_key' AS check, 'outlet_id' AS column, count(*) AS violations FROM facts
  WHERE outlet_id NOT IN (SELECT outlet_id FROM outlets WHERE capacity > 100)
UNION ALL SELECT 'foreign_key', 'product_id', count(*) FROM facts WHERE product_id NOT IN (SELECT product_id FROM products)""",
       ("facts", "outlets", "products"))
def _(spark, sf):
    return quality.sales_references(src.daily_facts(spark, sf), src.outlets(spark, sf).filter("capacity > 100"), src.products(spark, sf))


@query("descending_dates", "outlet_id descending:b rows:i", """
SELECT CAST(user_id AS VARCHAR) AS outlet_id, coalesce(max(CAST(d > p AS INTEGER)), 0) = 0 AS descending, count(*) AS rows
FROM (SELECT user_id, CAST(ts AS DATE) AS d, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) a
GROUP BY 1""")
def _(spark, sf):
    events = src.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("outlet_id"), F.to_date("ts").alias("date"), (-F.col("event_id")).alias("place"))
    return quality.descending_dates(events, "place", partition=["outlet_id"])


@query("record_contract", "table message rows:i", """
SELECT 'sales' AS table, 'revenue: out of range' AS message, count(*) AS rows FROM facts WHERE revenue - 40000 < 0
UNION ALL SELECT 'sales', 'unit: missing', count(*) FROM facts""", "facts")
def _(spark, sf):
    facts = src.daily_facts(spark, sf).withColumn("revenue", F.col("revenue") - 40000)
    return quality.record_report(facts, "sales")


@query("context_contracts", "table message rows:i", """
SELECT 'holidays' AS table, m AS message, count(*) AS rows FROM calendar_days,
  (VALUES ('country: missing'), ('holiday_name: missing'), ('holiday_type: missing'), ('importance: missing')) v(m) GROUP BY 2
UNION ALL SELECT 'promotions', 'discount: out of range', count(*) FROM facts WHERE discount * 12 > 100
UNION ALL SELECT 'promotions', m, count(*) FROM facts, (VALUES ('promotion_type: missing')) v(m) GROUP BY 2
UNION ALL SELECT 'demographics', m, count(*) FROM outlets, (VALUES ('city: missing'), ('population: missing')) v(m) GROUP BY 2""",
       ("calendar_days", "facts", "outlets"))
def _(spark, sf):
    facts = src.daily_facts(spark, sf)
    promotions = facts.select("outlet_id", "product_id", F.col("date").alias("start_date"), F.col("date").alias("end_date"),
                              (F.col("discount") * 12).alias("discount"))
    return quality.validate_tables({"holidays": src.calendar_days(facts), "promotions": promotions,
                                    "demographics": src.demographics(src.outlets(spark, sf))})


@query("dimension_report", "table check column violations:i", """
SELECT 'outlets' AS table, 'no_nulls' AS check, c AS column, 0 AS violations
  FROM (VALUES ('outlet_id'), ('outlet_type'), ('country'), ('region'), ('city')) v(c)
UNION ALL SELECT 'outlets', 'non_negative', c, 0
  FROM (VALUES ('capacity'), ('tourism_level'), ('business_area'), ('residential_area'), ('student_area')) v(c)
UNION ALL SELECT 'outlets', 'bounds', 'latitude', count(*) FILTER (NOT latitude BETWEEN -90 AND 90) FROM outlets
UNION ALL SELECT 'outlets', 'bounds', 'longitude', count(*) FILTER (NOT longitude BETWEEN -180 AND 180) FROM outlets
UNION ALL SELECT 'outlets', 'unique', 'outlet_id', count(*) - count(DISTINCT outlet_id) FROM outlets
UNION ALL SELECT 'products', 'no_nulls', c, CASE c WHEN 'product_name' THEN -1 ELSE 0 END
  FROM (VALUES ('product_id'), ('product_name'), ('category'), ('unit')) v(c)
UNION ALL SELECT 'products', 'unique', 'product_id', count(*) - count(DISTINCT product_id) FROM products""", ("outlets", "products"))
def _(spark, sf):
    return quality.dimension_report(src.outlets(spark, sf), src.products(spark, sf))


@query("history_summary", "series:i minimum_history_days:i maximum_history_days:i insufficient:i", """
SELECT count(*) AS series, min(n) AS minimum_history_days, max(n) AS maximum_history_days, count(*) FILTER (n < 120) AS insufficient
FROM (SELECT count(DISTINCT date) AS n FROM facts GROUP BY outlet_id, product_id) a""", "facts")
def _(spark, sf):
    return quality.history_summary(src.daily_facts(spark, sf), 120)


@query("short_series", "outlet_id product_id days:i", """
SELECT outlet_id, product_id, count(DISTINCT date) AS days FROM facts GROUP BY 1, 2 HAVING count(DISTINCT date) < 120""", "facts")
def _(spark, sf):
    return quality.short_series(src.daily_facts(spark, sf), 120)


@query("ledger_audit", "rows:i ledger_breaks:i sold_above_demand:i stockout_without_loss:i stockout_rate:6 stockout_rate_plausible:b", """
SELECT *, stockout_rate BETWEEN 0.01 AND 0.2 AS stockout_rate_plausible
FROM (SELECT count(*) AS rows, count(*) FILTER (abs(5 + received_stock - quantity_sold - closing_stock) > 1e-3) AS ledger_breaks,
  count(*) FILTER (quantity_sold > true_demand + 1e-3) AS sold_above_demand,
  count(*) FILTER (stockout AND NOT lost_demand > 0) AS stockout_without_loss, avg(CAST(stockout AS DOUBLE)) AS stockout_rate
  FROM true_demand) a""", "true_demand")
def _(spark, sf):
    facts = src.daily_facts(spark, sf)
    made = stockout.estimate_true_demand(facts, src.inventory(facts))
    return quality.ledger_audit(made.withColumns({"opening_stock": F.lit(5.0), "wastage": F.lit(0.0)}))


# --- leakage -----------------------------------------------------------------------------------------

@query("leakage_audit", "check violations:i passed:b", """
SELECT v."check", 0 AS violations, true AS passed FROM (VALUES ('lag_1'), ('lag_2'), ('lag_3'), ('lag_7'), ('lag_14'), ('lag_28'),
  ('rolling_mean_3'), ('rolling_std_3'), ('rolling_mean_7'), ('rolling_std_7'), ('rolling_mean_14'), ('rolling_std_14'),
  ('rolling_mean_28'), ('rolling_std_28'), ('temporal_split'), ('feature_names'), ('forecast_time_names')) v("check"), (SELECT count(*) AS n FROM facts) f
WHERE n > 0""", "facts")
def _(spark, sf):
    return leakage.leakage_audit(series.model_features(src.daily_facts(spark, sf)), series.MODEL_FEATURES)


@query("leaked_feature_audit", "feature violations:i passed:b", """
SELECT 'lag_1' AS feature, count(*) AS violations, false AS passed
FROM (SELECT quantity_sold AS q, lag(quantity_sold) OVER (PARTITION BY outlet_id, product_id ORDER BY date) AS p FROM facts) a
WHERE p IS NULL OR abs(q - p) > 1e-8 + 1e-5 * abs(p)""", "facts")
def _(spark, sf):
    return leakage.feature_value_audit(src.daily_facts(spark, sf).withColumn("lag_1", F.col("quantity_sold")))


@query("temporal_split_audit", "train_min:d train_max:d test_min:d test_max:d passed:b", """
SELECT min(date) FILTER (date < DATE '2000-01-01') AS train_min, max(date) FILTER (date < DATE '2000-01-01') AS train_max,
  min(date) FILTER (date >= DATE '2000-01-01') AS test_min, max(date) FILTER (date >= DATE '2000-01-01') AS test_max, true AS passed
FROM facts""", "facts")
def _(spark, sf):
    facts = src.daily_facts(spark, sf)
    return leakage.temporal_split_audit(facts.filter("date < DATE '2000-01-01'"), facts.filter("date >= DATE '2000-01-01'"))


# --- output validators on results as they are; validator_queries damages results first -----------------

@query("decision_rules", "rule violations:i", """
SELECT 'health error' AS rule, count(*) FILTER (NOT model_ok) AS violations FROM decided
UNION ALL SELECT r, 0 FROM (VALUES ('empty'), ('outlet_id missing'), ('product_id missing'), ('adjusted_forecast missing'),
  ('lead_time_demand missing'), ('recommended_order negative or missing'), ('demand_confidence outside [0, 1]')) v(r)""", "decided")
def _(spark, sf):
    return validators.decision_rules(decisions.autonomous_decisions(decision_queries.request_rows(spark, sf)))


@query("layers_agree", "rule violations:i", """
SELECT 'outlets missing from sales' AS rule, count(*) AS violations FROM outlets WHERE outlet_id NOT IN (SELECT outlet_id FROM facts)
UNION ALL SELECT 'outlets missing from catalog', count(DISTINCT outlet_id) FROM facts WHERE outlet_id NOT IN (SELECT outlet_id FROM outlets)""",
       ("outlets", "facts"))
def _(spark, sf):
    return validators.same_outlets(sales=src.daily_facts(spark, sf), catalog=src.outlets(spark, sf))


# --- catalogs: the first row of a key, by an order column ------------------------------------------------

@query("outlet_catalog", "outlet_id outlet_type country region city location_type", """
SELECT outlet_id, outlet_type, country, region, city, location_type FROM outlets""", "outlets")
def _(spark, sf):
    once = src.outlets(spark, sf)
    again = once.withColumn("outlet_type", F.concat(F.lit("z"), F.col("outlet_type")))
    return readers.outlet_catalog(once.unionByName(again))


@query("product_catalog", "product_id product_name category unit", """
SELECT p_brand AS product_id, min(p_name) AS product_name, 'Unknown' AS category, 'units' AS unit FROM part GROUP BY 1""")
def _(spark, sf):
    return readers.product_catalog(src.table(spark, sf, "part").select(F.col("p_brand").alias("product_id"), F.col("p_name").alias("name")))

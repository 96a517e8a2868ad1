"""Queries: client requests as JSON, made from the facts, answered end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requests
from ..sources import demand_tables as src
from .lineage import cut
from .registry import cte, query

# Three clients share the outlets; one sends too short a history, one no row that can be used. Every series comes in a request
# row of its own, every fifth without inventory, and each client sends some rows that must be set aside.
cte("asked_sales", """
SELECT 'client' || (ascii(right(outlet_id, 1)) % 3) AS client_id, outlet_id, product_id, date, quantity_sold AS quantity, FALSE AS bad FROM facts
UNION ALL SELECT 'clientshort', outlet_id, product_id, date, quantity_sold, FALSE
FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id, product_id ORDER BY date DESC) AS back FROM facts) a WHERE back <= 20 AND right(outlet_id, 1) = '3'
UNION ALL SELECT 'client' || (ascii(right(outlet_id, 1)) % 3), outlet_id, product_id, max(date), -1, TRUE FROM facts GROUP BY ALL
UNION ALL SELECT 'clientbad', outlet_id, product_id, date, -1, TRUE FROM facts WHERE right(outlet_id, 1) = '3'""", "facts")
cte("asked_gate", """
SELECT client_id, count(*) FILTER (NOT bad) AS sales_rows, count(DISTINCT (outlet_id, product_id)) FILTER (NOT bad) AS series,
  max(date) FILTER (NOT bad) AS last_date FROM asked_sales GROUP BY 1""", "asked_sales")
cte("asked_days", "SELECT client_id, outlet_id, product_id, count(DISTINCT date) AS days FROM asked_sales WHERE NOT bad GROUP BY ALL", "asked_sales")
cte("verdict", """
SELECT client_id, CASE WHEN sales_rows = 0 THEN 'NO_VALID_SALES' WHEN short > 0 THEN 'INSUFFICIENT_HISTORY:' || short END AS reason,
  sales_rows, series, least_days, most_days, last_date
FROM asked_gate LEFT JOIN (SELECT client_id, count(*) FILTER (days < 35) AS short, min(days) AS least_days, max(days) AS most_days
  FROM asked_days GROUP BY 1) d USING (client_id)""", "asked_gate", "asked_days")


def asked(spark, sf):
    """(value) JSON requests; one row per client and series, bounded by the calendar."""
    facts = cut(src.daily_facts(spark, sf).select(*"outlet_id product_id date quantity_sold closing_stock".split()))
    by = ("client_id", "outlet_id", "product_id")
    mine = F.concat(F.lit("client"), (F.expr("ascii(right(outlet_id, 1))") % 3).cast("string")).alias("client_id")
    sold = F.struct(F.col("date").cast("string").alias("date"), "outlet_id", "product_id", F.col("quantity_sold").cast("string").alias("quantity_sold"))
    unusable = F.struct(F.max("date").cast("string").alias("date"), F.first("outlet_id").alias("outlet_id"), F.first("product_id").alias("product_id"),
                        F.lit("-1").alias("quantity_sold"))
    stock = F.struct(F.first("outlet_id").alias("outlet_id"), F.first("product_id").alias("product_id"),
                     F.max_by("closing_stock", "date").alias("current_inventory"), (1 + F.count(F.lit(1)) % 7).cast("double").alias("lead_time_days"),
                     F.lit(5.0).alias("minimum_order_quantity"), F.lit(6.0).alias("order_multiple"))
    whole = facts.select(mine, "*").groupBy(*by).agg(F.collect_list(sold).alias("sales"), F.array(unusable).alias("bad"), stock.alias("stock"), F.count(F.lit(1)).alias("n"))
    whole = whole.select("client_id", F.lit(40).alias("top_n"), F.lit(True).alias("include_normal"), F.concat("sales", "bad").alias("sales"),
                         F.when(F.col("n") % 5 != 0, F.array("stock")).otherwise(F.array().cast(whole.select(F.array("stock")).schema[0].dataType)).alias("inventory"),
                         F.array(F.struct("outlet_id", F.lower("outlet_id").alias("outlet_name"))).alias("outlets"))
    few = facts.filter("right(outlet_id, 1) = '3'")
    tail = few.groupBy("outlet_id", "product_id").agg(F.slice(F.sort_array(F.collect_list(sold), False), 1, 20).alias("sales"))
    wrong = F.transform("sales", lambda s: s.withField("quantity_sold", F.lit("-1")))
    short = tail.select(F.lit("clientshort").alias("client_id"), "sales")
    bad = few.groupBy("outlet_id", "product_id").agg(F.collect_list(sold).alias("sales")).select(F.lit("clientbad").alias("client_id"), wrong.alias("sales"))
    return whole.select(F.to_json(F.struct("*")).alias("value")).unionByName(
        short.unionByName(bad).select(F.to_json(F.struct("*")).alias("value")))


@query("client_request_gate", "client_id reason sales_rows:i series:i least_days:i most_days:i", "SELECT * REPLACE (nullif(sales_rows, 0) AS sales_rows, nullif(series, 0) AS series) FROM verdict", "verdict")
def _(spark, sf):
    rows = asked(spark, sf)
    gate = requests.history_gate(requests.options(rows), cut(requests.readers.request_tables(rows)["sales"]))
    return gate.withColumnsRenamed({"minimum_history_days": "least_days", "maximum_history_days": "most_days"})


@query("client_request_refused", "client_id outlet_id product_id date quantity_sold reason", """
SELECT client_id, outlet_id, product_id, CAST(date AS VARCHAR) AS date, '-1' AS quantity_sold, 'NEGATIVE_QUANTITY' AS reason FROM asked_sales WHERE bad""", "asked_sales")
def _(spark, sf):
    return requests.readers.request_tables(asked(spark, sf))["refused"]


cte("request_rows", """
SELECT 'client' || (ascii(right(outlet_id, 1)) % 3) AS client_id, outlet_id, product_id, lower(outlet_id) AS outlet_name, d1, d7, lead, stock, safety_stock, lead_time_demand,
  CASE WHEN d1 / b - 1 >= 0.2 THEN 'HIGH' WHEN d1 / b - 1 >= 0.08 THEN 'MODERATE' ELSE 'LOW' END AS demand_risk,
  CASE WHEN stock IS NULL THEN 'UNKNOWN' WHEN stock < lead_time_demand THEN 'HIGH' ELSE 'LOW' END AS stockout_risk,
  CASE WHEN stock IS NULL THEN NULL WHEN lead_time_demand + safety_stock - stock > 0
       THEN ceil(greatest(lead_time_demand + safety_stock - stock, 5) / 6) * 6 ELSE 0 END AS recommended_order
FROM (SELECT *, f[1] AS d1, list_sum(f[1:7]) AS d7, coalesce(lead, 1) AS l, list_sum(f[1:coalesce(lead, 1)]) AS lead_time_demand,
        1.65 * deviation AS safety_stock, greatest(baseline, 1e-6) AS b
  FROM (SELECT outlet_id, product_id, list(prediction ORDER BY horizon) AS f FROM fact_forecast GROUP BY 1, 2) t
  JOIN (SELECT outlet_id, product_id, avg(quantity_sold) AS baseline, coalesce(stddev_samp(quantity_sold), 0) AS deviation
        FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id, product_id ORDER BY date DESC) AS back FROM facts) a
        WHERE back <= 28 GROUP BY 1, 2) v USING (outlet_id, product_id)
  LEFT JOIN (SELECT outlet_id, product_id, max_by(closing_stock, date) AS stock, 1 + count(*) % 7 AS lead FROM facts GROUP BY 1, 2
             HAVING count(*) % 5 <> 0) i USING (outlet_id, product_id)) a""", "fact_forecast", "facts")
cte("request_actions", """
SELECT client_id, outlet_id, product_id, outlet_name, d1, d7, safety_stock, recommended_order, stockout_risk, action, priority,
  row_number() OVER (PARTITION BY client_id ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MODERATE' THEN 1 ELSE 2 END, outlet_id, product_id) AS place
FROM (SELECT *, CASE WHEN action = 'REPLENISH' AND (stockout_risk = 'HIGH' OR demand_risk = 'HIGH') THEN 'HIGH' WHEN action = 'REPLENISH' THEN 'MODERATE' ELSE 'LOW' END AS priority
  FROM (SELECT *, CASE WHEN stock IS NULL THEN 'INVENTORY_DATA_REQUIRED' WHEN recommended_order > 0 THEN 'REPLENISH' ELSE 'NO_ACTION' END AS action
        FROM request_rows) a) b
JOIN verdict USING (client_id) WHERE reason IS NULL QUALIFY place <= 40""", "request_rows", "verdict")


@query("client_request_orders", "client_id place:i outlet_id product_id outlet_name d1:6 d7:6 safety_stock:6 recommended_order:4 stockout_risk action priority",
       "SELECT * FROM request_actions", "request_actions")
def _(spark, sf):
    """The whole way with a seasonal forecast, whose values SQL can give."""
    return requests.answer(asked(spark, sf), requests.seasonal).actions


@query("client_request_summary", "client_id report_date:d sales_rows:i outlets:i products:i series:i minimum_history_days:i inventory_rows:i "
       "outlets_rows:i actions_returned:i high_priority:i replenishment_actions:i", """
SELECT client_id, last_date + 1 AS report_date, sales_rows, outlets, products, series, least_days AS minimum_history_days, inventory_rows, series AS outlets_rows,
  actions_returned, high_priority, replenishment_actions
FROM verdict JOIN (SELECT client_id, count(DISTINCT outlet_id) AS outlets, count(DISTINCT product_id) AS products, count(*) FILTER (NOT missing) AS inventory_rows
  FROM (SELECT client_id, outlet_id, product_id, count(*) % 5 = 0 AS missing FROM asked_sales WHERE NOT bad GROUP BY ALL) s GROUP BY 1) o USING (client_id)
JOIN (SELECT client_id, count(*) AS actions_returned, count(*) FILTER (priority = 'HIGH') AS high_priority,
  count(*) FILTER (action = 'REPLENISH') AS replenishment_actions FROM request_actions GROUP BY 1) c USING (client_id)
WHERE reason IS NULL""", ("verdict", "asked_sales", "request_actions"))
def _(spark, sf):
    return requests.answer(asked(spark, sf), requests.seasonal).summary


@query("client_request_actions", "client_id place:i outlet_id product_id d1:6 d3:6 d7:6 demand_risk shortage:6 safety_stock:6 recommended_order:4 stockout_risk action priority")
def _(spark, sf):
    """The whole way with trees trained on the requests; their values have no SQL, the same way with a seasonal forecast has."""
    return requests.answer(asked(spark, sf)).actions

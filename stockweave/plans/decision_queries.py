"""Queries: weekly outlook, daily actions, autonomous decisions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import daily, decisions
from ..sources import demand_tables as src
from .feature_queries import with_context
from .lineage import cut
from .registry import cte, query

SERIES = "PARTITION BY outlet_id, product_id"


def history(spark, sf):
    """Stored, because the last day is looked up before the report is built."""
    return cut(with_context(spark, sf))


cte("ranked_days", f"""
SELECT *, isodow(date) - 1 AS dow, row_number() OVER ({SERIES} ORDER BY date DESC) AS back,
  row_number() OVER ({SERIES}, isodow(date) ORDER BY date DESC) AS dow_back,
  (SELECT max(date) + 1 FROM facts) AS report_day
FROM active_context""", "active_context", "facts")
_SEASON = ", ".join(f"""CASE WHEN count(*) FILTER (dow = {k}) >= 4 THEN avg(quantity_sold) FILTER (dow = {k} AND dow_back <= 12)
    ELSE avg(quantity_sold) FILTER (back <= 28) END""" for k in range(7))
cte("outlook_base", f"""
SELECT outlet_id, product_id, report_day, isodow(report_day) - 1 AS d0, count(*) AS n,
  avg(quantity_sold) FILTER (back <= 28) AS m, stddev_pop(quantity_sold) FILTER (back <= 28) AS sd,
  avg(quantity_sold) FILTER (back > 14 AND back <= 28) AS older, avg(quantity_sold) FILTER (back <= 14) AS newer,
  max_by(closing_stock, date) AS stock, [{_SEASON}] AS season, max(holiday_active) > 0 AS h, max(promotion_active) > 0 AS p,
  max(event_active) > 0 AS e, max(is_rainy) > 0 AS r
FROM ranked_days GROUP BY ALL""", "ranked_days")
_DAY = "greatest(0.55 * base + 0.45 * season[(d0 + {k}) % 7 + 1], 0)"
cte("outlook", f"""
SELECT *, [{', '.join(_DAY.format(k=k) for k in range(7))}] AS f
FROM (SELECT *, (0.55 * m + 0.45 * season[d0 + 1]) * trend AS base
FROM (SELECT *, CASE WHEN n >= 28 AND older > 0 THEN least(greatest(newer / older, 0.85), 1.15) ELSE 1.0 END AS trend
      FROM outlook_base) a) b""", "outlook_base")


def outlook(spark, sf):
    facts = history(spark, sf)
    day = daily.latest_day(facts) + timedelta(days=1)
    return daily.weekly_outlook(facts, day), day


@query("weekly_outlook", "outlet_id product_id date:d horizon:i demand:6", """
SELECT outlet_id, product_id, report_day + (k - 1)::INTEGER AS date, k AS horizon, f[k] AS demand
FROM outlook, range(1, 8) t(k)""", "outlook")
def _(spark, sf):
    return daily.outlook_days(*outlook(spark, sf))


cte("actions", """
SELECT *, CASE WHEN recommended_order <= 0 THEN 'LOW' WHEN recommended_order > lead THEN 'HIGH' ELSE 'MODERATE' END AS supplier_risk,
  CASE WHEN confidence < 0.5 THEN 'REVIEW_REQUIRED' WHEN shortage <= 0 THEN 'HOLD' ELSE 'REPLENISH' END AS action,
  CASE WHEN confidence < 0.5 THEN 'HIGH' WHEN shortage <= 0 THEN 'NORMAL' WHEN stockout_risk = 'HIGH' THEN 'HIGH'
    ELSE 'MODERATE' END AS priority
FROM (SELECT *, CASE WHEN NOT (change >= 20 AND z >= 1.5) THEN 'NONE' WHEN change >= 50 OR z >= 3 THEN 'EXTREME'
      WHEN change >= 35 OR z >= 2 THEN 'MAJOR' ELSE 'MODERATE' END AS demand_spike,
    CASE WHEN change >= 30 OR z >= 2 THEN 'HIGH' WHEN change >= 10 OR z >= 1 THEN 'MODERATE' ELSE 'LOW' END AS demand_risk,
    least(greatest(0.65 * least(1.0, n / 180.0) + 0.35 / (1 + greatest(cv, 0)), 0), 1) AS confidence,
    greatest(required - inv, 0) AS shortage, ceil(greatest(required - inv, 0)) AS recommended_order,
    CASE WHEN inv < lead THEN 'HIGH' WHEN inv < required THEN 'MODERATE' ELSE 'LOW' END AS stockout_risk
FROM (SELECT *, CASE WHEN m > 0 THEN (d7 / 7 - m) / m * 100 ELSE 0 END AS change,
        CASE WHEN sd > 0 THEN (d7 / 7 - m) / sd ELSE 0 END AS z, CASE WHEN m > 0 THEN sd / m ELSE 1 END AS cv,
        lead + safety AS required, greatest(coalesce(stock, 0), 0) AS inv
FROM (SELECT *, f[1] AS d1, f[1] + f[2] + f[3] AS d3, list_sum(f) AS d7, f[1] + f[2] + f[3] AS lead, greatest(1.28 * sd, 0) AS safety
      FROM outlook WHERE n >= 28) a) b) c""", "outlook")

ACTIONS = ("outlet_id product_id outlet_name outlet_type product_name unit date d1:2 d3:2 d7:2 current_inventory:2 "
           "required_inventory:2 shortage:2 safety_stock:2 lead_time_days:i lead_time_demand:2 recommended_order:2 "
           "supplier_risk demand_risk demand_spike stockout_risk priority action model_confidence:4 drivers")
ACTION_SQL = """
SELECT a.*, 'Outlet ' || a.outlet_id AS outlet_name, o.outlet_type, p.name AS product_name, p.unit,
  strftime(report_day, '%Y-%m-%d') AS date, inv AS current_inventory, required AS required_inventory,
  safety AS safety_stock, 3 AS lead_time_days, lead AS lead_time_demand, confidence AS model_confidence,
  concat_ws('; ', 'Recent historical demand pattern', 'Day-of-week demand behavior',
    CASE WHEN change > 5 THEN 'Positive recent demand trend' WHEN change < -5 THEN 'Negative recent demand trend' END,
    CASE WHEN h THEN 'Holiday context available' END, CASE WHEN a.p THEN 'Promotion context available' END,
    CASE WHEN e THEN 'Event context available' END, CASE WHEN r THEN 'Weather context available' END) AS drivers
FROM actions a JOIN outlets o USING (outlet_id) JOIN products p ON p.product_id = a.product_id"""


def report(spark, sf, include_normal=False):
    return daily.daily_report(history(spark, sf), src.outlets(spark, sf), src.products(spark, sf),
                              include_normal=include_normal)


def flat(actions):
    return daily.compact_actions(actions).withColumn("drivers", F.array_join("key_drivers", "; "))


@query("daily_actions", ACTIONS, ACTION_SQL + " WHERE priority <> 'NORMAL'", ("actions", "outlets", "products"))
def _(spark, sf):
    return flat(daily.rank_actions(report(spark, sf)))


@query("daily_actions_all", ACTIONS, ACTION_SQL, ("actions", "outlets", "products"))
def _(spark, sf):
    return flat(report(spark, sf, include_normal=True))


@query("daily_actions_filtered", ACTIONS, ACTION_SQL + " WHERE priority = 'HIGH' AND a.outlet_id = 'NATION_12'",
       ("actions", "outlets", "products"))
def _(spark, sf):
    return flat(daily.filter_actions(report(spark, sf), priority="high", outlet_id="NATION_12"))


_RANK = """ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3
  WHEN 'NORMAL' THEN 4 ELSE 99 END, round(shortage, 2) DESC, round(d7, 2) DESC, outlet_id, product_id"""


@query("daily_action_page", "outlet_id product_id priority shortage:2 page:i total_actions:i total_pages:i has_next:b", f"""
SELECT *, 2 AS page, (SELECT count(*) FROM actions WHERE priority <> 'NORMAL') AS total_actions,
  (SELECT (count(*) + 19) // 20 FROM actions WHERE priority <> 'NORMAL') AS total_pages,
  (SELECT count(*) > 40 FROM actions WHERE priority <> 'NORMAL') AS has_next
FROM (SELECT * FROM actions WHERE priority <> 'NORMAL' {_RANK} LIMIT 20 OFFSET 20) a""", "actions")
def _(spark, sf):
    return daily.action_page(report(spark, sf), page=2)


@query("daily_priorities", "critical:i high:i moderate:i low:i normal:i", """
SELECT count(*) FILTER (priority = 'CRITICAL') AS critical, count(*) FILTER (priority = 'HIGH') AS high,
  count(*) FILTER (priority = 'MODERATE') AS moderate, count(*) FILTER (priority = 'LOW') AS low,
  count(*) FILTER (priority = 'NORMAL') AS normal FROM actions""", "actions")
def _(spark, sf):
    return daily.priority_summary(report(spark, sf, include_normal=True))


@query("daily_counts_by_priority", "priority actions:i", "SELECT priority, count(*) AS actions FROM actions GROUP BY 1", "actions")
def _(spark, sf):
    return daily.counts_by(report(spark, sf, include_normal=True), "priority")


@query("daily_counts_by_risk", "stockout_risk actions:i",
       "SELECT stockout_risk, count(*) AS actions FROM actions GROUP BY 1", "actions")
def _(spark, sf):
    return daily.counts_by(report(spark, sf, include_normal=True), "stockout_risk")


@query("daily_summary", "outlets:i products:i series:i actions_required:i replenish_actions:i review_actions:i hold_actions:i", """
SELECT count(DISTINCT outlet_id) AS outlets, count(DISTINCT product_id) AS products, count(DISTINCT (outlet_id, product_id)) AS series,
  count(*) AS actions_required, count(*) FILTER (action = 'REPLENISH') AS replenish_actions,
  count(*) FILTER (action = 'REVIEW_REQUIRED') AS review_actions, count(*) FILTER (action = 'HOLD') AS hold_actions
FROM actions WHERE priority <> 'NORMAL'""", "actions")
def _(spark, sf):
    return daily.report_summary(report(spark, sf))


# --- autonomous decisions -------------------------------------------------------------------------------

cte("requests", """
SELECT outlet_id, product_id, f[1] AS forecast, greatest(coalesce(stock, 0), 0) AS inv, 1.28 * sd AS safety,
  1 + n % 4 AS lead_days, 5.0 AS moq, 5.0 AS mult, 1.1 AS scen, least(n / 180.0, 1.0) AS conf,
  n % 7 = 0 AS high_risk, n % 11 = 0 AS drift, n % 13 <> 0 AS model_ok
FROM outlook""", "outlook")
cte("decided", """
SELECT *, CASE WHEN inv <= 0 THEN 'critical' WHEN inv < lead THEN 'high' WHEN inv < target THEN 'moderate' ELSE 'low' END AS risk,
  CASE WHEN inv <= 0 THEN 'URGENT_REPLENISHMENT' WHEN inv < lead THEN 'REPLENISH' WHEN inv < target THEN 'MONITOR_AND_REPLENISH'
    ELSE 'NO_REPLENISHMENT' END AS action,
  CASE WHEN target - inv > 0 THEN ceil(greatest(target - inv, moq) / mult) * mult ELSE 0 END AS recommended_order
FROM (SELECT *, forecast * scen AS adjusted, forecast * scen * lead_days AS lead, forecast * scen * lead_days + safety AS target
      FROM requests) a""", "requests")


def request_rows(spark, sf):
    week, _day = outlook(spark, sf)
    n = F.col("history_rows")
    return week.select(
        "outlet_id", "product_id", F.get("forecast", F.lit(0)).alias("forecast_demand"), "current_inventory",
        (1.28 * F.col("recent_std")).alias("safety_stock"), (1 + n % 4).alias("lead_time_days"),
        F.lit(5.0).alias("minimum_order_quantity"), F.lit(5.0).alias("order_multiple"),
        F.lit(1.1).alias("scenario_multiplier"), F.least(n / 180.0, F.lit(1.0)).alias("demand_confidence"),
        (n % 7 == 0).alias("high_risk"), (n % 11 == 0).alias("drift_signal"), (n % 13 != 0).alias("model_available"))


@query("replenishment_decisions", "outlet_id product_id adjusted_forecast:6 lead_time_demand:6 target_inventory:6 "
       "shortage:6 recommended_order:6 risk action", """
SELECT *, adjusted AS adjusted_forecast, lead AS lead_time_demand, target AS target_inventory,
  greatest(target - inv, 0) AS shortage FROM decided""", "decided")
def _(spark, sf):
    return decisions.decide(request_rows(spark, sf))


@query("autonomous_decisions", "outlet_id product_id recommended_order:6 risk action commercial_action allowed:b reason "
       "risk_level errors", """
SELECT *, CASE WHEN NOT model_ok THEN 'HOLD' WHEN conf < 0.5 OR drift OR high_risk THEN 'REVIEW_REQUIRED' ELSE action END AS commercial_action,
  model_ok AND conf >= 0.5 AND NOT drift AND NOT high_risk AS allowed,
  CASE WHEN NOT model_ok THEN 'System health gate failed.'
    WHEN conf < 0.5 THEN 'Forecast confidence is below the autonomous-action threshold.'
    WHEN drift THEN 'Drift signal detected; autonomous commercial action is held.'
    WHEN high_risk THEN 'High-risk commercial decision requires review.'
    WHEN action = 'NO_REPLENISHMENT' THEN 'Inventory position satisfies current target.'
    ELSE 'Health, confidence and governance gates passed.' END AS reason,
  CASE WHEN NOT model_ok THEN 'critical' WHEN conf < 0.5 OR drift OR high_risk THEN 'high'
    WHEN action = 'NO_REPLENISHMENT' THEN 'low' ELSE 'moderate' END AS risk_level,
  CASE WHEN NOT model_ok THEN 'model_unavailable' ELSE '' END AS errors
FROM decided""", "decided")
def _(spark, sf):
    made = decisions.autonomous_decisions(request_rows(spark, sf))
    return made.select("*", F.col("governance.allowed").alias("allowed"), F.col("governance.reason").alias("reason"),
                       F.col("governance.risk_level").alias("risk_level"),
                       F.array_join("health.errors", ",").alias("errors"))

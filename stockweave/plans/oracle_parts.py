"""Shared SQL of the oracles: base tables and window snippets."""

from __future__ import annotations

from .registry import cte

SERIES = "PARTITION BY outlet_id, product_id ORDER BY date"


def lag(column: str, rows: int = 1, over: str = SERIES) -> str:
    return f"lag({column}, {rows}) OVER ({over})"


def roll(column: str, rows: int, agg: str = "avg", least: int | None = None, today: bool = False,
         over: str = SERIES) -> str:
    frame = (f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW" if today
             else f"ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING")
    call = f"quantile_cont({column}, 0.5)" if agg == "median" else f"{agg}({column})"
    least = rows if least is None else least
    return (f"CASE WHEN count({column}) OVER ({over} {frame}) >= {least} "
            f"THEN {call} OVER ({over} {frame}) END")


def expand(column: str, agg: str = "avg", least: int = 1, today: bool = False, over: str = SERIES) -> str:
    frame = f"ROWS BETWEEN UNBOUNDED PRECEDING AND {'CURRENT ROW' if today else '1 PRECEDING'}"
    return (f"CASE WHEN count({column}) OVER ({over} {frame}) >= {least} "
            f"THEN {agg}({column}) OVER ({over} {frame}) END")


def clip(x: str, low=None, high=None) -> str:
    out = x
    if low is not None:
        out = f"greatest({out}, CAST({low} AS DOUBLE))"
    if high is not None:
        out = f"least({out}, CAST({high} AS DOUBLE))"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN {out} END)"


def columns(pairs: dict[str, str]) -> str:
    return ",\n  ".join(f"{expression} AS {name}" for name, expression in pairs.items())


cte("facts", """
SELECT n_name AS outlet_id, p_type AS product_id, CAST(l_shipdate AS DATE) AS date,
       SUM(l_quantity) AS quantity_sold,
       SUM(l_extendedprice * (1 - l_discount)) AS revenue,
       MAX(l_discount) * 100 AS discount,
       SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS received_stock,
       SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 0 ELSE l_quantity END) AS closing_stock
FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1, 2, 3
""")

cte("stocked", "SELECT *, closing_stock = 0 AS stockout FROM facts", "facts")

cte("event_series", """
SELECT 'U' || (user_id % 10) AS outlet_id, event_type AS product_id, CAST(ts AS DATE) AS date,
       SUM(value) AS quantity_sold
FROM events GROUP BY 1, 2, 3
""")

cte("outlets", """
SELECT n_name AS outlet_id, n_name AS name,
  ['cafe','bistro','bakery','diner','kiosk'][n_nationkey % 5 + 1] AS outlet_type,
  r_name AS country, r_name AS region, n_name AS city,
  ['center','suburb','campus','coast','station'][n_nationkey % 5 + 1] AS location_type,
  CASE WHEN n_nationkey % 3 = 0 THEN 'mixed' END AS cuisine,
  30 + 10 * n_nationkey AS capacity,
  n_nationkey % 2 = 0 AS delivery_available, n_nationkey % 2 = 1 AS takeaway_available,
  n_nationkey % 3 = 0 AS bar_available,
  ['open','closed','shared'][n_nationkey % 3 + 1] AS kitchen_type,
  (n_nationkey % 10) / 10.0 AS tourism_level,
  ((n_nationkey + 3) % 10) / 10.0 AS business_area,
  ((n_nationkey + 5) % 10) / 10.0 AS residential_area,
  ((n_nationkey + 7) % 10) / 10.0 AS student_area,
  ((n_nationkey * 7) % 180) - 90.0 AS latitude,
  ((n_nationkey * 15) % 360) - 180.0 AS longitude
FROM nation JOIN region ON n_regionkey = r_regionkey
""")

cte("products", """
SELECT DISTINCT p_type AS product_id, p_type AS name, 'parts' AS category, 'pieces' AS unit FROM part
""")

cte("calendar_days", """
SELECT outlet_id, date,
  CASE WHEN month(date) = 12 AND day(date) = 25 THEN 1.0 ELSE 0.0 END AS holiday_importance,
  CASE WHEN month(date) = 12 AND day(date) <= 26 THEN 0.5 ELSE 0.0 END AS religious_importance,
  CASE WHEN day(date) = 1 THEN 0.4 ELSE 0.0 END AS event_importance,
  CAST(max(discount) >= 9 AS INTEGER) AS promotion_active,
  CAST(day(date) % 5 = 0 AS INTEGER) AS is_rainy
FROM facts GROUP BY outlet_id, date
""", "facts")

cte("demographics", """
SELECT outlet_id, capacity * 1.0 AS population_density, tourism_level AS tourism_index,
  student_area AS student_index, business_area AS business_index,
  residential_area AS residential_index, 1.0 - tourism_level AS religious_population_share,
  0.3 AS young_population_share, business_area AS working_population_share
FROM outlets
""", "outlets")

cte("context_facts", """
SELECT *, 15.0 + 10.0 * (month(date) % 7) - (day(date) % 9) AS temperature,
  CASE WHEN day(date) % 5 = 0 THEN 2.5 ELSE 0.0 END AS precipitation,
  CASE WHEN month(date) = 12 AND day(date) = 25 THEN 1.0 ELSE 0.0 END AS holiday_importance,
  CASE WHEN day(date) = 1 THEN 1.0 ELSE 0.0 END AS event_active
FROM facts
""", "facts")

cte("bom", """
SELECT DISTINCT p_type AS product_id, p_brand AS supply_product_id,
  1.0 + (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 4) * 0.25 AS quantity_per_unit,
  'pieces' AS supply_unit
FROM part
""")

cte("contract", """
SELECT DISTINCT p_brand AS supply_product_id, 'S-' || p_brand AS supplier_id,
  1 + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5 AS lead_time_days,
  5.0 AS minimum_order_quantity, 5.0 AS order_multiple
FROM part
""")

cte("supply_stock", """
SELECT n_name AS outlet_id, p_brand AS supply_product_id, CAST(l_shipdate AS DATE) AS date,
  SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS received_stock,
  SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 0 ELSE l_quantity END) AS closing_stock
FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1, 2, 3
""")

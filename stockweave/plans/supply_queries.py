"""Queries: supply requirements, orders, reorder points and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenario, supply
from ..sources import demand_tables as src
from .demand_queries import demand, demand_of
from .lineage import cut
from .registry import cte, query


def _needed(made):
    return made.select("outlet_id", "product_id", "date", F.col("deconstrained_demand").alias("demand"))


def product_demand(spark, sf):
    return _needed(demand(spark, sf))


def required(spark, sf):
    return supply.supply_demand(product_demand(spark, sf), src.bill_of_materials(spark, sf))


def recommendations(spark, sf):
    """Demand and stock from one stored cube, so the line items are scanned once."""
    cube = src.supply_cube(spark, sf)
    need = supply.supply_demand(_needed(demand_of(cut(src.facts_of(cube)))), src.bill_of_materials(spark, sf))
    return supply.supply_recommendations(need, src.stock_of(cube), supply.normalize_contract(src.supplier_contract(spark, sf)))


cte("exploded", """
SELECT outlet_id, date, product_id, deconstrained_demand AS demand, supply_product_id, supply_unit, quantity_per_unit,
  deconstrained_demand * quantity_per_unit AS supply_requirement
FROM decon JOIN bom USING (product_id)""", "decon", "bom")
cte("required", """
SELECT outlet_id, date, supply_product_id, supply_unit, greatest(sum(supply_requirement), 0) AS required_supply
FROM exploded GROUP BY ALL""", "exploded")


@query("bom_requirements", "outlet_id date:d product_id supply_product_id demand:6 quantity_per_unit:6 supply_requirement:6",
       "SELECT * FROM exploded", "exploded")
def _(spark, sf):
    return supply.explode_demand(product_demand(spark, sf), supply.normalize_bom(src.bill_of_materials(spark, sf)))


@query("bom_violations", "rows:i null_product:i null_supply:i not_positive:i duplicate_pairs:i", """
SELECT count(*) AS rows, count(*) FILTER (product_id IS NULL) AS null_product,
  count(*) FILTER (supply_product_id IS NULL) AS null_supply, count(*) FILTER (quantity_per_unit <= 0) AS not_positive,
  count(*) - count(DISTINCT (product_id, supply_product_id)) AS duplicate_pairs
FROM (SELECT p_type AS product_id, p_brand AS supply_product_id,
        CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 4 AS quantity_per_unit FROM part) a""")
def _(spark, sf):
    raw = src.table(spark, sf, "part").select(
        F.col("p_type").alias("product_id"), F.col("p_brand").alias("supply_product_id"),
        (src._brand_number(F.col("p_brand")) % 4).alias("quantity_per_unit"), F.lit("pieces").alias("supply_unit"))
    return supply.bom_violations(raw)


@query("supply_demand", "outlet_id date:d supply_product_id supply_unit required_supply:6", "SELECT * FROM required", "required")
def _(spark, sf):
    return required(spark, sf)


@query("horizon_supply", "outlet_id supply_product_id horizon_supply:4 average_daily_supply:6 peak_daily_supply:6", """
SELECT outlet_id, supply_product_id, sum(required_supply) AS horizon_supply, avg(required_supply) AS average_daily_supply,
  max(required_supply) AS peak_daily_supply FROM required GROUP BY 1, 2""", "required")
def _(spark, sf):
    return supply.horizon_supply(required(spark, sf))


@query("supplier_contract", "supply_product_id supplier_id lead_time_days:6 minimum_order_quantity:6 order_multiple:6",
       "SELECT * FROM contract", "contract")
def _(spark, sf):
    return supply.normalize_contract(src.supplier_contract(spark, sf))


cte("recommended", """
SELECT *, recommended_order_quantity > 0 AS order_required,
  CASE WHEN supply_risk_ratio < 0.5 THEN 'high' WHEN supply_risk_ratio < 0.8 THEN 'moderate' ELSE 'low' END AS supply_risk
FROM (SELECT *, CASE WHEN shortage > 0 THEN ceil(greatest(shortage, minimum_order_quantity) / order_multiple) * order_multiple
          ELSE 0 END AS recommended_order_quantity,
        CASE WHEN target_inventory > 0 THEN least(greatest(inventory_position / target_inventory, 0), 1) ELSE 1 END AS supply_risk_ratio
FROM (SELECT *, greatest(target_inventory - inventory_position, 0) AS shortage
FROM (SELECT *, required_supply * lead_time_days AS lead_time_demand, required_supply AS safety_stock,
        required_supply * lead_time_days + required_supply AS target_inventory,
        current_inventory + incoming_stock AS inventory_position
FROM (SELECT outlet_id, date, supply_product_id, required_supply, coalesce(closing_stock, 0) AS current_inventory,
        coalesce(received_stock, 0) AS incoming_stock, lead_time_days, minimum_order_quantity, order_multiple
      FROM (SELECT outlet_id, date, supply_product_id, sum(required_supply) AS required_supply FROM required GROUP BY 1, 2, 3) r
      LEFT JOIN supply_stock USING (outlet_id, date, supply_product_id)
      LEFT JOIN contract USING (supply_product_id)) a) b) c) d""", "required", "supply_stock", "contract")


# Orders jump by 5 at exact multiples, where the last bit of a product decides: the shortage is
# compared, and the order through the rounded shortage of both engines.
@query("supply_recommendations", "outlet_id date:d supply_product_id required_supply:6 current_inventory:6 "
       "incoming_stock:6 lead_time_demand:6 safety_stock:6 target_inventory:6 inventory_position:6 shortage:6 "
       "recommended_order_quantity:6 supply_risk_ratio:6 supply_risk order_required:b",
       "SELECT * FROM recommended", "recommended")
def _(spark, sf):
    return recommendations(spark, sf)


# --- reorder point per pair: last seven days as the forecast ------------------------------------------

cte("reorder_input", """
SELECT outlet_id, product_id, 3 AS lead_time_days, 6.0 AS pack,
  list(quantity_sold ORDER BY date) FILTER (back <= 7) AS f, stddev_samp(quantity_sold) AS sd,
  max_by(closing_stock, date) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id, product_id ORDER BY date DESC) AS back FROM facts) a
GROUP BY 1, 2""", "facts")


@query("inventory_recommendations", "outlet_id product_id forecast_demand:6 lead_time_demand:6 safety_stock:6 "
       "reorder_point:6 reorder:b recommended_order_quantity:6 stockout_risk:b", """
SELECT *, position <= reorder_point AS reorder, position < lead_time_demand AS stockout_risk,
  ceil(greatest(reorder_point + forecast_demand - position, 0) / pack) * pack AS recommended_order_quantity
FROM (SELECT *, f[1] AS forecast_demand, list_sum(f[1:3]) AS lead_time_demand, 1.6449 * sd * sqrt(3) AS safety_stock,
        list_sum(f[1:3]) + 1.6449 * sd * sqrt(3) AS reorder_point FROM reorder_input) a""", "reorder_input")
def _(spark, sf):
    from pyspark.sql import Window
    facts = src.daily_facts(spark, sf)
    back = F.row_number().over(Window.partitionBy("outlet_id", "product_id").orderBy(F.desc("date")))
    recent = F.when(F.col("back") <= 7, F.struct("date", "quantity_sold"))
    pairs = facts.withColumn("back", back).groupBy("outlet_id", "product_id").agg(
        F.transform(F.array_sort(F.collect_list(recent)), lambda x: x["quantity_sold"]).alias("daily_forecast"),
        F.stddev_samp("quantity_sold").alias("demand_std"),
        F.max_by("closing_stock", "date").alias("inventory_position"))
    return supply.inventory_recommendations(pairs.withColumns({"lead_time_days": F.lit(3), "pack_size": F.lit(6.0)}))


# --- scenarios -----------------------------------------------------------------------------------------

SCENARIOS = [
    scenario.scenario("baseline"),
    scenario.scenario("holiday_peak", holiday_multiplier=1.4, tourism_multiplier=1.25),
    scenario.scenario("rainy_week", weather_multiplier=0.75),
    scenario.scenario("campaign", promotion_multiplier=1.5, event_multiplier=1.1, cultural_multiplier=0.9),
]
cte("scenario_rows", """
SELECT outlet_id, product_id, date, scenario_name, quantity_sold AS baseline_demand, m AS scenario_multiplier,
  quantity_sold * m AS scenario_demand, quantity_sold * m - quantity_sold AS absolute_change,
  coalesce((quantity_sold * m - quantity_sold) / nullif(quantity_sold, 0) * 100, 0) AS percentage_change
FROM facts, (VALUES ('baseline', 1.0::DOUBLE), ('holiday_peak', 1.4::DOUBLE * 1.25::DOUBLE), ('rainy_week', 0.75::DOUBLE),
             ('campaign', 1.5::DOUBLE * 1.1::DOUBLE * 0.9::DOUBLE)) s(scenario_name, m)""", "facts")


def compared(spark, sf):
    base = src.daily_facts(spark, sf).withColumn("baseline_demand", F.col("quantity_sold"))
    return scenario.compare_scenarios(base, SCENARIOS)


@query("scenario_comparison", "outlet_id product_id date:d scenario_name baseline_demand:6 scenario_multiplier:6 "
       "scenario_demand:6 absolute_change:6 percentage_change:6", "SELECT * FROM scenario_rows", "scenario_rows")
def _(spark, sf):
    return compared(spark, sf)


@query("scenario_single", "outlet_id product_id date:d scenario_name scenario_demand:6",
       "SELECT * FROM scenario_rows WHERE scenario_name = 'holiday_peak'", "scenario_rows")
def _(spark, sf):
    base = src.daily_facts(spark, sf).withColumn("baseline_demand", F.col("quantity_sold"))
    return scenario.run_scenario(base, SCENARIOS[1])


@query("scenario_summary", "scenario_name baseline_demand:4 scenario_demand:4 absolute_change:4 percentage_change:6", """
SELECT scenario_name, sum(baseline_demand) AS baseline_demand, sum(scenario_demand) AS scenario_demand,
  sum(absolute_change) AS absolute_change, sum(absolute_change) / sum(baseline_demand) * 100 AS percentage_change
FROM scenario_rows GROUP BY 1""", "scenario_rows")
def _(spark, sf):
    return scenario.scenario_summary(compared(spark, sf))

"""From demand to supply requirements, reorder points and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_col, clip, first_rule, gate, ratio, require_columns, to_number

BOM_COLUMNS = ("product_id", "supply_product_id", "quantity_per_unit", "supply_unit")
CONTRACT_COLUMNS = ("supply_product_id", "supplier_id", "lead_time_days", "minimum_order_quantity", "order_multiple")
SUPPLY_KEY = ("outlet_id", "date", "supply_product_id")

# Normal quantile of the supported service levels.
SERVICE_LEVEL_Z = {0.80: 0.8416, 0.85: 1.0364, 0.90: 1.2816, 0.95: 1.6449, 0.975: 1.96, 0.99: 2.3263}


def bom_violations(bom: DataFrame) -> DataFrame:
    """One row of violation counts for a bill of materials."""
    require_columns(bom, BOM_COLUMNS, "bill of materials")
    per_pair = bom.groupBy("product_id", "supply_product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~(F.col("quantity_per_unit") > 0), 1)).alias("bad"))
    return per_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("product_id").isNull(), F.col("n"))), F.lit(0)).alias("null_product"),
        F.coalesce(F.sum(F.when(F.col("supply_product_id").isNull(), F.col("n"))), F.lit(0)).alias("null_supply"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("not_positive"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pairs"))


def normalize_bom(bom: DataFrame) -> DataFrame:
    """Checked and typed bill of materials."""
    found = bom_violations(bom).first()
    errors = [name for name in found.asDict() if name != "rows" and found[name]]
    if not found["rows"]:
        errors.append("empty")
    if errors:
        raise ValueError(f"bill of materials: {', '.join(errors)}")
    return bom.select(F.col("product_id").cast("string").alias("product_id"),
                      F.col("supply_product_id").cast("string").alias("supply_product_id"),
                      F.col("quantity_per_unit").cast("double").alias("quantity_per_unit"), "supply_unit")


def normalize_contract(contract: DataFrame) -> DataFrame:
    require_columns(contract, CONTRACT_COLUMNS, "supplier contract")
    typed = contract.withColumns({c: F.col(c).cast("double") for c in CONTRACT_COLUMNS[2:]})
    bad = typed.agg(*[F.count(F.when(rule, 1)).alias(name) for name, rule in {
        "negative lead_time_days": F.col("lead_time_days") < 0,
        "minimum_order_quantity not positive": F.col("minimum_order_quantity") <= 0,
        "order_multiple not positive": F.col("order_multiple") <= 0}.items()]).first()
    errors = [name for name, n in bad.asDict().items() if n]
    if errors:
        raise ValueError(f"supplier contract: {', '.join(errors)}")
    return typed


def explode_demand(demand: DataFrame, bom: DataFrame) -> DataFrame:
    """Requirement per supply item. Demand without a mapping has no supply item to require."""
    require_columns(demand, ["outlet_id", "product_id", "date", "demand"], "demand")
    need = F.coalesce(to_number("demand"), F.lit(0.0))
    return (demand.select("outlet_id", "date", "product_id", need.alias("demand"))
                  .join(bom.select(*BOM_COLUMNS), "product_id")
                  .withColumn("supply_requirement", F.col("demand") * F.col("quantity_per_unit")))


def supply_demand(demand: DataFrame, bom: DataFrame) -> DataFrame:
    """Required supply per outlet, day and supply item.

    Demand is summed per product before the many-to-many mapping and the mapped rows are
    partially aggregated before their shuffle.
    """
    keys = ["outlet_id", "date", "supply_product_id", "supply_unit"]
    return (explode_demand(demand, bom)
            .filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
            .groupBy(*keys).agg(F.greatest(F.sum("supply_requirement"), F.lit(0.0)).alias("required_supply")))


def horizon_supply(supply: DataFrame) -> DataFrame:
    require_columns(supply, [*SUPPLY_KEY, "required_supply"], "supply demand")
    return supply.groupBy("outlet_id", "supply_product_id").agg(
        F.sum("required_supply").alias("horizon_supply"),
        F.avg("required_supply").alias("average_daily_supply"),
        F.max("required_supply").alias("peak_daily_supply"))


def constrained_order(quantity, minimum, multiple) -> Column:
    """0 for no need, else at least the minimum, rounded up to the multiple."""
    quantity, minimum, multiple = (as_col(c) for c in (quantity, minimum, multiple))
    step = F.greatest(multiple, F.lit(1e-9))
    wanted = F.greatest(quantity, minimum, F.lit(0.0))
    return F.when(quantity > 0, F.ceil(wanted / step) * step).otherwise(0.0)


def supply_recommendations(supply: DataFrame, inventory: DataFrame, contract: DataFrame,
                           safety_stock_days: float = 1.0) -> DataFrame:
    """Target stock, shortage, order and risk per outlet, day and supply item."""
    require_columns(supply, [*SUPPLY_KEY, "required_supply"], "supply demand")
    require_columns(inventory, ["outlet_id", "date", "product_id", "closing_stock", "received_stock"], "inventory")
    if safety_stock_days < 0:
        raise ValueError("safety_stock_days cannot be negative")
    stock = inventory.select(
        "outlet_id", "date", F.col("product_id").cast("string").alias("supply_product_id"),
        F.col("closing_stock").alias("current_inventory"), F.col("received_stock").alias("incoming_stock"))
    daily = supply.groupBy(*SUPPLY_KEY).agg(F.sum("required_supply").alias("required_supply"))
    df = daily.join(stock, list(SUPPLY_KEY), "left").join(contract, "supply_product_id", "left")
    filled = {"current_inventory": 0.0, "incoming_stock": 0.0, "lead_time_days": 3.0,
              "minimum_order_quantity": 0.0, "order_multiple": 1.0}
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in filled.items()})
    df = df.withColumns({c: F.greatest(c, F.lit(0.0)) for c in ("current_inventory", "incoming_stock")})
    need = F.col("required_supply")
    df = df.withColumns({
        "lead_time_demand": need * F.col("lead_time_days"),
        "safety_stock": need * float(safety_stock_days),
        "inventory_position": F.col("current_inventory") + F.col("incoming_stock"),
    }).withColumn("target_inventory", F.col("lead_time_demand") + F.col("safety_stock"))
    target, position = F.col("target_inventory"), F.col("inventory_position")
    df = df.withColumn("shortage", F.greatest(target - position, F.lit(0.0)))
    df = df.withColumns({
        "recommended_order_quantity": constrained_order("shortage", "minimum_order_quantity", "order_multiple"),
        "supply_risk_ratio": F.when(target > 0, clip(ratio(position, target), 0.0, 1.0)).otherwise(1.0),
    })
    return df.withColumns({
        "supply_risk": first_rule([(F.col("supply_risk_ratio") < 0.5, "high"),
                                   (F.col("supply_risk_ratio") < 0.8, "moderate")], "low"),
        "order_required": F.col("recommended_order_quantity") > 0,
    })


# --- reorder point -------------------------------------------------------------------------------

def safety_stock(demand_std, lead_time_days, service_level: float = 0.95) -> Column:
    if service_level not in SERVICE_LEVEL_Z:
        raise ValueError(f"service_level must be one of {sorted(SERVICE_LEVEL_Z)}")
    return F.lit(SERVICE_LEVEL_Z[service_level]) * as_col(demand_std) * F.sqrt(as_col(lead_time_days))


def lead_time_demand(daily_forecast, lead_time_days) -> Column:
    """Sum of the first values of a forecast array; the task fails when it is too short."""
    values, days = as_col(daily_forecast), as_col(lead_time_days)
    total = F.aggregate(F.slice(values, 1, F.greatest(days.cast("int"), F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) >= days, total).otherwise(
        F.raise_error(F.lit("the forecast is shorter than the lead time")).cast("double"))


def order_quantity(reorder_point, position, forecast=0.0, review_days=0) -> Column:
    target = as_col(reorder_point) + F.lit(forecast) * F.lit(review_days) if not isinstance(forecast, Column) \
        else as_col(reorder_point) + forecast * F.lit(review_days)
    return F.greatest(target - F.greatest(as_col(position), F.lit(0.0)), F.lit(0.0))


def pack_size(quantity, pack) -> Column:
    pack = as_col(pack)
    return F.ceil(as_col(quantity) / pack) * pack


def inventory_recommendations(df: DataFrame, service_level: float = 0.95, review_period_days: int = 1) -> DataFrame:
    """Reorder decision for every row.

    Needs daily_forecast (array), demand_std, lead_time_days, inventory_position and pack_size.
    """
    require_columns(df, ["daily_forecast", "demand_std", "lead_time_days", "inventory_position", "pack_size"],
                    "inventory_recommendations")
    df = gate(df, F.size("daily_forecast") < F.col("lead_time_days"), "the forecast is shorter than the lead time")
    df = df.withColumns({
        "forecast_demand": F.get("daily_forecast", F.lit(0)),
        "lead_time_demand": lead_time_demand("daily_forecast", "lead_time_days"),
        "safety_stock": safety_stock("demand_std", "lead_time_days", service_level),
    }).withColumn("reorder_point", F.col("lead_time_demand") + F.col("safety_stock"))
    position = F.col("inventory_position")
    order = order_quantity("reorder_point", position, F.col("forecast_demand"), review_period_days)
    return df.withColumns({
        "reorder": position <= F.col("reorder_point"),
        "recommended_order_quantity": pack_size(order, "pack_size"),
        "stockout_risk": position < F.col("lead_time_demand"),
    })

"""Client reports from forecasts, and the single-series demonstration form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import column_or, first_rule, pick_column
from ..functions.windows import SERIES
from . import daily

PRIORITY = ("HIGH", "MODERATE", "LOW")


def recent_level(sales: DataFrame, keys=SERIES, rows: int = 28) -> DataFrame:
    """Mean and sample deviation of the last rows of every series."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    kept = F.when(F.col("_back") <= rows, F.col("quantity_sold"))
    return sales.withColumn("_back", back).groupBy(*keys).agg(
        F.avg(kept).alias("baseline"), F.coalesce(F.stddev_samp(kept), F.lit(0.0)).alias("deviation"))


def client_actions(forecast: DataFrame, sales: DataFrame, inventory: DataFrame, outlets: DataFrame, products: DataFrame,
                   include_normal: bool = False, keys=SERIES) -> DataFrame:
    """Actions for every series from a wide forecast with d1..d7 or more days (`baselines.pivot_horizon`).

    With `client_id` in the keys many requests are answered together. A series without an
    inventory row is told so instead of getting an order, and so is one whose lead time is
    longer than the forecast.
    """
    steps = 0
    while f"d{steps + 1}" in forecast.columns:
        steps += 1
    if steps < 7:
        raise ValueError("the forecast needs the days d1 to d7")
    level = recent_level(sales, keys)
    wide = forecast.withColumnsRenamed({f"d{i}": f"_f{i}" for i in range(1, steps + 1)})
    who = [k for k in keys if k not in SERIES]
    stock = inventory.select(
        *keys, *[column_or(inventory, c, None).cast("double").alias(c) for c in (
            "current_inventory", "lead_time_days", "safety_stock", "minimum_order_quantity", "order_multiple")],
        column_or(inventory, "supplier_risk", None).cast("string").alias("_supplier_risk")).dropDuplicates(list(keys))
    name = pick_column(outlets, ("outlet_name", "name"))
    title = pick_column(products, ("product_name", "name"))
    places = outlets.select(*who, "outlet_id", *[F.col(c).cast("string").alias(a) for c, a in ((name, "_outlet_name"),) if c],
                            *[column_or(outlets, c, None).alias(c) for c in ("outlet_type", "country", "region", "city")]
                            ).dropDuplicates([*who, "outlet_id"])
    goods = products.select(*who, "product_id", *[F.col(c).cast("string").alias(a) for c, a in ((title, "_product_name"),) if c],
                            *[column_or(products, c, None).alias(c) for c in ("category", "unit")]
                            ).dropDuplicates([*who, "product_id"])
    df = (level.join(wide, list(keys), "left").join(stock, list(keys), "left")
               .join(places, [*who, "outlet_id"], "left").join(goods, [*who, "product_id"], "left"))
    zero = F.lit(0.0)
    days = [F.coalesce(F.col(f"_f{i}"), zero) for i in range(1, steps + 1)]
    base = F.greatest("baseline", F.lit(1e-6))
    lead = F.greatest(F.coalesce(F.col("lead_time_days").cast("int"), F.lit(1)), F.lit(1))
    known = F.col("current_inventory").isNotNull()
    covered = F.col("lead_time_demand").isNotNull()
    df = df.withColumns({
        "d1": days[0], "d3": days[0] + days[1] + days[2], "d7": sum(days[1:7], days[0]),
        "lead_time_days": lead,
        "lead_time_demand": F.when(lead <= steps, F.aggregate(F.slice(F.array(*days), F.lit(1), lead), zero, lambda a, x: a + x)),
        "safety_stock": F.greatest(F.coalesce("safety_stock", 1.65 * F.col("deviation")), zero),
        "change": (days[0] - base) / base,
        "current_inventory": F.when(known, F.greatest("current_inventory", zero)),
        "supplier_risk": F.coalesce("_supplier_risk", F.lit("UNKNOWN")),
    })
    required = F.col("lead_time_demand") + F.col("safety_stock")
    short = F.when(known & covered, F.greatest(required - F.col("current_inventory"), zero))
    wanted = F.when((F.col("minimum_order_quantity") > 0) & (short > 0), F.greatest(short, "minimum_order_quantity")).otherwise(short)
    multiple = F.col("order_multiple")
    order = F.when((multiple > 0) & (wanted > 0), F.ceil(wanted / multiple) * multiple).otherwise(wanted)
    df = df.withColumns({
        "required_inventory": F.when(known, required),
        "shortage": short,
        "recommended_order": order,
        "demand_risk": first_rule([(F.col("change") >= 0.20, "HIGH"), (F.col("change") >= 0.08, "MODERATE")], "LOW"),
        "demand_spike": F.when(F.col("change") >= 0.20, "WATCH").otherwise("NONE"),
        "demand_change_pct": F.col("change") * 100.0,
        "stockout_risk": first_rule([(~known | ~covered, "UNKNOWN"), (F.col("current_inventory") < F.col("lead_time_demand"), "HIGH")], "LOW"),
    }).withColumn("action", first_rule([
        (~known, "INVENTORY_DATA_REQUIRED"), (~covered, "LONGER_FORECAST_REQUIRED"), (F.col("recommended_order") > 0, "REPLENISH")], "NO_ACTION"))
    replenish = F.col("action") == "REPLENISH"
    drivers = F.array_compact(F.array(F.when(F.col("change") > 0.08, "recent demand acceleration"),
                                      F.lit("recent demand pattern"), F.lit("day-of-week demand behavior")))
    df = df.withColumns({
        "priority": first_rule([
            (replenish & ((F.col("stockout_risk") == "HIGH") | (F.col("demand_risk") == "HIGH")), "HIGH"), (replenish | (F.col("action") == "LONGER_FORECAST_REQUIRED"), "MODERATE")], "LOW"),
        "outlet_name": F.coalesce(column_or(df, "_outlet_name", None).cast("string"), F.concat(F.lit("Outlet "), F.col("outlet_id"))),
        "product_name": F.coalesce(column_or(df, "_product_name", None).cast("string"), F.concat(F.lit("Product "), F.col("product_id"))),
        "key_drivers": drivers,
    })
    out = df.select(*keys, "outlet_name", "outlet_type", "product_name", "category", "unit", "d1", "d3", "d7", "demand_risk",
                    "demand_change_pct", "demand_spike", "current_inventory", "required_inventory", "shortage", "safety_stock",
                    "lead_time_days", "lead_time_demand", "recommended_order", "supplier_risk", "stockout_risk", "priority",
                    "action", "key_drivers")
    return out if include_normal else out.filter(F.col("priority") != "LOW")


def priority_order() -> Column:
    chain = F
    for i, p in enumerate(PRIORITY):
        chain = chain.when(F.col("priority") == p, i)
    return chain.otherwise(len(PRIORITY))


def top_actions(actions: DataFrame, top_n: int = 50, who: str | None = None) -> DataFrame:
    """The first actions by priority; with `who` that many for each client."""
    if who is None:
        return actions.orderBy(priority_order(), *SERIES).limit(top_n)
    place = F.row_number().over(Window.partitionBy(who).orderBy(priority_order(), *SERIES))
    return actions.withColumn("_place", place).filter(F.col("_place") <= top_n).drop("_place")


def demonstration(outlook: DataFrame, lead_time_days: int = 3, current_inventory: float | None = None) -> DataFrame:
    """The daily action columns with an inventory given by the caller.

    Without one the last known stock counts, and without any the mean of the last week. A lead
    time beyond the seven forecast days is refused.
    """
    if not 1 <= lead_time_days <= 7:
        raise ValueError("the lead time must be within the seven forecast days")
    stock = F.coalesce(F.lit(current_inventory).cast("double"), F.greatest("last_stock", F.lit(0.0)),
                       F.greatest("recent_week_mean", F.lit(0.0)))
    made = daily.series_actions(outlook.withColumn("current_inventory", stock), lead_time_days)
    return made.withColumn("priority", F.when(F.col("priority") == "MODERATE", "MEDIUM").otherwise(F.col("priority")))

"""The daily action report: a weekly outlook per series and what to do about it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, column_or, count_where, first_rule, gate, pick_column, require_columns, to_number
from ..functions.windows import SERIES
from ..plans.lineage import cut
from ..plans.slices import SLICE_ROWS, before, sliced

# Accepted names of the demand and stock columns, in order of preference.
DEMAND_NAMES = ("deconstrained_demand", "estimated_true_demand", "true_demand", "quantity_sold")
STOCK_NAMES = ("closing_stock", "current_inventory", "inventory", "stock", "available_inventory")
CONTEXT_DRIVERS = {
    "holiday_active": "Holiday context available",
    "promotion_active": "Promotion context available",
    "event_active": "Event context available",
    "is_rainy": "Weather context available",
}
PRIORITIES = ("CRITICAL", "HIGH", "MODERATE", "LOW", "NORMAL")
MIN_HISTORY = 28
HISTORY_REQUIRED = "HISTORY_REQUIRED"
LEAD_TIME_DAYS = 3


def demand_column(df: DataFrame) -> str:
    found = pick_column(df, DEMAND_NAMES)
    if not found:
        raise ValueError(f"no demand column, expected one of {DEMAND_NAMES}")
    return found


def weekly_outlook(history: DataFrame, forecast_date: date, demand: str | None = None,
                   stock: str | None = None) -> DataFrame:
    """Per series: recent level, trend and same-weekday means, blended into seven days.

    One exchange on the series serves both orderings and the aggregation. The history of a
    series is bounded by the calendar.
    """
    demand = demand or demand_column(history)
    stock = stock or pick_column(history, STOCK_NAMES)
    require_columns(history, [*SERIES, "date", demand], "history")
    context = [c for c in CONTEXT_DRIVERS if c in history.columns]
    df = history.select(
        *[F.col(c).cast("string").alias(c) for c in SERIES], F.col("date").cast("date").alias("date"),
        to_number(demand).alias("_x"),
        (to_number(stock) if stock else F.lit(None).cast("double")).alias("_stock"),
        *[to_number(c).alias(c) for c in context],
    ).dropna(subset=[*SERIES, "date", "_x"]).filter(F.col("date") < F.lit(forecast_date))
    df = df.withColumns({
        "_back": F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("date"))),
        "_dow": F.weekday("date"),
    })
    df = df.withColumn("_dow_back", F.row_number().over(
        Window.partitionBy(*SERIES, "_dow").orderBy(F.desc("date"))))
    x, back = F.col("_x"), F.col("_back")
    weekdays = range(7)
    out = df.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("history_rows"),
        F.avg(F.when(back <= 28, x)).alias("recent_mean"),
        F.stddev_pop(F.when(back <= 28, x)).alias("recent_std"),
        F.avg(F.when((back > 14) & (back <= 28), x)).alias("_older"),
        F.avg(F.when(back <= 14, x)).alias("_newer"),
        F.avg(F.when(back <= 7, x)).alias("recent_week_mean"),
        F.max_by(F.when(F.col("_stock").isNotNull(), F.col("_stock")),
                 F.when(F.col("_stock").isNotNull(), F.col("date"))).alias("last_stock"),
        *[F.avg(F.when((F.col("_dow") == k) & (F.col("_dow_back") <= 12), x)).alias(f"_mean_{k}") for k in weekdays],
        *[count_where(F.col("_dow") == k).alias(f"_count_{k}") for k in weekdays],
        *[F.coalesce(F.max(c) > 0, F.lit(False)).alias(f"_has_{c}") for c in context])
    mean = F.col("recent_mean")

    def seasonal(k: int) -> Column:
        return F.when(F.col(f"_count_{k}") >= 4, F.col(f"_mean_{k}")).otherwise(mean)

    trend = F.when(F.col("history_rows") >= 28,
                   F.when(F.col("_older") > 0, clip(F.col("_newer") / F.nullif(F.col("_older"), F.lit(0.0)), 0.85, 1.15))
                    .otherwise(1.0)).otherwise(1.0)
    first_dow = forecast_date.weekday()
    out = out.withColumn("_base", (0.55 * mean + 0.45 * seasonal(first_dow)) * trend)
    days = [F.greatest(0.55 * F.col("_base") + 0.45 * seasonal((first_dow + k) % 7), F.lit(0.0)) for k in range(7)]
    return out.withColumns({
        "trend_ratio": trend,
        "forecast": F.array(*days),
        "current_inventory": F.greatest(F.coalesce("last_stock", F.lit(0.0)), F.lit(0.0)),
        "_active": F.array_compact(F.array(
            *[F.when(F.col(f"_has_{c}"), F.lit(CONTEXT_DRIVERS[c])) for c in context])) if context
            else F.array().cast("array<string>"),
    }).select(*SERIES, "history_rows", "recent_mean", "recent_std", "recent_week_mean", "last_stock", "trend_ratio",
              "forecast", "current_inventory", F.col("_active").alias("context_drivers"))


def outlook_days(outlook: DataFrame, forecast_date: date) -> DataFrame:
    """The seven forecast days as rows."""
    return (outlook.select(*SERIES, F.posexplode("forecast").alias("step", "demand"))
            .withColumns({"date": F.date_add(F.lit(forecast_date), F.col("step")), "horizon": F.col("step") + 1}))


def _first_days(n: int) -> Column:
    return F.aggregate(F.slice("forecast", 1, n), F.lit(0.0), lambda a, v: a + v)


def series_actions(outlook: DataFrame, lead_time: int = LEAD_TIME_DAYS, min_history: int = MIN_HISTORY) -> DataFrame:
    """Risk, shortage, order, priority and drivers of every series.

    `order_multiple` is 1, so orders are whole units. A series with fewer rows than `min_history`
    keeps its row: the action is HISTORY_REQUIRED with priority LOW, its risks are UNKNOWN and its
    order is NULL. `with_history` leaves these rows out.
    """
    df = outlook.withColumns({
        "d1": F.get("forecast", F.lit(0)), "d3": _first_days(3), "d7": _first_days(7),
        "lead_time_days": F.lit(lead_time),
        "lead_time_demand": _first_days(lead_time),
        "safety_stock": F.greatest(1.28 * F.col("recent_std"), F.lit(0.0)),
    })
    base, std = F.col("recent_mean"), F.col("recent_std")
    daily = F.col("d7") / 7.0
    zero = F.lit(0.0)
    df = df.withColumns({
        "change_pct": F.when(base > 0, (daily - base) / F.nullif(base, zero) * 100.0).otherwise(0.0),
        "z_score": F.when(std > 0, (daily - base) / F.nullif(std, zero)).otherwise(0.0),
        "cv": F.when(base > 0, std / F.nullif(base, zero)).otherwise(1.0),
        "required_inventory": F.col("lead_time_demand") + F.col("safety_stock"),
    })
    change, z, stock, required = (F.col(c) for c in ("change_pct", "z_score", "current_inventory", "required_inventory"))
    confidence = (0.65 * F.least(F.lit(1.0), F.col("history_rows") / 180.0)
                  + 0.35 / (1.0 + F.greatest(F.col("cv"), zero)))
    df = df.withColumns({
        "demand_spike": first_rule([
            (~((change >= 20.0) & (z >= 1.5)), "NONE"), ((change >= 50.0) | (z >= 3.0), "EXTREME"),
            ((change >= 35.0) | (z >= 2.0), "MAJOR")], "MODERATE"),
        "demand_risk": first_rule([((change >= 30.0) | (z >= 2.0), "HIGH"), ((change >= 10.0) | (z >= 1.0), "MODERATE")], "LOW"),
        "confidence": clip(confidence, 0.0, 1.0),
        "shortage": F.greatest(required - stock, zero),
        "stockout_risk": first_rule([(stock < F.col("lead_time_demand"), "HIGH"), (stock < required, "MODERATE")], "LOW"),
    }).withColumn("recommended_order", F.ceil("shortage").cast("double"))
    order, unsure = F.col("recommended_order"), F.col("confidence") < 0.5
    df = df.withColumns({
        "supplier_risk": first_rule([(order <= 0, "LOW"), (order > F.col("lead_time_demand"), "HIGH")], "MODERATE"),
        "action": first_rule([(unsure, "REVIEW_REQUIRED"), (F.col("shortage") <= 0, "HOLD")], "REPLENISH"),
        "priority": first_rule([(unsure, "HIGH"), (F.col("shortage") <= 0, "NORMAL"),
                                (F.col("stockout_risk") == "HIGH", "HIGH")], "MODERATE"),
        "reason": first_rule([
            (unsure, "Forecast confidence is below the autonomous decision threshold."),
            (F.col("shortage") <= 0,
             "Projected demand is covered by the current inventory position and safety-stock requirement."),
            (F.col("stockout_risk") == "HIGH", "Projected lead-time demand exceeds available inventory coverage.")],
            "Additional inventory is required to reach the projected lead-time target."),
    })
    fixed = F.array(F.lit("Recent historical demand pattern"), F.lit("Day-of-week demand behavior"),
                    F.when(change > 5, "Positive recent demand trend").when(change < -5, "Negative recent demand trend"))
    df = df.withColumn("key_drivers", F.array_distinct(F.concat(F.array_compact(fixed), "context_drivers")))
    short = F.col("history_rows") < min_history
    instead = {c: "UNKNOWN" for c in ("demand_spike", "demand_risk", "stockout_risk", "supplier_risk")} | {
        "recommended_order": None, "action": HISTORY_REQUIRED, "priority": "LOW",
        "reason": f"The series has fewer than {min_history} days of history."}
    return df.withColumns({c: F.when(short, F.lit(v)).otherwise(F.col(c)) for c, v in instead.items()})


def with_history(actions: DataFrame) -> DataFrame:
    """The actions, flat or nested, of series with enough history."""
    return actions.filter(F.col("recommendation.action" if "recommendation" in actions.columns else "action") != HISTORY_REQUIRED)


# --- identities and the nested report -------------------------------------------------------------

# Names of the products every installation knows.
KNOWN_PRODUCTS = {
    "P001": ("Milk", "Dairy", "litre"), "P002": ("Chicken", "Meat", "kg"), "P003": ("Beef", "Meat", "kg"),
    "P004": ("Rice", "Staples", "kg"), "P005": ("Flour", "Staples", "kg"), "P006": ("Cheese", "Dairy", "kg"),
    "P007": ("Cooking Oil", "Staples", "litre"), "P008": ("Eggs", "Dairy", "pieces"),
    "P009": ("Bread", "Bakery", "pieces"), "P010": ("Pizza Dough", "Pizza", "pieces"),
    "P011": ("Pizza Base 12-inch", "Pizza", "pieces"), "P012": ("Pizza Base 14-inch", "Pizza", "pieces"),
    "P013": ("Pizza Base 16-inch", "Pizza", "pieces"), "P014": ("Soft Drink", "Beverage", "bottles"),
    "P015": ("Bottled Water", "Beverage", "bottles"), "P016": ("Coffee", "Beverage", "kg"),
    "P017": ("Tea", "Beverage", "kg"), "P018": ("Tomatoes", "Produce", "kg"),
    "P019": ("Potatoes", "Produce", "kg"), "P020": ("Packaging Box", "Packaging", "pieces"),
}
OUTLET_FIELDS = ("outlet_type", "country", "region", "city", "location_type")
OUTLET_DETAILS = ("cuisine", "capacity", "kitchen_type", "delivery_available", "takeaway_available", "bar_available")


def with_outlet_identity(df: DataFrame, outlets: DataFrame) -> DataFrame:
    """Nested outlet identity; an outlet the catalog does not know fails every action."""
    known = outlets.select("outlet_id", F.lit(True).alias("_known"), *[
        column_or(outlets, c, None).alias(f"_{c}") for c in (*OUTLET_FIELDS, *OUTLET_DETAILS)
    ]).dropDuplicates(["outlet_id"])
    identity = F.struct(
        "outlet_id", F.concat(F.lit("Outlet "), F.col("outlet_id")).alias("outlet_name"),
        *[F.coalesce(F.col(f"_{c}").cast("string"), F.lit("unknown")).alias(c) for c in OUTLET_FIELDS],
        *[F.col(f"_{c}").alias(c) for c in OUTLET_DETAILS])
    named = gate(df.join(known, "outlet_id", "left"), F.col("_known").isNull(),
                 F.concat(F.lit("outlet not in the catalog: "), F.coalesce(F.col("outlet_id").cast("string"), F.lit("null"))))
    return (named.withColumn("outlet", identity)
              .drop("_known", *[f"_{c}" for c in (*OUTLET_FIELDS, *OUTLET_DETAILS)]))


def with_product_identity(df: DataFrame, products: DataFrame) -> DataFrame:
    """Nested product identity: catalog, else the known products, else the id itself."""
    name = pick_column(products, ("product_name", "name")) or "product_id"
    catalog = products.select(
        "product_id", F.col(name).cast("string").alias("_name"),
        F.coalesce(column_or(products, "category", None).cast("string"), F.lit("Unknown")).alias("_category"),
        F.coalesce(column_or(products, "unit", None).cast("string"), F.lit("units")).alias("_unit"),
    ).dropDuplicates(["product_id"])
    key = F.col("product_id")

    known = F.try_element_at(F.create_map(*[
        part for product, (title, category, unit) in KNOWN_PRODUCTS.items()
        for part in (F.lit(product), F.struct(F.lit(title).alias("name"), F.lit(category).alias("category"),
                                              F.lit(unit).alias("unit")))]), key)
    identity = F.struct(
        key.alias("product_id"), F.coalesce("_name", known["name"], key).alias("product_name"),
        F.coalesce("_category", known["category"], F.lit("Unknown")).alias("category"),
        F.coalesce("_unit", known["unit"], F.lit("units")).alias("unit"))
    return df.join(catalog, "product_id", "left").withColumn("product", identity).drop("_name", "_category", "_unit")


def _rounded(*names: str, digits: int = 2) -> list[Column]:
    return [F.bround(n, digits).alias(n) for n in names]


def nested_actions(actions: DataFrame, outlets: DataFrame, products: DataFrame, report_date: date) -> DataFrame:
    df = actions.transform(with_outlet_identity, outlets).transform(with_product_identity, products)
    return df.select(
        "outlet", "product", F.lit(report_date.isoformat()).alias("date"),
        F.struct(*_rounded("d1", "d3", "d7")).alias("forecast"),
        "demand_risk", "demand_spike", F.bround("confidence", 4).alias("model_confidence"),
        F.struct(*_rounded("current_inventory", "required_inventory", "shortage", "safety_stock")).alias("inventory"),
        F.struct("lead_time_days", *_rounded("lead_time_demand", "recommended_order"),
                 F.col("product.unit").alias("order_unit"), F.lit(1.0).alias("order_multiple"),
                 "supplier_risk").alias("supply"),
        "stockout_risk", "priority",
        F.struct("action", "priority", "reason").alias("recommendation"), "key_drivers")


def latest_day(df: DataFrame) -> date:
    return df.agg(F.max("date").alias("day")).first()["day"]


def daily_report(history: DataFrame, outlets: DataFrame, products: DataFrame, report_date: date | None = None,
                 include_normal: bool = False) -> DataFrame:
    """One nested action per series for the day after the data, unranked.

    A report date inside the history is refused. Without one, the last day is looked up first.
    """
    last = latest_day(history)
    report_date = report_date or last + timedelta(days=1)
    if report_date <= last:
        raise ValueError(f"report_date must be after {last}")
    actions = nested_actions(series_actions(weekly_outlook(history, report_date)), outlets, products, report_date)
    return actions if include_normal else actions.filter(F.col("priority") != "NORMAL")


def priority_value(column="priority") -> Column:
    name = F.upper(F.col(column) if isinstance(column, str) else column)
    chain = F
    for i, p in enumerate(PRIORITIES):
        chain = chain.when(name == p, i)
    return chain.otherwise(99)


def ranking_order() -> list[Column]:
    return [priority_value().asc(), F.desc("inventory.shortage"), F.desc("forecast.d7"),
            F.asc("outlet.outlet_id"), F.asc("product.product_id")]


def rank_actions(actions: DataFrame) -> DataFrame:
    return actions.orderBy(*ranking_order())


def filter_actions(actions: DataFrame, priority: str | None = None, outlet_id: str | None = None,
                   product_id: str | None = None) -> DataFrame:
    if priority is not None:
        actions = actions.filter(F.upper("priority") == priority.upper())
    if outlet_id is not None:
        actions = actions.filter(F.col("outlet.outlet_id") == outlet_id)
    if product_id is not None:
        actions = actions.filter(F.col("product.product_id") == product_id)
    return actions


def action_page(actions: DataFrame, page: int = 1, page_size: int = 20, **filters) -> DataFrame:
    """One page of the ranked actions, with the totals a pager needs."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page >= 1 and 1 <= page_size <= 100 are required")
    found = filter_actions(actions, **filters)
    totals = found.agg(F.count(F.lit(1)).alias("total_actions"))
    rows = rank_actions(found).offset((page - 1) * page_size).limit(page_size)
    return compact_actions(rows).join(F.broadcast(totals), F.lit(True)).withColumns({
        "page": F.lit(page),
        "total_pages": F.ceil(F.col("total_actions") / page_size),
        "has_next": F.lit(page) * page_size < F.col("total_actions"),
    })


def page_index(actions: DataFrame, page_size: int = 20, rows: int = SLICE_ROWS, **filters) -> DataFrame:
    """The ranked actions stored with their position, so that a page is a range of positions.

    They are ranged once by the ranking order and numbered inside each range, after the ranges before;
    files hold rising positions, by which a reader skips all but those of the page.
    """
    if not 1 <= page_size <= 100:
        raise ValueError("1 <= page_size <= 100 is required")
    parts = sliced(filter_actions(actions, **filters).withColumn("_one", F.lit(1)), ranking_order(), rows)
    offsets = before(parts, "_one")
    total = offsets.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_actions"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy(*ranking_order()))
    numbered = parts.join(offsets.select("slice", "before"), "slice").withColumn("position", F.col("before") + inside)
    numbered = numbered.drop("slice", "before", "_one").join(F.broadcast(total), F.lit(True)).withColumn("page_size", F.lit(page_size))
    return cut(numbered.sortWithinPartitions("position"))


def indexed_page(index: DataFrame, page: int) -> DataFrame:
    """One page of a `page_index`, by a filter on positions; a page beyond the last has no rows."""
    if page < 1:
        raise ValueError("page >= 1 is required")
    size = index.select("page_size").first()
    last = page * (size[0] if size else 1)
    first = last - (size[0] if size else 1) + 1
    rows = index.filter(F.col("position").between(first, last))
    extra = [F.col("position"), F.lit(page).alias("page"), F.col("total_actions"), F.ceil(F.col("total_actions") / F.col("page_size")).alias("total_pages"),
             (F.lit(last) < F.col("total_actions")).alias("has_next")]
    return _compact(rows, extra)


def _compact(actions: DataFrame, extra=()) -> DataFrame:
    return actions.select(
        "outlet.outlet_id", "outlet.outlet_name", "outlet.outlet_type", "product.product_id", "product.product_name",
        "product.unit", "date", "forecast.*", "inventory.*", "supply.lead_time_days", "supply.lead_time_demand",
        "supply.recommended_order", "supply.order_unit", "supply.supplier_risk", "demand_risk", "demand_spike",
        "stockout_risk", "priority", "recommendation.action", "recommendation.reason", "model_confidence", "key_drivers", *extra)


def compact_actions(actions: DataFrame) -> DataFrame:
    """Nested actions as flat columns."""
    return _compact(actions)


def priority_summary(actions: DataFrame) -> DataFrame:
    """Counts per priority in one row; a name outside the list counts as NORMAL."""
    name = F.when(F.upper("priority").isin(*PRIORITIES), F.upper("priority")).otherwise("NORMAL")
    return actions.agg(*[count_where(name == p).alias(p.lower()) for p in PRIORITIES])


def counts_by(actions: DataFrame, column: str) -> DataFrame:
    label = F.upper(F.coalesce(F.col(column), F.lit("UNKNOWN")))
    return actions.groupBy(label.alias(column)).agg(F.count(F.lit(1)).alias("actions"))


def report_summary(actions: DataFrame) -> DataFrame:
    """Outlets, products, series and actions in one row."""
    act = F.col("recommendation.action")
    return actions.agg(
        F.count_distinct("outlet.outlet_id").alias("outlets"),
        F.count_distinct("product.product_id").alias("products"),
        F.count_distinct(F.struct("outlet.outlet_id", "product.product_id")).alias("series"),
        F.count(F.lit(1)).alias("actions_required"),
        count_where(act == "REPLENISH").alias("replenish_actions"),
        count_where(act == "REVIEW_REQUIRED").alias("review_actions"),
        count_where(act == "HOLD").alias("hold_actions"),
        count_where(act == HISTORY_REQUIRED).alias("history_actions"))

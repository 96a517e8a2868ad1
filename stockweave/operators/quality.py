"""Data-quality checks. Column checks of one table are conditional counts of a single
aggregation; the result is one row per check: (check, column, violations)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_where, require_columns, to_number

# Texts that mean "missing" in input files.
NULL_TOKENS = ("", "NA", "N/A", "null", "None")
CHECK_SCHEMA = "check string, column string, violations bigint"


# --- cleaning ------------------------------------------------------------------------------------

def normalize_nulls(df: DataFrame) -> DataFrame:
    texts = [n for n, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)) for c in texts}) if texts else df


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def clean(df: DataFrame) -> DataFrame:
    return df.transform(normalize_columns).transform(normalize_nulls)


def typed(df: DataFrame, date: str = "date", target: str = "quantity_sold") -> DataFrame:
    """Date and target converted leniently; rows without key, date or target are dropped."""
    require_columns(df, ["outlet_id", "product_id", date, target], "typed")
    return df.withColumns({date: F.col(date).try_cast("date"), target: to_number(target)}).dropna(
        subset=["outlet_id", "product_id", date, target])


def numeric_text_columns(df: DataFrame) -> DataFrame:
    """Convert a text column to double where every present value converts: one counting pass."""
    texts = [n for n, t in df.dtypes if t == "string" and n not in ("outlet_id", "product_id")]
    if not texts:
        return df
    counts = df.agg(*[F.struct(F.count(c).alias("present"), F.count(to_number(c)).alias("numbers")).alias(c) for c in texts]).first()
    good = [c for c in texts if counts[c]["present"] and counts[c]["present"] == counts[c]["numbers"]]
    return df.withColumns({c: to_number(c) for c in good}) if good else df


# --- checks --------------------------------------------------------------------------------------

def _as_rows(df: DataFrame, rules: list[tuple[str, str, Column | None]]) -> DataFrame:
    """Evaluate (check, column, counter) rules in one aggregation; no counter means the column is missing."""
    spark = df.sparkSession
    missing = [(check, column, -1) for check, column, counter in rules if counter is None]
    present = [(check, column, counter) for check, column, counter in rules if counter is not None]
    out = spark.createDataFrame(missing, CHECK_SCHEMA) if missing else None
    if present:
        rows = F.array(*[F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), F.col(f"_{i}").alias("violations"))
                         for i, (check, column, _) in enumerate(present)])
        found = df.agg(*[counter.cast("bigint").alias(f"_{i}") for i, (_, _, counter) in enumerate(present)]).select(F.inline(rows))
        out = found if out is None else found.unionByName(out)
    return out if out is not None else spark.createDataFrame([], CHECK_SCHEMA)


def column_checks(df: DataFrame, no_nulls=(), non_negative=(), bounds: dict | None = None, dates=(),
                  date_range: dict | None = None) -> DataFrame:
    """Any number of column checks for the price of one scan. -1 marks a missing column."""
    have = set(df.columns)
    rules: list[tuple[str, str, Column | None]] = []
    for c in no_nulls:
        rules.append(("no_nulls", c, count_where(F.col(c).isNull()) if c in have else None))
    for c in non_negative:
        if c in have:
            rules.append(("non_negative", c, count_where(F.col(c) < 0)))
    for c, (low, high) in (bounds or {}).items():
        rules.append(("bounds", c, count_where((F.col(c) < low) | (F.col(c) > high)) if c in have else None))
    for c in dates:
        rules.append(("valid_date", c, count_where(F.col(c).cast("string").try_cast("timestamp").isNull()) if c in have else None))
    for c, (start, end) in (date_range or {}).items():
        day = F.col(c).try_cast("date") if c in have else None
        rules.append(("date_range", c, count_where((day < F.lit(start).cast("date")) | (day > F.lit(end).cast("date"))) if c in have else None))
    return _as_rows(df, rules)


def unique_key(df: DataFrame, columns) -> DataFrame:
    """Rows beyond the first of each key; NULLs equal each other. Partial aggregation first."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    name = ",".join(columns)
    if set(columns) - set(df.columns):
        return df.sparkSession.createDataFrame([("unique", name, -1)], CHECK_SCHEMA)
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit("unique").alias("check"), F.lit(name).alias("column"), "violations")


def descending_dates(df: DataFrame, sequence: str, date: str = "date", partition=("outlet_id", "product_id")) -> DataFrame:
    """Series whose days never rise along a given row sequence (one row per series).

    Rows are first reduced to the span of sequence numbers per day: the order falls exactly
    when every later day ends before the day before it begins. A series with any number of
    rows is therefore a window over its days only.
    """
    spans = df.filter(F.col(date).isNotNull()).groupBy(*partition, F.col(date).alias("_day")).agg(
        F.min(sequence).alias("_first"), F.max(sequence).alias("_last"), F.count(F.lit(1)).alias("_n"))
    later = F.lead("_last").over(Window.partitionBy(*partition).orderBy("_day"))
    return spans.withColumn("_rises", F.coalesce(later > F.col("_first"), F.lit(False))).groupBy(*partition).agg(
        (~F.bool_or("_rises")).alias("descending"), F.sum("_n").alias("rows"))


def foreign_keys(child: DataFrame, parent: DataFrame, child_column: str, parent_column: str | None = None) -> DataFrame:
    """Child rows whose key the parent lacks; a NULL key counts.

    The child is reduced to its distinct keys before the join, so a hot key is one row.
    """
    parent_column = parent_column or child_column
    keys = child.groupBy(F.col(child_column).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_column).alias("_key")).distinct()
    return keys.join(known, "_key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit("foreign_key").alias("check"), F.lit(child_column).alias("column"), "violations")


def sales_references(sales: DataFrame, outlets: DataFrame, products: DataFrame) -> DataFrame:
    return foreign_keys(sales, outlets, "outlet_id").unionByName(foreign_keys(sales, products, "product_id"))


# --- record contracts ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Record:
    """Contract of one table: required and optional columns and the range of numbers."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()


POSITIVE = (0, None)
RECORDS = {
    "sales": Record(("outlet_id", "date", "product_id", "quantity_sold", "unit", "revenue"), (),
                    {"quantity_sold": POSITIVE, "revenue": POSITIVE}, ("date",)),
    "inventory": Record(("outlet_id", "date", "product_id", "opening_stock", "received_stock", "closing_stock"), ("wastage", "stockout"),
                        {c: POSITIVE for c in ("opening_stock", "received_stock", "closing_stock", "wastage")}, ("date",)),
    "outlets": Record(("outlet_id", "outlet_type", "country", "region", "city", "latitude", "longitude", "location_type"),
                      ("cuisine", "capacity", "kitchen_type"), {"capacity": POSITIVE}, (), ("latitude", "longitude")),
    "products": Record(("product_id", "product_name", "category", "unit"),
                       ("unit_size", "dimension", "pack_size", "conversion_factor", "shelf_life_days")),
    "holidays": Record(("date", "country", "holiday_name", "holiday_type", "importance"), ("region",), {"importance": POSITIVE}, ("date",)),
    "events": Record(("event_id", "event_name", "event_type", "city", "latitude", "longitude", "start_date", "end_date", "importance"), (),
                     {"importance": POSITIVE}, ("start_date", "end_date"), ("latitude", "longitude")),
    "weather": Record(("date", "city", "temperature", "precipitation", "humidity", "weather_condition"), (),
                      {"precipitation": POSITIVE, "humidity": (0, 100)}, ("date",), ("temperature",)),
    "demographics": Record(("city", "population", "population_density", "tourism_index", "student_index", "business_index"), (),
                           {c: POSITIVE for c in ("population", "population_density", "tourism_index", "student_index", "business_index")}),
    "promotions": Record(("outlet_id", "product_id", "start_date", "end_date", "promotion_type", "discount"), (),
                         {"discount": (0, 100)}, ("start_date", "end_date")),
}


def record_errors(df: DataFrame, record: str | Record, name: str = "errors") -> DataFrame:
    """Add an array of contract violations to every row."""
    rule = RECORDS[record] if isinstance(record, str) else record
    have = set(df.columns)
    messages: list[Column] = []

    def when(condition: Column, text: str) -> None:
        messages.append(F.when(condition, F.lit(text)))

    for c in rule.required:
        when(F.col(c).isNull() if c in have else F.lit(True), f"{c}: missing")
    for c in rule.dates:
        if c in have:
            when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("date").isNull(), f"{c}: not a date")
    for c in (*rule.ranges, *rule.numbers):
        if c in have:
            when(F.col(c).isNotNull() & to_number(c).isNull(), f"{c}: not a number")
    for c, (low, high) in rule.ranges.items():
        if c in have:
            bad = (to_number(c) < low) if high is None else ~to_number(c).between(low, high)
            when(bad, f"{c}: out of range")
    return df.withColumn(name, F.array_compact(F.array(*messages)))


def record_report(df: DataFrame, record: str | Record, table: str = "") -> DataFrame:
    """(table, message, rows): how many rows break each rule of the contract."""
    return (record_errors(df, record).select(F.explode("errors").alias("message"))
            .groupBy("message").agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table or str(record)).alias("table"), "message", "rows"))


def validate_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Contract report of every table that is present."""
    reports = [record_report(df, name, name) for name, df in tables.items() if df is not None]
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def dimension_report(outlets: DataFrame, products: DataFrame) -> DataFrame:
    """All checks of both dimensions with the table they belong to."""
    def named(df: DataFrame, table: str) -> DataFrame:
        return df.select(F.lit(table).alias("table"), "check", "column", "violations")

    checks = column_checks(outlets, no_nulls=["outlet_id", "outlet_type", "country", "region", "city"],
                           non_negative=["capacity", "tourism_level", "business_area", "residential_area", "student_area"],
                           bounds={"latitude": (-90, 90), "longitude": (-180, 180)})
    return (named(checks, "outlets").unionByName(named(unique_key(outlets, "outlet_id"), "outlets"))
            .unionByName(named(column_checks(products, no_nulls=["product_id", "product_name", "category", "unit"]), "products"))
            .unionByName(named(unique_key(products, "product_id"), "products")))


# --- sufficiency -------------------------------------------------------------------------------------

def short_series(df: DataFrame, minimum_days: int = 35) -> DataFrame:
    """Series with fewer distinct days than needed."""
    return (df.groupBy("outlet_id", "product_id").agg(F.count_distinct("date").alias("days"))
              .filter(F.col("days") < minimum_days))


def history_summary(df: DataFrame, minimum_days: int = 35) -> DataFrame:
    days = df.groupBy("outlet_id", "product_id").agg(F.count_distinct("date").alias("days"))
    return days.agg(F.count(F.lit(1)).alias("series"), F.min("days").alias("minimum_history_days"),
                    F.max("days").alias("maximum_history_days"), count_where(F.col("days") < minimum_days).alias("insufficient"))


def require_history(df: DataFrame, minimum_days: int = 35) -> DataFrame:
    """The frame itself, or an error that names up to ten short series."""
    examples = short_series(df, minimum_days).limit(10).collect()
    if examples:
        raise ValueError(f"series need {minimum_days} days, too short: {[(r.outlet_id, r.product_id, r.days) for r in examples]}")
    return df


def sufficiency(df: DataFrame, minimum_rows: int = 1000, validation_days: int = 30, evaluation_days: int = 30) -> DataFrame:
    """Rows, days, series and the first gate that fails."""
    pairs = df.groupBy("outlet_id", "product_id", F.col("date").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    one = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct("date").alias("days"),
                    F.count_distinct("outlet_id", "product_id").alias("series"))
    needed = validation_days + evaluation_days + 28
    reason = (F.when(F.col("rows") < minimum_rows, F.concat(F.lit("INSUFFICIENT_DATA:"), F.col("rows").cast("string"), F.lit(f"<{minimum_rows}")))
               .when(F.col("days") < needed, F.concat(F.lit("INSUFFICIENT_HISTORY:"), F.col("days").cast("string"), F.lit(f"<{needed}")))
               .when(F.col("series") == 0, "NO_OUTLET_PRODUCT_SERIES").otherwise("SUFFICIENT_DATA"))
    return one.withColumn("reason", reason).withColumn("sufficient", F.col("reason") == "SUFFICIENT_DATA")


def ledger_audit(ledger: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Stock identity, demand relations and stockout rate of a ledger joined on its key, in one row.

    Needs opening_stock, received_stock, closing_stock, wastage, quantity_sold, true_demand,
    lost_demand and stockout.
    """
    gap = F.abs(F.col("opening_stock") + F.col("received_stock") - F.col("quantity_sold") - F.col("wastage") - F.col("closing_stock"))
    out = F.coalesce(F.col("stockout"), F.lit(False))
    one = ledger.agg(
        F.count(F.lit(1)).alias("rows"), count_where(gap > tolerance).alias("ledger_breaks"),
        count_where(F.col("quantity_sold") > F.col("true_demand") + tolerance).alias("sold_above_demand"),
        count_where(out & ~(F.col("lost_demand") > 0)).alias("stockout_without_loss"),
        F.avg(out.cast("double")).alias("stockout_rate"))
    return one.withColumn("stockout_rate_plausible", F.coalesce(F.col("stockout_rate").between(0.01, 0.20), F.lit(False)))

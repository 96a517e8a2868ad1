"""Readers and writers: tables, client files, feeds, JSON requests, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import column_or, pick_column, require_columns, to_number
from ..operators import admission, calendar, quality
from ..plans.lineage import cut
from . import feeds
from .feeds import ALIASES, FORMATS, REQUIRED

FEED_KEY = ("outlet_id", "product_id", "date")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}")


def write_table(df: DataFrame, base: str, name: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> str:
    """Write a stage result as parquet (interim, processed or feature tables)."""
    path = f"{base}/{name}"
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def read_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by suffix: csv, parquet or json."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file type {suffix}, expected one of {FORMATS}")
    if suffix == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.csv(path, header=True) if suffix == "csv" else reader.json(path, multiLine=False)


def list_files(spark: SparkSession, folder: str, formats=FORMATS) -> list[str]:
    """Non-empty files of the accepted formats; only names and sizes are read."""
    out: list[str] = []
    for fmt in formats:
        found = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{fmt}").load(folder)
                 .filter("length > 0").select("path").collect())
        out += [r["path"] for r in found]
    return sorted(out)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Client files of any accepted format and header in the canonical columns as text, parsed once (`feeds`)."""
    staged = cut(feeds.stage(spark, paths))
    return feeds.canonical(staged, feeds.layouts(staged))


def read_package(spark: SparkSession, folder: str, formats=FORMATS) -> DataFrame:
    """Every waiting file of a folder; empty files are skipped."""
    paths = list_files(spark, folder, formats)
    if not paths:
        raise ValueError(f"no {', '.join(formats)} file in {folder}")
    return read_files(spark, paths)


def manifest(df: DataFrame) -> DataFrame:
    """Path, size, modification time and row count of the files behind a file-based frame."""
    files = df.select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
    one = files.groupBy("file_path", "file_name", "file_size", "file_modification_time").agg(F.count(F.lit(1)).alias("rows"))
    stamp = F.concat_ws("|", "file_path", "file_size", "file_modification_time")
    return one.withColumns({"file_id": F.substring(F.sha2(stamp, 256), 1, 16), "status": F.lit("DISCOVERED")})


def missing_feed_columns(df: DataFrame) -> list[str]:
    """Required columns a feed lacks after renaming; reads the schema only."""
    return sorted(set(REQUIRED) - set(normalize_feed_columns(df).columns))


def normalize_feed_columns(df: DataFrame) -> DataFrame:
    """Trim and lower the names, then map the first known alias onto each absent canonical name."""
    df = quality.normalize_columns(df)
    rename = {}
    for target, aliases in ALIASES.items():
        found = next((a for a in aliases if a in df.columns), None)
        if target not in df.columns and found:
            rename[found] = target
    return df.withColumnsRenamed(rename) if rename else df


def typed_feed(df: DataFrame) -> DataFrame:
    """Canonical names and types; nothing is dropped yet."""
    df = require_columns(normalize_feed_columns(df), REQUIRED, "client feed")
    stamp = F.col("date").cast("string")
    return df.withColumns({
        "date": F.coalesce(stamp.try_cast("date"), stamp.try_cast("timestamp").cast("date")),
        "quantity_sold": to_number("quantity_sold"),
        "outlet_id": F.col("outlet_id").cast("string"),
        "product_id": F.col("product_id").cast("string"),
    })


def canonical_feed(df: DataFrame) -> DataFrame:
    """A client feed with complete rows only; one negative quantity refuses the whole feed, before any row is handed out."""
    rows = typed_feed(df).dropna(subset=list(REQUIRED))
    return admission.admit(rows, {"negative quantity_sold": F.col("quantity_sold") < 0}, "client feed", empty=None)


def daily_grain(df: DataFrame) -> DataFrame:
    """One row per series and day; sums repeated rows, partially before the shuffle."""
    return df.groupBy(*FEED_KEY).agg(F.sum("quantity_sold").alias("quantity_sold"))


# --- JSON requests -----------------------------------------------------------------------------------

REQUEST_SCHEMA = """client_id string, as_of_date string, top_n int, include_normal boolean,
  sales array<struct<date: string, outlet_id: string, product_id: string, quantity_sold: string>>,
  inventory array<struct<outlet_id: string, product_id: string, current_inventory: double, lead_time_days: double,
    safety_stock: double, minimum_order_quantity: double, order_multiple: double, supplier_risk: string>>,
  outlets array<struct<outlet_id: string, outlet_name: string, outlet_type: string, country: string, region: string, city: string>>,
  products array<struct<product_id: string, product_name: string, category: string, unit: string>>"""


def request_tables(df: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """JSON requests, one per row, to tables keyed by client_id.

    `refused` holds the sales rows that are not used, as they came, each with a reason.
    """
    parsed = df.select(F.from_json(column, REQUEST_SCHEMA).alias("request")).select("request.*")
    tables = {name: parsed.select("client_id", F.inline(name)) for name in ("inventory", "outlets", "products")}
    sent = parsed.select("client_id", F.inline("sales"))
    rows = typed_feed(sent.withColumn("_sent", F.struct(*REQUIRED)))
    reason = F.when(F.col("client_id").isNull(), F.lit("NO_CLIENT"))
    for c in REQUIRED:
        reason = reason.when(F.col(c).isNull(), F.lit(f"INVALID_{c.upper()}"))
    rows = rows.withColumn("reason", reason.when(F.col("quantity_sold") < 0, F.lit("NEGATIVE_QUANTITY")))
    tables["refused"] = rows.filter("reason IS NOT NULL").select("client_id", "_sent.*", "reason")
    tables["sales"] = (rows.filter("reason IS NULL").groupBy("client_id", *FEED_KEY)
                           .agg(F.sum("quantity_sold").alias("quantity_sold")))
    return tables


# --- catalogs and reports -------------------------------------------------------------------------------

def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, chosen by an order column so that the choice is repeatable."""
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.min_by(row, order).alias("_row")).select(key, "_row.*")


def outlet_catalog(df: DataFrame, order: str = "outlet_type") -> DataFrame:
    require_columns(df, ["outlet_id", "outlet_type", "country", "region", "city", "location_type"], "outlet catalog")
    return first_by(df.withColumn("outlet_id", F.col("outlet_id").cast("string")), "outlet_id", order)


def product_catalog(df: DataFrame) -> DataFrame:
    name = pick_column(df, ("product_name", "name")) or "product_id"
    one = df.select(
        F.col("product_id").cast("string").alias("product_id"), F.col(name).cast("string").alias("product_name"),
        F.coalesce(column_or(df, "category", None).cast("string"), F.lit("Unknown")).alias("category"),
        F.coalesce(column_or(df, "unit", None).cast("string"), F.lit("units")).alias("unit"))
    return first_by(one, "product_id", "product_name")


def write_report(actions: DataFrame, path: str, report: DataFrame) -> str:
    """Write nested actions as JSON lines, unless the validation report has a violation."""
    broken = [r["rule"] for r in report.filter("violations > 0").collect()]
    if broken:
        raise ValueError(f"the report breaks {broken}")
    actions.write.mode("overwrite").json(path)
    return path


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def process_dataset(spark: SparkSession, base: str, name: str, processed: str) -> str:
    """Load a table, clean it, add date parts and write it to the processed area."""
    df = read_table(spark, base, name).transform(quality.clean).transform(calendar.date_parts)
    return write_table(df, processed, name)

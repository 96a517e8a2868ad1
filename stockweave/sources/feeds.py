"""Client files of any header and accepted format, parsed once.

A file's header or keys are part of its content, so a layout is known only after reading. Instead of
reading twice, every file is read as what it is (CSV lines as cells, JSON lines and parquet rows as
named fields) and stored by column; layouts are then one aggregate per file over the stored rows, and
the canonical columns a lookup in each row. Files are never opened by the driver, and parquet schemas
are merged by Spark's footer job; only where types conflict are files grouped by their schema first.

Defined results: a column counts as present if the header names it (CSV) or some row has a value for it
(JSON, parquet). A quoted CSV cell may hold separators and doubled quotes, not line breaks. A JSON line
that does not parse is a row without values. A blank line is no row.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet", "json")
REQUIRED = ("date", "outlet_id", "product_id", "quantity_sold")

# Accepted client names of the canonical columns.
ALIASES = {
    "date": ("timestamp", "datetime", "sale_date", "sales_date", "transaction_date"),
    "quantity_sold": ("quantity", "qty", "units_sold", "sold_quantity"),
    "outlet_id": ("outlet", "store_id", "restaurant_id", "branch_id"),
    "product_id": ("product", "item_id", "sku", "item"),
}
KNOWN = sorted({*REQUIRED, *(a for names in ALIASES.values() for a in names)})

STAGED = "source_file string, line long, starts boolean, cells array<string>, fields array<struct<name: string, value: string>>"
_SEPARATOR = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'  # outside quotes


def _plain(name: Column) -> Column:
    return F.lower(F.trim(name))


def _staged(df: DataFrame, cells: Column | None = None, fields: Column | None = None) -> DataFrame:
    none = F.lit(None)
    kept = F.filter(fields, lambda f: f["name"].isin(KNOWN) & f["value"].isNotNull()) if fields is not None else none
    return df.select("source_file", (F.col("line") if cells is not None else none).cast("long").alias("line"),
                     (F.col("starts") if cells is not None else F.lit(False)).alias("starts"),
                     (cells if cells is not None else none).cast("array<string>").alias("cells"),
                     kept.cast("array<struct<name: string, value: string>>").alias("fields"))


def _csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.text(paths).select(
        F.regexp_replace("value", "^﻿|\\r$", "").alias("text"), F.col("_metadata.file_path").alias("source_file"),
        (F.col("_metadata.file_block_start") == 0).alias("starts"), F.monotonically_increasing_id().alias("line")).filter("trim(text) <> ''")

    def unquoted(cell: Column) -> Column:
        inner = F.regexp_extract(cell, '^\\s*"(.*)"\\s*$', 1)
        return F.when(cell.rlike('^\\s*".*"\\s*$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)

    quoted = F.transform(F.split("text", _SEPARATOR, -1), unquoted)
    return _staged(lines, cells=F.when(F.contains("text", F.lit('"')), quoted).otherwise(F.split("text", ",", -1)))


def _json(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file")).filter("trim(value) <> ''")
    pairs = F.map_entries(F.from_json("value", "map<string,string>"))
    named = F.transform(pairs, lambda p: F.struct(_plain(p["key"]).alias("name"), p["value"].alias("value")))
    return _staged(lines, fields=F.coalesce(named, F.array().cast("array<struct<name: string, value: string>>")))


def _parquet(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    def rows(df: DataFrame) -> DataFrame:
        known = [c for c in df.columns if c.strip().lower() in KNOWN]
        named = [F.struct(F.lit(c.strip().lower()).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in known]
        empty = F.array().cast("array<struct<name: string, value: string>>")
        return _staged(df.withColumn("source_file", F.col("_metadata.file_path")), fields=F.array(*named) if named else empty)

    try:
        return [rows(spark.read.option("mergeSchema", True).parquet(*paths))]
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    with ThreadPoolExecutor(16) as pool:
        schemas = list(pool.map(lambda path: tuple(spark.read.parquet(path).dtypes), paths))
    groups: dict[tuple, list[str]] = {}
    for schema, path in zip(schemas, paths):
        groups.setdefault(schema, []).append(path)
    return [rows(spark.read.parquet(*group)) for group in groups.values()]


def stage(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The content of client files, as read; columns are those of STAGED. Store it before it is used."""
    by_format: dict[str, list[str]] = {}
    for path in paths:
        by_format.setdefault(path.rsplit(".", 1)[-1].lower(), []).append(path)
    unknown = set(by_format) - set(FORMATS)
    if unknown:
        raise ValueError(f"unsupported file types {sorted(unknown)}")
    frames = []
    if "csv" in by_format:
        frames.append(_csv(spark, by_format["csv"]))
    if "json" in by_format:
        frames.append(_json(spark, by_format["json"]))
    if "parquet" in by_format:
        frames += _parquet(spark, by_format["parquet"])
    if not frames:
        raise ValueError("no file to read")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def layouts(staged: DataFrame) -> DataFrame:
    """One row per file: its header line, the name used for each canonical column and its place, the columns it lacks."""
    header = F.col("starts") & F.col("cells").isNotNull()
    one = staged.groupBy("source_file").agg(
        F.min_by(F.when(header, F.col("cells")), F.when(header, F.col("line"))).alias("header"), F.min(F.when(header, F.col("line"))).alias("header_line"),
        F.array_distinct(F.flatten(F.collect_set(F.transform("fields", lambda f: f["name"])))).alias("keys"))
    one = one.withColumn("names", F.coalesce(F.transform("header", _plain), "keys"))
    for target in REQUIRED:
        choice = F.coalesce(*[F.when(F.array_contains("names", n), F.lit(n)) for n in (target, *ALIASES[target])])
        one = one.withColumn(f"use_{target}", choice).withColumn(f"at_{target}", F.array_position("names", F.col(f"use_{target}")))
    lacking = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"use_{t}").isNull(), F.lit(t)) for t in REQUIRED])))
    return one.withColumn("missing_columns", F.concat_ws(",", lacking)).drop("header", "keys", "names")


def canonical(staged: DataFrame, by_file: DataFrame) -> DataFrame:
    """Rows in the canonical columns as text, with source_file and the columns their file lacks."""
    rows = staged.join(by_file, "source_file").filter("header_line IS NULL OR line IS NULL OR line <> header_line")

    def value(target: str) -> Column:
        named = F.get(F.filter("fields", lambda f: f["name"] == F.col(f"use_{target}")), F.lit(0))["value"]
        cell = F.get("cells", (F.col(f"at_{target}") - 1).cast("int"))
        return F.nullif(F.when(F.col("cells").isNotNull(), cell).otherwise(named), F.lit("")).alias(target)

    return rows.select(*[value(t) for t in REQUIRED], "source_file", "missing_columns")

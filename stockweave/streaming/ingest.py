"""Streaming ingest of client files.

Files that land in a folder are parsed once into canonical rows (`sources.feeds`); a file with a
negative quantity, without a required column or without a usable row is quarantined as a whole. A
micro-batch writes its rows once, partitioned by the verdict of their file, a sufficiency row, and at
last its manifest, one row per file. All lie in folders named after the batch, so a batch that is run
again after a failure replaces its own output, and a batch without a manifest is not seen by readers.
The checkpoint replaces the moving of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import count_where
from ..operators import quality
from ..plans.lineage import delete
from ..sources import feeds, readers


def feed_stream(spark: SparkSession, incoming: str, max_files: int = 1000) -> DataFrame:
    """Names, sizes and times of arriving csv, json and parquet files, in subfolders too; batches read their content.

    Files without a byte are passed over.
    Client files differ in header and format, which one streaming schema cannot express.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{csv,json,parquet}")
            .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(incoming)
            .select("path", F.col("_metadata.file_path").alias("source_file"), "length", "modificationTime"))


def judge(files: DataFrame, by_file: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest: per file its id, size and time, rows, usable and negative rows, verdict and reason."""
    typed = readers.typed_feed(rows)
    complete = F.lit(True)
    for c in readers.REQUIRED:
        complete = complete & F.col(c).isNotNull()
    counts = typed.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), count_where(complete).alias("usable_rows"),
                                              count_where(F.col("quantity_sold") < 0).alias("negative_rows"))
    one = (files.select("source_file", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
           .join(by_file.select("source_file", "missing_columns"), "source_file", "left").join(counts, "source_file", "left")
           .fillna(0, ["rows", "usable_rows", "negative_rows"]))
    reason = (F.when(F.col("missing_columns") != "", F.concat(F.lit("MISSING_COLUMNS:"), "missing_columns"))
               .when(F.col("usable_rows") == 0, "NO_VALID_ROWS")
               .when(F.col("negative_rows") > 0, "NEGATIVE_QUANTITY"))
    stamp = F.concat_ws("|", "source_file", "size_bytes", "modified_at")
    return one.withColumns({"file_id": F.substring(F.sha2(stamp, 256), 1, 16), "reason": reason,
                            "status": F.when(reason.isNull(), "PROCESSED").otherwise("REJECTED")})


def write_batch(files: DataFrame, batch: int, target: str, minimum_rows: int = 1000) -> None:
    """Rows of one micro-batch by verdict, then its sufficiency row, then its manifest."""
    spark = files.sparkSession
    listed = files.collect()  # at most maxFilesPerTrigger names
    if not listed:
        return
    named = F.broadcast(spark.createDataFrame(listed, files.schema))
    paths = [r["path"] for r in listed]
    staged_path, schema = f"{target}/staged/batch={batch}", feeds.STAGED
    feeds.stage(spark, paths).write.mode("overwrite").parquet(staged_path)
    staged = spark.read.schema(schema).parquet(staged_path)
    by_file = F.broadcast(feeds.layouts(staged))  # one row per file, as the manifest
    judged_path = f"{target}/judged/batch={batch}"
    judge(named, by_file, feeds.canonical(staged, by_file)).write.mode("overwrite").parquet(judged_path)
    verdict = spark.read.parquet(judged_path)
    rows = feeds.canonical(staged, by_file).join(F.broadcast(verdict.select("source_file", "status", "reason")), "source_file")
    rows.write.mode("overwrite").partitionBy("status").parquet(f"{target}/rows/batch={batch}")
    accepted = _accepted(spark.read.schema(f"{_ROWS}, status string").parquet(f"{target}/rows/batch={batch}"))
    quality.sufficiency(accepted, minimum_rows).write.mode("overwrite").parquet(f"{target}/sufficiency/batch={batch}")
    verdict.write.mode("overwrite").parquet(f"{target}/manifest/batch={batch}")
    delete(spark, staged_path)
    delete(spark, judged_path)


_ROWS = "date string, outlet_id string, product_id string, quantity_sold string, source_file string, missing_columns string, reason string"


def _accepted(rows: DataFrame) -> DataFrame:
    return readers.typed_feed(rows.filter("status = 'PROCESSED'")).dropna(subset=list(readers.REQUIRED))


def start_ingest(spark: SparkSession, incoming: str, target: str, checkpoint: str, minimum_rows: int = 1000,
                 max_files: int = 1000) -> StreamingQuery:
    """Process everything that waits in `incoming`, then stop; run it again for new files."""
    return (feed_stream(spark, incoming, max_files).writeStream
            .foreachBatch(lambda files, batch: write_batch(files, batch, target, minimum_rows))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def manifest_table(spark: SparkSession, target: str) -> DataFrame:
    """Every file that was judged, with its batch."""
    return spark.read.parquet(f"{target}/manifest")


def _committed(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the batches that have a manifest."""
    rows = spark.read.schema(f"{_ROWS}, batch long, status string").parquet(f"{target}/rows")
    done = manifest_table(spark, target).select(F.col("batch").cast("long").alias("batch")).distinct()
    return rows.join(done, "batch", "left_semi")


def quarantine_table(spark: SparkSession, target: str) -> DataFrame:
    """The rows of rejected files as they came, with the reason."""
    return _committed(spark, target).filter("status = 'REJECTED'").select(*readers.REQUIRED, "source_file", "reason", "batch")


def sufficiency_table(spark: SparkSession, target: str) -> DataFrame:
    done = manifest_table(spark, target).select("batch").distinct()
    return spark.read.parquet(f"{target}/sufficiency").join(done, "batch", "left_semi")


def sales_rows(spark: SparkSession, target: str) -> DataFrame:
    """All accepted rows, typed, as they came."""
    return _accepted(_committed(spark, target))


def sales_table(spark: SparkSession, target: str) -> DataFrame:
    """All accepted rows, one per series and day."""
    return readers.daily_grain(sales_rows(spark, target))

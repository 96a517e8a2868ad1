"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, ship_code

__all__ = ["BROADCAST_ROWS", "cut", "ship", "sized", "table", "text_or_empty"]

# A table of a few long columns below this count takes some ten megabytes; larger ones are shuffled.
BROADCAST_ROWS = 500_000


BATCH_ROWS, BATCH_BYTES = 1000, "4m"  # of an Arrow batch: whichever is reached first ends it, so long texts come in short batches


def ship(spark: SparkSession) -> None:
    """Bound Arrow batches, and make this package importable on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship_code(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow stored table as a join side: broadcast if its counted rows are few, else left to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))

"""Session settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Series windows cost far more CPU per byte than a scan, so adaptive execution may keep small
# shuffle partitions apart (the default merges everything below 1 MB of compressed data).
# Large shuffles are sized by the advisory size as usual; skewed joins are split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder

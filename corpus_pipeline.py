"""A corpus pipeline: language, near-duplicates, benchmark passages, secrets, packing.

Every stage takes all rows its predecessor kept and returns them in the columns of `documents`,
the last one the packed pieces. A stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import decontaminate as benchmark
from stockweave.llm import langid, minhash, packing, secretscan
from stockweave.llm.common import cut, ship, table

ORACLE_SQL = None  # the fitted language model and the signatures are beyond SQL; see tests/llm


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; without a letter there is none."""
    ship(spark)
    return langid.with_language(docs).filter("lang_pred <> 'und'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return minhash.keep_one(docs, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is near a benchmark item."""
    return benchmark.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows the text."""
    ship(spark)
    return secretscan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, as pieces of documents."""
    ship(spark)
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontaminate),
          ("secret_scan", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    *first, last = STAGES
    for _name, stage in first:
        docs = cut(stage(spark, docs, sf_dir))
    return last[1](spark, docs, sf_dir)

"""Queries over the test tables, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, htmltext, langid, minhash, nra, packing, ppm, secretscan, sharding, urlfilter, vectors, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_simhash_windows(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


@query
def op3_tag_path_ratios(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_virtual_slots(spark, sf_dir):
    rows, _map = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"))


RULES = [urlfilter.Rule("allow", "org/"), urlfilter.Rule("block", "example.org/es/"), urlfilter.Rule("block", "example.org/en/1"),
         urlfilter.Rule("allow", "com/fr/"), urlfilter.Rule("block", "com/de/")]


@query
def op5_url_language_models(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select(
        "page_id", "host", "path", "rule", "verdict", "score")


@query
def op6_superminhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


@query
def op7_hyperplane_tables(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_language_hierarchy(spark, sf_dir):
    docs = langid.with_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op9_randomness_battery(spark, sf_dir):
    docs = secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.size(secretscan.of_kind("spans", kind)).cast("long").alias(f"n_{kind}") for kind in secretscan.KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return docs.select("doc_id", *count[:3], F.sha2(secretscan.written(base), 256).alias("base_sha256"),
                       secretscan.written(F.col("spans")).alias("spans"))


@query
def op10_warc_derivatives(spark, sf_dir):
    rows = warc.derive(warc.responses_of(table(spark, sf_dir, "pages")), key="page_id")
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest",
                       F.length("block").cast("long").alias("content_length"), F.crc32(warc.serialised()).alias("record_crc32"))


@query
def op11_partial_matching(spark, sf_dir):
    return ppm.score(table(spark, sf_dir, "documents"))


@query
def op12_shared_cuts(spark, sf_dir):
    return alignment.compare(table(spark, sf_dir, "documents"))


@query
def op13_no_random_access(spark, sf_dir):
    return nra.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# the same ranking by scoring every document that shares a term
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLES["op13_no_random_access"] = f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
                              * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length)))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id) CROSS JOIN whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50"""

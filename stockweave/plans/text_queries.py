"""Queries: text signals and multimodal fusion over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_features
from ..sources import demand_tables as src
from .registry import cte, query

cte("tokens", r"""
SELECT doc_id, text, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s\-]', ' ', 'g'), '\s+'),
  lambda w: w <> '') AS t, n_chars FROM documents""")


def _hits(terms) -> str:
    return f"len(list_filter(t, lambda w: w IN ({', '.join(repr(x) for x in terms)})))"


_COUNTS = ", ".join(f"{_hits(terms)} AS c_{name}" for name, terms in text_features.SIGNALS.items())
cte("counted", f"""
SELECT doc_id, n_chars, len(t) AS n, len(list_distinct(t)) AS u, length(coalesce(text, '')) AS text_length, greatest(len(t), 1) AS size,
  {_hits(text_features.INTENSITY)} AS intense, {_COUNTS} FROM tokens""", "tokens")
_ACTIVE = " + ".join(f"CAST(c_{name} > 0 AS INTEGER)" for name in text_features.SIGNALS)
_SIGNALS = ", ".join(f"c_{n} AS text_{n}_count, least(c_{n} / size * 10.0, 1.0) AS text_{n}_score, CAST(c_{n} > 0 AS INTEGER) AS text_has_{n}"
                     for n in text_features.SIGNALS)
cte("signals_text", f"""
SELECT *, n AS text_token_count, u AS text_unique_token_count, u / size AS text_vocabulary_density, {_SIGNALS},
  least(intense / size * 10.0, 1.0) AS text_intensity, {_ACTIVE} AS text_context_count, ({_ACTIVE}) / 14.0 AS text_context_density,
  CASE WHEN n > 0 THEN least(0.6 * least(n / 20.0, 1.0) + 0.4 * u / size, 1.0) ELSE 0.0 END AS text_quality
FROM counted""", "counted")

BASE = "text_token_count:6 text_unique_token_count:6 text_length:6 text_vocabulary_density:6 "
SPEC = BASE + " ".join(f"text_{n}_count:6 text_{n}_score:6 text_has_{n}:6" for n in text_features.SIGNALS) + \
    " text_intensity:6 text_context_count:6 text_context_density:6 text_quality:6"


def documents(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", "text", "n_chars")


@query("text_tokens", "doc_id:i tokens:i first last", """
SELECT doc_id, len(t) AS tokens, coalesce(t[1], '') AS first, coalesce(t[-1], '') AS last FROM tokens""", "tokens")
def _(spark, sf):
    tokens = documents(spark, sf).withColumn("t", text_features.tokenize("text"))
    return tokens.select("doc_id", F.size("t").alias("tokens"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"),
                         F.coalesce(F.try_element_at("t", F.lit(-1)), F.lit("")).alias("last"))


@query("text_features", f"doc_id:i {SPEC}", "SELECT * FROM signals_text", "signals_text")
def _(spark, sf):
    return text_features.text_features(documents(spark, sf))


@query("text_quality", "doc_id:i text_quality:6", "SELECT * FROM signals_text", "signals_text")
def _(spark, sf):
    return text_features.text_features(documents(spark, sf))


# Every third document comes without text, and length in thousands plays the demand.
def fused(spark, sf):
    df = text_features.text_features(documents(spark, sf)).withColumn("demand", F.col("n_chars") / 1000.0)
    text = ["text_context_density", "text_promotion_score", "text_event_score", "text_weather_score", "text_token_count"]
    return text_features.fuse(df, ["demand", "prediction"], text, text_available=F.col("doc_id") % 3 != 0)


@query("multimodal_fusion", "doc_id:i mm_numeric_demand:6 mm_text_text_token_count:6 mm_has_text:6 mm_modality_count:6 mm_text_quality:6 "
       "mm_text_numeric_interaction:6 mm_promotion_numeric_interaction:6 mm_event_numeric_interaction:6 "
       "mm_weather_numeric_interaction:6 mm_fusion_score:6 mm_quality_score:6", """
SELECT doc_id, n_chars / 1000.0 AS mm_numeric_demand, h * n AS mm_text_text_token_count, h AS mm_has_text, 1 + h AS mm_modality_count,
  h * text_quality AS mm_text_quality, h * text_context_density * n_chars / 1000.0 AS mm_text_numeric_interaction,
  h * text_promotion_score * n_chars / 1000.0 AS mm_promotion_numeric_interaction,
  h * text_event_score * n_chars / 1000.0 AS mm_event_numeric_interaction,
  h * text_weather_score * n_chars / 1000.0 AS mm_weather_numeric_interaction,
  (0.5 + 0.25 * h) * (0.5 + 0.25 * h * text_quality) / (0.5 + 0.25 * h) AS mm_fusion_score,
  (0.5 + 0.25 * h * text_quality) / (0.5 + 0.25 * h) AS mm_quality_score
FROM (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END AS h FROM signals_text) a""", "signals_text")
def _(spark, sf):
    return fused(spark, sf)

"""URL filter: rules first, then a ratio of two character language models.

The rules name hosts (with all their subdomains) and path prefixes; the longest fitting one
decides. The URLs that rules accept and reject train two smoothed Markov models of variable order
over the characters of host and path: the chance of a character mixes those of all context lengths
from none to `order`, each context trusted by how often it was seen and how many different
characters followed it (Witten-Bell). A URL without a rule is judged by the difference of the two
log-likelihoods per character, against a threshold that is calibrated on a fifth of the labelled
URLs which no model has seen: the one with the best mean of both classes' hit rates.

All counts are exact and have no limit. A character with its longest context is one n-gram, and the
shorter contexts of a character are the ends of that n-gram, so one table of the different n-grams of
all URLs, with their counts among the labelled ones, holds both models. It is stored and grows with the
input; order by order, each n-gram is joined with the one without its first character, which gives
every n-gram its chance. A URL's score is the sum over its n-grams, looked up in that table by a join.
Sums are of whole numbers (nats in steps of 2^-32), so they do not depend on the order of rows. After
the threshold is found, URLs are scored by models of all labelled URLs, the calibration's included.
A few rows with the calibration's histogram are all that reaches the driver.

Defined results: a null URL or one without `://` has empty host and path and fits no rule; an
empty string has no likelihood and is allowed; if one class has no labelled URL, everything
without a rule is allowed; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sized

ORDER = 5
SLOT_BITS = 18  # of `Markov`, which `judge` does not use
BINS, REACH = 4000, 10.0  # histogram of scores in nats a character
STEPS = float(1 << 32)  # of a nat in stored scores


@dataclass(frozen=True)
class Rule:
    """`rule` is a host, a slash and the rest of a path prefix, such as `example.org/es/`."""

    verdict: str
    rule: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, rest = self.rule.partition("/")
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Columns host, path, rule and rule_verdict beside those of pages (which they replace)."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "rule_verdict")]
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    longest = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(longest):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def _grams(text: str, order: int) -> list[np.ndarray]:
    """For each context length 0..order: the hashes of context and next character, aligned by next character."""
    codes = np.frombuffer((chr(2) * order + text + chr(3)).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - order
    out = []
    for k in range(order + 1):
        context = np.full(n, k + 1, np.uint32)
        for i in range(order - k, order):
            context = (context ^ codes[i: i + n]) * np.uint32(0x01000193)
            context ^= context >> np.uint32(13)
        whole = (context ^ codes[order:] ^ np.uint32(0xABCD0000)) * np.uint32(0x85EBCA6B)
        out.append(context)
        out.append(whole ^ whole >> np.uint32(15))
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)


class Markov:
    """Counts of one class in hashed slots, for a few texts in memory: n-grams, contexts, and different n-grams of a context."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.grams, self.contexts, self.followers = (np.zeros(1 << SLOT_BITS, np.float32) for _ in range(3))

    def log_likelihood(self, grams: list[np.ndarray]) -> float:
        p = 1 / 256
        for k in range(self.order + 1):
            context, gram = _slots(grams[2 * k]), _slots(grams[2 * k + 1])
            seen, kinds = self.contexts[context], self.followers[context]
            p = np.where(seen > 0, (self.grams[gram] + kinds * p) / np.maximum(seen + kinds, 1), p)
        return float(np.log(p).sum())


MODELS = ("first_allow", "first_block", "allow", "block")  # the first two have not seen the calibration's URLs


def _ngrams(order: int) -> Column:
    """Every character of `text` and its end, each with the `order` characters before it."""
    padded = F.concat(F.lit(chr(2) * order), F.col("text"), F.lit(chr(3)))
    return F.explode(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))."), F.lit(1))).alias("gram")


def _texts(ruled: DataFrame) -> DataFrame:
    """The different texts (host and path) with verdict of the rules, number of rows, and whether they calibrate."""
    rows = ruled.select(F.concat("host", "path").alias("text"), F.col("rule_verdict").alias("verdict")).filter("text <> ''")
    return rows.groupBy("text").agg(F.max("verdict").alias("verdict"), F.count(F.lit(1)).alias("n")).select(
        "*", _key(F.col("text")).alias("key"), (F.crc32("text") % 5 == 0).alias("apart"))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def ngram_scores(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Each n-gram of the texts with `first` and `score`: log-chance of allow less that of block, in STEPS."""
    def counted(verdict: str, all_rows: bool) -> Column:
        fits = F.col("verdict") == verdict
        return F.sum(F.when(fits if all_rows else fits & ~F.col("apart"), F.col("n")).otherwise(0))

    longest = (texts.select("verdict", "apart", "n", _ngrams(order))
               .groupBy("gram").agg(*[counted(m.removeprefix("first_"), m in ("allow", "block")).alias(m) for m in MODELS]))
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.right("gram", k))).alias("gram")
    grams = longest.select(ends, *MODELS).groupBy("gram").agg(*[F.sum(m).alias(m) for m in MODELS])
    context = Window.partitionBy(F.expr("left(gram, length(gram) - 1)"))
    grams = cut(grams.select("gram", F.length("gram").alias("size"), *MODELS, *[F.sum(m).over(context).alias(f"{m}_seen") for m in MODELS],
                             *[F.count_if(F.col(m) > 0).over(context).alias(f"{m}_kinds") for m in MODELS]))
    found = None
    for size in range(1, order + 2):
        level = grams.filter(F.col("size") == size)
        if found is not None:
            level = level.withColumn("end", F.right("gram", F.lit(size - 1))).join(
                found.withColumnRenamed("gram", "end"), "end")  # every end is an n-gram of the table itself
        def chance(m: str) -> Column:
            below = F.lit(1 / 256) if size == 1 else F.col(f"{m}_p")
            n, seen, kinds = F.col(m), F.col(f"{m}_seen"), F.col(f"{m}_kinds")
            return F.when(seen > 0, (n + kinds * below) / (seen + kinds)).otherwise(below)

        found = level.select("gram", *[chance(m).alias(f"{m}_p") for m in MODELS])

    def steps(allow: str, block: str) -> Column:
        return F.round((F.log(F.col(f"{allow}_p")) - F.log(F.col(f"{block}_p"))) * STEPS).cast("long")

    return cut(found.select("gram", steps("first_allow", "first_block").alias("first"), steps("allow", "block").alias("score")))


def _threshold(scored: DataFrame) -> float:
    """The cut with the best mean of both classes' hit rates, from `first` of the labelled rows; 0 unless both classes have some."""
    step = BINS / (2 * REACH)
    place = F.least(F.greatest(F.floor((F.col("first") + REACH) * step), F.lit(0)), F.lit(BINS - 1)).cast("int")
    histogram = {v: np.zeros(BINS) for v in ("allow", "block")}
    for r in scored.filter("verdict is not null").groupBy("verdict", place.alias("bin")).agg(F.sum("n").alias("n")).collect():
        histogram[r["verdict"]][r["bin"]] = r["n"]
    if not all(h.sum() for h in histogram.values()):
        return 0.0
    hits = 1 - np.cumsum(histogram["allow"]) / histogram["allow"].sum() + np.cumsum(histogram["block"]) / histogram["block"].sum()
    best = np.flatnonzero(hits >= hits.max() - 1e-12)
    return (float(best[len(best) // 2]) + 1) / step - REACH


def judge(pages: DataFrame, rules: Sequence[Rule], order: int = ORDER) -> DataFrame:
    """Columns host, path, rule, verdict and score (null where a rule decides) beside those of pages."""
    ruled = with_rules(pages, rules)
    kept = [c for c in ruled.columns if c not in ("rule_verdict", "verdict", "score", "text")]
    texts = cut(_texts(ruled))
    classes = {(r["verdict"], r["apart"]) for r in texts.select("verdict", "apart").distinct().collect()}
    if not {"allow", "block"} <= {v for v, _ in classes}:
        return ruled.select(*kept, F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    mean = [(F.sum(c) / F.count(F.lit(1)) / STEPS).alias(c) for c in ("first", "score")]  # nats a character, the end included
    scored = cut(texts.filter("verdict is null or apart").select("key", "verdict", "n", _ngrams(order))
                 .join(sized(ngram_scores(texts, order)), "gram").groupBy("key", "verdict", "n").agg(*mean))
    trained = {("allow", False), ("block", False)} <= classes
    threshold = _threshold(scored) if trained else 0.0
    empty = (F.col("host") == "") & (F.col("path") == "")
    found = scored.filter("verdict is null").select(F.col("key").alias("_key"), F.col("score").alias("_score"))
    rows = ruled.select(*kept, "rule_verdict", _key(F.concat("host", "path")).alias("_key")).join(sized(found), "_key", "left")
    score = F.when(F.col("rule_verdict").isNull(), F.when(empty, 0.0).otherwise(F.col("_score")))
    fine = empty | (F.col("_score") >= threshold)
    return rows.select(*kept, F.coalesce("rule_verdict", F.when(fine, "allow").otherwise("block")).alias("verdict"), score.alias("score"))

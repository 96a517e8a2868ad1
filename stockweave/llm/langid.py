"""Language identification by hierarchical discrimination: the family first, then its languages.

A text is a vector of hashed byte n-grams (one to four bytes) of its lower-cased letters; the
square roots of their shares have length one. A multinomial logistic regression tells families
apart; inside a family one linear support vector machine for each two languages votes, and ties
go to the larger sum of margins. Both are fitted with Spark ML on a sample of labelled rows whose
bound is a parameter. The fitted weights are a few dense rows and go to the tasks with the code;
the whole table is judged in one pass without a shuffle.

The score is the family's probability times the logistic of the smallest margin with which the
language won its votes (the family's probability alone if it has one language).

Defined results: null text, no letter, or nothing to learn from gives `und` with score 0; texts
of any length are used whole; an empty table gives no rows; a null doc_id counts as the empty
string for the split. `lang`, `source` and `doc_id` never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SLOTS = 1 << 12
SAMPLE = 400  # labelled rows per language that a model is fitted on

# ISO 639-1 codes by family. A language not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.arange(256, dtype=np.uint8)  # lower-cased ASCII letters and the bytes of other characters; else a space
_KEEP[[b for b in range(128) if not chr(b).isalpha()]] = 32
_KEEP = _KEEP.tobytes()


def features(text: str) -> np.ndarray:
    """The vector of a text; n-grams do not go over more than one space."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_KEEP) + b" ", np.uint8)
    blank = b == 32
    b = b[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    counts = np.zeros(SLOTS, np.int64)
    gram = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        gram = gram[: len(b) - n + 1] * np.uint32(257) + b[n - 1:] + np.uint32(1)
        slot = gram * np.uint32(0x9E3779B1)
        slot ^= slot >> np.uint32(15)
        counts += np.bincount((slot * np.uint32(0x85EBCA77)) >> np.uint32(20), minlength=SLOTS)
    return np.sqrt(counts / max(1, counts.sum()))


@dataclass(frozen=True)
class Model:
    """Weights have one row a class or pair; the last column is the intercept."""

    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not _LETTER.search(text):
            return "und", 0.0
        x = np.append(features(text), 1.0)
        z = self.family_weights @ x
        z = np.exp(z - z.max())
        best = int(z.argmax())
        score, family = float(z[best] / z.sum()), self.families[best]
        languages = self.languages[family]
        if len(languages) == 1:
            return languages[0], score
        margins = self.pair_weights[family] @ x
        votes, sums = np.zeros(len(languages)), np.zeros(len(languages))
        least = np.full(len(languages), np.inf)
        for (i, j), m in zip(self.pairs[family], margins):  # a positive margin speaks for j
            votes[j if m > 0 else i] += 1
            sums[j] += m
            sums[i] -= m
            least[j], least[i] = min(least[j], m), min(least[i], -m)
        won = max(range(len(languages)), key=lambda k: (votes[k], sums[k]))
        return languages[won], score / (1 + float(np.exp(-4 * np.clip(least[won], -50, 50))))


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """About `sample` different texts of each language, at most 1.5 times as many: those with the smallest salted hashes."""
    hashed = labelled.select("lang", "text", F.xxhash64("text").alias("h"))
    distinct = cut(hashed.select("lang", "h").distinct())
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return labelled.limit(0)
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, sample / n))])
    salted = F.xxhash64("h", F.lit(17))
    draw = F.pmod(salted, F.lit(1 << 30)) / float(1 << 30)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "h"))  # over about `sample` rows a language
    chosen = (distinct.withColumn("draw", draw).filter(F.col("draw") < F.element_at(share, F.col("lang")))
              .withColumn("place", place).filter(F.col("place") <= sample + sample // 2).select("lang", "h"))
    return hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(
        F.first("text").alias("text")).select("lang", "text")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.list_(pa.float64()))], names=["lang", "x"])


def fit(labelled: DataFrame, families: Mapping[str, str] = FAMILIES, sample: int = SAMPLE, iterations: int = 20) -> Model:
    """A model from the columns text and lang; rows without a label or a letter are left out.

    Equal texts count once. `sample` bounds the rows per language that the fit holds.
    """
    rows = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).filter(
        "lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    rows = cut(_sampled(rows, sample).mapInArrow(_vectors, "lang string, x array<double>"))
    known = sorted(r[0] for r in rows.select("lang").distinct().collect())
    by_family: dict[str, list[str]] = {}
    for lang in known:
        by_family.setdefault(families.get(lang, lang), []).append(lang)
    names = sorted(by_family)
    if not names:
        return Model([], np.zeros((0, SLOTS + 1)), {}, {}, {})
    vectors = rows.select("lang", array_to_vector("x").alias("features")).cache()

    def with_label(df: DataFrame, label: Mapping[str, int]) -> DataFrame:
        pairs = F.create_map(*[F.lit(v) for lang, k in label.items() for v in (lang, float(k))])
        return df.withColumn("label", F.element_at(pairs, F.col("lang")))

    family_weights = np.zeros((1, SLOTS + 1))
    if len(names) > 1:
        label = {lang: k for k, name in enumerate(names) for lang in by_family[name]}
        fitted = LogisticRegression(regParam=1e-4, maxIter=iterations, family="multinomial", standardization=False).fit(
            with_label(vectors, label))
        family_weights = np.column_stack((fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()))
    pairs, pair_weights = {}, {}
    for name, languages in by_family.items():
        pairs[name] = list(combinations(range(len(languages)), 2))
        each = []
        for i, j in pairs[name]:
            two = with_label(vectors.filter(F.col("lang").isin(languages[i], languages[j])), {languages[i]: 0, languages[j]: 1})
            svm = LinearSVC(regParam=1e-4, maxIter=iterations, standardization=False).fit(two)
            each.append(np.append(svm.coefficients.toArray(), svm.intercept))
        pair_weights[name] = np.array(each).reshape(len(each), SLOTS + 1)
    vectors.unpersist()
    return Model(names, family_weights, by_family, pairs, pair_weights)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and lang_pred and score; columns of these names are replaced."""

    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang", "score"])

    judge = F.pandas_udf(judged, "lang string, score double")
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "_judged")]
    return docs.select(*rest, judge(F.col("text").cast("string")).alias("_judged")).select(
        *rest, F.col("_judged.lang").alias("lang_pred"), F.col("_judged.score").alias("score"))


def held_out(doc_id: str = "doc_id"):
    """Rows of the held-out quarter: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def with_language(docs: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows of docs outside the held-out quarter and judge all of them."""
    return identify(docs, fit(docs.filter(~held_out()), **options))

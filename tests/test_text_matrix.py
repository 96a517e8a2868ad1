"""The reduced term matrix against a full decomposition of the same weights."""

from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.operators.text_matrix import TextMatrix, _counts


def test_axes_equal_a_full_decomposition(spark):
    rng = np.random.default_rng(3)
    topics = ["rain storm cold wind", "price sale offer cheap", "game match goal team", "bread milk cheese tea"]
    texts = [" ".join(rng.choice(topics[i % 4].split(), 4 + 5 * (i % 4))) for i in range(80)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], texts[0]])] + [(900, None), (901, ""), (902, "unseen words")]
    frame = spark.createDataFrame(rows, "id long, text string").withColumn("key", F.lit("clash"))
    fitted = TextMatrix.fit(frame.filter("id < 900"), "text", extra=8, turns=12)
    made = fitted.transform(frame, "text")
    assert made.columns == ["id", "text", "key", "text_0", "text_1", "text_2", "text_3"]
    got = {r.id: [r[f"text_{d}"] for d in range(4)] for r in made.collect()}

    terms = [Counter((w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:])]) for _, t in rows if t and t != "unseen words"]
    names = sorted(set().union(*terms))
    seen = Counter(n for t in terms for n in t)
    x = np.array([[(1 + log(t[n])) * log((len(terms) + 1) / (seen[n] + 1)) if n in t else 0.0 for n in names] for t in terms])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert fitted.captured == pytest.approx((s[:4] ** 2 / (s**2).sum()).tolist(), rel=1e-4)
    places = np.array([got[i] for i in range(82)])
    assert np.allclose(np.abs(places.T @ u[:, :4] / s[:4]), np.eye(4), atol=0.02)
    axes = np.array([r.axis for r in fitted.places.collect()])
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-9)
    assert got[900] == got[901] == got[902] == [0.0] * 4 and len(got) == len(rows)


def test_no_training_texts(spark):
    frame = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    made = TextMatrix.fit(frame, "text").transform(frame, "text").collect()
    assert [r.text_3 for r in made] == [0.0, 0.0]


def test_texts_are_not_shuffled(spark):
    frame = spark.createDataFrame([(i, f"rain {i % 7} storm {i % 5}") for i in range(60)], "id long, text string")
    fitted = TextMatrix.fit(frame, "text")
    shown = [df._jdf.queryExecution().executedPlan().toString() for df in (_counts(frame, "text", 1 << 10), fitted.transform(frame, "text"))]
    assert not any("Exchange" in plan for plan in shown)
    assert fitted.transform(frame.unionAll(frame), "text").distinct().count() == 60  # repeated rows lie at one place

"""TF-IDF of one- and two-word terms, reduced to a few dimensions by a randomised range finder.

Terms are hashed into 2^18 slots and stay sparse: a stored row per text with its slots and their
times. The leading directions come from subspace iteration: random signs for every slot, then in
turn places of texts (a sum over their slots) and places of slots (a sum over their texts), made
orthonormal after each turn. A turn is one pass over the stored rows: a task looks its texts up in
the places of the slots and adds what they give to a table of slots of its own. So nothing is
shuffled but these tables, one a task, and neither they nor the places, which the driver makes
orthonormal and sends out, grow with the texts. Placing a text needs its own row only.

A text without terms, and every text if the training texts have none, lies at 0; so do directions
beyond the matrix's rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sparse
from ..plans.lineage import cut, ship_code
from .text_features import tokenize

SLOTS = 1 << 18  # terms that share a slot are added up
DIMENSIONS = 4
EXTRA, TURNS = 4, 3  # further directions that are followed, and turns of the iteration


def _terms(df: DataFrame, text: str, slots: int) -> DataFrame:
    """The columns of df and `_at`, the slots of all terms of the text."""
    words = df.select("*", tokenize(text).alias("_words"))
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs").transform(words)
    at = F.transform(F.concat("_words", "_pairs"), lambda t: F.pmod(F.xxhash64(t), F.lit(slots)).cast("int"))
    return pairs.select(*df.columns, at.alias("_at"))


def _counts(df: DataFrame, text: str, slots: int) -> DataFrame:
    """A row per text with a term: its different slots and how often it has each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, slot, times = sparse.counted(batch.column("_at"), slots)
            bounds = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            made = [pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32))) for v in (slot, times)]
            yield pa.RecordBatch.from_arrays(made, names=["slots", "times"])

    at = _terms(df.select(text), text, slots).select("_at").filter(F.size("_at") > 0)
    return at.mapInArrow(run, "slots array<int>, times array<int>")


def _texts_with(entries: DataFrame, slots: int) -> DataFrame:
    """A row per slot and task: slot, n (texts that have it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("slots").flatten().to_numpy(zero_copy_only=False), minlength=slots)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found])], names=["slot", "n"])

    return entries.select("slots").mapInArrow(run, "slot int, n long")


def _turned(entries: DataFrame, idf: np.ndarray, z: np.ndarray) -> np.ndarray:
    """New places of the slots: sums over the texts at their places."""
    size, sent = z.shape[1], entries.sparkSession.sparkContext.broadcast((idf, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, z = sent.value
        out = np.zeros((size, len(idf)))
        for batch in batches:
            for rows, owner, slot, times in sparse.stored(batch):
                w = sparse.weights(owner, slot, times, idf, rows)
                y = sparse.row_sums(owner, slot, w, z, rows)[owner]
                for i in range(size):
                    out[i] += np.bincount(slot, w * y[:, i], len(idf))
        found = np.flatnonzero(out.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *[pa.array(v[found]) for v in out]],
                                         names=["slot", *[f"_{i}" for i in range(size)]])

    made = entries.mapInArrow(run, ", ".join(["slot int", *[f"_{i} double" for i in range(size)]]))
    table = made.groupBy("slot").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(size)]).toArrow()
    sent.destroy()
    places = np.zeros_like(z)
    places[table["slot"].to_numpy()] = np.stack([table[f"_{i}"].to_numpy() for i in range(size)], 1)
    return places


def _gram(entries: DataFrame, idf: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, int]:
    """Products of the columns of the texts' places, and the number of texts with a weight."""
    size, sent = z.shape[1], entries.sparkSession.sparkContext.broadcast((idf, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, z = sent.value
        out, n = np.zeros((size, size)), 0
        for batch in batches:
            for rows, owner, slot, times in sparse.stored(batch):
                w = sparse.weights(owner, slot, times, idf, rows)
                y = sparse.row_sums(owner, slot, w, z, rows)
                out += y.T @ y
                n += len(np.unique(owner[w != 0]))
        yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([v]) for v in out.ravel()]], names=["n", *[f"_{i}" for i in range(size * size)]])

    names = [f"_{i}" for i in range(size * size)]
    made = entries.mapInArrow(run, ", ".join(["n long", *[f"{c} double" for c in names]]))
    n, *sums = made.agg(F.sum("n"), *[F.sum(c) for c in names]).first()
    sent.destroy()
    return np.array(sums, float).reshape(size, size), n


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """Places with orthonormal columns; columns without length go."""
    lengths, turned = np.linalg.eigh(z.T @ z)
    live = lengths > 1e-12 * max(lengths.max(), 1e-300)
    return z @ (turned[:, live] / np.sqrt(lengths[live]))


class TextMatrix:
    """Fitted on training texts only: `places` has slot, idf and axis, `captured` the share of the squared length on each axis."""

    def __init__(self, places: DataFrame | None, captured: list[float], slots: int, dimensions: int):
        self.places, self.captured, self.slots, self.dimensions = places, captured, slots, dimensions

    @staticmethod
    def fit(train: DataFrame, text: str, slots: int = SLOTS, dimensions: int = DIMENSIONS, extra: int = EXTRA, turns: int = TURNS) -> "TextMatrix":
        spark = train.sparkSession
        ship_code(spark)
        entries = cut(_counts(train, text, slots))
        n = entries.count()
        if not n:
            return TextMatrix(None, [], slots, dimensions)
        seen = _texts_with(entries, slots).groupBy("slot").agg(F.log(F.lit(n + 1.0) / (F.sum("n") + 1)).alias("idf"))
        seen = seen.withColumn("signs", F.xxhash64(F.lit(17), "slot")).orderBy("slot").toArrow()
        slot = seen["slot"].to_numpy()
        idf = np.zeros(slots)
        idf[slot] = seen["idf"].to_numpy()
        if not idf.any():
            return TextMatrix(None, [], slots, dimensions)
        z = np.zeros((slots, dimensions + extra))
        z[slot] = np.where(seen["signs"].to_numpy()[:, None] >> np.arange(dimensions + extra) & 1, 1.0, -1.0)
        z = _orthonormal(z)
        for _turn in range(turns):
            z = _orthonormal(_turned(entries, idf, z))
        products, total = _gram(entries, idf, z)
        strength, turned = np.linalg.eigh(products)
        kept = np.argsort(-strength)[:dimensions]
        axes = z @ turned[:, kept]
        # An axis points to where its longest component is positive; of equal ones the last slot's counts.
        long = np.round(np.abs(axes[slot]), 9)
        longest = [axes[slot[np.flatnonzero(v == v.max())[-1]], i] for i, v in enumerate(long.T)]
        axes *= np.where(np.array(longest) > 0, 1.0, -1.0)
        table = pa.table({"slot": pa.array(slot), "idf": pa.array(idf[slot]), "axis": pa.array(list(axes[slot]), pa.list_(pa.float64()))})
        return TextMatrix(cut(spark.createDataFrame(table)), [float(s) / total for s in strength[kept]], slots, dimensions)

    def transform(self, df: DataFrame, text: str, prefix: str = "text_") -> DataFrame:
        names = [f"{prefix}{d}" for d in range(self.dimensions)]
        if self.places is None:
            return df.withColumns({name: F.lit(0.0) for name in names})
        ship_code(df.sparkSession)
        found = self.places.toArrow()
        slot, slots = found["slot"].to_numpy(), self.slots
        # A slot that no training text has carries no weight, as it has no place.
        idf, axes = np.zeros(slots), np.zeros((slots, self.dimensions))
        idf[slot] = found["idf"].to_numpy()
        along = np.stack(found["axis"].to_numpy(zero_copy_only=False))
        axes[slot, : along.shape[1]] = along
        sent = df.sparkSession.sparkContext.broadcast((idf, axes))

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            idf, axes = sent.value
            for batch in batches:
                made = []
                for low in range(0, len(batch), sparse.ROWS):
                    part = batch.iloc[low: low + sparse.ROWS]
                    owner, slot, times = sparse.counted(pa.array(part, pa.list_(pa.int32())), slots)
                    made += list(sparse.row_sums(owner, slot, sparse.weights(owner, slot, times, idf, len(part)), axes, len(part)))
                yield pd.Series(made, dtype=object)

        place = F.pandas_udf(run, "array<double>")
        out = _terms(df, text, slots).select(*df.columns, place("_at").alias("_place"))
        return out.select(*df.columns, *[F.get("_place", F.lit(d)).alias(name) for d, name in enumerate(names)])

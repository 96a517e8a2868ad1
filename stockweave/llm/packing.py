"""Packing documents into training sequences by order-preserving dynamic programming.

A partition's documents, in their order, form one stream of token ids. Cuts may fall after a
document (free), after a sentence, or anywhere (dearer). For cut points t_0 < t_1 < ... the cost
of ending a sequence at t_j that began at t_i is its padding plus the price of cutting at t_j:

    F[j] = price[j] + min over i of  F[i] + m * inside + (m + 1) * length - (t_j - t_i)

where m = (t_j - t_i - 1) div length full sequences, cut inside sentences, come first and the last
one is padded. Every sentence end is a cut point and m has no bound, so this is the cheapest of all
ways to cut: what lies between two points is best cut in full sequences. m depends on t_i div length
and on which of t_i and t_j - 1 comes first modulo length only, so the best i is looked up in two
staircases over the remainders, which hold at most `length` points. The stream is packed in chunks; what follows a chunk's
last full sequence is carried into the next one, so only a partition's end is padded: there, the
rest is split into sequences whose lengths are powers of two, which need no padding, where that
is cheaper.

Nothing is shuffled: the text is read once where it lies, and memory is bounded by a chunk and
the longest document. A lost executor's partition is packed again from the same file block with
the same result, and sequence ids are numbered by partition.

Defined results: a null or empty text is the end-of-document id alone; a null doc_id keeps its
pieces under null; repeated rows are packed each; an empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

LENGTH = 1024
SENTENCE, INSIDE = 1.0, 6.0  # prices of a cut, in tokens of padding
CHUNK = 1 << 18


def cut_points(points: np.ndarray, prices: np.ndarray, length: int = LENGTH, inside: float = INSIDE, full: int | None = None) -> list[int]:
    """Ends of the cheapest sequences over the points (ascending, from 0); the last point is the end of the last one.

    Any number of full sequences may stand in a row; `full`, once their most, bounds nothing any more.
    """
    t, price, step = points.tolist(), prices.tolist(), inside + length
    laps, places = ((points - 1) // length).tolist(), ((points - 1) % length).tolist()
    back, best = [0] * len(t), 0.0
    # Two staircases of F[i] + t_i - step * (t_i div length) over t_i mod length: falling values for the
    # points at or before a place of the circle, rising ones for those behind it.
    at_a, value_a, point_a = [], [], []
    at_b, value_b, point_b = [], [], []
    for j in range(len(t)):
        place = places[j]
        if j:
            k = bisect_right(at_a, place) - 1
            best, come = (value_a[k], point_a[k]) if k >= 0 else (float("inf"), 0)
            k = bisect_right(at_b, place)
            if k < len(at_b) and (v := value_b[k] - step, -point_b[k]) < (best, -come):
                best, come = v, point_b[k]
            best += laps[j] * step + length - t[j] + price[j]
            back[j] = come
        at = t[j] % length
        value = best + t[j] - t[j] // length * step
        low = high = bisect_left(at_a, at)
        if not low or value_a[low - 1] >= value:
            while high < len(at_a) and value_a[high] >= value:
                high += 1
            if high > low or low == len(at_a) or at_a[low] > at:
                at_a[low:high], value_a[low:high], point_a[low:high] = [at], [value], [j]
        low = high = bisect_right(at_b, at)
        if high == len(at_b) or value_b[high] >= value:
            while low and value_b[low - 1] >= value:
                low -= 1
            if low < high or not high or at_b[high - 1] < at:
                at_b[low:high], value_b[low:high], point_b[low:high] = [at], [value], [j]
    ends, j = [], len(t) - 1
    while j:
        i = back[j]
        ends += [t[j], *(t[i] + k * length for k in range((t[j] - t[i] - 1) // length, 0, -1))]
        j = i
    return ends[::-1]


def _tail(start: int, end: int, length: int, inside: float) -> list[int]:
    """Ends of the last sequences: one padded, or several whose lengths are powers of two."""
    rest = end - start
    bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    if rest == 0 or length & (length - 1) or (len(bits) - 1) * inside >= length - rest:
        return [end] if rest else []
    return (start + np.cumsum(bits)).tolist()


class _Stream:
    """Documents not yet packed, as one run of ids from position 0."""

    def __init__(self, length: int, sentence: float, inside: float) -> None:
        self.length, self.sentence, self.inside = length, sentence, inside
        self.docs: list[tuple] = []  # (doc_id, first id's place in the document, ids, the document's ids)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.size += len(ids)

    def take(self, enc, last: bool) -> Iterator[list[tuple]]:
        """The pieces of every finished sequence; what is left stays, unless it is the last call."""
        if not self.size:
            return
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        points = np.flatnonzero(enc.ends_sentence[ids[:-1]] & enc.starts_gap[ids[1:]]) + 1
        points = np.union1d(points, ends)
        prices = np.where(np.isin(points, ends), 0.0, self.sentence)
        cuts = cut_points(np.concatenate(([0], points)), np.concatenate(([0.0], prices)), self.length, self.inside)
        cuts = cuts[:-1] + (_tail(cuts[-2] if len(cuts) > 1 else 0, cuts[-1], self.length, self.inside) if last else [])
        d, low = 0, 0
        for high in cuts:
            pieces = []
            while low < high:
                begin = ends[d] - len(self.docs[d][2])
                stop = min(high, ends[d])
                doc_id, first, _, total = self.docs[d]
                pieces.append((doc_id, first + low - begin, ids[low:stop], total))
                low = stop
                d += stop == ends[d]
            yield pieces
        kept = []
        for k in range(d, len(self.docs)):
            doc_id, first, own, total = self.docs[k]
            skip = max(0, low - (ends[k] - len(own)))
            kept.append((doc_id, int(first + skip), own[skip:], total))
        self.docs, self.size = kept, self.size - low


_SCHEMA = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(ranks: str, tokenizer: str, end_id: int, length: int, sentence: float, inside: float, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, tokenizer)
        ending = np.array([end_id], "<u4").tobytes()
        stream, number = _Stream(length, sentence, inside), TaskContext.get().partitionId() << 33
        kind = None

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            cols: list[list] = [[] for _ in range(7)]
            for pieces in stream.take(enc, last):
                offset = 0
                for doc_id, start, ids, total in pieces:
                    for col, v in zip(cols, (doc_id, int(start), len(ids), ids.tobytes(), total, number, offset)):
                        col.append(v)
                    offset += len(ids)
                number += 1
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                stream.add(doc_id, np.frombuffer(enc.encode(text.as_py() or "") + ending, "<u4"))
                if stream.size >= chunk:
                    yield from emit(False)
        if stream.size:
            yield from emit(True)

    return run


def pack(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0,
         length: int = LENGTH, sentence: float = SENTENCE, inside: float = INSIDE, chunk: int = CHUNK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    Pieces are in the order of the packed stream; the ids of a sequence are those of its pieces by offset.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    kind = "long" if kind == "void" else kind
    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pack(ranks, tokenizer, end_id, length, sentence, inside, chunk), _SCHEMA.format(kind))

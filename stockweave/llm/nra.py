"""Ranked lexical search without random access: every document ranked for every item of a query set.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. With
N documents that have a term, L terms in all, n of one document, df and tf: a term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 100 - 50 + (50 n N) div L, and a term
of an item adds its impact w * ((10^9 tf) div (1000 tf + 20 m)), once. All but ln is integer.

One pass over the texts keeps, per document, its length and the query set's terms in it; counts of
the whole table follow from that narrow stored table. Then documents are searched in blocks of at
most BLOCK_POSTINGS postings, as they are stored: in each, the postings of a term form a list sorted
by impact, and every item reads the lists of its terms from the top, `step` entries of each at
first and twice as many each round (`search`). What was read of a document is its lower bound; the
upper bound adds, for every list it was not met in, that list's next impact. A document whose upper
bound is below the k-th best lower bound is out; once an unread document could not get in either,
only those left are kept from what is read. Reading ends when every interval left is closed, so
that membership, ties and scores are exact. The best k of a block are ranked with those of the
others, first within slices of the documents, then all.

The query set goes through in parts of at most PART_TERMS (item, term) pairs, one pass over the texts
a part; only such a part is sent to the tasks.

Defined results: equal scores rank by ascending key, null keys first; documents with the same key are
ranked each. Null and empty texts and texts without a term match nothing and are not among the N.
Items that are null, without a term, or without a match have no rows; repeated items (equal id and
text) are searched once, an id with several texts is searched with the terms of all. Extra columns
are left out. Empty tables: no rows. Terms are compared by 64-bit numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import cut, ship
from .shingles import _BASE, _BYTES, _INVERSE, _power, mix

PART_TERMS = 500_000
BLOCK_POSTINGS = 2_000_000
TEXT_BYTES = 1 << 20

_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of several texts as numbers, and the text each is in."""
    data = np.frombuffer((b"\n" + b"\n".join(texts) + b"\n").lower(), np.uint8)
    inside = _TERM[data]
    starts = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _power(_BASE, len(data)))))
    numbers = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts])
    first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) + 1
    return numbers, np.searchsorted(first, starts, "right") - 1


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts in runs of bounded bytes."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and size + len(t) > TEXT_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(k)
            texts.append(t)
            size += len(t)
    if texts:
        yield keys, texts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in _groups(batches):
        numbers, of = terms(texts)
        pairs = np.unique(np.stack((of, numbers.view(np.int64)), 1), axis=0)
        at = pa.array(rows, pa.int64()).take(pa.array(pairs[:, 0]))
        yield pa.RecordBatch.from_arrays([at, pa.array(pairs[:, 1])], names=["row", "term"])


def _matched(key_type: pa.DataType, asked: np.ndarray):
    """Per document its number of terms, and which of the asked terms occur how often."""
    schema = pa.schema([("key", key_type), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _groups(batches):
            numbers, of = terms(texts)
            place = np.searchsorted(asked, numbers)
            place[place == len(asked)] = 0
            hit = asked[place] == numbers if len(asked) else np.zeros(len(numbers), bool)
            pairs, tfs = np.unique(of[hit] * len(asked) + place[hit], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(keys) + 1) * len(asked)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (pairs % max(1, len(asked)), tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(np.bincount(of, minlength=len(keys))), *lists], schema=schema)

    return run


def search(lists: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of one item and their scores, from lists (documents, impacts) sorted by falling impact.

    `rank` orders documents with equal scores. Documents are numbers below len(rank).
    """
    found = np.empty(0, np.int64)  # the documents left, sorted
    low = np.empty(0, np.int64)
    met = np.empty((0, len(lists)), bool)
    read, closed = 0, False  # entries read of each list; closed: no other document can get in
    while True:
        docs = [d[read : read + step] for d, _ in lists]
        gains = [g[read : read + step] for _, g in lists]
        of = np.repeat(np.arange(len(lists)), [len(d) for d in docs])
        docs, gains = np.concatenate(docs), np.concatenate(gains)
        if not closed:
            every = np.union1d(found, docs)
            at = np.searchsorted(every, found)
            grown, seen = np.zeros(len(every), np.int64), np.zeros((len(every), len(lists)), bool)
            grown[at], seen[at] = low, met
            found, low, met = every, grown, seen
        at = np.searchsorted(found, docs)
        at[at == len(found)] = 0
        ours = found[at] == docs if len(found) else np.zeros(len(docs), bool)
        np.add.at(low, at[ours], gains[ours])
        met[at[ours], of[ours]] = True
        read, step = read + step, 2 * step
        bars = np.array([g[read] if read < len(g) else 0 for _, g in lists], np.int64)
        high = low + (~met).astype(np.float64).dot(bars.astype(np.float64)).astype(np.int64)  # exact below 2**53
        if len(found) >= k:
            least = np.partition(low, len(low) - k)[len(low) - k]
            left = high >= least
            found, low, met, high = found[left], low[left], met[left], high[left]
            closed = closed or bars.sum() < least
        if not bars.any() or closed and (high == low).all():
            best = np.lexsort((rank[found], -low))[:k]
            return found[best], low[best]


def _ranked(key_type: pa.DataType, of_item: dict[int, np.ndarray], weights: np.ndarray, docs: int, length: int, k: int):
    """The best of each block for every item."""
    schema = pa.schema([("item", pa.int64()), ("key", key_type), ("score", pa.int64())])

    def block(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        keys, n = table.column("key").combine_chunks(), table.column("n").to_numpy().astype(np.int64)
        rank = np.argsort(pa.compute.sort_indices(keys, null_placement="at_start").to_numpy()) if len(keys) else np.empty(0, np.int64)
        lists = table.column("terms").combine_chunks()
        term, tf = lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(keys)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        m = 100 - 50 + 50 * n[doc] * docs // max(1, length)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
        worth = impact > 0
        term, doc, impact = term[worth], doc[worth], impact[worth]
        order = np.lexsort((-impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        names, starts = np.unique(term, return_index=True)
        where = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)])))
        items, found, scores = [], [], []
        for item, asked in of_item.items():
            spans = [where[t] for t in asked if t in where]
            if spans:
                best, score = search([(doc[a:b], impact[a:b]) for a, b in spans], rank, k)
                items.append(np.full(len(best), item))
                found.append(best)
                scores.append(score)
        if items:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items), pa.int64()), keys.take(pa.array(np.concatenate(found))),
                                              pa.array(np.concatenate(scores), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= BLOCK_POSTINGS:
                yield from block(held)
                held, size = [], 0
        if held:
            yield from block(held)

    return run


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = 50) -> DataFrame:
    """The k best documents of each item: item, rank from 1, key, score above 0."""
    spark = docs.sparkSession
    ship(spark)
    as_bytes = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")
    key_type, item_type = docs.schema[key].dataType, items.schema[item].dataType
    wanted = cut(items.select(F.col(item).alias("item"), as_bytes).filter("item is not null").distinct().withColumn("row", F.monotonically_increasing_id()))
    pairs = (wanted.select("row", "text").mapInArrow(_item_terms, "row long, term long").join(wanted.select("row", "item"), "row")
             .groupBy("item").agg(F.collect_set("term").alias("terms")))
    pairs = cut(pairs.withColumn("number", F.monotonically_increasing_id()))
    parts = max(1, math.ceil((pairs.agg(F.sum(F.size("terms"))).first()[0] or 0) / PART_TERMS))
    results = []
    for part in range(parts):
        mine = pairs.filter(F.pmod(F.xxhash64("number"), F.lit(parts)) == part).select("number", "terms").collect()
        asked = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.array(r.terms, np.int64).view(np.uint64) for r in mine)]))
        arrow, plain = to_arrow_type(key_type), docs.select(F.col(key).alias("key"), as_bytes)
        fields = StructType([StructField("key", key_type)]).add("n", "long").add("terms", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType()))
        matched = cut(plain.mapInArrow(_matched(arrow, asked), fields))
        counted = matched.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        total, length = counted[0], counted[1] or 0
        df = {r.term: r.df for r in matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(asked))], np.int64)
        of_item = {r.number: np.searchsorted(asked, np.sort(np.array(r.terms, np.int64).view(np.uint64))).tolist() for r in mine}
        found = StructType().add("item", LongType()).add(StructField("key", key_type)).add("score", LongType())
        results.append(matched.filter(F.size("terms") > 0).mapInArrow(_ranked(arrow, of_item, weights, total, length, k), found))
    best = results[0]
    for more in results[1:]:
        best = best.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_first("key")]
    for group in (["item", F.pmod(F.xxhash64("key"), F.lit(32))], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
    names = best.join(pairs.select(F.col("number").alias("item"), F.col("item").alias("name")), "item")
    return names.select(F.col("name").cast(item_type).alias(item), "rank", F.col("key").alias(key), "score")

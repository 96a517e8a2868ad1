"""Near-duplicate documents by SuperMinHash.

Every shingle draws a random permutation of the signature's places, one place a step; a place
keeps the earliest step that reached it and, within the step, the smallest draw. The steps run
over all shingles of a document at once and stop as soon as every place is taken (a later step
cannot win), which for longer texts is after one to three of them.

Signatures are cut into bands. Documents of equal shingle sets are one class; classes that share
a band form a candidate group (components of class - smallest class edges). Inside a group all
pairs are compared on the full sets, in blocks of bounded size, each block pair a task of its own
that counts intersections by a matrix product and keeps only the links that join two sets of its
union-find. So no pair list is written, and a huge group becomes many equal tasks. Components of
these links give the result.

Defined results: null or empty text has an empty set and is linked with nothing; a null doc_id
takes no part in linking, its component is null and it is kept; rows that repeat a doc_id are one
node; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized
from .components import UnionFind, components
from .shingles import U, mix, shingle_set

ROWS = 6  # of a band
MISSED = 1 / 80_000  # of the pairs at the threshold share no band; those above it are missed far less often
BLOCK_ROWS, BLOCK_BYTES = 128, 4 << 20


def bands_for(threshold: float, rows: int = ROWS, missed: float = MISSED) -> int:
    """Bands that a pair at the threshold shares none of with at most this probability: 24 at 0.85, 38 at 0.8."""
    return math.ceil(math.log(missed) / math.log1p(-(threshold ** rows)))


def signature(numbers: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash of a non-empty set: per place (step << 32 | draw) of the winner."""
    n = len(numbers)
    rows = np.arange(n)
    empty = U(2**64 - 1)
    out = np.full(places, empty, U)
    order = None
    for step in range(places):
        draw = mix(numbers + U((step + 1) * 0xA24BAED4963EE407 % 2**64))
        at = step + ((draw >> U(40)) * U(places - step) >> U(24)).astype(np.int64)
        if step:
            if order is None:  # only now the permutations are needed: replay the first swap
                order = np.tile(np.arange(places, dtype=np.int16), (n, 1))
                order[rows, first] = 0
            place = order[rows, at]
            order[rows, at] = order[rows, step]
        else:
            place = first = at
        level = np.full(places, empty, U)
        np.minimum.at(level, place, (draw & U(0xFFFFFFFF)) | U(step << 32))
        out = np.minimum(out, level)
        if out.max() != empty:
            break
    return out


def band_keys(numbers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    slots = signature(numbers, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=U)
    for i in range(rows):
        key = mix(key ^ slots[:, i])
    return key.view(np.int64)


def _marks(threshold: float, bands: int, rows: int, k: int):
    # A set this small reaches the threshold with an equal set only, so bands would find nothing.
    alone = int(np.floor(threshold / (1 - threshold))) if threshold < 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ones, twos, keys = [], [], [], []
            for text in batch.column("text"):
                numbers = shingle_set(text.as_py(), k)
                n = len(numbers)
                sizes.append(n)
                ones.append(int(mix(numbers).sum(dtype=U).view(np.int64)) if n else 0)
                twos.append(int(mix(numbers ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64)) if n else 0)
                small = alone is None or n <= alone - 1e-9
                keys.append(None if n == 0 or small else band_keys(numbers, bands, rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()),
                 pa.array(twos, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "one", "two", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), k).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("group"), pa.array(sets, pa.binary())],
                                             names=["node", "group", "numbers"])

    return run


def block_links(left: list[np.ndarray], right: list[np.ndarray], threshold: float, percent: int = 100) -> Iterator[tuple[int, int]]:
    """Index pairs of two lists of sorted sets with intersection >= threshold * union, in whole numbers."""
    need = round(threshold * percent)
    sets = [*left, *right]
    sizes = np.array([len(s) for s in sets], np.int64)
    numbers, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(numbers, kind="stable")
    numbers, owner = numbers[order], owner[order]
    fresh = np.concatenate(([True], numbers[1:] != numbers[:-1]))
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1  # a shingle of one set adds to no intersection
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        common += has[: len(left)] @ has[len(left):].T
    both = np.rint(common).astype(np.int64)  # exact: counts stay below 2**24 in any text of bounded length
    union = sizes[: len(left), None] + sizes[None, len(left):] - both
    yield from zip(*np.nonzero(percent * both >= need * union), strict=True)


def _verify(threshold: float):
    def links(key, rows) -> Iterator[tuple[int, int]]:
        _group, low, high = key
        left = [r for r in rows if r[1] == low]
        right = left if low == high else [r for r in rows if r[1] == high]
        if not left or not right:
            return
        joined = UnionFind()
        for i, j in block_links([r[2] for r in left], [r[2] for r in right], threshold):
            a, b = left[i][0], right[j][0]
            if a != b and joined.union(a, b):
                yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                cols = [batch.column(c) for c in ("group", "low", "high", "node", "block", "numbers")]
                for i in range(batch.num_rows):
                    group, low, high, node, block, numbers = (c[i].as_py() for c in cols)
                    yield (group, low, high), (node, block, np.frombuffer(numbers, U))

        found: list[tuple[int, int]] = []
        key, held = None, []
        for now, row in rows():
            if now != key:
                if len(held) > 1:
                    found += links(key, held)
                key, held = now, []
            held.append(row)
        if len(held) > 1:
            found += links(key, held)
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                                         names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int | None = None, rows: int = ROWS, k: int = 5,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (see the module text).

    `threshold` is taken in whole percent, so that the comparison of counts is exact. There are as
    many bands as it asks for (`bands_for`), if no number is given.
    """
    bands = bands or bands_for(threshold, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = cut(texts.mapInArrow(_marks(threshold, bands, rows, k),
                                 "doc_id long, n_shingles long, one long, two long, bands array<long>"))
    named = marks.filter("doc_id is not null and n_shingles > 0")
    classes = cut(named.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))

    keyed = classes.select("node", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("root"), F.max("node").alias("last")).filter("root <> last")
    groups = components(keyed.join(least.select("key", "root"), "key"), "node", "root")
    # The smallest class of a group has no edge of its own in the result; it is added back.
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    groups = groups.withColumnRenamed("component", "group")

    sets = cut(texts.join(sized(groups), texts["doc_id"] == groups["node"]).select("node", "group", "text")
               .mapInArrow(_sets(k), "node long, group long, numbers binary"))
    parts = sets.groupBy("group").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum(F.length("numbers")) / BLOCK_BYTES)).cast("long").alias("parts"))
    blocked = sets.join(sized(cut(parts)), "group").withColumn("block", F.pmod(F.xxhash64("node"), "parts"))
    pairs = blocked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).select(
        "group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block", "numbers")
    links = (pairs.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")
             .mapInArrow(_verify(threshold), "a long, b long"))
    found = components(cut(links), "a", "b")

    member = classes.select("one", "two", "n_shingles", "node").join(found, "node", "left").select(
        "one", "two", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    joined = marks.drop("bands").join(member, ["one", "two", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """The documents of which one of each group stays; rows without a doc_id stay, repeated rows become one."""
    kept = cut(near_duplicates(docs, threshold, **options).filter("kept and doc_id is not null").groupBy(
        F.col("doc_id").alias("_kept_id")).count())
    named = docs.join(sized(kept.select("_kept_id")), F.col("doc_id") == F.col("_kept_id"), "left_semi")
    if not kept.filter("count > 1").isEmpty():
        named = named.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return named.unionByName(docs.filter("doc_id is null"))

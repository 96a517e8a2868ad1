"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Vectors of one label and length with equal components are one class. Each class gets, for every
table, a code of the signs of its products with random hyperplanes; two classes meet in the
buckets of the tables whose codes agree. The bits of a code follow the counted classes of the
label, so that a class meets an unrelated one in about one table of 64 whatever their number, and
the number of tables follows the bits, so that a pair at the threshold is missed at most once in
1 / `miss`: pair work and tables grow by a small power of the classes, not with their square.

Buckets are counted on keys alone. A class takes the tables in which it has company, its vector is
looked up once, and only those (class, table) rows carry it on. A bucket is split into blocks of
bounded size, and each pair of blocks is a task's group: one matrix product in double precision
gives all cosines. A pair is counted in the first table that its codes agree in, so nothing is
counted twice and no pairs are written: a block pair yields the number of links of each class,
weighted by the rows of the other class, and the links that join two sets of its union-find.
Components of those give the groups. No pair below the threshold is linked, since every link is
verified.

Defined results: a vector that is null, empty, all zero or holds a null or non-finite component,
and any vector without a label, links with nothing and is its own group; so does a null vec_id,
whose group is null; rows that repeat a vec_id count as vectors each; an empty table gives no
rows. Extra columns are ignored.
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

SPARE_BITS = 6  # bits of a code beyond those that number the classes of a label
MISS = 5e-5
BLOCK_ROWS = 512
WRITTEN = 10_000  # result rows of a batch


def table_count(bits: int, threshold: float, miss: float) -> int:
    """Tables after which a pair at the threshold has met in none with probability `miss` at most."""
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return 1 if agree >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def planes(length: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, length, bits]).standard_normal((length, tables * bits))


def codes(matrix: np.ndarray, tables: int, bits: int) -> np.ndarray:
    signs = matrix @ planes(matrix.shape[1], tables, bits) > 0
    return signs.reshape(len(matrix), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _coded(threshold: float, miss: float):
    kept = ("class", "label", "node", "rows", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            out: list = [None] * len(vectors)
            alike: dict[tuple[int, int], list[int]] = {}
            for i, (v, bits) in enumerate(zip(vectors, batch.column("bits").to_pylist())):
                alike.setdefault((len(v), bits), []).append(i)
            for (_, bits), at in alike.items():
                tables = table_count(bits, threshold, miss)
                for i, c in zip(at, codes(np.array([vectors[i] for i in at], float), tables, bits).tolist()):
                    out[i] = c
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.list_(pa.int64()))], names=[*kept, "codes"])

    return run


def _linked(threshold: float):
    def links(key, left, right):
        table = key[2]
        same = left is right
        a, b = (np.array([r[3] for r in side], float) for side in (left, right))
        x, y = (np.array([r[4] for r in side]) for side in (left, right))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        close = a @ b.T >= threshold
        i, j = np.nonzero(np.triu(close, 1) if same else close)
        first = np.ones(len(i), bool)
        for t in range(table):  # one table at a time, so that memory does not grow with their number
            first &= x[i, t] != y[j, t]
        return i[first], j[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            key, held = None, []
            for batch in batches:
                keys, members = ([batch.column(c).to_pylist() for c in names] for names in (
                    ("label", "length", "table", "code", "low", "high"), ("block", "node", "rows")))
                lists = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column("vector"), batch.column("codes"))]
                for i, (now, own) in enumerate(zip(zip(*keys), zip(*members))):
                    if now != key:
                        if held:
                            yield key, held
                        key, held = now, []
                    held.append((*own, *[values[at[i]:at[i + 1]] for values, at in lists]))
            if held:
                yield key, held

        found: list[tuple] = []

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b", "n"])

        for key, held in groups():
            if len(held) < 2:
                continue
            low, high = key[4:6]
            left = [r for r in held if r[0] == low]
            right = left if low == high else [r for r in held if r[0] == high]
            if not left or not right:
                continue
            i, j = links(key, left, right)
            if not len(i):
                continue
            rows_l, rows_r = np.array([r[2] for r in left]), np.array([r[2] for r in right])
            count_l, count_r = np.bincount(i, rows_r[j], len(left)), np.bincount(j, rows_l[i], len(right))
            if left is right:
                count_l, count_r = count_l + count_r, np.zeros(0)
            found += [(left[k][1], None, int(n)) for k, n in enumerate(count_l) if n]
            found += [(right[k][1], None, int(n)) for k, n in enumerate(count_r) if n]
            joined = UnionFind()
            for a, b in zip(i.tolist(), j.tolist()):
                if joined.union(left[a][1], right[b][1]):
                    found.append((left[a][1], right[b][1], 0))
            if len(found) >= WRITTEN:
                yield written()
                found.clear()
        if found:
            yield written()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = MISS, spare_bits: int = SPARE_BITS,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (see the module text)."""
    raw = F.col("embedding").cast("array<double>")
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), raw.alias("vector")))
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
           & F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
           & F.exists("vector", lambda v: v != 0))
    # Adding zero makes -0.0 equal to 0.0.
    good = rows.filter(F.coalesce(fit, F.lit(False))).withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("rows"))
    classes = cut(classes.select(F.xxhash64("label", "vector").alias("class"), "label", F.size("vector").alias("length"), "node", "rows", "vector"))
    # 62 bits and a sign are what a code can hold; they number more classes than there are.
    bits = F.least(F.ceil(F.log2(F.count(F.lit(1)).cast("double"))).cast("int") + spare_bits, F.lit(62))
    widths = sized(cut(classes.groupBy("label", "length").agg(bits.alias("bits"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")))
    coded = cut(classes.join(widths, ["label", "length"]).mapInArrow(
        _coded(threshold, miss), "class long, label string, node long, rows long, vector array<double>, codes array<long>"))

    keys = ["label", "length", "table", "code"]
    at = coded.select("class", "node", "label", F.size("vector").alias("length"), F.posexplode("codes").alias("table", "code"))
    sizes = at.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("parts"), F.count(F.lit(1)).alias("members"))
    sizes = sized(cut(sizes.filter("members > 1").drop("members")))
    shared = at.join(sizes, keys).groupBy("class", "node").agg(F.collect_list(F.struct("table", "code", "parts")).alias("tables"))
    placed = coded.join(shared, ["class", "node"]).select(
        "label", F.size("vector").alias("length"), F.explode("tables").alias("at"), "node", "rows", "vector", "codes").select(
        "label", "length", "at.table", "at.code", "at.parts", "node", "rows", "vector", "codes")
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("node"), "parts"))
    paired = blocked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).select(
        *keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "rows", "vector", "codes")
    group = [*keys, "low", "high"]
    found = cut(paired.repartition(*group).sortWithinPartitions(*group).mapInArrow(_linked(threshold), "a long, b long, n long"))
    counted = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    joined = components(found.filter("b is not null"), "a", "b")

    per_class = classes.select("label", "vector", "node", "rows").join(counted, "node", "left").join(joined, "node", "left").select(
        "label", "vector", (F.coalesce("others", F.lit(0).cast("long")) + F.col("rows") - 1).alias("links"),
        F.coalesce("component", "node").alias("group"))
    keyed = rows.withColumn("vector", F.when(F.coalesce(fit, F.lit(False)), F.transform("vector", lambda v: v + F.lit(0.0))))
    out = keyed.join(per_class, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("group", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

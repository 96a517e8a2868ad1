"""Benchmark decontamination by SimHash over windows of item size, with built-in functions only.

Texts are sequences of shingles of five words (an item with fewer words is one shingle of that
many). A window of a document has as many words as a benchmark item and is clipped at the ends of
the text. Windows without any benchmark shingle have similarity 0 with every item, so windows are
laid only where a shingle of an item of that size puts them: at the place of the document's
shingle minus its place in the item.

Each such window and each item gets a 64-bit SimHash of its weighted shingles. Fingerprints are
cut into radius + 1 blocks; two that differ in at most `radius` bits agree in at least one block,
so a join on (size, block, bits of the block) finds every pair within the radius, each at the
first block it agrees in. The default radius, 20, is 3.8 standard deviations above the mean
distance of two sets at similarity 0.8. Pairs within it are verified exactly: the weighted Jaccard
similarity of the two bags of shingles, where a shingle weighs 16 * log2(1 + items / items with
it), rounded, so that sums are exact whatever the order.

The text is read twice and never shuffled unless the found documents are too many to broadcast;
everything else is in proportion to the shingles that hit.

Defined results: a null or empty text or item matches nothing; a null doc_id or item_id is kept in
the result; rows that repeat a document give its matches once; a document shorter than an item is
one clipped window; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized

BITS = 64
WHITE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Words of a text in lower case; none for a null or blank text."""
    bare = F.btrim(F.lower(text), F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>"))


def shingles(name: str, k: int) -> Column:
    """Hashes of every k words in a row of the array column."""
    n = F.size(name)
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(name, i + j) for j in range(k)]))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def _items(items: DataFrame, k: int) -> DataFrame:
    """A row per shingle: item_key, item_id, width (words of a shingle), size (words of the item), place, hash."""
    text = F.col("text").cast("string")
    rows = items.select("item_id", F.xxhash64(F.col("item_id").cast("string"), text).alias("item_key"), words(text).alias("words"))
    rows = rows.select("*", F.size("words").alias("size"), F.least(F.size("words"), F.lit(k)).alias("width")).filter("size > 0")
    rows = rows.dropDuplicates(["item_key"])
    hashes = F.when(F.col("width") == k, shingles("words", k))
    for w in range(1, k):
        hashes = hashes.when(F.col("width") == w, shingles("words", w))
    return rows.select("item_key", "item_id", "width", "size", F.posexplode(hashes).alias("place", "hash"))


def _fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash and total weight per key, of rows with hash and weight."""
    up = [F.sum(F.when(F.shiftright("hash", b).bitwiseAND(1) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"_b{b}")
          for b in range(BITS)]
    bits = [F.when(F.col(f"_b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
            for b in range(BITS)]
    whole = bits[0]
    for bit in bits[1:]:
        whole = whole.bitwiseOR(bit)
    summed = rows.groupBy(*keys).agg(F.sum("weight").alias("total"), *up)
    return summed.select(*keys, "total", whole.alias("print"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, mask) of radius + 1 blocks of nearly equal width."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _indexed(prints: DataFrame, radius: int) -> DataFrame:
    keys = F.array(*[F.shiftrightunsigned("print", a).bitwiseAND(F.lit(mask).cast("long")) for a, mask in _blocks(radius)])
    return prints.select("*", F.posexplode(keys).alias("block", "bits"))


def _first_block(a: str, b: str, radius: int) -> Column:
    """The first block in which two fingerprints agree."""
    out = F.lit(None).cast("int")
    differ = F.col(a).bitwiseXOR(F.col(b))
    for i, (at, mask) in reversed(list(enumerate(_blocks(radius)))):
        out = F.when(F.shiftrightunsigned(differ, at).bitwiseAND(F.lit(mask).cast("long")) == 0, i).otherwise(out)
    return out


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = 20, k: int = 5) -> DataFrame:
    """One row per document and matching item: doc_id, text_hash, item_id, start_word, n_words, similarity.

    The window is the most similar one, the first of equals.
    """
    if not 0 <= radius < BITS:
        raise ValueError("radius must be from 0 to 63")
    item_rows = cut(_items(items, k))
    n_items = item_rows.select("item_key").distinct().count()
    seen = item_rows.groupBy("width", "hash").agg(F.countDistinct("item_key").alias("n"))
    scale = lambda n: F.round(16 * F.log2(1 + F.lit(float(n_items)) / n)).cast("long")
    weights = sized(cut(seen.select("width", "hash", scale(F.col("n")).alias("weight"))))
    rare = scale(F.lit(1))  # a shingle of no item weighs as much as one of a single item
    anchors = sized(cut(item_rows.select("width", "hash", "size", "place").distinct()))
    widths = sorted(r[0] for r in item_rows.select("width").distinct().collect())  # at most k values

    text = F.col("text").cast("string")
    read = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    with_words = read.select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    laid = None
    for w in widths:
        one = with_words.select("doc_id", "text_hash", F.posexplode(shingles("words", w)).alias("pos", "hash"))
        one = one.join(anchors.filter(F.col("width") == w), "hash").select(
            "doc_id", "text_hash", "width", "size", (F.col("pos") - F.col("place")).alias("start"))
        laid = one if laid is None else laid.unionByName(one)
    if laid is None:
        laid = read.select("doc_id", "text_hash", *[F.lit(0).alias(c) for c in ("width", "size", "start")]).filter("false")
    laid = cut(laid.distinct().groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("width", "size", "start")).alias("windows")))

    found = sized(laid.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash"))
    again = read.join(found, read["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    again = again.select("doc_id", "text_hash", "windows", words(F.col("text")).alias("words")).dropDuplicates(["doc_id", "text_hash"])
    keys = ["doc_id", "text_hash", "width", "size", "start"]
    parts = None
    for w in widths:
        one = again.select("doc_id", "text_hash", F.filter("windows", lambda x: x["width"] == w).alias("windows"), shingles("words", w).alias("hashes"))
        one = one.filter(F.size("windows") > 0).select("doc_id", "text_hash", "hashes", F.explode("windows").alias("at")).select(
            "doc_id", "text_hash", "at.*", F.slice("hashes", F.greatest(F.col("at.start"), F.lit(0)) + 1, F.greatest(
                F.lit(0), F.col("at.size") - w + 1 + F.least(F.col("at.start"), F.lit(0)))).alias("own"))
        one = one.select(*keys, F.explode("own").alias("hash"))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        parts = laid.select("doc_id", "text_hash", *[F.lit(0).alias(c) for c in keys[2:]], F.lit(0).cast("long").alias("hash")).filter("false")
    bags = cut(parts.groupBy(*keys, "hash").agg(F.count(F.lit(1)).alias("times")).join(weights, ["width", "hash"], "left").select(
        *keys, "hash", "times", F.coalesce("weight", rare).alias("one")))
    weighted = lambda df: df.withColumn("weight", F.col("times") * F.col("one"))
    item_bags = cut(item_rows.groupBy("item_key", "width", "size", "hash").agg(F.count(F.lit(1)).alias("times"))
                    .join(weights, ["width", "hash"]).withColumnRenamed("weight", "one"))

    prints = _indexed(_fingerprint(weighted(bags), keys), radius)
    item_prints = _indexed(_fingerprint(weighted(item_bags), ["item_key", "width", "size"]), radius)
    item_prints = sized(cut(item_prints.withColumnRenamed("print", "item_print").withColumnRenamed("total", "item_total")))
    near = prints.join(item_prints, ["width", "size", "block", "bits"]).filter(
        (F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        & (F.col("block") == _first_block("print", "item_print", radius)))
    near = near.select(*keys, "item_key", "total", "item_total")

    same = [bags[c].eqNullSafe(near[c]) if c == "doc_id" else bags[c] == near[c] for c in keys]
    common = near.join(bags, same).select(*[near[c] for c in keys], "item_key", "total", "item_total", "hash", "times", "one")
    common = common.join(sized(item_bags.select("item_key", "hash", F.col("times").alias("item_times"))), ["item_key", "hash"])
    shared = common.groupBy(*keys, "item_key", "total", "item_total").agg(
        F.sum(F.col("one") * F.least("times", "item_times")).alias("shared"))
    union = F.col("total") + F.col("item_total") - F.col("shared")
    passed = shared.filter(F.col("shared") >= threshold * union).withColumn("similarity", F.col("shared") / union)
    best = passed.groupBy("doc_id", "text_hash", "item_key").agg(F.max(F.struct(
        "similarity", (-F.col("start")).alias("back"), "size")).alias("best"))
    ids = sized(cut(item_rows.select("item_key", "item_id").distinct()))
    return best.join(ids, "item_key").select(
        "doc_id", "text_hash", "item_id", F.greatest(-F.col("best.back"), F.lit(0)).cast("long").alias("start_word"),
        F.col("best.size").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a match, in their own columns."""
    found = matches(docs, items, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    found = sized(cut(found))
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash")), "left_anti")

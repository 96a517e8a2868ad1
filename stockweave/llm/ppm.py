"""Scores of whole texts by prediction by partial matching, with counts of the whole training part.

The model is a trie of byte contexts: a context of `order` bytes, its suffixes, and for each the
counts of the bytes that follow it in the training texts. A byte seen c times after the longest
context has probability (2c - 1) / 2N, N being all its followers; what is left, D / 2N for D different
followers, is the escape to the context one byte shorter (method D). There, the bytes already seen
after the longer context are excluded: from N and D alike. Below the empty context all bytes not seen at all
are equal. Texts are read as UTF-8 with A-Z lower-cased; the byte 0xFF, which no text holds, stands
before a text as often as the order says and ends it, so a text's probabilities sum to one.

Counts are exact and all of them are kept: the trie is a table with a row for each distinct
(order + 1)-gram, in either part, and levels are sums of the level above. A gram's probability
depends on nothing else, so it is computed once and looked up by the blocks (`blocks`) that hold it.
Tokens and their corpus counts, for the unigram baseline, are looked up the same way.

Defined results: a null or empty text has one token, the end, and one coded byte, its end. With no
training text, all counts are 0: `base_score` is 0 (one unseen token has all mass) and every byte has
probability 1/256. Repeated rows are scored each, and each counts in training. A null key is crc32
of nothing: null, so that row is not held out and trains. Extra columns are left out of the result.
Empty table: no rows. Words are compared by 64-bit numbers; logarithms travel with 24 bits and are added with 53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks
from .common import cut, ship
from .shingles import _BYTES, _INVERSE, _WHITE, _power, mix

ORDER = 5  # bytes of context
TEXT_BYTES = 1 << 19  # of texts joined in one row
WORDS, GRAMS = 0, 1
END = b"\xff"

_BASE = 0xD6E8FEB86659FD93
_GAP = _WHITE.copy()
_GAP[0xFF] = True


def held_out(key: str = "doc_id") -> Column:
    """A tenth of the documents, by their key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 10 == 0, F.lit(False))


def _join(texts: list[bytes], order: int) -> bytes:
    gap = END * order
    return gap + b"".join(t.lower() + gap for t in texts)


def _joined(key_type, order: int):
    """Rows of joined, compressed texts with their keys; a row belongs to one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, press = blocks.Numbers(), zstandard.ZstdCompressor(level=1)
        schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(key_type)), ("held", pa.list_(pa.bool_())), ("texts", pa.binary())])

        def rows() -> Iterator[tuple]:
            keys, held, texts, size = [], [], [], 0
            for batch in batches:
                for k, h, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if keys and size + len(t) > TEXT_BYTES:
                        yield numbered.of(size), keys, held, press.compress(_join(texts, order))
                        keys, held, texts, size = [], [], [], 0
                    keys.append(k)
                    held.append(h)
                    texts.append(t)
                    size += len(t)
            if keys:
                yield numbered.of(size), keys, held, press.compress(_join(texts, order))

        yield from blocks.as_batches(rows(), schema)

    return run


class Texts:
    """One row of joined texts as arrays."""

    def __init__(self, packed: bytes, n: int, order: int) -> None:
        data = self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        self.n, self.order = n, order
        stops = np.flatnonzero(data == 0xFF)[order:].reshape(n, order)[:, 0]  # the end symbol of each text
        self.starts = np.concatenate(([order], stops[:-1] + order))
        self.stops = stops

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Every coded byte with its context as one number, and the text it is in."""
        wide = self.data.astype(np.uint64)
        size = len(wide) - self.order
        keys = np.zeros(size, np.uint64)
        for i in range(self.order + 1):
            keys = (keys << np.uint64(8)) | wide[i : i + size]
        of = np.repeat(np.arange(self.n), np.diff(np.concatenate((self.starts, [len(self.data)]))))[:size]
        real = np.ones(size, bool)
        for i in range(1, self.order):  # what stands between two texts, after the end symbol
            at = self.stops + i - self.order
            real[at[at < size]] = False
        return keys[real], of[real]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Every word as one number, and the text it is in."""
        data = self.data
        gap = _GAP[data]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        if not len(starts):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _power(_BASE, len(data)))))
        numbers = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts])
        return numbers, np.searchsorted(self.starts, starts, "right") - 1


def _counted(keys: np.ndarray, of: np.ndarray, held: np.ndarray) -> tuple[list, list]:
    """Distinct keys of all texts, with their occurrences in training texts."""
    out = held[of]
    learned, n = np.unique(keys[~out], return_counts=True)
    asked = np.unique(keys[out])
    return [learned, asked], [n, np.zeros(len(asked), np.int64)]


def _pieces(order: int, places: int):
    """The distinct words and grams of each block."""
    schema = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, found = None, {WORDS: blocks.Sums(), GRAMS: blocks.Sums()}

            def flush() -> Iterator[tuple]:
                for kind, sums in found.items():
                    k, c = sums.take()
                    at = k if kind == WORDS else k >> np.uint64(8 * min(2, order))  # grams of a place come in runs of close numbers
                    yield from blocks.dealt(kind, now, k, c, blocks.place_of(at, places), blocks.steps)

            for batch in batches:
                for i in range(batch.num_rows):
                    block, held = batch.column("block")[i].as_py(), np.array(batch.column("held")[i].as_py(), bool)
                    if now is not None and block != now:
                        yield from flush()
                    now = block
                    texts = Texts(batch.column("texts")[i].as_py(), len(held), order)
                    for kind, (keys, of) in ((WORDS, texts.words()), (GRAMS, texts.grams())):
                        found[kind].add(*blocks.added(*_counted(keys, of, held)))
            if now is not None:
                yield from flush()

        yield from blocks.as_batches(rows(), schema)

    return run


ANSWERS = "kind int, block long, keys binary, vals binary, distinct_words long, tokens long"


def _word_answers(group: pa.Table) -> pa.Table:
    """Corpus counts for each block's words; a last row has the place's different words and tokens in training."""
    keys = [blocks.unstepped(b) for b in group.column("keys").to_pylist()]
    all_keys, totals = blocks.added(keys, [blocks.numbers(b, "<i8") for b in group.column("counts").to_pylist()])
    vals = [totals[np.searchsorted(all_keys, k)].astype("<i8").tobytes() for k in keys]
    n = len(keys)
    return pa.table({"kind": pa.array([WORDS] * n + [-1], pa.int32()), "block": pa.array([*group.column("block").to_pylist(), -1], pa.int64()),
                     "keys": pa.array([*group.column("keys").to_pylist(), None], pa.binary()), "vals": pa.array([*vals, None], pa.binary()),
                     "distinct_words": pa.array([None] * n + [int((totals > 0).sum())], pa.int64()),
                     "tokens": pa.array([None] * n + [int(totals.sum())], pa.int64())})


def _gram_totals(group: pa.Table) -> pa.Table:
    keys, totals = blocks.added([blocks.unstepped(b) for b in group.column("keys").to_pylist()],
                                [blocks.numbers(b, "<i8") for b in group.column("counts").to_pylist()])
    return pa.table({"place": pa.array([group.column("place")[0].as_py()] * len(keys), pa.int64()),
                     "gram": pa.array(keys.astype(np.int64)), "c": pa.array(totals.astype(np.int64))})


def _gram_answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    grams, logs = known.column("gram").to_numpy().astype(np.uint64), known.column("log10_p").to_numpy()
    order = np.argsort(grams)
    grams, logs = grams[order], logs[order]
    rows = asked.column("keys").to_pylist()
    vals = [logs[np.searchsorted(grams, blocks.unstepped(b))].astype("<f4").tobytes() for b in rows]
    n = len(rows)
    return pa.table({"kind": pa.array([GRAMS] * n, pa.int32()), "block": asked.column("block").cast(pa.int64()), "keys": pa.array(rows, pa.binary()),
                     "vals": pa.array(vals, pa.binary()), "distinct_words": pa.nulls(n, pa.int64()), "tokens": pa.nulls(n, pa.int64())})


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """log10_p of every row (gram, c): the gram's last byte after the others, c its training count, which may be 0.

    Grams are numbers of order + 1 bytes. Every level has all grams of the level above without their
    first byte, so each context chain is there; `rest` is the probability of a byte once a context is left.
    """
    levels = [grams]
    for size in range(order, 0, -1):  # bytes in a gram of the level
        mask = F.lit((1 << 8 * size) - 1)
        levels.append(cut(levels[-1].groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("c").alias("c"))))
    levels.reverse()
    everywhere = Window.partitionBy("context")

    def followers(level: DataFrame) -> DataFrame:
        return (level.withColumn("context", F.shiftright("gram", 8))
                .withColumns({"n": F.sum("c").over(everywhere), "d": F.count_if(F.col("c") > 0).over(everywhere)}))

    below = followers(levels[0]).withColumn("rest", 1 / (256 - F.col("d")))
    for size, level in enumerate(levels[1:], 2):
        short = below.select(F.col("gram").alias("short"), F.col("c").alias("c_short"), F.col("n").alias("n_short"),
                             F.col("d").alias("d_short"), F.col("rest").alias("rest_short"))
        mask = F.lit((1 << 8 * (size - 1)) - 1)
        here = followers(level).join(short, F.col("gram").bitwiseAND(mask) == F.col("short"))
        excluded = F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("c_short"))).over(everywhere), F.lit(0))
        here = here.withColumns({"n_left": F.col("n_short") - excluded, "d_left": F.col("d_short") - F.col("d")})
        half = 2 * F.col("n_left")
        below = here.withColumn("rest", F.when(half == 0, F.col("rest_short")).when(F.col("c_short") > 0, (2 * F.col("c_short") - 1) / half)
                                .otherwise(F.col("d_left") / half * F.col("rest_short")))
    half = 2 * F.col("n")
    p = F.when(F.col("c") > 0, (2 * F.col("c") - 1) / half).when(half > 0, F.col("d") / half * F.col("rest")).otherwise(F.col("rest"))
    return below.withColumn("log10_p", F.log10(p)).select("gram", "log10_p", *[c for c in grams.columns if c not in ("gram", "c")])


def _scored(order: int, distinct_words: int, tokens: int, enders: int, schema: pa.Schema):
    """Texts of a block and the answers for its words and grams: one row per text."""
    floor = tokens + 0.1 * (distinct_words + 1)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tables = {}
        for kind, form in ((WORDS, "<i8"), (GRAMS, "<f4")):
            mine = answers.filter(pa.compute.equal(answers.column("kind"), kind))
            keys = np.concatenate([np.empty(0, np.uint64), *map(blocks.unstepped, mine.column("keys").to_pylist())])
            vals = np.concatenate([np.empty(0, form), *(blocks.numbers(b, form) for b in mine.column("vals").to_pylist())])
            keys, first = np.unique(keys, return_index=True)
            tables[kind] = blocks.Lookup(keys, vals[first])
        made = []
        for keys, held, packed in zip(*(texts.column(c).to_pylist() for c in ("keys", "held", "texts"))):
            joined = Texts(packed, len(keys), order)
            n = joined.n
            words, of = joined.words()
            c = tables[WORDS](words)
            base = np.bincount(of, np.log10((c + 0.1) / floor), n) + np.log10((enders + 0.1) / floor)
            grams, place = joined.grams()
            score = np.bincount(place, tables[GRAMS](grams), n)
            made.append(pa.table([pa.array(keys, schema.field(0).type), pa.array(held, pa.bool_()), np.bincount(of, minlength=n) + 1,
                                  np.bincount(of[c > 0], minlength=n) + (enders > 0), np.full(n, tokens, np.int64), base, score,
                                  joined.stops - joined.starts + 1], schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None, order: int = ORDER) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score, coded_bytes.

    `held` says which documents stay out of training (default `held_out`). Scores are log10 probabilities;
    -score / coded_bytes / log10(2) is the code length in bits a byte.
    """
    spark = docs.sparkSession
    ship(spark)
    if not 1 <= order <= 6:
        raise ValueError("an order is 1 to 6 bytes")
    key_type = docs.schema[key].dataType
    plain = docs.select(F.col(key).alias("key"), (held_out(key) if held is None else F.coalesce(held, F.lit(False))).alias("held"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    fields = StructType().add("block", "long").add("keys", ArrayType(key_type)).add("held", ArrayType(BooleanType())).add("texts", "binary")
    texts = cut(plain.mapInArrow(_joined(to_arrow_type(key_type), order), fields))
    total = texts.agg(F.sum(F.length("texts"))).first()[0]
    places = blocks.place_count(3 * (total or 0))
    pieces = cut(texts.select("block", "held", "texts").mapInArrow(_pieces(order, places), blocks.PIECES))
    ends = texts.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    words = cut(pieces.filter(F.col("kind") == WORDS).groupBy("place").applyInArrow(_word_answers, ANSWERS))
    seen = words.filter("block = -1").agg(F.sum("distinct_words"), F.sum("tokens")).first()
    asked = pieces.filter(F.col("kind") == GRAMS)
    grams = cut(asked.groupBy("place").applyInArrow(_gram_totals, "place long, gram long, c long"))
    known = probabilities(grams, order)
    answers = asked.groupBy("place").cogroup(known.groupBy("place")).applyInArrow(_gram_answers, ANSWERS)
    answers = words.filter("block >= 0").unionByName(answers).select("block", "kind", "keys", "vals")
    result = StructType([StructField(key, key_type)]).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add(
        "train_tokens", "long").add("base_score", "double").add("score", "double").add("coded_bytes", "long")
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in result])
    scored = _scored(order, (seen[0] or 0) + (ends > 0), (seen[1] or 0) + ends, ends, schema)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, result)

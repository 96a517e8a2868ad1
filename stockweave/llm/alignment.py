"""Aligning the tokens of two tokenizers over the same bytes, and counting which ids stand together.

Both tokenizers cut " " + text. An offset where a token of each ends is a shared cut. Within an
interval, a common end near the middle is looked for: the ends of the first tokenizer are tried from
the middle outwards, each by bisection among the ends of the second; both halves are treated alike,
and an interval without a cut inside is a group (`align`). The last tokens of a group end together:
they are a link, and links are counted by id pair over the whole corpus.

Neither tokenizer joins a single space between two visible characters to what stands before it, so
these spaces are shared cuts that are known beforehand, and the tokens and groups between two of them
depend on nothing else. Such spans repeat and are kept, per worker, in two tables of bounded size: a
full one is set aside, and what is used of the one set aside before moves on.
A text whose tokens of either kind do not spell " " + text has no tokens.

Per document the distinct pairs are stored with their numbers; blocks of documents ask once per pair
for its corpus count and whether that is the highest of its second id (`blocks`). Pairs are dealt to
places by their second id, so that a place sees all pairs of an id.

Defined results: null, empty and unspellable texts have zeros and an empty hash. Repeated rows count
as often as they occur. Extra columns are left out. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from . import blocks
from .common import cut, ship

BYTES_A, PIECES_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
KEPT_SPANS = 150_000  # in each of the two tables
_NAMES = [str(i) for i in range(1 << 16)]
_SPAN = re.compile(r"(?<=\S) (?=\S)")
_SPACED = re.compile(r"\s | \s|^ | $")  # a space that does not stand between two visible characters


def align(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Shared cuts in order, as numbers of tokens before them; both lists rise and end at the same offset."""
    cuts, open_ = [], [(0, len(ends_a) - 1, 0, len(ends_b) - 1)]  # tokens of an interval: first to last, the last ones end together
    while open_:
        a, z, b, y = open_.pop()
        left = right = (a + z) // 2
        found = None
        while found is None and (left >= a or right < z):
            for i in ((left, right) if left != right else (left,)):
                if a <= i < z:
                    j = bisect_left(ends_b, ends_a[i], b, y)
                    if j < y and ends_b[j] == ends_a[i]:
                        found = i, j
                        break
            left, right = left - 1, right + 1
        if found is None:
            cuts.append((z + 1, y + 1))
        else:
            i, j = found
            open_.append((i + 1, z, j + 1, y))
            open_.append((a, i, b, j))
    return cuts


class Span:
    """The tokens and groups of a piece of text that begins with a space."""

    __slots__ = ("groups", "n_a", "n_b", "n_groups", "pairs")

    def __init__(self, a: list[int], b: list[int], cuts: list[tuple[int, int]]) -> None:
        self.n_a, self.n_b, self.n_groups = len(a), len(b), len(cuts)
        names_a, names_b = ([_NAMES[t] if t < 65536 else str(t) for t in ids] for ids in (a, b))
        written, i, j = [], 0, 0
        for m, n in cuts:
            left = names_a[i] if m - i == 1 else ",".join(names_a[i:m])
            written.append(f"{left}|{names_b[j] if n - j == 1 else ','.join(names_b[j:n])}")
            i, j = m, n
        self.groups = ";".join(written)
        self.pairs = array("Q", [a[m - 1] << 32 | b[n - 1] for m, n in cuts])


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        visible = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        hidden = [b for b in range(256) if b not in visible.values()]
        visible |= {chr(256 + i): b for i, b in enumerate(hidden)}  # the byte-level alphabet
        self.bytes_a = {i: bytes(visible[c] for c in token) if all(c in visible for c in token) else token.encode()
                        for token, i in self._a.get_vocab().items()}
        self._fast = self._ranked(path_a)
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece goes on after a word
        self._kept: dict[str, Span | None] = {}
        self._before: dict[str, Span | None] = {}

    def _ranked(self, path: str):
        """tiktoken with the same vocabulary as ranks, if `path` is the public file that has such a twin."""
        import base64

        import public_tokenizers
        import tiktoken

        if path != public_tokenizers.path(BYTES_A):
            return None
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        if self._fast is not None:
            return [self._fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self._a.encode_batch(texts, add_special_tokens=False)]

    def spans(self, texts: list[str]) -> list[Span | None]:
        """Of each " " + text; None if its tokens do not spell it."""
        found = []
        for text, a, b in zip(texts, self._ids_a([" " + t for t in texts]), self._b.encode(texts, num_threads=1)):
            spelt_a, spelt_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
            whole = (" " + text).encode()
            if not text or b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
                found.append(None)
            else:
                found.append(Span(a, b, align([*accumulate(map(len, spelt_a))], [*accumulate(map(len, spelt_b))])))
        return found

    def documents(self, texts: list[str]) -> Iterator[list[Span]]:
        """The spans of each text, in order; none for a text without tokens."""
        if len(self._kept) > KEPT_SPANS:
            self._kept, self._before = {}, self._kept
        kept, before = self._kept, self._before
        cutter = [([t] if not self.apart else t.split(" ") if _SPACED.search(t) is None else _SPAN.split(t)) if t else [] for t in texts]
        fresh = set(chain.from_iterable(cutter)).difference(kept)
        known = fresh.intersection(before)
        kept.update((s, before[s]) for s in known)
        new = sorted(fresh - known)
        kept.update(zip(new, self.spans(new)))
        for text, pieces in zip(texts, cutter):
            spans = [kept[p] for p in pieces]
            if None in spans:  # a part is spelt otherwise: the text as a whole decides
                whole = self.spans([text])[0]
                spans = [] if whole is None else [whole]
            yield spans


@cache
def aligner(a: str, b: str) -> Aligner:
    """One a worker; files are named as in the folder of public tokenizers, or by path."""
    import os

    import public_tokenizers

    return Aligner(*(f if os.path.isabs(f) else public_tokenizers.path(f) for f in (a, b)))


_DOCS = ["n_a", "n_b", "n_groups", "n_links"]


def _aligned(key_type: pa.DataType, a: str, b: str):
    """Per document its numbers, the hash of its groups, and its distinct pairs with their counts."""
    schema = pa.schema([("block", pa.int64()), ("key", key_type), *((c, pa.int64()) for c in _DOCS), ("groups_sha256", pa.string()),
                        ("pairs", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, numbered = aligner(a, b), blocks.Numbers()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for key, text, spans in zip(batch.column(0).to_pylist(), texts, both.documents(texts)):
                    pairs = array("Q")
                    for s in spans:
                        pairs += s.pairs
                    distinct, n = np.unique(np.frombuffer(pairs, np.uint64), return_counts=True)
                    sha = hashlib.sha256(";".join([s.groups for s in spans]).encode()).hexdigest() if spans else ""
                    groups = sum([s.n_groups for s in spans])
                    yield (numbered.of(len(text)), key, sum([s.n_a for s in spans]), sum([s.n_b for s in spans]), groups, len(pairs), sha,
                           distinct.astype("<u8").tobytes(), n.astype("<u4").tobytes())

        yield from blocks.as_batches(rows(), schema)

    return run


def _pieces(places: int):
    schema = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, keys, counts = None, [], []

            def flush() -> Iterator[tuple]:
                k, c = blocks.added(keys, counts)
                yield from blocks.dealt(0, now, k, c, blocks.place_of(k & np.uint64(0xFFFFFFFF), places))
                keys.clear()
                counts.clear()

            for batch in batches:
                for block, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "counts"))):
                    if now is not None and block != now:
                        yield from flush()
                    now = block
                    keys.append(blocks.numbers(pairs, "<u8"))
                    counts.append(blocks.numbers(n, "<u4").astype(np.int64))
                    if len(keys) >= 2000:
                        k, c = blocks.added(keys, counts)
                        keys[:], counts[:] = [k], [c]
            if now is not None:
                yield from flush()

        yield from blocks.as_batches(rows(), schema)

    return run


def _best(keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Whether a pair's total is the highest of its second id."""
    _, of = np.unique(keys & np.uint64(0xFFFFFFFF), return_inverse=True)
    most = np.zeros(of.max() + 1 if len(of) else 0, np.int64)
    np.maximum.at(most, of, totals)
    return totals == most[of]


ANSWERS = "block long, keys binary, vals binary"


def _answers(group: pa.Table) -> pa.Table:
    """Corpus counts of each block's pairs; the lowest bit says whether it is the highest of the second id."""
    keys = [blocks.numbers(b, "<u8") for b in group.column("keys").to_pylist()]
    known, totals = blocks.added(keys, [blocks.numbers(b, "<i8") for b in group.column("counts").to_pylist()])
    vals = totals * 2 + _best(known, totals)
    return pa.table({"block": group.column("block").cast(pa.int64()), "keys": group.column("keys").cast(pa.binary()),
                     "vals": pa.array([vals[np.searchsorted(known, k)].astype("<i8").tobytes() for k in keys], pa.binary())})


def _totals(group: pa.Table) -> pa.Table:
    keys, totals = blocks.added([blocks.numbers(b, "<u8") for b in group.column("keys").to_pylist()],
                                [blocks.numbers(b, "<i8") for b in group.column("counts").to_pylist()])
    return pa.table({"a": pa.array((keys >> np.uint64(32)).astype(np.int64)), "b": pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                     "links": pa.array(totals.astype(np.int64)), "best": pa.array(_best(keys, totals))})


def _summed(schema: pa.Schema):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = np.concatenate([np.empty(0, "<u8"), *(blocks.numbers(b, "<u8") for b in answers.column("keys").to_pylist())])
        vals = np.concatenate([np.empty(0, "<i8"), *(blocks.numbers(b, "<i8") for b in answers.column("vals").to_pylist())])
        keys, first = np.unique(keys, return_index=True)
        look = blocks.Lookup(keys, vals[first])
        pairs, counts = docs.column("pairs").to_pylist(), docs.column("counts").to_pylist()
        best, total = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        for i, (p, n) in enumerate(zip(pairs, counts)):
            if p:
                v, n = look(blocks.numbers(p, "<u8")), blocks.numbers(n, "<u4").astype(np.int64)
                best[i], total[i] = n[v & 1 == 1].sum(), (n * (v >> 1)).sum()
        columns = [docs.column(c) for c in ("key", *_DOCS)]
        return pa.table([*columns, pa.array(best), pa.array(total), docs.column("groups_sha256")], schema=schema)

    return run


def _stored(docs: DataFrame, key: str, text: str, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    ship(docs.sparkSession)
    key_type = docs.schema[key].dataType
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    fields = StructType().add("block", "long").add(StructField("key", key_type))
    for c in _DOCS:
        fields = fields.add(c, "long")
    fields = fields.add("groups_sha256", "string").add("pairs", "binary").add("counts", "binary")
    rows = cut(plain.mapInArrow(_aligned(to_arrow_type(key_type), a, b), fields))
    places = blocks.place_count(rows.agg(F.sum(F.length("pairs"))).first()[0])
    return rows, cut(rows.select("block", "pairs", "counts").mapInArrow(_pieces(places), blocks.PIECES))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = BYTES_A, b: str = PIECES_B) -> DataFrame:
    """The corpus' id pairs: a, b, links, best (no pair of that b has more)."""
    _, pieces = _stored(docs, key, text, a, b)
    return pieces.groupBy("place").applyInArrow(_totals, "a long, b long, links long, best boolean")


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = BYTES_A, b: str = PIECES_B) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    key_type = docs.schema[key].dataType
    rows, pieces = _stored(docs, key, text, a, b)
    answers = pieces.groupBy("place").applyInArrow(_answers, ANSWERS)
    fields = StructType([StructField(key, key_type)])
    for c in (*_DOCS, "n_best", "count_sum"):
        fields = fields.add(c, "long")
    fields = fields.add("groups_sha256", "string")
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_summed(schema), fields)

"""Looking up corpus-wide values for the distinct keys of a block of documents.

Documents are dealt into blocks of bounded size inside the task that reads them. A block asks once
for each of its distinct keys, however often they occur in it, so no key has more rows than there
are blocks: a word in every text costs a block as much as a word that occurs once. Keys travel as
sorted arrays, one row per (block, place); a place holds the same keys of all blocks, is chosen by
a hash of the key, and there are as many places as the input has bytes for (`place_count`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from .shingles import mix

BLOCK_BYTES = 32 << 20  # of text; one longer document is a block of its own
PLACE_BYTES = 8 << 20
PIECES = "kind int, place long, block long, keys binary, counts binary"


def place_count(total_bytes: int | None) -> int:
    return max(16, -(-(total_bytes or 0) // PLACE_BYTES))


class Numbers:
    """Block numbers of one task: a new one when the present block would exceed its size."""

    def __init__(self, size: int = BLOCK_BYTES) -> None:
        self.size, self.held = size, 0
        self.number = TaskContext.get().partitionId() << 24

    def of(self, n: int) -> int:
        if self.held and self.held + n > self.size:
            self.number, self.held = self.number + 1, 0
        self.held += n
        return self.number


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c[order], first)


def raw(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").tobytes()


def dealt(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, places: np.ndarray, written=raw) -> Iterator[tuple]:
    """One row per place that has keys of this block; `written` makes bytes of sorted keys."""
    order = np.argsort(places, kind="stable")
    places = places[order]
    starts = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))) if len(places) else []
    for a, b in zip(starts, [*starts[1:], len(places)]):
        at = order[a:b]
        yield kind, int(places[a]), block, written(keys[at]), counts[at].astype("<i8").tobytes()


def place_of(keys: np.ndarray, places: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(places)).astype(np.int64)


def as_batches(rows: Iterator[tuple], schema: pa.Schema, at_most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, (bytes, str, list)) else 8 for v in row)
        if size >= at_most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, the lowest bytes of all first: mostly zeros where keys are close, which compresses."""
    if not len(keys):
        return b""
    return np.diff(keys.astype("<u8"), prepend=np.zeros(1, "<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def unstepped(buffer: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(buffer, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


class Sums:
    """Distinct keys and the sums of their counts, merged whenever enough has come in."""

    def __init__(self, at_most: int = 500_000) -> None:
        self.keys, self.counts, self.new, self.at_most = [], [], 0, at_most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.new += len(keys)
        if self.new > self.at_most:
            self._merge()

    def _merge(self) -> None:
        keys, counts = added(self.keys, self.counts)
        self.keys, self.counts, self.new = [keys], [counts], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        (keys,), (counts,) = self.keys, self.counts
        self.keys, self.counts = [], []
        return keys, counts


def numbers(buffer: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(buffer, kind)


class Lookup:
    """Values of many keys at once: an open-addressed table over distinct keys, probed by whole arrays.

    Every key asked for must be among the keys given.
    """

    def __init__(self, keys: np.ndarray, vals: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        keys = np.ascontiguousarray(keys, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)  # of a slot: place of its key, or -1
        self.keys, self.vals = keys, vals
        left, slots = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.at[slots] < 0
            self.at[slots[free]] = left[free]  # one of several for the same slot stays
            stay = self.at[slots] != left
            left, slots = left[stay], (slots[stay] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return self.vals[:0]
        slots = self._slots(keys)
        found = self.at[slots]
        left = np.flatnonzero(self.keys[found] != keys)
        slots = slots[left]
        while len(left):
            slots = (slots + 1) & self.mask
            found[left] = at = self.at[slots]
            miss = self.keys[at] != keys[left]
            left, slots = left[miss], slots[miss]
        return self.vals[found]

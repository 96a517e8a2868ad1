"""Word shingles of whole texts as sets of 64-bit numbers, with array operations only.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. A word's number comes from one
running sum over the bytes; a shingle's number mixes the numbers of its words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(256, dtype=U))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1; kept and grown by doubling."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        size = max(1 << 16, 1 << n.bit_length())
        row = np.full(size, base & (2**64 - 1), U)
        row[0] = 1
        kept = _powers[base] = np.multiply.accumulate(row)
    return kept[:n]


def word_numbers(text: str | None) -> np.ndarray:
    """One number a word, in order."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    white = np.concatenate(([True], _WHITE[data], [True]))
    starts = np.flatnonzero(white[:-1] & ~white[1:])
    ends = np.flatnonzero(~white[:-1] & white[1:])
    if not len(starts):
        return np.empty(0, U)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTES[data] * _power(_BASE, len(data)))))
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts])


_PLACES = mix(np.arange(1, 4097, dtype=U)) | U(1)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct shingles of k words, sorted; a shorter text is one shingle; no word, no shingle."""
    words = word_numbers(text)
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix((words * _PLACES[:n]).sum(dtype=U, keepdims=True) + U(n * 0x9E3779B97F4A7C15 % 2**64))
    row = words[: n - k + 1] * _PLACES[0]
    for i in range(1, k):
        row = row + words[i : n - k + 1 + i] * _PLACES[i]
    return np.unique(mix(row))

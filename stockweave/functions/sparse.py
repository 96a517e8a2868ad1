"""Sums over sparse rows of slots, in numpy: what a task of the term matrix does with a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS = 512  # of a step: its slots times the columns of a matrix are held at once


def counted(at: pa.ListArray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different slots of every row in order: row, slot, times."""
    owner = np.repeat(np.arange(len(at), dtype=np.int64), at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    keys, times = np.unique(owner * slots + at.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    return keys // slots, keys % slots, times


def weights(owner: np.ndarray, slot: np.ndarray, times: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """TF-IDF weights; those of a row have length one, or are 0."""
    raw = (1.0 + np.log(times)) * idf[slot]
    norm = np.sqrt(np.bincount(owner, raw * raw, rows))
    return np.divide(raw, norm[owner], out=np.zeros_like(raw), where=norm[owner] > 0)


def row_sums(owner: np.ndarray, slot: np.ndarray, w: np.ndarray, matrix: np.ndarray, rows: int) -> np.ndarray:
    """Per row the sum of weight times the slot's row of the matrix."""
    found = matrix[slot]
    return np.stack([np.bincount(owner, w * found[:, i], rows) for i in range(matrix.shape[1])], 1)


def stored(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of slots and times in steps: number of rows, row, slot, times."""
    for low in range(0, batch.num_rows, ROWS):
        part = batch.slice(low, ROWS)
        slot, times = part.column("slots"), part.column("times")
        owner = np.repeat(np.arange(part.num_rows), slot.value_lengths().to_numpy(zero_copy_only=False))
        yield part.num_rows, owner, slot.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)

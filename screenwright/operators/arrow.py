"""Slices of Arrow columns, so that a Python worker never holds what it makes of a whole batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
SLICE_ROWS = 4096


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``most``; a row is never cut."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        stop = min(max(int(np.searchsorted(ends, before + most, side="right")), at + 1), at + SLICE_ROWS)
        yield at, stop - at
        at = stop


def text_slices(batches: Iterator[pa.Array], most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Parts of string columns of about ``most`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
        yield from (batch.slice(*cut) for cut in _cuts(sizes, most))


def struct_slices(batches: Iterator[pa.Array], most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Parts of structs of strings of about ``most`` bytes together."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.field(at)), 0).to_numpy(zero_copy_only=False) for at in range(batch.type.num_fields))
        yield from (batch.slice(*cut) for cut in _cuts(sizes, most))


def list_slices(batches: Iterator[pa.Array], most: int) -> Iterator[pa.Array]:
    """Parts of list columns with about ``most`` items."""
    for batch in batches:
        yield from (batch.slice(*cut) for cut in _cuts(np.diff(batch.offsets.to_numpy()), most))

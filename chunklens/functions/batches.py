"""Slices of Arrow batches, so that what a Python function holds follows its rows and not the size of the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose results are held at once.
BYTES = 1 << 20


def _bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each text, or of each list of texts, and a few for each row and text."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        ends = np.append(0, np.cumsum(_bytes(column.flatten())))
        upto = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        return np.diff(ends[upto], prepend=0) + 16
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of about ``BYTES`` bytes of a column of texts, or of lists of texts; a longer row is a slice of its own or ends one."""
    size = _bytes(column)
    starts = np.cumsum(size) - size
    edges = np.append(np.flatnonzero(np.diff(starts // BYTES, prepend=-1)), len(size)).tolist()
    for i, j in zip(edges, edges[1:], strict=False):
        yield i, j - i

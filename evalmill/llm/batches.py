"""Arrow batches cut to a size in bytes, so that work arrays stay small however long the texts are."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a piece, about; a single longer text is a piece of its own.
MOST = 4 << 20


def cuts(lengths: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """(first, rows) of runs of rows whose lengths add up to ``most`` at most, or that are one row."""
    ends = np.cumsum(lengths, dtype=np.int64)
    out, at = [], 0
    while at < len(lengths):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        out.append((at, stop - at))
        at = stop
    return out


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """The bytes of each text; 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The batches in pieces by the bytes of a text column; empty batches are left out."""
    for b in batches:
        for first, rows in cuts(byte_lengths(b.column(column)), most):
            yield b.slice(first, rows)

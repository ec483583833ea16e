"""Helpers for vectorised work on Arrow batches inside ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Gather small batches into tables of at least ``rows`` rows (the last may be smaller)."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """One int64 code per distinct combination of the named columns; nulls form their own value."""
    out = np.zeros(table.num_rows, np.int64)
    for name in names:
        col = table.column(name).combine_chunks()
        d = pc.dictionary_encode(col, null_encoding="encode")
        if isinstance(d, pa.ChunkedArray):
            d = d.combine_chunks()
        idx = np.asarray(d.indices.to_numpy(zero_copy_only=False), np.int64)
        size = len(d.dictionary) + 1
        if size > 1 and out.size and int(out.max()) > (1 << 62) // size:
            out = np.unique(out, return_inverse=True)[1]
        out = out * size + idx
    return out


def starts(*cols: np.ndarray) -> np.ndarray:
    """Mask of rows that begin a run of equal values in sorted columns."""
    first = np.zeros(len(cols[0]), bool)
    if len(first):
        first[0] = True
        for c in cols:
            first[1:] |= c[1:] != c[:-1]
    return first


def rank_in_run(first: np.ndarray) -> np.ndarray:
    """Position from 0 of each row in its run."""
    at = np.flatnonzero(first)
    return np.arange(len(first)) - np.repeat(at, np.diff(np.append(at, len(first))))

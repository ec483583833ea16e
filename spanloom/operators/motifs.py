"""Position-weight matrices: construction, tandem motifs, scanning and best hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODE = np.full(256, 4, np.int8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def flat_background() -> list[float]:
    return [0.25] * 4


def make(counts: list[list[int]], background: list[float]) -> np.ndarray:
    """Log-odds of each position (count plus background, over the position's sum, over background) and a fifth column, the expectation, for other letters."""
    c, bg = np.asarray(counts, float), np.asarray(background, float)
    r = np.log((c + bg) / c.sum(1, keepdims=True) / bg)
    return np.column_stack([r, (r[:, :-1] * bg[:-1]).sum(1) + r[:, -1] * bg[-1]])


def build(df: DataFrame, ident: str, counts: str, background: list[float]) -> DataFrame:
    """id, pos (from 0), base (ACGT, N for other letters), score of the matrix of each row of ``counts`` (ARRAY<ARRAY<INT>>); null and empty ones give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, m in zip(b.column("id").to_pylist(), b.column("m").to_pylist(), strict=True):
                w = make(m, background)
                n = w.size
                yield pa.record_batch([pa.array([i] * n, pa.int64()), pa.array(np.repeat(np.arange(len(w), dtype=np.int32), 5)), pa.array([*"ACGTN"] * len(w)), pa.array(w.ravel())], ["id", "pos", "base", "score"])

    src = df.where(F.col(ident).isNotNull() & (F.size(counts) > 0)).select(F.col(ident).cast("bigint").alias("id"), F.col(counts).alias("m"))
    return src.mapInArrow(run, "id bigint, pos int, base string, score double")


def reverse_complement(m: np.ndarray) -> np.ndarray:
    """Positions reversed, A and T exchanged, C and G exchanged."""
    return m[::-1][:, [3, 2, 1, 0, *range(4, m.shape[1])]]


def tandem(m1: np.ndarray, m2: np.ndarray, spacer: int, orientation: str = "direct") -> np.ndarray:
    """Two motifs with a spacer that scores nothing; ``everted`` turns the first, ``inverted`` the second."""
    if orientation not in ("direct", "everted", "inverted"):
        raise ValueError(orientation)
    a = reverse_complement(m1) if orientation == "everted" else m1
    b = reverse_complement(m2) if orientation == "inverted" else m2
    return np.vstack([a, np.zeros((spacer, 5)), b])


def scores(m: np.ndarray, seq: str) -> np.ndarray:
    """Score of every position the matrix fits on."""
    code = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(code) - len(m) + 1
    if n <= 0:
        return np.zeros(0)
    out = np.zeros(n)
    for j, row in enumerate(m):
        out += row[code[j : j + n]]
    return out


def _scan(df: DataFrame, ident: str, seq: str, pick) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, sc = [], [], []
            for i, s in zip(b.column("id").to_pylist(), b.column("s").to_pylist(), strict=True):
                p, x = pick(s)
                ids += [i] * len(p)
                at.append(p)
                sc.append(x)
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(sc).astype(float))], ["id", "pos", "score"])

    src = df.where(F.col(ident).isNotNull() & F.col(seq).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(seq).cast("string").alias("s"))
    return src.mapInArrow(run, "id bigint, pos int, score double")


def scan(df: DataFrame, ident: str, seq: str, matrix: np.ndarray, tolerance: float) -> DataFrame:
    """id, pos (from 0), score of every hit above ``tolerance``; a sequence shorter than the matrix has none."""

    def pick(s: str):
        x = scores(matrix, s)
        p = np.flatnonzero(x > tolerance)
        return p, x[p]

    return _scan(df, ident, seq, pick)


def best_hit(df: DataFrame, ident: str, seq: str, matrix: np.ndarray) -> DataFrame:
    """id, pos, score of the best hit of each sequence, the right-most of equal ones; no row for a sequence shorter than the matrix."""

    def pick(s: str):
        x = scores(matrix, s)
        p = np.flatnonzero(x == x.max())[-1:] if len(x) else np.zeros(0, np.int64)
        return p, x[p]

    return _scan(df, ident, seq, pick)

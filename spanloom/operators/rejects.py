"""Rows of text files that fail to parse, apart from the valid ones and with the reason.

Structural rejects come from the CSV reader's callback for invalid rows; every field is read as a string, and vectors of fields
are then tested and cast, so that the failing cell is known. The line's id travels as the first field.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: While the CSV reader has a line, control characters inside it stand as this character and a letter, and the character itself as it and ``e``.
_ESC = "\ue00d"
_STANDS = ((_ESC, "e"), ("\t", "t"), ("\r", "r"), ("\n", "n"), ("\0", "z"))


def digits(v: pa.Array) -> np.ndarray:
    return _mask(pc.match_substring_regex(v, "^[0-9]+$"))


def one_of(*values: str) -> Callable[[pa.Array], np.ndarray]:
    return lambda v: _mask(pc.is_in(v, pa.array(values)))


def bounded(lo: int, hi: int) -> Callable[[pa.Array], np.ndarray]:
    width = len(str(hi))

    def test(v: pa.Array) -> np.ndarray:
        short = pc.replace_substring_regex(v, "^0+([0-9])", r"\1")
        fits = digits(v) & _mask(pc.less_equal(pc.utf8_length(short), width))
        n = pc.cast(pc.if_else(pa.array(fits), short, "-1"), pa.int64()).to_numpy()
        return fits & (n >= lo) & (n <= hi)

    return test


def finite_decimal(v: pa.Array) -> np.ndarray:
    ok = _mask(pc.match_substring_regex(v, r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    plain = pc.if_else(pa.array(ok), pc.replace_substring_regex(v, r"^[+]|[.]($|[eE])", r"\1"), "nan")
    try:
        n = pc.cast(plain, pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # beyond what a double holds
        n = np.array([float(x) for x in plain.to_pylist()])
    return ok & np.isfinite(n)


def _mask(a) -> np.ndarray:
    return pc.fill_null(a, False).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Layout:
    """The columns of a kind of file. ``rest``: more columns may follow and are kept in ``others``. ``tests`` apply in order."""

    columns: tuple[str, ...]
    tests: tuple[tuple[str, Callable[[pa.Array], np.ndarray]], ...] = field(default=())
    rest: bool = False
    header: str = ""


def _parsed(ids: pa.Array, lines: pa.Array, layout: Layout) -> tuple[dict[str, pa.Array], list[int]]:
    """Fields of the rows with the right number of columns, with their id in ``__id``; the ids of the others."""
    n = len(layout.columns)
    for c, stand in _STANDS:
        if c != "\t":
            lines = pc.replace_substring(lines, c, _ESC + stand)
    if layout.rest:
        parts = pc.split_pattern(lines, "\t", max_splits=n - 1)
        lines = pc.binary_join(pa.ListArray.from_arrays(parts.offsets, pc.replace_substring(parts.flatten(), "\t", _ESC + "t")), "\t")
    rows = pc.binary_join_element_wise(pc.cast(ids, pa.string()), lines, "\t")
    data = ("\n".join(rows.to_pylist()) + "\n").encode()
    bad: list[int] = []

    def invalid(row: pcsv.InvalidRow) -> str:
        bad.append(int(row.text.split("\t", 1)[0]))
        return "skip"

    names = ["__id", *layout.columns]
    got = pcsv.read_csv(
        pa.BufferReader(data),
        pcsv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=names),
        pcsv.ParseOptions(delimiter="\t", quote_char=False, double_quote=False, escape_char=False, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=invalid),
        pcsv.ConvertOptions(column_types={c: pa.string() for c in layout.columns} | {"__id": pa.int64()}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    return {c: got.column(c).combine_chunks() for c in names}, bad


def _restored(v: pa.Array) -> pa.Array:
    for c, stand in reversed(_STANDS):
        v = pc.replace_substring(v, _ESC + stand, c)
    return v


def _loader(layouts: dict[str, Layout]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, lines = b.column("kind"), pc.replace_substring_regex(b.column("line"), "\r$", "")
            blank = _mask(pc.match_substring_regex(lines, r"^\s*$")) | _mask(pc.starts_with(lines, "#"))
            for kind, layout in layouts.items():
                here = _mask(pc.equal(kinds, kind)) & ~blank
                if layout.header:
                    here &= ~_mask(pc.starts_with(lines, layout.header))
                if not here.any():
                    continue
                take = pa.array(here)
                ids, raw = b.column("id").filter(take), lines.filter(take)
                cells, bad = _parsed(ids, raw, layout)
                at = cells["__id"].to_numpy()
                reason = np.full(len(at), "", object)
                # quotes are counted in the line itself
                where = pc.index_in(cells["__id"], ids)
                odd = pc.count_substring(raw.take(where), '"').to_numpy() % 2 == 1
                reason[odd] = "quoting"
                values = {c: cells[c] for c in layout.columns}
                others = pa.nulls(len(at), pa.string())
                if layout.rest and len(at):
                    last = layout.columns[-1]
                    # the first stand-in of a tab ends the last column
                    split = pc.split_pattern(values[last], _ESC + "t", max_splits=1)
                    more = pc.greater(pc.list_value_length(split), 1)
                    ends = split.offsets.to_numpy()
                    values[last], tail = split.values.take(pa.array(ends[:-1])), split.values.take(pa.array(ends[1:] - 1))
                    others = pc.if_else(more, tail, pa.scalar(None, pa.string()))
                values = {c: _restored(v) for c, v in values.items()}
                for name, test in layout.tests if len(at) else ():
                    reason[(reason == "") & ~test(values[name])] = name
                n = len(at) + len(bad)
                names = [*layout.columns, "others"]
                flat = [*values.values(), _restored(others)]
                keys = pa.array(names * len(at), pa.string())
                # cell (row, column) of the row-major map values
                order = np.arange(len(at) * len(names)).reshape(len(names), len(at)).T.ravel()
                vals = pa.concat_arrays([x.cast(pa.string()) for x in flat]).take(pa.array(order)) if len(at) else pa.array([], pa.string())
                offsets = pa.array(np.concatenate([np.arange(len(at) + 1) * len(names), np.full(len(bad), len(at) * len(names))]).astype(np.int32))
                cols = pa.MapArray.from_arrays(offsets, keys, vals)
                yield pa.record_batch(
                    [pa.array(np.concatenate([at, np.array(bad, np.int64)])), pa.array([kind] * n), pa.array([r or None for r in reason] + ["column_count"] * len(bad), pa.string()), cols],
                    names=["id", "kind", "reason", "cells"],
                )

    return run


def load_lines(df: DataFrame, ident: str, kind: str, line: str, layouts: dict[str, Layout]) -> DataFrame:
    """Every content line: id, kind, reason (null if it is valid), cells (map of its fields; empty if the columns don't fit).

    The reason is the first that applies of ``column_count``, ``quoting`` (a double quote without its partner) and the layout's tests in
    order, named by their field. A carriage return at the end isn't part of a line. Null and blank lines, lines that start with # and
    header lines give no row, nor do rows with a null id or a kind without layout. Ids are integers.
    """
    src = df.where(F.col(ident).isNotNull() & F.col(line).isNotNull() & F.col(kind).isin(*layouts))
    src = src.select(F.col(ident).cast("bigint").alias("id"), F.col(kind).cast("string").alias("kind"), F.col(line).cast("string").alias("line"))
    return src.mapInArrow(_loader(layouts), "id bigint, kind string, reason string, cells map<string,string>")

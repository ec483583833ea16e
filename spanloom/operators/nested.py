"""Deeply nested JSON records as related flat tables, by shared inlining.

The schema graph has one node per element (the field name of an object or a list) and one edge per parent and child. Elements
that are repeated, shared by several parents or recursive get their own table; all others are inlined into the table above
them. Every row knows its parent's table, row and the path by which it hangs there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import written

ROOT = "record"
#: A schema has fewer edges than this; more means that field names hold data, which no set of tables can have as columns.
MAX_EDGES = 100_000
_SHRED = "doc bigint, tab string, row_id bigint, parent_tab string, parent_id bigint, path string, ord int, shape string, cols map<string,string>"


@dataclass(frozen=True)
class Edge:
    parent: str
    child: str
    repeated: bool


def _load(text: str | None):
    try:
        # numbers stay as they were written
        x = json.loads(text, parse_int=str, parse_float=str) if text is not None else None
    except (ValueError, RecursionError) as e:
        return None, type(e).__name__
    return (x, None) if isinstance(x, (dict, list)) else (None, "not an object")


def _text(x) -> str | None:
    return None if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


def escaped(name: str) -> str:
    """A field name as a step of a path: dots part steps, so a dot in a name follows a backslash, as does a backslash."""
    return name.replace("\\", "\\\\").replace(".", "\\.") if "." in name or "\\" in name else name


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[str, str, bool]] = set()
    for b in batches:
        for text in b.column("payload").to_pylist():
            x, _ = _load(text)
            todo = [(ROOT, v) for v in (x if isinstance(x, list) else [x])] if x is not None else []
            while todo:
                name, v = todo.pop()
                if not isinstance(v, dict):
                    continue
                for k, w in v.items():
                    if isinstance(w, dict):
                        seen.add((name, k, False))
                        todo.append((k, w))
                    elif isinstance(w, list):
                        seen.add((name, k, True))
                        while any(isinstance(y, list) for y in w):
                            seen.add((k, k, True))
                            w = [z for y in w for z in (y if isinstance(y, list) else [y])]
                        todo += [(k, y) for y in w]
    p, c, r = zip(*seen, strict=True) if seen else ((), (), ())
    yield pa.record_batch([pa.array(p, pa.string()), pa.array(c, pa.string()), pa.array(r, pa.bool_())], ["parent", "child", "repeated"])


def schema_graph(df: DataFrame, payload: str) -> set[Edge]:
    """The edges that occur in all records; found on the executors, where repeats fall away."""
    found = df.select(F.col(payload).cast("string").alias("payload")).mapInArrow(_edges, "parent string, child string, repeated boolean")
    rows = found.groupBy("parent", "child").agg(F.max("repeated").alias("repeated")).limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError("field names seem to hold data: too many edges for a schema")
    return {Edge(r["parent"], r["child"], r["repeated"]) for r in rows}


def tables_of(edges: set[Edge]) -> set[str]:
    """Elements with a table of their own: the root, and those repeated, shared or on a cycle."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    own = {ROOT}
    for e in edges:
        parents.setdefault(e.child, set()).add(e.parent)
        children.setdefault(e.parent, set()).add(e.child)
        if e.repeated:
            own.add(e.child)
    own |= {c for c, p in parents.items() if len(p) > 1}
    for node in children:
        seen, todo = set(), [*children[node]]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += children.get(x, ())
        if node in seen:
            own.add(node)
    return own


def _shredder(own: set[str]):
    def record(doc: int, text: str | None) -> list[tuple]:
        x, why = _load(text)
        if why or x is None:
            return [(doc, "_invalid", 0, None, None, "", 0, "value", [("reason", why or "null")])]
        out: list[tuple] = []
        # value, element, parent table, parent row, path from the parent's row, position
        todo = [(v, ROOT, None, None, "", i) for i, v in enumerate(x if isinstance(x, list) else [x])]
        while todo:
            v, name, ptab, pid, path, i = todo.pop()
            row, cols = len(out), {}
            out.append((doc, name, row, ptab, pid, path, i, "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "value", cols))
            if isinstance(v, list):  # a list within a list is a row of its own, its elements hang below it
                todo += [(y, name, name, row, "", n) for n, y in enumerate(v) if y is not None]
                continue
            if not isinstance(v, dict):
                cols["value"] = _text(v)
                continue
            inner = [(v, "")]
            while inner:
                obj, at = inner.pop()
                for k, w in obj.items():
                    p = f"{at}.{escaped(k)}" if at else escaped(k)
                    if isinstance(w, list):
                        # null elements keep their position and give no row
                        todo += [(y, k, name, row, p, n) for n, y in enumerate(w) if y is not None]
                    elif isinstance(w, dict):
                        if k in own:
                            todo.append((w, k, name, row, p, 0))
                        else:
                            inner.append((w, p))
                    else:
                        cols[p] = _text(w)
        return [(*r[:8], [*r[8].items()]) for r in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("tab", pa.string()), ("row_id", pa.int64()), ("parent_tab", pa.string()), ("parent_id", pa.int64()),
                            ("path", pa.string()), ("ord", pa.int32()), ("shape", pa.string()), ("cols", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("payload").to_pylist(), strict=True):
                rows += record(doc, text)
                if len(rows) >= 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


class Shredded:
    """The flat tables of a column of JSON records; ``df(name)`` and ``links()`` give them.

    ``declared``: edges known beforehand, added to those that occur. ``inlined``: elements that as lone objects stay in the table above
    them wherever else they occur, so that their paths don't depend on the other records; in a list they are rows. Null payloads and payloads that aren't JSON objects or lists
    come out in table ``_invalid`` with their reason. A list of scalars is a table with a column ``value``; a list within a list is a row of
    the same table (``shape`` list) that its elements have as parent, with an empty path; a lone object is a list of one; null elements keep their position and give no row. Rows with a null id are left out.
    """

    def __init__(self, df: DataFrame, ident: str, payload: str, declared: set[Edge] = frozenset(), inlined: set[str] = frozenset()):
        src = df.where(F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("doc"), F.col(payload).cast("string").alias("payload"))
        self.edges = schema_graph(src, "payload") | set(declared)
        self.tables = tables_of(self.edges)
        self.rows = written(src.mapInArrow(_shredder(self.tables - set(inlined)), _SHRED), "shredded", "tab")

    def df(self, name: str, columns: dict[str, str] | None = None) -> DataFrame:
        """One table: doc, row_id, parent_tab, parent_id, path, ord, shape (object, list or value) and the named columns (column name -> inlined path, see :func:`escaped`)."""
        got = self.rows.where(F.col("tab") == name)
        return got.select("doc", "row_id", "parent_tab", "parent_id", "path", "ord", "shape", *(F.col("cols")[p].alias(c) for c, p in (columns or {}).items()))

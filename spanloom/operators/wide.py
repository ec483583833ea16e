"""Entity, attribute, value rows as one row per entity with typed columns.

The deciding row of each (entity, attribute) is found by a map-side combined aggregate, so an entity with very many rows sends only
its few attributes on. Rows sorted by entity are streamed, attributes as column indices, into columnar builders: a row index per
entity and column, with -1 for absent, becomes the validity mask and the typed buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.arrow import starts

_TYPES = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


@dataclass(frozen=True)
class Attr:
    """A column of the result: the spellings it stands for (normalised), its type, and a pattern whose match is the value."""

    names: tuple[str, ...]
    kind: str = "string"
    pattern: str = ""


def normalised(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\s_-]", "")


def _typed(v: pa.Array, kind: str) -> pa.Array:
    if kind == "string":
        return v
    if kind == "bigint":
        ok = pc.match_substring_regex(v, r"^[+-]?[0-9]+$")
        short = pc.replace_substring_regex(v, r"^[+-]?0*", "")
        most = pc.if_else(pc.starts_with(v, "-"), str(1 << 63), str((1 << 63) - 1))
        size = pc.utf8_length(short)
        ok = pc.and_(ok, pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(short, most))))
    elif kind == "double":
        ok = pc.match_substring_regex(v, r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    else:
        v = pc.utf8_lower(v)
        ok = pc.is_in(v, pa.array(["true", "false"]))
    return pc.cast(pc.replace_substring_regex(pc.if_else(ok, v, pa.scalar(None, pa.string())), r"^\+", ""), _TYPES[kind])


def _builder(columns: dict[str, Attr]):
    kinds = [a.kind for a in columns.values()]

    def block(t: pa.Table) -> pa.RecordBatch:
        e, c, v = t.column("entity").to_numpy(), t.column("c").to_numpy(), t.column("v").combine_chunks()
        first = starts(e)
        row = np.cumsum(first) - 1
        n = int(row[-1]) + 1
        at = np.full((len(kinds), n), -1, np.int64)
        real = c >= 0
        at[c[real], row[real]] = np.flatnonzero(real)
        out = [pa.array(e[first])]
        for k, kind in enumerate(kinds):
            out.append(_typed(v.take(pa.array(at[k], mask=at[k] < 0)), kind))
        return pa.record_batch(out, ["entity", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            e = t.column("entity").to_numpy()
            cut = int(np.searchsorted(e, e[-1]))  # the last entity may go on
            if cut:
                yield block(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield block(held)

    return run


def widen(df: DataFrame, entity: str, attribute: str, value: str, order: str, columns: dict[str, Attr], absent: tuple[str, ...] = ("", "-")) -> DataFrame:
    """One row per entity with a typed column for each of ``columns``.

    Attribute names are the same if they differ only in case, blanks, hyphens or underscores. The row with the highest ``order`` decides (of
    equal ones the greatest value); values are trimmed, and null and those in ``absent`` mean that the entity doesn't have the attribute. A value
    that doesn't fit the type is absent too. Entities without any of the attributes have a row of nulls; null entities are left out.
    """
    name = normalised(F.col(attribute))
    index = F.lit(-1)
    for i, a in enumerate(columns.values()):
        index = F.when(name.isin(*a.names), i).otherwise(index)
    index = F.coalesce(F.when(name.isNull(), -1).otherwise(index), F.lit(-1)).cast("int")
    rows = df.where(F.col(entity).isNotNull()).select(F.col(entity).cast("bigint").alias("entity"), index.alias("c"), F.col(order).alias("o"), F.regexp_replace(F.col(value).cast("string"), r"^\s+|\s+$", "").alias("v"))
    rows = rows.withColumn("v", F.when((F.col("c") < 0) | F.col("v").isin(*absent), None).otherwise(F.col("v")))
    last = rows.groupBy("entity", "c").agg(F.max(F.struct("o", "v")).alias("x")).select("entity", "c", F.col("x.v").alias("v"))
    for i, a in enumerate(columns.values()):
        if a.pattern:
            hit = F.regexp_extract("v", a.pattern, 0)
            last = last.withColumn("v", F.when(F.col("c") == i, F.when(hit != "", hit)).otherwise(F.col("v")))
    schema = "entity bigint, " + ", ".join(f"`{c}` {a.kind}" for c, a in columns.items())
    wide = last.repartition("entity").sortWithinPartitions("entity", "c").mapInArrow(_builder(columns), schema)
    return wide.withColumnRenamed("entity", entity)

"""Continuous blocks of intervals per key, and the gaps between them, by dyadic decomposition.

Every half-open integer interval is the union of few canonical dyadic blocks (a power of two long, aligned to it). Blocks nest or
are disjoint, so those covered by an ancestor fall away, two siblings become their parent, and adjacent blocks form a run. This is
done in each map task first and again per zone, a stretch of the coordinates between two quantiles, so that neither a hot key nor a hot
stretch reaches one task whole, however far out single intervals lie. Only the outermost runs of each zone, two at most, are joined over zone borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.arrow import chunks, codes, starts
from spanloom.operators.ordered import borders
from spanloom.runtime import spread, written

CHUNK_ROWS = 200_000
#: Zones reach so far to both sides; what lies beyond is joined with the outermost runs.
_LIMIT = 1 << 61


def _floor_power(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> s)
    return x - (x >> 1)


def decomposed(g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical dyadic blocks (group, start, size) of half-open intervals."""
    out = []
    while len(g):
        low = lo & -lo
        size = _floor_power(hi - lo)
        size = np.where((low != 0) & (low < size), low, size)
        out.append((g, lo, size))
        lo = lo + size
        on = lo < hi
        g, lo, hi = g[on], lo[on], hi[on]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (g, lo, hi)


def condensed(g: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint blocks in order: those covered by an ancestor removed, siblings merged upward."""
    if not len(g):
        return g, start, size
    by = np.lexsort((-size, start, g))
    g, start, size = g[by], start[by], size[by]
    end = np.unique(start + size, return_inverse=True)[1]
    group = np.cumsum(starts(g)) - 1
    reach = np.maximum.accumulate(group * len(g) + end)
    keep = np.ones(len(g), bool)
    keep[1:] = (group[1:] * len(g) + end[1:]) > reach[:-1]
    g, start, size = g[keep], start[keep], size[keep]
    while True:
        pair = np.zeros(len(g), bool)
        pair[:-1] = (g[1:] == g[:-1]) & (size[1:] == size[:-1]) & (start[:-1] + size[:-1] == start[1:]) & ((start[:-1] & (2 * size[:-1] - 1)) == 0)
        if not pair.any():
            return g, start, size
        size = np.where(pair, 2 * size, size)
        keep = np.ones(len(g), bool)
        keep[1:] = ~pair[:-1]
        g, start, size = g[keep], start[keep], size[keep]


def _blocks(keys: list[str], at: list[int]):
    border = np.array(at, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_ROWS):
            c = codes(t, keys)
            lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
            heads, g = np.unique(c, return_index=True, return_inverse=True)[1:]
            by = np.lexsort((hi, lo, g))
            by = by[starts(g[by], lo[by], hi[by])]
            g, lo, hi = g[by], lo[by], hi[by]
            # an interval is cut where zones meet
            zone = np.searchsorted(border, lo, "right")
            n = np.searchsorted(border, hi - 1, "right") - zone + 1
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            g, zone, whole = np.repeat(g, n), np.repeat(zone, n) + nth, np.repeat(n, n)
            lo = np.where(nth == 0, np.repeat(lo, n), border[np.maximum(zone - 1, 0)] if len(border) else 0)
            hi = np.where(nth == whole - 1, np.repeat(hi, n), border[np.minimum(zone, len(border) - 1)] if len(border) else 0)
            g, start, size = condensed(*decomposed(g * (len(border) + 1) + zone, lo, hi))
            g, zone = g // (len(border) + 1), g % (len(border) + 1)
            head = t.select(keys).take(pa.array(heads[g]))
            yield from pa.table([*(head.column(k) for k in keys), pa.array(zone.astype(np.int64)), pa.array(start), pa.array(size)], names=[*keys, "zone", "start", "size"]).combine_chunks().to_batches()

    return run


def _runs(keys: list[str]):
    names = [*keys, "zone"]

    def runs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = codes(t, names)
        heads, g = np.unique(c, return_index=True, return_inverse=True)[1:]
        g, start, size = condensed(g, t.column("start").to_numpy(), t.column("size").to_numpy())
        first = starts(g)
        first[1:] |= start[1:] != (start + size)[:-1]
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(g)) - 1
        g, lo, hi = g[at], start[at], (start + size)[last]
        head, tail = starts(g), np.append(starts(g)[1:], True)
        outer = head | tail
        follows = np.flatnonzero(~head)  # a gap lies before these runs
        who = np.concatenate([g, g[follows]])
        top = t.select(names).take(pa.array(heads[who]))
        kind = np.concatenate([np.where(outer, 0, 1), np.full(len(follows), 2)]).astype(np.int32)  # 0: outermost run, 1: block, 2: gap
        cols = [*(top.column(k) for k in names), pa.array(kind), pa.array(np.concatenate([lo, hi[follows - 1]])), pa.array(np.concatenate([hi, lo[follows]]))]
        yield from pa.table(cols, names=[*names, "kind", "lo", "hi"]).combine_chunks().to_batches()

    def shrunk(t: pa.Table) -> pa.Table:
        """The blocks of one zone, condensed, so that what is held is bounded by the zone."""
        _, start, size = condensed(np.zeros(t.num_rows, np.int64), t.column("start").to_numpy(), t.column("size").to_numpy())
        head = t.select(names).take(pa.array(np.zeros(len(start), np.int64)))
        return head.append_column("start", pa.array(start)).append_column("size", pa.array(size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for t in chunks(batches, CHUNK_ROWS):
            t = t if held is None else pa.concat_tables([held, t])
            cut = int(np.flatnonzero(starts(codes(t, names)))[-1])  # the last zone may go on
            if cut:
                yield from runs(t.slice(0, cut))
            held = shrunk(t.slice(cut))
        if held is not None:
            yield from runs(held)

    return run


def blocks_and_gaps(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """``keys``, kind (``block`` or ``gap``), lo, hi (half-open): continuous blocks of each key and the gaps between neighbours.

    Overlapping, nested and touching intervals form one block. Rows with a null bound or ``hi`` <= ``lo`` take no part. Intervals are cut at
    +-2**61, and the parts beyond are gathered per key, one for each ``lo``. Keys keep their types; a null key is a key of its own. A key of one block has no gap; an empty table gives no rows.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi"))
    rows = rows.where("lo < hi")
    part = lambda least, most: F.struct(F.greatest("lo", F.lit(least)).alias("lo"), F.least("hi", F.lit(most)).alias("hi"))
    inside = rows.select(*ks, part(-_LIMIT, _LIMIT).alias("p"), ((F.col("lo") < -_LIMIT) | (F.col("hi") > _LIMIT)).alias("far"))
    met = F.when(F.col("p.lo") < F.col("p.hi"), F.col("p"))
    span = inside.agg(F.avg(met["hi"] - met["lo"]).alias("mean"), F.max("far").alias("far")).first()
    inside = inside.select(*ks, "p.lo", "p.hi").where("lo < hi")
    # few intervals cross from one zone to the next
    at = borders(inside, "lo", 1 << min(60, int(8 * (span["mean"] or 1)).bit_length()))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in ks)
    cut = spread(inside).mapInArrow(_blocks(ks, at), f"{key_schema}, zone bigint, start bigint, size bigint")
    runs = cut.repartition(*ks, "zone").sortWithinPartitions(*ks, "zone").mapInArrow(_runs(ks), f"{key_schema}, zone bigint, kind int, lo bigint, hi bigint")
    runs = written(runs, "runs")
    if span["far"]:
        beyond = rows.select(*ks, F.inline(F.array(part(-(1 << 63), -_LIMIT), part(_LIMIT, (1 << 63) - 1)))).where("lo < hi").groupBy(*ks, "lo").agg(F.max("hi").alias("hi"))
        runs = runs.unionByName(beyond.select(*ks, F.lit(None).cast("bigint").alias("zone"), F.lit(0).alias("kind"), "lo", "hi"))
    w = Window.partitionBy(*ks).orderBy("lo")
    # runs of zones are disjoint, parts beyond them may overlap
    before, zone_before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lag("zone").over(w)
    outer = runs.where("kind = 0").withColumns({"before": before, "zone_before": zone_before})
    outer = outer.withColumn("begins", F.col("before").isNull() | (F.col("lo") > F.col("before")))
    joined = outer.withColumn("island", F.sum(F.col("begins").cast("int")).over(w)).groupBy(*ks, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = ["kind", "lo", "hi"]
    parts = [
        joined.select(*ks, F.lit("block").alias("kind"), "lo", "hi"),
        outer.where("begins AND before IS NOT NULL AND coalesce(zone <> zone_before, true)").select(*ks, F.lit("gap").alias("kind"), F.col("before").alias("lo"), F.col("lo").alias("hi")),
        runs.where("kind > 0").select(*ks, F.when(F.col("kind") == 1, "block").otherwise("gap").alias("kind"), "lo", "hi"),
    ]
    got = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return got.toDF(*keys, *out)

"""Exact percentiles of groups of any size by one distributed sort, and summaries of days that can be combined.

All values are range-partitioned and sorted by (group, value, id); every partition is written with the running count of
its rows. The rows a group has in each partition, and where they start there, give the partition and position of every
target rank; the rows at these positions are joined and the two neighbouring order statistics interpolated. It doesn't
matter which task reads which part of a partition, and no group is ever held by one task or by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.arrow import chunks, codes, starts
from spanloom.runtime import written

CHUNK_ROWS = 100_000
_GROUP = ["src", "dim", "grp"]
_ROW = "src string, dim string, grp string, value double, id bigint"


def measured(df: DataFrame, src: str, dims: dict[str, Column], value: str, ident: str) -> DataFrame:
    """One row per valid value and dimension: src, dim, grp, value, id.

    Null, NaN and negative values, null ids and null groups don't count.
    """
    v = F.col(value).cast("double")
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), c.cast("string").alias("grp")) for d, c in dims.items()))
    flat = df.where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & F.col(ident).isNotNull()).select(pairs.alias("p"), v.alias("value"), F.col(ident).cast("bigint").alias("id"))
    return flat.select(F.lit(src).alias("src"), F.inline("p"), F.col("value"), F.col("id")).where("grp IS NOT NULL").select("src", "dim", "grp", (F.col("value") + 0.0).alias("value"), "id")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop repeated rows (neighbours after the sort) and add the partition and the running count within it."""
    pid, done, last = TaskContext.get().partitionId(), 0, None
    for t in chunks(batches, CHUNK_ROWS):
        g, v, i = codes(t, ["src", "dim", "grp"]), t.column("value").to_numpy(), t.column("id").to_numpy()
        keep = starts(g, v, i)
        key = lambda k: tuple(t.column(c)[k].as_py() for c in ("src", "dim", "grp", "value", "id"))
        if last is not None and key(0) == last:
            keep[0] = False
        last = key(t.num_rows - 1)
        t = t.filter(pa.array(keep)).drop_columns("id")
        n = t.num_rows
        t = t.append_column("pid", pa.array(np.full(n, pid, np.int32))).append_column("pos", pa.array(np.arange(done, done + n, dtype=np.int64)))
        done += n
        yield from t.to_batches()


class Sorted:
    """Values sorted by group and value over all partitions, with what is needed to find any position."""

    def __init__(self, rows: DataFrame):
        order = [*_GROUP, "value", "id"]
        numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "src string, dim string, grp string, value double, pid int, pos bigint")
        self.table = written(numbered, "sorted")
        per = self.table.groupBy(*_GROUP, "pid").agg(F.count("*").alias("have"), F.min("pos").alias("start"))
        # one row for each partition that a group reaches into
        w = Window.partitionBy(*_GROUP)
        before = F.coalesce(F.sum("have").over(w.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        #: src, dim, grp, n, pid, have, start, offset: the group's rows in all and in the partition, where they start there, and how many come before
        self.parts = per.select(*_GROUP, F.sum("have").over(w).alias("n"), "pid", "have", "start", before.alias("offset"))

    def at(self, qs: list[float]) -> DataFrame:
        """src, dim, grp, n, q, value: each quantile by linear interpolation between neighbouring order statistics."""
        h = (F.col("n") - 1) * F.col("q")
        ranks = self.parts.withColumn("q", F.explode(F.array(*(F.lit(q) for q in qs)))).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))))
        here = ranks.where((F.col("rank") >= F.col("offset")) & (F.col("rank") < F.col("offset") + F.col("have")))
        targets = here.select(*_GROUP, "n", "q", "pid", (F.col("start") + F.col("rank") - F.col("offset")).alias("pos"))
        both = self.table.select("pid", "pos", "value").join(targets, ["pid", "pos"]).groupBy(*_GROUP, "n", "q").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        return both.select(*_GROUP, "n", "q", (F.col("lo") + (F.col("hi") - F.col("lo")) * (h - F.floor(h))).alias("value"))


def percentiles(rows: DataFrame, qs: list[float]) -> DataFrame:
    """Exact percentiles of each (src, dim, grp) in ``rows`` (see :func:`measured`): src, dim, grp, n, q, value.

    Rows with equal src, dim, grp, value and id count once. A group of one value gives it for every q; an empty table gives
    no rows. Ties cost nothing: equal values are split between partitions by id.
    """
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    return Sorted(rows).at(sorted(set(map(float, qs))))


def summaries(rows: DataFrame, points: int = 100) -> DataFrame:
    """A mergeable summary of each group: src, dim, grp, n, points (order statistics at equal steps of rank), error.

    The points are the values at ranks 0, 1/points, ... 1 of the group, found exactly. Any number of summaries may be combined
    by :func:`merged`; a rank found in the combination is off by at most ``1/points`` of the combined count (plus one rank a
    summary), whatever their sizes. A summary of at most ``points`` + 1 values per group repeats some of them.
    """
    at = Sorted(rows).at([k / points for k in range(points + 1)])
    got = at.groupBy("src", "dim", "grp", "n").agg(F.array_sort(F.collect_list("value")).alias("points"))
    return got.withColumn("error", F.lit(1.0 / points))


def merged(summary: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """Percentiles of the union of all summaries with equal ``keys``: keys, n, q, value.

    Each summary of n values and k + 1 points stands for its value at rank r with k steps of n/k values between the points;
    the lower edge of each step carries its weight half way. What is gathered for a key is bounded by summaries times points,
    never by values; weights are summed per distinct value before the window.
    """
    k = F.size("points") - 1
    inner = summary.select(*keys, "n", F.posexplode("points").alias("i", "value"), k.alias("k"))
    weight = F.col("n") / F.col("k") * F.when((F.col("i") == 0) | (F.col("i") == F.col("k")), 0.5).otherwise(1.0)
    pts = inner.select(*keys, "value", weight.alias("w")).groupBy(*keys, "value").agg(F.sum("w").alias("w"))
    w = Window.partitionBy(*keys).orderBy("value")
    cum = pts.withColumn("hi", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = summary.groupBy(*keys).agg(F.sum("n").alias("n"))
    targets = total.select(*(F.col(c).alias("t_" + c) for c in keys), "n", F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("q"))
    on = [F.col(c).eqNullSafe(F.col("t_" + c)) for c in keys]
    # the first point whose weight up to it reaches the target rank
    reach = cum.join(targets, on).where(F.col("hi") >= F.col("q") * F.col("n") * (1 - 1e-12))
    return reach.groupBy(*keys, "n", "q").agg(F.min("value").alias("value"))

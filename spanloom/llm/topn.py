"""Top N items of every group by partition lower bounds.

Every partition finds its local best N distinct items of each group. The N-th of them is a valid bound for the whole
group: N distinct items at least as good exist. The best bound of each group is joined to the candidates, rows behind it
are dropped before the shuffle, and the few survivors are ranked. A hot group never reaches one task whole: it sends at
most N rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.arrow import chunks, codes, rank_in_run, starts
from spanloom.runtime import written

#: Rows sorted at once by a Python worker.
CHUNK_ROWS = 200_000
#: Bounds are broadcast up to so many measured bytes; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _best(t: pa.Table, groups: list[str], keys: list[str], n: int) -> pa.Table:
    g = codes(t, groups)
    k = [t.column(c).to_numpy() for c in keys]
    ident = t.column("__id").to_numpy()
    # the best row of each item
    order = np.lexsort((*reversed(k), ident, g))
    order = order[starts(g[order], ident[order])]
    g, ident, k = g[order], ident[order], [x[order] for x in k]
    by = np.lexsort((ident, *reversed(k), g))
    at = rank_in_run(starts(g[by]))
    keep = at < n
    out = t.take(pa.array(order[by[keep]])).drop_columns("__nth")
    return out.append_column("__nth", pa.array(at[keep] == n - 1))


def _local(groups: list[str], keys: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, rows = None, [], 0
        for t in chunks(batches, CHUNK_ROWS):
            held.append(_best(t, groups, keys, n))
            rows += held[-1].num_rows
            if rows > 2 * max(CHUNK_ROWS, state.num_rows if state is not None else 0):
                state = _best(pa.concat_tables([*([state] if state is not None else []), *held]), groups, keys, n)
                held, rows = [], 0
        if state is not None or held:
            state = _best(pa.concat_tables([*([state] if state is not None else []), *held]), groups, keys, n)
            yield from state.to_batches(max_chunksize=50_000)

    return run


def top_n(df: DataFrame, groups: list[str], scores: list[str], ident: str, n: int, rank_name: str = "rnk") -> DataFrame:
    """The ``n`` best items of every group with their rank from 1.

    Order: each of ``scores`` descending (null and NaN last), then ``ident`` ascending. Rows whose first score is null or
    NaN, or whose ``ident`` is null, take no part. An item repeated within a group counts once, by its best row. A null
    in a group column is a group value of its own. Groups with fewer than ``n`` items come out whole, an empty table
    gives an empty result. Returns the group columns, ``rank_name`` and ``ident``.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    gs = [f"__g{i}" for i in range(len(groups))]
    cols, keys = [F.col(c).alias(g) for c, g in zip(groups, gs, strict=True)], []
    for i, s in enumerate(scores):
        x = F.col(s).cast("double")
        absent = x.isNull() | F.isnan(x)
        cols += [F.when(absent, 1).otherwise(0).cast("int").alias(f"__m{i}"), F.when(absent, 0.0).otherwise(F.lit(0.0) - x).alias(f"__k{i}")]
        keys += [f"__m{i}", f"__k{i}"]
    rows = df.select(*cols, F.col(ident).cast("bigint").alias("__id"), F.lit(False).alias("__nth")).where("__m0 = 0 AND __id IS NOT NULL")
    # the candidates are written once, for the bounds and for the rows behind them
    local = written(rows.mapInArrow(_local(gs, keys, n), rows.schema), "candidates")
    order = [*keys, "__id"]
    bounds = written(local.where("__nth").groupBy(*gs).agg(F.min(F.struct(*order)).alias("__bound")), "bounds")
    texts = sum((F.coalesce(F.octet_length(F.col(g).cast("string")), F.lit(0)) for g in gs), F.lit(64 + 16 * len(order)))
    hint = F.broadcast if (bounds.agg(F.sum(texts).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES else (lambda d: d)
    b = hint(bounds.select(*(F.col(g).alias(g + "b") for g in gs), "__bound"))
    on = [F.col(g).eqNullSafe(F.col(g + "b")) for g in gs]
    alive = local.join(b, on, "left").where(F.col("__bound").isNull() | (F.struct(*order) <= F.col("__bound"))).select(*gs, *order)
    single = alive.repartition(*gs).groupBy(*gs, "__id").agg(F.min(F.struct(*keys)).alias("__k")).select(*gs, "__id", "__k.*")
    w = Window.partitionBy(*gs).orderBy(*order)
    return (
        single.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
        .select(*(F.col(g).alias(c) for c, g in zip(groups, gs, strict=True)), F.col("__r").alias(rank_name), F.col("__id").alias(ident))
    )

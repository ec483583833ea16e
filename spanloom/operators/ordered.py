"""Running sums over a global order, or per key over positions, without a window that holds a whole table or key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.arrow import codes, starts
from spanloom.runtime import written

#: Stretches that all positions are divided into, with about equally many rows each.
STRETCHES = 1024
#: Rows of a stretch at least.
ROWS = 65_536
#: Share of the rows that borders are drawn from; they decide how even the stretches are, never a result.
SAMPLE = 0.1
#: Borders that are compared at once.
_STEP = 32


def borders(df: DataFrame, pos: str, least: int = 1) -> list[int]:
    """Sorted positions that divide the rows into stretches of about equal numbers (ROWS or more; at most STRETCHES), whatever lies far out; multiples of ``least``."""
    at = [k / STRETCHES for k in range(1, STRETCHES)]
    got = df.sample(SAMPLE, 7).agg(F.percentile_approx(pos, at, 2 * STRETCHES).alias("q"), F.count(pos).alias("n")).first()
    if not got["q"]:
        return []
    number = min(STRETCHES, int(got["n"] / SAMPLE) // ROWS)
    return sorted({got["q"][STRETCHES * k // number - 1] // least * least for k in range(1, number)})


def stretch_of(pos: Column, at: list[int]) -> Column:
    """Number of borders at or below ``pos``, by two rounds of comparisons."""
    if not at:
        return F.lit(0)
    lists = lambda xs: "array(" + ", ".join(f"CAST({x} AS BIGINT)" if x < 0 else f"{x}L" for x in xs) + ")"
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= pos))
    if len(at) <= _STEP:
        return below(F.expr(lists(at)))
    groups = [at[k : k + _STEP] for k in range(0, len(at), _STEP)]
    group = F.greatest(below(F.expr(lists([g[0] for g in groups]))), F.lit(1)) - 1
    return group * _STEP + below(F.get(F.expr("array(" + ", ".join(map(lists, groups)) + ")"), group))


def _cumulated(values: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, done = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for b in batches:
            t = pa.Table.from_batches([b])
            for v in values:
                run_ = np.cumsum(b.column(v).to_numpy(zero_copy_only=False)) + done[v]
                done[v] = run_[-1] if len(run_) else done[v]
                t = t.append_column(f"{v}_to", pa.array(run_))
            yield from t.append_column("__pid", pa.array(np.full(b.num_rows, pid, np.int32))).to_batches()

    return run


def prefix_sums(df: DataFrame, order: list[str], values: list[str], descending: bool = False) -> DataFrame:
    """Adds ``<v>_to`` for each of ``values`` (BIGINT or DOUBLE, not null): the sum over all rows up to and including this one.

    Rows must be unique in ``order`` (aggregate first), which also makes the range partitions even. The rows are range-partitioned and written with
    local sums; what is gathered between partitions is one row of totals a partition.
    """
    cols = [F.desc(c) if descending else F.asc(c) for c in order]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + "".join(f", `{v}_to` {kinds[v]}" for v in values) + ", __pid int"
    local = written(df.repartitionByRange(*cols).sortWithinPartitions(*cols).mapInArrow(_cumulated(values), schema), "ordered")
    totals = local.groupBy("__pid").agg(*(F.sum(v).alias(v) for v in values))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__pid", *(F.coalesce(F.sum(v).over(w), F.lit(0)).cast(kinds[v]).alias(f"__{v}") for v in values))
    # one row a partition: bounded by the number of partitions
    both = local.join(F.broadcast(before), "__pid")
    return both.select(*df.columns, *((F.col(f"{v}_to") + F.col(f"__{v}")).alias(f"{v}_to") for v in values))


def carried(df: DataFrame, order: list[str], mark: Column, state: Column, reset: list[str], counted: Column) -> DataFrame:
    """Adds ``carried``: ``state`` (a struct) of the last row at or before this one in ``order`` for which ``mark`` holds and whose ``reset`` columns are equal, null before the first;
    and ``since``: how many rows after that one, up to this, satisfy ``counted`` (before the first mark, since the first row).

    Rows must be unique in ``order``, which begins with the ``reset`` columns; a marked row isn't counted. They are range-partitioned and filled within each
    partition; of a partition only its last row is gathered, for the rows of the next ones that come before their first mark.
    """
    rows = df.withColumns({"__s": F.when(mark, state), "__n": F.when(counted & ~mark, 1).otherwise(0).cast("bigint")})
    cols = [F.asc(c) for c in order]
    kind = rows.schema["__s"].dataType.simpleString()
    filled = rows.repartitionByRange(*cols).sortWithinPartitions(*cols).mapInArrow(_filled(reset), f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, __s {kind}, __n bigint, __pid int, __last boolean")
    local = written(filled, "carried")
    # one row a partition
    runs = [f"__r{i}" for i in range(len(reset))]
    last = local.where("__last").select("__pid", *(F.col(c).alias(r) for c, r in zip(reset, runs, strict=True)), F.col("__s").alias("__end"), F.col("__n").alias("__more"))
    w = Window.partitionBy(*runs).orderBy("__pid")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ends = last.withColumn("__turn", F.count("__end").over(upto)).withColumns({"__end": F.last("__end", True).over(upto), "__more": F.sum("__more").over(Window.partitionBy(*runs, "__turn").orderBy("__pid").rowsBetween(Window.unboundedPreceding, 0)), "__to": F.lead("__pid").over(w)})
    ends = ends.select(*runs, "__end", "__more", F.col("__pid").alias("__from"), "__to")
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in zip(reset, runs, strict=True)]
    before = local.where("__s IS NULL").join(F.broadcast(ends), [*same, F.col("__pid") > F.col("__from"), F.col("__to").isNull() | (F.col("__pid") <= F.col("__to"))], "left")
    own = local.where("__s IS NOT NULL").select(*df.columns, F.col("__s").alias("carried"), F.col("__n").alias("since"))
    return own.unionByName(before.select(*df.columns, F.col("__end").alias("carried"), (F.col("__n") + F.coalesce("__more", F.lit(0))).alias("since")))


def _filled(reset: list[str]):
    """Forward fill of ``__s``, and counts of ``__n`` since, within runs of equal ``reset`` columns of a sorted partition; its last row is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, key, state, more, held = TaskContext.get().partitionId(), None, None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield _with(*held, pid, False)
            t = pa.Table.from_batches([b])
            s, n = t.column("__s").combine_chunks(), t.column("__n").to_numpy()
            there, rows = s.is_valid().to_numpy(zero_copy_only=False), np.arange(b.num_rows)
            begin = np.maximum.accumulate(np.where(starts(codes(t, reset)), rows, 0))
            at = np.maximum.accumulate(np.where(there, rows, -1))
            at = np.where(at >= begin, at, -1)
            # rows of the run that the batch before ended with go on from its end
            goes_on = (begin == 0) & (at < 0) & (tuple(t.column(c)[0].as_py() for c in reset) == key)
            filled = s.take(pa.array(np.where(at >= 0, at, 0), mask=at < 0))
            if state is not None and goes_on.any():
                filled = pa.compute.if_else(pa.array(goes_on), pa.scalar(state, s.type), filled)
            upto = np.concatenate([[0], np.cumsum(n)])
            since = upto[1:] - upto[np.where(at >= 0, at, begin)] + np.where(goes_on, more, 0)
            key, state, more = tuple(t.column(c)[-1].as_py() for c in reset), filled[-1].as_py(), int(since[-1])
            held = t, filled, since
        if held is not None:
            yield _with(*held, pid, True)

    return run


def _with(t: pa.Table, s: pa.Array, since: np.ndarray, pid: int, last: bool) -> pa.RecordBatch:
    mark = np.zeros(t.num_rows, bool)
    mark[-1] = last
    for name, col in (("__s", s), ("__n", pa.array(since.astype(np.int64))), ("__pid", pa.array(np.full(t.num_rows, pid, np.int32))), ("__last", pa.array(mark))):
        t = (t.drop_columns([name]) if name in t.column_names else t).append_column(name, col)
    return t.combine_chunks().to_batches()[0]


def _sums(events: DataFrame, keys: list[str], pos: str, deltas: list[str]) -> DataFrame:
    """Events combined per position, in their stretches, each with the totals of the stretches before it (``__sum_``) and the first position after its stretch (``__next``)."""
    at = borders(events.where(F.col(pos).isNotNull()), pos)
    ev = events.withColumn("__b", stretch_of(F.col(pos), at)).groupBy(*keys, "__b", pos).agg(*(F.sum(d).alias(d) for d in deltas)).repartition(*keys, "__b")
    w = Window.partitionBy(*keys).orderBy("__b")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    per = ev.groupBy(*keys, "__b").agg(*(F.sum(d).alias(d) for d in deltas), F.min(pos).alias("__first"))
    per = per.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__b").alias("__bb"), *(F.coalesce(F.sum(d).over(upto), F.lit(0)).alias(f"__sum_{d}") for d in deltas), F.lead("__first").over(w).alias("__next"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__b") == F.col("__bb")]
    return ev.join(per, on)


def stepped(events: DataFrame, keys: list[str], pos: str, deltas: list[str]) -> DataFrame:
    """keys, pos, next_pos and the running sum of each delta up to pos, per key in order of pos (BIGINT); one row a position.

    Deltas are combined per position before they are shuffled. Running sums are taken per stretch of positions, and each stretch starts from the
    totals of those before it, so a hot key is spread over many tasks, and stretches have about equally many rows.
    """
    inner = Window.partitionBy(*keys, "__b").orderBy(pos)
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    got = _sums(events, keys, pos, deltas)
    return got.select(*keys, pos, F.coalesce(F.lead(pos).over(inner), F.col("__next")).alias("next_pos"), *((F.sum(d).over(run) + F.col(f"__sum_{d}")).alias(d) for d in deltas))


def stretches_where(events: DataFrame, keys: list[str], pos: str, deltas: list[str], keep: Callable[..., Column]) -> DataFrame:
    """keys, begin, end: the longest half-open stretches of positions on which ``keep(running sums)`` holds; it must not hold where all sums are 0.

    Within a stretch of the input only positions at which ``keep`` turns matter; what is open at its end is closed by the first turn of a later
    stretch, so that at most two rows a key and stretch meet in a window.
    """
    inner = Window.partitionBy(*keys, "__b").orderBy(pos)
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    got = _sums(events, keys, pos, deltas)
    sums = got.select(*keys, "__b", pos, keep(*(F.sum(d).over(run) + F.col(f"__sum_{d}") for d in deltas)).alias("__in"), keep(*(F.col(f"__sum_{d}") for d in deltas)).alias("__before"))
    turns = sums.withColumn("__was", F.coalesce(F.lag("__in").over(inner), F.col("__before"))).where("__in <> __was")
    # written, as it is read twice and costs more than its size
    turns = written(turns.select(*keys, F.col(pos).alias("begin"), "__in", F.lead(pos).over(inner).alias("end"), F.lag(pos).over(inner).isNull().alias("__leads")), "turns")
    closed = turns.where("__in AND end IS NOT NULL").select(*keys, "begin", "end")
    over = turns.where("__in AND end IS NULL OR NOT __in AND __leads")
    open_ = over.withColumn("end", F.lead("begin").over(Window.partitionBy(*keys).orderBy("begin"))).where("__in AND end IS NOT NULL").select(*keys, "begin", "end")
    return closed.unionByName(open_)

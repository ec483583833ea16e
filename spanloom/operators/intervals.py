"""Interval algebra per key on closed integer ranges [lo, hi].

Rows with a null bound or hi < lo take no part. Nothing here gathers a whole key in one task: set operations work on stretches of positions,
joins on bins, merging on dyadic zones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.dyadic import blocks_and_gaps
from spanloom.operators.ordered import borders, stepped, stretch_of, stretches_where

def valid(df: DataFrame) -> DataFrame:
    return df.where("lo <= hi")


def merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Canonical set: overlapping and adjacent ranges of a key joined. keys, lo, hi."""
    got = blocks_and_gaps(valid(df).select(*keys, "lo", (F.col("hi") + 1).alias("hi")), keys, "lo", "hi")
    return got.where("kind = 'block'").select(*keys, "lo", (F.col("hi") - 1).alias("hi"))


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """The ranges between the neighbours of a key's canonical set."""
    got = blocks_and_gaps(valid(df).select(*keys, "lo", (F.col("hi") + 1).alias("hi")), keys, "lo", "hi")
    return got.where("kind = 'gap'").select(*keys, "lo", (F.col("hi") - 1).alias("hi"))


def complement(df: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """What the set leaves of [least, most]; only keys that occur."""
    ends = valid(df).groupBy(*keys).agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    before = ends.select(*keys, F.lit(least).cast("bigint").alias("lo"), (F.col("first") - 1).alias("hi"))
    after = ends.select(*keys, (F.col("last") + 1).alias("lo"), F.lit(most).cast("bigint").alias("hi"))
    return restrict(gaps(df, keys).unionByName(before).unionByName(after).where("lo <= hi"), least, most)


def restrict(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Clip to a half line or a range: from ``least`` and until ``most``."""
    lo: Column = F.greatest("lo", F.lit(least)) if least is not None else F.col("lo")
    hi: Column = F.least("hi", F.lit(most)) if most is not None else F.col("hi")
    return df.withColumns({"lo": lo.cast("bigint"), "hi": hi.cast("bigint")}).where("lo <= hi")


def _events(df: DataFrame, keys: list[str], a: int, b: int) -> DataFrame:
    """Two events a range, for sweeps."""
    edge = lambda at, s: F.struct(at.alias("pos"), F.lit(a * s).cast("bigint").alias("a"), F.lit(b * s).cast("bigint").alias("b"))
    return valid(df).select(*keys, F.inline(F.array(edge(F.col("lo").cast("bigint"), 1), edge((F.col("hi") + 1).cast("bigint"), -1))))


def depth(df: DataFrame, keys: list[str], dedup_events: bool = False) -> DataFrame:
    """Coverage: keys, lo, hi, depth of every stretch between events on which it is above 0. Duplicates count.

    ``dedup_events``: ranges that begin (or end) at the same position count as one beginning (or end), so that depth falls short where ranges share a bound.
    """
    events = _events(df, keys, 1, 0)
    got = stepped(events.distinct() if dedup_events else events, keys, "pos", ["a"])
    return got.where("a > 0").select(*keys, F.col("pos").alias("lo"), (F.col("next_pos") - 1).alias("hi"), F.col("a").alias("depth"))


def _where(a: DataFrame, b: DataFrame, keys: list[str], keep: Callable[[Column, Column], Column]) -> DataFrame:
    got = stretches_where(_events(a, keys, 1, 0).unionByName(_events(b, keys, 0, 1)), keys, "pos", ["a", "b"], keep)
    return got.select(*keys, F.col("begin").alias("lo"), (F.col("end") - 1).alias("hi"))


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return merge(a.select(*keys, "lo", "hi").unionByName(b.select(*keys, "lo", "hi")), keys)


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Canonical set of the points in both."""
    return _where(a, b, keys, lambda x, y: (x > 0) & (y > 0))


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Canonical set of the points in ``a`` but not in ``b``."""
    return _where(a, b, keys, lambda x, y: (x > 0) & (y == 0))


def subset(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys of ``a`` and whether all its points lie in ``b``: is_subset, is_equal."""
    got = stepped(_events(a, keys, 1, 0).unionByName(_events(b, keys, 0, 1)), keys, "pos", ["a", "b"])
    only_a, only_b = (F.col("a") > 0) & (F.col("b") == 0), (F.col("b") > 0) & (F.col("a") == 0)
    per = got.groupBy(*keys).agg(F.max(only_a).alias("x"), F.max(only_b).alias("y"), F.max(F.col("a") > 0).alias("has"))
    return per.where("has").select(*keys, (~F.col("x")).alias("is_subset"), (~F.col("x") & ~F.col("y")).alias("is_equal"))


def cardinality(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the number of points in the set."""
    return merge(df, keys).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("points"))


def elements(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per point of the set."""
    return merge(df, keys).select(*keys, F.explode(F.sequence("lo", "hi")).alias("point"))


def keep_elements(df: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """Canonical set of the points (column ``point``) for which ``holds`` is true."""
    kept = elements(df, keys).where(holds)
    return merge(kept.select(*keys, F.col("point").alias("lo"), F.col("point").alias("hi")), keys)


def partition(df: DataFrame, keys: list[str], holds: Column) -> tuple[DataFrame, DataFrame]:
    """Canonical sets of the points for which ``holds`` is true, and of all others (false or null)."""
    sure = F.coalesce(holds, F.lit(False))
    return keep_elements(df, keys, sure), keep_elements(df, keys, ~sure)


def quantified(df: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """keys, for_all, exists: whether ``holds`` is true for every point of the key's set, and for one at least."""
    sure = F.coalesce(holds, F.lit(False))
    return elements(df, keys).groupBy(*keys).agg(F.min(sure).alias("for_all"), F.max(sure).alias("exists"))


def expanded(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys, pos, payloads: every position that a range covers with the payloads of all ranges over it, in order; as many as the depth there."""
    return valid(df).select(*keys, F.explode(F.sequence("lo", "hi")).alias("pos"), payload).groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(payload)).alias("payloads"))


def regions(df: DataFrame, keys: list[str], passing: Column, max_gap: int) -> DataFrame:
    """Runs of passing ranges with at most ``max_gap`` failing or missing units between them, from the first to the last passing unit.

    Passing ranges are widened by the tolerated gap, merged, and narrowed again, which needs no window over a key.
    """
    near = valid(df).where(passing).select(*keys, "lo", (F.col("hi") + max_gap).alias("hi"))
    return merge(near, keys).select(*keys, "lo", (F.col("hi") - max_gap).alias("hi"))


#: Bins of a range that one row makes at once; a longer range is parted into rows of so many first.
PART = 1024


def bin_width(*frames: DataFrame) -> tuple[int, bool]:
    """At least the mean width of all ranges, so that bins multiply the rows by three at most; and whether some range has so many bins that they are more than a task's work."""
    total = None
    for f in frames:
        part = valid(f).select((F.col("hi") - F.col("lo") + 1).alias("w"))
        total = part if total is None else total.unionByName(part)
    got = total.agg(F.avg("w").alias("m"), F.max("w").alias("most")).first()
    width = 1 << max(0, int(got["m"] or 1).bit_length())
    return width, (got["most"] or 0) // width > PART * PART


def _binned(df: DataFrame, width: int, far: bool) -> DataFrame:
    first, last = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
    parts = df.withColumn("__part", F.explode(F.sequence(first, last, F.lit(PART).cast("bigint"))))
    parts = parts.repartition("__part", "lo", "hi") if far else parts
    return parts.withColumn("__bin", F.explode(F.sequence(F.col("__part"), F.least(F.col("__part") + PART - 1, last)))).drop("__part")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every overlapping pair: the columns of ``a``, and those of ``b`` but the keys with ``_b`` added. Bags: duplicates are kept.

    Both sides are joined on (key, bin); a pair comes out of the bin in which its overlap begins.
    """
    width, far = bin_width(a, b)
    left = _binned(valid(a), width, far)
    right = _binned(valid(b), width, far).select(*(F.col(c).alias(f"{c}_b") for c in [*b.columns, "__bin"]))
    on = [F.col(k) == F.col(f"{k}_b") for k in keys] + [F.col("__bin") == F.col("__bin_b")]
    pairs = left.join(right, on).where((F.col("lo") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi")) & (F.floor(F.greatest("lo", "lo_b") / width) == F.col("__bin")))
    return pairs.drop("__bin", "__bin_b", *(f"{k}_b" for k in keys))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` that overlap any range of ``b``; repeated rows are kept. ``b`` is merged first, so it is small where it overlaps itself."""
    left = valid(a).withColumn("__id", F.struct(*keys, "lo", "hi"))
    hit = overlaps(valid(a).select(*keys, "lo", "hi").distinct(), merge(b, keys), keys).select(F.struct(*keys, "lo", "hi").alias("__id")).distinct()
    return left.join(hit, "__id", "left_semi").drop("__id")


def overlap_size(a: DataFrame, b: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """``ident`` and the number of points each row of ``a`` shares with the set ``b`` (0 if none)."""
    shared = overlaps(a, merge(b, keys), keys).groupBy(ident).agg(F.sum(F.least("hi", "hi_b") - F.greatest("lo", "lo_b") + 1).alias("shared"))
    return valid(a).select(ident).distinct().join(shared, ident, "left").select(ident, F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"))


def nearest(queries: DataFrame, targets: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """For each query: ident, near_lo, near_hi, distance (0 if they overlap); null where its key has no target. Ties: least (lo, hi).

    The best target on either side is found by running extremes over stretches of positions; overlaps by the binned join.
    """
    q = valid(queries).select(ident, *keys, "lo", "hi")
    t = valid(targets).select(*keys, "lo", "hi").distinct()
    hits = overlaps(q, t, keys).groupBy(ident).agg(F.min(F.struct(F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi"))).alias("best"))
    sides = []
    for side in ("left", "right"):
        at_t, at_q = ("hi", "lo") if side == "left" else ("lo", "hi")
        sign = 1 if side == "left" else -1
        # among equally near targets the least (lo, hi) wins
        tied = t.groupBy(*keys, F.col(at_t).alias("p")).agg(F.min(F.struct("lo", "hi")).alias("t"))
        rows = tied.select(*keys, (F.col("p") * sign).alias("p"), F.lit(1).alias("o"), "t", F.lit(None).cast(dict(q.dtypes)[ident]).alias(ident))
        rows = rows.unionByName(q.select(*keys, (F.col(at_q) * sign).alias("p"), F.lit(0).alias("o"), F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("t"), ident))
        rows = rows.withColumn("__b", stretch_of(F.col("p"), borders(rows, "p")))
        per = rows.where("o = 1").groupBy(*keys, "__b").agg(F.max_by("t", "p").alias("t"))
        every = rows.select(*keys, "__b").distinct().join(per, [*keys, "__b"], "left")
        before = every.withColumn("__before", F.last("t", True).over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("t")
        w = Window.partitionBy(*keys, "__b").orderBy("p", "o").rowsBetween(Window.unboundedPreceding, 0)
        found = rows.join(before, [*keys, "__b"]).withColumn("best", F.coalesce(F.last("t", True).over(w), F.col("__before"))).where("o = 0")
        sides.append(found.select(ident, F.col("best").alias(side)))
    all_ = q.join(sides[0], ident, "left").join(sides[1], ident, "left").join(hits, ident, "left")
    d_left, d_right = F.col("lo") - F.col("left.hi"), F.col("right.lo") - F.col("hi")
    cand = F.array_compact(F.array(
        F.when(F.col("best").isNotNull(), F.struct(F.lit(0).cast("bigint").alias("d"), F.col("best.lo").alias("lo"), F.col("best.hi").alias("hi"))),
        F.when(F.col("left").isNotNull(), F.struct(d_left.alias("d"), F.col("left.lo").alias("lo"), F.col("left.hi").alias("hi"))),
        F.when(F.col("right").isNotNull(), F.struct(d_right.alias("d"), F.col("right.lo").alias("lo"), F.col("right.hi").alias("hi"))),
    ))
    best = F.array_min(F.filter(cand, lambda c: c["d"] >= 0))
    return all_.select(ident, best.getField("lo").alias("near_lo"), best.getField("hi").alias("near_hi"), best.getField("d").alias("distance"))


def value_at(points: DataFrame, segments: DataFrame, keys: list[str], ident: str, default: float) -> DataFrame:
    """A step function's value at each point: ident, value; ``default`` outside all segments. Segments of a key are disjoint."""
    p = points.select(ident, *keys, F.col("pos").alias("lo"), F.col("pos").alias("hi"))
    hit = overlaps(p, segments.select(*keys, "lo", "hi", "value"), keys).groupBy(ident).agg(F.max("value_b").alias("value"))
    return points.select(ident).join(hit, ident, "left").select(ident, F.coalesce("value", F.lit(default)).alias("value"))


# --- predicates on a pair of ranges (columns lo, hi and lo_b, hi_b) ---


def relations() -> dict[str, Column]:
    """Every positional and containment relation of two ranges as a column."""
    lo, hi, lo2, hi2 = F.col("lo"), F.col("hi"), F.col("lo_b"), F.col("hi_b")
    over = F.least(hi, hi2) - F.greatest(lo, lo2) + 1
    same, s_before, s_after = (lo == lo2) & (hi == hi2), (lo < lo2) & (hi < hi2), (lo2 < lo) & (hi2 < hi)
    sub, sup = (lo >= lo2) & (hi <= hi2), (lo2 >= lo) & (hi2 <= hi)
    return {
        "overlap": over, "gap": -over, "strict_before": s_before, "strict_after": s_after, "before": s_before | same, "after": s_after | same,
        "subset": sub, "superset": sup, "strict_subset": sub & ~same, "strict_superset": sup & ~same,
        "compare_positional": F.when(same, 0).when(s_before, -1).when(s_after, 1), "compare_containment": F.when(same, 0).when(sub, -1).when(sup, 1),
    }


def adjacency(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Per key: any_overlap, all_positional, max_gap of consecutive ranges in order of (lo, hi).

    Each pair of neighbours is judged within ``part`` (a column that bounds a task's rows, such as a sub-key). A key with one range has no overlap,
    is positional, and its max_gap is null.
    """
    w = Window.partitionBy(*keys, part).orderBy("lo", "hi")
    rows = valid(df).withColumns({"plo": F.lag("lo").over(w), "phi": F.lag("hi").over(w)})
    before = ((F.col("plo") < F.col("lo")) & (F.col("phi") < F.col("hi"))) | ((F.col("plo") == F.col("lo")) & (F.col("phi") == F.col("hi")))
    overlap, positional = F.coalesce(F.max(F.col("lo") <= F.col("phi")), F.lit(False)), F.coalesce(F.min(before), F.lit(True))
    return rows.groupBy(*keys, part).agg(overlap.alias("any_overlap"), positional.alias("all_positional"), F.max(F.col("lo") - F.col("phi") - 1).alias("max_gap"))


def least_window(size: Column, start: Column, enough: Callable[[Column, Column], Column]) -> Column:
    """struct<lo, hi>: the first range around ``start`` within 0 to size - 1, grown forward and backward in turn, for which ``enough(lo, hi)`` holds; null if none does or the start lies outside."""
    lo = lambda k: F.greatest(F.lit(0), start - F.floor(k / 2).cast("int"))
    hi = lambda k: F.least(size - 1, start + F.ceil(k / 2).cast("int"))
    k = F.get(F.filter(F.sequence(F.lit(0), F.greatest(2 * size, F.lit(0))), lambda k: enough(lo(k), hi(k))), F.lit(0))
    return F.when((start >= 0) & (start < size) & k.isNotNull(), F.struct(lo(k).alias("lo"), hi(k).alias("hi")))

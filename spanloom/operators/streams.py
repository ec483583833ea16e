"""Combinators on tables: routing, zipping, prefixes and pairs by an explicit order; and alignment statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.sequence import flag, reference_length
from spanloom.operators.ordered import prefix_sums

Step = Callable[[DataFrame], DataFrame]


def compose(*steps: Step) -> Step:
    """Steps one after the other."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


def filter_compose(df: DataFrame, to_step: Column, step: Step) -> DataFrame:
    """Rows for which ``to_step`` holds go through ``step``, the others around it (null counts as not)."""
    on = F.coalesce(to_step, F.lit(False))
    return df.where(on).transform(step).unionByName(df.where(~on), allowMissingColumns=True)


def split_and_merge(df: DataFrame, first: Column, left: Step, right: Step) -> DataFrame:
    """Two ways for two kinds of rows, results merged; order isn't kept."""
    on = F.coalesce(first, F.lit(False))
    return df.where(on).transform(left).unionByName(df.where(~on).transform(right), allowMissingColumns=True)


def on_ok(df: DataFrame, column: str, value: Column, error: str = "error") -> DataFrame:
    """Map ``column`` only in rows without an error."""
    return df.withColumn(column, F.when(F.col(error).isNull(), value).otherwise(F.col(column)))


def on_error(df: DataFrame, value: Column, error: str = "error") -> DataFrame:
    """Map the error only in rows that have one."""
    return df.withColumn(error, F.when(F.col(error).isNotNull(), value))


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Position from 0 in a global order, by range partitions; ``order`` must make rows unique."""
    got = prefix_sums(df.withColumn("__one", F.lit(1).cast("bigint")), order, ["__one"])
    return got.withColumn(name, F.col("__one_to") - 1).drop("__one", "__one_to")


def take_while(df: DataFrame, order: list[str], keep: Column) -> DataFrame:
    """The rows before the first in order that fails; null fails."""
    fails = df.where(~F.coalesce(keep, F.lit(False))).agg(F.min(F.struct(*order)).alias("__first"))
    return df.crossJoin(F.broadcast(fails)).where(F.col("__first").isNull() | (F.struct(*order) < F.col("__first"))).drop("__first")  # one row


def drop_while(df: DataFrame, order: list[str], drop: Column) -> DataFrame:
    """From the first row in order that fails ``drop``."""
    fails = df.where(~F.coalesce(drop, F.lit(False))).agg(F.min(F.struct(*order)).alias("__first"))
    return df.crossJoin(F.broadcast(fails)).where(F.struct(*order) >= F.col("__first")).drop("__first")  # one row


def skip(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """All but the first ``n`` rows."""
    return numbered(df, order, "__pos").where(F.col("__pos") >= n).drop("__pos")


def mix(a: DataFrame, a_order: list[str], b: DataFrame, b_order: list[str]) -> DataFrame:
    """Rows paired by position: ``pos``, struct ``a``, struct ``b``; what is left of the longer stands alone."""
    x = numbered(a, a_order).select("pos", F.struct(*a.columns).alias("a"))
    y = numbered(b, b_order).select("pos", F.struct(*b.columns).alias("b"))
    return x.join(y, "pos", "full")


def demanded(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """The rows, or an error where ``ok`` isn't true of one; whichever columns are read."""
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def zip_exact(a: DataFrame, a_order: list[str], b: DataFrame, b_order: list[str]) -> DataFrame:
    """As :func:`mix`, but a row without partner raises an error."""
    both = mix(a, a_order, b, b_order)
    return demanded(both, F.col("a").isNotNull() & F.col("b").isNotNull(), "the tables differ in length")


def zip_all(*parts: tuple[DataFrame, list[str]]) -> DataFrame:
    """Rows of any number of tables (each with its order) paired by position: pos and structs t0, t1, ...; tables of unequal length raise an error."""
    out = None
    for i, (df, order) in enumerate(parts):
        one = numbered(df, order).select("pos", F.struct(*df.columns).alias(f"t{i}"))
        out = one if out is None else out.join(one, "pos", "full")
    ok = F.lit(True)
    for i in range(len(parts)):
        ok = ok & F.col(f"t{i}").isNotNull()
    return demanded(out, ok, "the tables differ in length")


def first_bytes(df: DataFrame, order: list[str], size: Column, most: int) -> DataFrame:
    """The rows in order up to which the sizes sum to at most ``most``; a null size is 0."""
    run = prefix_sums(df.withColumn("__size", F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))), order, ["__size"])
    return run.where(F.col("__size_to") <= most).drop("__size", "__size_to")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], item: Column, zero: Column, step: Callable[[Column, Column], Column], name: str = "folded") -> DataFrame:
    """keys and the fold of each key's items in order: ``step(state, item)`` from ``zero``. As any step may depend on the one before it, a key is folded in one task."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("__item")))).alias("__rows"))
    return rows.select(*keys, F.aggregate("__rows", zero, lambda a, r: step(a, r["__item"])).alias(name))


def named_values(declared: DataFrame, reserved: DataFrame, key: str) -> DataFrame:
    """key, value of two tables (key, value) in one: a declared value wins over a reserved one, and either may be missing."""
    mine, other = declared.select(key, F.col("value").alias("__mine")), reserved.select(key, F.col("value").alias("__other"))
    return mine.join(other, key, "full").select(key, F.coalesce("__mine", "__other").alias("value"))


def group2(df: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive rows in pairs: pair, first, second (null at an odd end)."""
    rows = numbered(df, order)
    row = F.struct(*df.columns)
    return rows.groupBy(F.floor(F.col("pos") / 2).alias("pair")).agg(F.min_by(row, "pos").alias("first"), F.max(F.when(F.col("pos") % 2 == 1, row)).alias("second"))


def product(a: DataFrame, b: DataFrame, on: list[str], where: Column, keys: list[str]) -> DataFrame:
    """Counts by ``keys`` of the pairs of rows with equal ``on`` for which ``where`` holds."""
    return a.join(b, on).where(where).groupBy(*keys).agg(F.count("*").alias("n"))


def first_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def alignment_stats(df: DataFrame, flags: str, require_proper: bool = False) -> DataFrame:
    """One row: total, qc_pass, single_reads, read_pairs, mapped_reads, mapped_pairs."""
    x = F.col(flags)
    ok = ~flag("not_passing_quality_controls", x)
    many = flag("has_multiple_segments", x)
    pair = many & flag("is_first", x)
    mapped = ~(flag("is_unmapped", x) | flag("is_secondary", x) | flag("is_supplementary", x))
    both = mapped & pair & (flag("each_segment_is_properly_aligned", x) if require_proper else F.lit(True))
    n = {"qc_pass": F.lit(True), "single_reads": ~many, "read_pairs": pair, "mapped_reads": mapped, "mapped_pairs": both}
    return df.where(x.isNotNull()).agg(F.count("*").alias("total"), *(F.count_if(ok & c).alias(k) for k, c in n.items()))


def fragments(df: DataFrame, flags: str, mapq: str, min_mapq: int = 0) -> DataFrame:
    """Rows of properly aligned pairs with at least ``min_mapq``; a missing mapping quality fails."""
    x = F.col(flags)
    return df.where(flag("has_multiple_segments", x) & ~flag("is_unmapped", x) & flag("each_segment_is_properly_aligned", x) & (F.col(mapq) >= min_mapq))


def covered(df: DataFrame, by: str = "cigar") -> DataFrame:
    """chrom, lo, hi (closed) of aligned rows of SAM (rname, pos, cigar, seq): as far as the operations reach on the reference, or as many bases as the sequence has.

    A row without reference, position or length is left out; by ``sequence``, a sequence of ``=`` or none is as long as its operations reach.
    """
    if by not in ("cigar", "sequence"):
        raise ValueError(by)
    reach = reference_length(F.col("cigar"))
    n = reach if by == "cigar" else F.when(F.col("seq").isNull() | (F.col("seq") == "="), reach).otherwise(F.length("seq"))
    return df.where(F.col("rname").isNotNull() & F.col("pos").isNotNull() & (n > 0)).select(F.col("rname").alias("chrom"), F.col("pos").cast("bigint").alias("lo"), (F.col("pos") + n - 1).cast("bigint").alias("hi"))


def neighbours(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Adds ``previous`` and ``next`` of ``column`` within a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"previous": F.lag(column).over(w), "next": F.lead(column).over(w)})


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """The rows in an order drawn by ``seed``."""
    return df.orderBy(F.rand(seed))

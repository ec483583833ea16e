"""Statistics: robust summaries, tied ranks, correlations, rank-sum test, quantile normalisation, histograms, prediction curves.

Whatever needs an order over a whole column works on distinct values with their counts and distributed running sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.arrow import starts
from spanloom.operators.ordered import prefix_sums



def ratio(num: Column, den: Column) -> Column:
    """num / den, NaN where den is 0."""
    return F.when(den == 0, F.lit(float("nan"))).otherwise(num.cast("double") / den)


def clean(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null nor NaN."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, variance (n - 1), stdv, rms, minimum and maximum per key; variance is null for one value."""
    v = F.col(value).cast("double")
    return clean(df, value).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("stdv"), F.sqrt(F.avg(v * v)).alias("rms"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with n, the total of their key, how many rows lie before them, and the average rank (ties share it; from 1)."""
    per = clean(df, value).groupBy(*keys, (F.col(value).cast("double") + 0.0).alias("value")).agg(F.count("*").alias("n"))
    run = prefix_sums(per, [*keys, "value"], ["n"])
    if keys:
        first = run.groupBy(*keys).agg(F.min(F.col("n_to") - F.col("n")).alias("__start"), F.sum("n").alias("total"))
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        run = run.join(first.select(*(F.col(k).alias(f"__{k}") for k in keys), "__start", "total"), on)
    else:
        run = run.crossJoin(F.broadcast(run.agg(F.lit(0).alias("__start"), F.sum("n").alias("total"))))  # one row
    before = F.col("n_to") - F.col("n") - F.col("__start")
    return run.select(*keys, "value", "n", "total", before.alias("before"), (before + (F.col("n") + 1) / 2).alias("avg_rank"))


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median (mean of the two middle values)."""
    at = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
    lo, hi = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    picked = ranked(df, keys, value).where(at(lo) | at(hi))
    return picked.groupBy(*keys).agg(F.max("total").alias("n"), ((F.min("value") + F.max("value")) / 2).alias("median"))


def mads(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median, mad (median of absolute deviations from it)."""
    m = medians(df, keys, value).drop("n")
    key = m.select(*(F.col(k).alias(f"__{k}") for k in keys), "median")
    off = clean(df, value).join(key, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]) if keys else clean(df, value).crossJoin(F.broadcast(m))  # one row
    dev = medians(off.select(*keys, F.abs(F.col(value).cast("double") - F.col("median")).alias("dev")), keys, "dev").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("median").alias("mad"))
    return m.join(dev, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select(*keys, "median", "mad") if keys else m.crossJoin(F.broadcast(dev))


def _pair_median(x: np.ndarray) -> float | None:
    """Median of the means of all pairs i < j, by bisection on counts over the sorted values; no pair is formed."""
    n = len(x)
    total = n * (n - 1) // 2
    if total == 0:
        return float(x[0]) if n else None
    x = np.sort(x)

    def count(t: float) -> int:
        """Pairs with a sum of at most t."""
        upto = np.searchsorted(x, t - x, "right")
        return int(np.maximum(upto - np.arange(1, n + 1), 0).sum())

    def kth(k: int) -> float:
        lo, hi = 2 * x[0] - 1, 2 * x[-1] + 1
        while True:
            mid = (lo + hi) / 2
            if not lo < mid < hi:
                break
            lo, hi = (lo, mid) if count(mid) >= k else (mid, hi)
        # the least real sum above lo
        at = np.searchsorted(x, lo - x, "right")
        at = np.maximum(at, np.arange(1, n + 1))
        some = at < n
        sums = x[some] + x[at[some]]
        return float(sums.min()) if len(sums) else hi

    return (kth((total + 1) // 2) + kth(total // 2 + 1)) / 4


def pseudomedians(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, pseudomedian: the median of the means of all pairs of different rows of a key (the value itself where there is one).

    A key's sorted values are held by one task (8 bytes each), as the statistic isn't defined piecewise; pairs are never formed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            k, v = t.column("k").combine_chunks(), t.column("v").to_numpy()
            at = np.append(np.flatnonzero(starts(k.to_numpy(zero_copy_only=False))), len(v))
            return pa.record_batch([k.take(pa.array(at[:-1])), pa.array([_pair_median(v[a:b]) for a, b in zip(at, at[1:])])], ["k", "m"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.concat_tables([*held, pa.Table.from_batches([b])])
            k = t.column("k").combine_chunks().to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(starts(k))[-1])
            if cut:
                yield done(t.slice(0, cut))
            held = [t.slice(cut)]
        if held:
            yield done(pa.concat_tables(held))

    src = clean(df, value).where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    got = src.repartition("k").sortWithinPartitions("k").mapInArrow(run, f"k {dict(src.dtypes)['k']}, m double")
    return got.select(F.col("k").alias(key), F.col("m").alias("pseudomedian"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pearson and spearman of two columns over rows where both are given."""
    both = clean(clean(df, x), y).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rx = ranked(both, [], "x").select(F.col("value").alias("x"), F.col("avg_rank").alias("rx"))
    ry = ranked(both, [], "y").select(F.col("value").alias("y"), F.col("avg_rank").alias("ry"))
    # copies of a pair are counted before the joins, so that a frequent value is joined once
    pairs = both.groupBy("x", "y").agg(F.count("*").cast("double").alias("w")).join(rx, "x").join(ry, "y")
    # sums of centred values, as those of large values cancel; the mean rank follows from the number of rows
    mean = both.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), ((F.count("*") + 1) / 2).alias("mr"))
    s = lambda a, b: F.sum(F.col("w") * a * b)
    out = {}
    for name, a, b in (("pearson", F.col("x") - F.col("mx"), F.col("y") - F.col("my")), ("spearman", F.col("rx") - F.col("mr"), F.col("ry") - F.col("mr"))):
        out[name] = ratio(s(a, b), F.sqrt(s(a, a) * s(b, b)))
    return pairs.crossJoin(F.broadcast(mean)).agg(*(c.alias(n) for n, c in out.items()))  # one row


# Coefficients of the polynomial for the cumulative normal.
CND = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
CND_P, CND_C = 0.2316419, 0.39894228
# Coefficients of the rational approximations for the normal quantile.
QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
Q_LOW = 0.02425


def _poly(coef: tuple[float, ...], x: Column) -> Column:
    """Coefficients from the highest power down."""
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


def cnd(x: Column) -> Column:
    """Cumulative standard normal."""
    t = 1 / (1 + F.lit(CND_P) * F.abs(x))
    tail = F.lit(CND_C) * F.exp(-x * x / 2) * t * _poly(CND[::-1], t)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def ltqnorm(p: Column) -> Column:
    """Quantile of the standard normal; null outside (0, 1)."""
    tail = lambda q: _poly(QC, q) / _poly((*QD, 1.0), q)
    q = p - 0.5
    mid = _poly(QA, q * q) * q / _poly((*QB, 1.0), q * q)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(p < Q_LOW, tail(low)).when(p > 1 - Q_LOW, -tail(high)).otherwise(mid)


def rank_sum(df: DataFrame, value: str, first: Column, alpha: float = 0.05) -> DataFrame:
    """One row: z, p (two-tailed) and reject of the rank-sum test of rows with ``first`` against the others."""
    rows = clean(df, value).where(first.isNotNull()).withColumn("__f", first.cast("int"))
    r = ranked(rows, [], value).select(F.col("value").alias("__v"), "avg_rank")
    per = rows.groupBy((F.col(value).cast("double") + 0.0).alias("__v")).agg(F.sum("__f").alias("n1"), F.sum(1 - F.col("__f")).alias("n2")).join(r, "__v")
    s = per.agg(F.sum(F.col("n1") * F.col("avg_rank")).alias("s"), F.sum("n1").cast("double").alias("l1"), F.sum("n2").cast("double").alias("l2"))
    l1, l2 = F.col("l1"), F.col("l2")
    z = (F.col("s") - l1 * (l1 + l2 + 1) / 2) / F.sqrt(l1 * l2 * ((l1 + l2 + 1) / 12))
    got = s.select(z.alias("z"))
    return got.select("z", (2 * (1 - cnd(F.abs("z")))).alias("p")).withColumn("reject", F.col("p") < alpha)


def quantile_normalised(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Long form (row, column, value): each value replaced by the mean over all columns of the values with its rank. Ties by row."""
    rows = clean(df, value).select(F.col(column).alias("c"), F.col(value).cast("double").alias("v"), F.col(row).alias("r")).withColumn("one", F.lit(1).cast("bigint"))
    run = prefix_sums(rows, ["c", "v", "r"], ["one"])
    first = run.groupBy("c").agg(F.min("one_to").alias("s"))
    placed = run.join(F.broadcast(first) if first.limit(10_001).count() <= 10_000 else first, "c").withColumn("k", F.col("one_to") - F.col("s"))
    means = placed.groupBy("k").agg(F.avg("v").alias("norm"))
    return placed.join(means, "k").select(F.col("r").alias(row), F.col("c").alias(column), F.col("norm").alias(value))


def histogram(df: DataFrame, value: str, least: float, most: float, bins: int, weight: Column | None = None) -> DataFrame:
    """Uniform half-open bins: bin, lo, hi, count (0 where empty); values outside are left out."""
    if not least < most or bins < 1:
        raise ValueError("least must be below most, with one bin or more")
    step = (most - least) / bins
    spark = df.sparkSession
    limits = [least + step * i for i in range(bins)] + [most]
    frame = spark.createDataFrame([(i, limits[i], limits[i + 1]) for i in range(bins)], "bin int, lo double, hi double")
    v = F.col(value).cast("double")
    guess = F.floor((v - least) / step).cast("int")
    # rounding may put a value one bin off its limits
    lim = F.array(*(F.lit(x) for x in limits))
    at = F.when(v >= F.get(lim, guess + 1), guess + 1).when(v < F.get(lim, guess), guess - 1).otherwise(guess)
    got = clean(df, value).where((v >= least) & (v < most)).groupBy(at.alias("bin")).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("n"))
    return frame.join(got, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0.0)).alias("count"))


def histogram_at(df: DataFrame, value: str, limits: list[float], weight: Column | None = None) -> DataFrame:
    """Half-open bins between any rising limits: bin, lo, hi, count (0 where empty); values outside are left out."""
    if len(limits) < 2 or any(not a < b for a, b in zip(limits, limits[1:])):
        raise ValueError("limits must rise, with one bin or more")
    frame = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(limits, limits[1:]))], "bin int, lo double, hi double")
    v = F.col(value).cast("double")
    lim = F.array(*(F.lit(float(x)) for x in limits))
    inside = clean(df, value).where((v >= limits[0]) & (v < limits[-1]))
    got = inside.groupBy((F.size(F.filter(lim, lambda x: x <= v)) - 1).alias("bin")).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("n"))
    return frame.join(got, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0.0)).alias("count"))


def binned(df: DataFrame, bin: Column, **folds: Column) -> DataFrame:
    """A fold by bins: ``bin`` and the named aggregates of each bin's rows."""
    return df.groupBy(bin.alias("bin")).agg(*(c.alias(n) for n, c in folds.items()))


def counter(df: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """key, n and, where a weight is given, its sum."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *([F.sum(weight).alias("weight")] if weight is not None else []))


def relation(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and the sorted list of its values. A list is one value, so that a key's values meet in one task; only keys of bounded size have a relation."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


RATIOS = {
    "positive": lambda tp, tn, fp, fn: tp + fn,
    "negative": lambda tp, tn, fp, fn: tn + fp,
    "cardinal": lambda tp, tn, fp, fn: tp + tn + fp + fn,
    "sensitivity": lambda tp, tn, fp, fn: ratio(tp, tp + fn),
    "false_positive_rate": lambda tp, tn, fp, fn: ratio(fp, fp + tn),
    "accuracy": lambda tp, tn, fp, fn: ratio(tp + tn, tp + tn + fp + fn),
    "specificity": lambda tp, tn, fp, fn: ratio(tn, fp + tn),
    "ppv": lambda tp, tn, fp, fn: ratio(tp, tp + fp),
    "npv": lambda tp, tn, fp, fn: ratio(tn, tn + fn),
    "fdr": lambda tp, tn, fp, fn: ratio(fp, fp + tp),
    "f1": lambda tp, tn, fp, fn: ratio(2 * tp, 2 * tp + fp + fn),
}


def confusion(df: DataFrame, score: Column, label: Column, threshold: float) -> DataFrame:
    """One row: tp, tn, fp, fn of score > threshold, and all ratios."""
    yes = score > threshold
    n = lambda c: F.count_if(c)
    m = df.where(score.isNotNull() & label.isNotNull()).agg(n(yes & label).alias("tp"), n(~yes & ~label).alias("tn"), n(yes & ~label).alias("fp"), n(~yes & label).alias("fn"))
    c = [F.col(x) for x in ("tp", "tn", "fp", "fn")]
    return m.select("tp", "tn", "fp", "fn", *(f(*c).alias(k) for k, f in RATIOS.items()))


def performance_curve(df: DataFrame, score: Column, label: Column) -> DataFrame:
    """threshold, tp, tn, fp, fn for infinity and each distinct score, counting scores at or above the threshold as positive."""
    per = df.where(score.isNotNull() & label.isNotNull()).groupBy(score.cast("double").alias("threshold")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("q"))
    run = prefix_sums(per, ["threshold"], ["p", "q"], descending=True)
    total = per.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("np"), F.coalesce(F.sum("q"), F.lit(0)).alias("nq"))
    rows = run.select("threshold", F.col("p_to").alias("tp"), F.col("q_to").alias("fp"), "p", "q")
    rows = rows.unionByName(total.select(F.lit(math.inf).alias("threshold"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q")))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    return rows.select("threshold", "tp", (F.col("nq") - F.col("fp")).alias("tn"), "fp", (F.col("np") - F.col("tp")).alias("fn"), "p", "q")


def areas(df: DataFrame, score: Column, label: Column) -> DataFrame:
    """One row: auc (trapezoids) and average_precision (steps); NaN where a class is empty."""
    c = performance_curve(df, score, label)
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    # each point's step from the one before it, which had p positives and q negatives fewer
    trapezoid = F.col("q") * (F.col("tp") + F.col("tp") - F.col("p")) / 2.0
    step = F.when(F.col("tp") + F.col("fp") > 0, F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    s = c.agg(F.sum(trapezoid).alias("t"), F.sum(step).alias("s"), F.max(pos).cast("double").alias("np"), F.max(neg).cast("double").alias("nn"))
    return s.select(ratio(F.col("t"), F.col("np") * F.col("nn")).alias("auc"), ratio(F.col("s"), F.col("np")).alias("average_precision"))

"""Queries of statistics, grouping and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import stats as st
from spanloom.runtime import table


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem")


def _scored(s: SparkSession, d: str) -> tuple[DataFrame, F.Column, F.Column]:
    return table(s, d, "peaks").dropDuplicates(["peak_id"]).where("NOT isnan(pileup) AND fold_enrichment IS NOT NULL"), F.round("pileup", 0), F.col("fold_enrichment") > 5


QUERIES = {
    "g01_binned_fold": lambda s, d: _r(st.binned(table(s, d, "events"), F.col("user_id") % 10, greatest=F.max("value"), squares=F.sum(F.col("value") * F.col("value"))), 2),
    "g02_counter": lambda s, d: st.counter(table(s, d, "events"), "event_type", F.col("user_id")),
    "g03_relation": lambda s, d: st.relation(table(s, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.concat_ws(",", "values").alias("orders")),
    "g04_value_histogram": lambda s, d: st.counter(_lines(s, d), "l_quantity"),
    "g05_limits": lambda s, d: st.histogram_at(_lines(s, d), "l_extendedprice", [0.0, 1000.0, 1500.0, 20000.0, 50000.0, 104949.5]),
    "g05_histogram": lambda s, d: _r(st.histogram(_lines(s, d), "l_extendedprice", 0.0, 100000.0, 40)),
    "g06_summary": lambda s, d: _r(st.summary(_lines(s, d), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 2),
    "g07_median": lambda s, d: _r(st.medians(_lines(s, d), ["l_returnflag"], "l_extendedprice"), 4),
    "g07_mad": lambda s, d: _r(st.mads(_lines(s, d), ["l_returnflag"], "l_extendedprice"), 4),
    "g07_pseudomedian": lambda s, d: _r(st.pseudomedians(table(s, d, "orders"), "o_custkey", "o_totalprice"), 6),
    "g08_correlation": lambda s, d: _r(st.spearman(_lines(s, d), "l_quantity", "l_extendedprice")),
    "g09_rank_sum": lambda s, d: _r(st.rank_sum(_lines(s, d), "l_extendedprice", F.col("l_returnflag") == "R"), 5),
    "g10_prediction_values": lambda s, d: _r(_prediction_values(s, d)),
    "g11_confusion": lambda s, d: _r(st.confusion(*_scored(s, d), 30.0)),
    "g12_performance_curve": lambda s, d: st.performance_curve(*_scored(s, d)).select("threshold", "tp", "tn", "fp", "fn"),
    "g12_roc_curve": lambda s, d: _r(st.performance_curve(*_scored(s, d)).select("threshold", st.RATIOS["false_positive_rate"](*map(F.col, ("tp", "tn", "fp", "fn"))).alias("fpr"), st.RATIOS["sensitivity"](*map(F.col, ("tp", "tn", "fp", "fn"))).alias("tpr")), 9),
    "g12_areas": lambda s, d: _r(st.areas(*_scored(s, d))),
    "w01_average_rank": lambda s, d: st.ranked(_lines(s, d), ["l_returnflag"], "l_extendedprice").select("l_returnflag", "value", "n", "avg_rank"),
    "w02_idxsort": lambda s, d: _idxsort(s, d),
    "w03_quantile_normalisation": lambda s, d: _r(st.quantile_normalised(_long(s, d), "r", "c", "v"), 4).withColumn("v", F.col("v") + 0.0),
    "m01_scalars": lambda s, d: _r(_scalars(s, d)),
    "m02_normal": lambda s, d: _r(table(s, d, "part").select("p_partkey", st.cnd((F.col("p_size") - 25) / 8.0).alias("cnd"), st.ltqnorm(F.col("p_size") / 51.0).alias("quantile"))),
}


def _prediction_values(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy("l_shipdate").agg(*(F.count_if(c).alias(n) for n, c in (
        ("tp", (F.col("l_quantity") > 25) & (F.col("l_returnflag") == "R")), ("tn", (F.col("l_quantity") <= 25) & (F.col("l_returnflag") != "R")),
        ("fp", (F.col("l_quantity") > 25) & (F.col("l_returnflag") != "R")), ("fn", (F.col("l_quantity") <= 25) & (F.col("l_returnflag") == "R")))))
    c = [F.col(x) for x in ("tp", "tn", "fp", "fn")]
    return rows.select("l_shipdate", *(F.coalesce(F.nanvl(st.RATIOS[k](*c), F.lit(-1.0)), F.lit(-1.0)).alias(k) for k in ("sensitivity", "specificity", "ppv", "npv")))


def _idxsort(s: SparkSession, d: str) -> DataFrame:
    """0-based positions of order keys sorted by price; ties by the original index."""
    from spanloom.operators.ordered import prefix_sums

    rows = table(s, d, "orders").select("o_totalprice", "o_orderkey", F.lit(1).cast("bigint").alias("one"))
    return prefix_sums(rows, ["o_totalprice", "o_orderkey"], ["one"]).select((F.col("one_to") - 1).alias("pos"), "o_orderkey")


def _long(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v"))


def _scalars(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    return table(s, d, "part").select(
        "p_partkey", F.ln("p_retailprice").alias("ln"), F.log10("p_retailprice").alias("log10"), F.log2("p_retailprice").alias("log2"), (n % 2 == 0).alias("even"), (n % 2 != 0).alias("odd"),
        F.factorial(n % 15).alias("factorial"), F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda a, i: a + i * 0.5).alias("epsilon"),
        F.array_join(F.sequence(F.lit(1), n, F.lit(7)), ",").alias("range_ints"),
    )


_SC = """
WITH p AS (SELECT DISTINCT ON (peak_id) peak_id, round(pileup, 0) AS s, fold_enrichment > 5 AS l FROM peaks WHERE pileup IS NOT NULL AND NOT isnan(pileup) AND fold_enrichment IS NOT NULL)"""
_CURVE = _SC + """, c AS (SELECT s, count(*) FILTER (WHERE l) AS p, count(*) FILTER (WHERE NOT l) AS q FROM p GROUP BY s),
r AS (SELECT s AS threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, p, q FROM c WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0, 0, 0),
k AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST((SELECT sum(q) FROM c) - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST((SELECT sum(p) FROM c) - tp AS BIGINT) AS fn, p, q FROM r)"""
_POLY_T = "(1 / (1 + 0.2316419 * abs(x)))"
_TAIL = f"0.39894228 * exp(-x * x / 2) * {_POLY_T} * ((((1.330274429 * {_POLY_T} - 1.821255978) * {_POLY_T} + 1.781477937) * {_POLY_T} - 0.356563782) * {_POLY_T} + 0.319381530)"


def _horner(coef: tuple[float, ...], x: str) -> str:
    out = repr(coef[0])
    for c in coef[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


_QTAIL = lambda q: f"{_horner(st.QC, q)} / {_horner((*st.QD, 1.0), q)}"

ORACLE = {
    "g01_binned_fold": "SELECT user_id % 10 AS bin, round(max(value), 2) AS greatest, round(sum(value * value), 2) AS squares FROM events GROUP BY 1",
    "g02_counter": "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS weight FROM events GROUP BY 1",
    "g03_relation": "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1",
    "g04_value_histogram": "SELECT l_quantity, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1",
    "g05_limits": """WITH b(bin, lo, hi) AS (VALUES (0, 0.0::DOUBLE, 1000.0::DOUBLE), (1, 1000, 1500), (2, 1500, 20000), (3, 20000, 50000), (4, 50000, 104949.5))
SELECT bin, lo, hi, CAST(count(l_orderkey) AS DOUBLE) AS count FROM b LEFT JOIN lineitem ON l_extendedprice >= lo AND l_extendedprice < hi GROUP BY ALL""",
    "g05_histogram": """WITH b AS (SELECT CAST(i AS INTEGER) AS bin, i * 2500.0::DOUBLE AS lo, (i + 1) * 2500.0::DOUBLE AS hi FROM range(40) t(i))
SELECT bin, lo, hi, CAST(count(l_extendedprice) AS DOUBLE) AS count FROM b LEFT JOIN lineitem ON l_extendedprice >= lo AND l_extendedprice < hi GROUP BY ALL""",
    "g06_summary": """SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice), 2) AS mean, round(var_samp(l_extendedprice), 2) AS variance, round(stddev_samp(l_extendedprice), 2) AS stdv,
round(sqrt(avg(l_extendedprice * l_extendedprice)), 2) AS rms, round(min(l_extendedprice), 2) AS minimum, round(max(l_extendedprice), 2) AS maximum FROM lineitem GROUP BY 1, 2""",
    "g07_median": "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1",
    "g07_mad": "SELECT l_returnflag, round(median(l_extendedprice), 4) AS median, round(mad(l_extendedprice), 4) AS mad FROM lineitem GROUP BY 1",
    "g07_pseudomedian": """WITH p AS (SELECT a.o_custkey, (a.o_totalprice + b.o_totalprice) / 2 AS m FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey),
o AS (SELECT o_custkey, o_totalprice AS m FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1))
SELECT o_custkey, round(median(m), 6) AS pseudomedian FROM (SELECT * FROM p UNION ALL SELECT * FROM o) GROUP BY 1""",
    "g08_correlation": """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""",
    "g09_rank_sum": f"""WITH r AS (SELECT l_returnflag = 'R' AS f, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r FROM lineitem),
s AS (SELECT sum(r) FILTER (WHERE f) AS s, CAST(count(*) FILTER (WHERE f) AS DOUBLE) AS l1, CAST(count(*) FILTER (WHERE NOT f) AS DOUBLE) AS l2 FROM r),
z AS (SELECT (s - l1 * (l1 + l2 + 1) / 2) / sqrt(l1 * l2 * ((l1 + l2 + 1) / 12)) AS z FROM s), t AS (SELECT z, abs(z) AS x FROM z)
SELECT round(z, 5) AS z, round(2 * ({_TAIL}), 5) AS p, 2 * ({_TAIL}) < 0.05 AS reject FROM t""",
    "g10_prediction_values": """WITH c AS (SELECT l_shipdate, l_quantity > 25 AS y, l_returnflag = 'R' AS l FROM lineitem),
m AS (SELECT l_shipdate, CAST(count(*) FILTER (WHERE y AND l) AS DOUBLE) AS tp, count(*) FILTER (WHERE NOT y AND NOT l) AS tn, count(*) FILTER (WHERE y AND NOT l) AS fp, count(*) FILTER (WHERE NOT y AND l) AS fn FROM c GROUP BY 1)
SELECT l_shipdate, coalesce(round(tp / nullif(tp + fn, 0), 6), -1) AS sensitivity, coalesce(round(CAST(tn AS DOUBLE) / nullif(fp + tn, 0), 6), -1) AS specificity,
coalesce(round(tp / nullif(tp + fp, 0), 6), -1) AS ppv, coalesce(round(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 6), -1) AS npv FROM m""",
    "g11_confusion": _SC + """, m AS (SELECT count(*) FILTER (WHERE s > 30 AND l) AS tp, count(*) FILTER (WHERE s <= 30 AND NOT l) AS tn, count(*) FILTER (WHERE s > 30 AND NOT l) AS fp, count(*) FILTER (WHERE s <= 30 AND l) AS fn FROM p)
SELECT tp, tn, fp, fn, tp + fn AS positive, tn + fp AS negative, tp + tn + fp + fn AS cardinal, round(tp / (tp + fn), 6) AS sensitivity, round(fp / (fp + tn), 6) AS false_positive_rate,
round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tn / (fp + tn), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv, round(fp / (fp + tp), 6) AS fdr,
round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m""",
    "g12_performance_curve": _CURVE + "SELECT threshold, tp, tn, fp, fn FROM k",
    "g12_roc_curve": _CURVE + "SELECT threshold, round(fp / (fp + tn), 9) AS fpr, round(tp / (tp + fn), 9) AS tpr FROM k",
    "g12_areas": _CURVE + """SELECT round(sum(q * (2 * tp - p) / 2.0) / (max(tp + fn) * max(tn + fp)), 6) AS auc,
round(sum(CASE WHEN tp + fp > 0 THEN p * tp / (tp + fp) ELSE 0 END) / max(tp + fn), 6) AS average_precision FROM k""",
    "w01_average_rank": """WITH r AS (SELECT l_returnflag, l_extendedprice AS value, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r FROM lineitem)
SELECT l_returnflag, value, CAST(count(*) AS BIGINT) AS n, CAST(min(r) + (count(*) - 1) / 2.0 AS DOUBLE) AS avg_rank FROM r GROUP BY 1, 2""",
    "w02_idxsort": "SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey FROM orders",
    "w03_quantile_normalisation": """WITH l AS (SELECT vec_id AS r, unnest(range(len(embedding))) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY v, r) AS k FROM l), m AS (SELECT k, avg(v) AS n FROM k GROUP BY k)
SELECT r, CAST(c AS INTEGER) AS c, round(n, 4) + 0.0 AS v FROM k JOIN m USING (k)""",
    "m01_scalars": """SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(log10(p_retailprice), 6) AS log10, round(log2(p_retailprice), 6) AS log2, p_size % 2 = 0 AS even, p_size % 2 <> 0 AS odd,
CAST(factorial(p_size % 15) AS BIGINT) AS factorial, p_size * (p_size + 1) / 4.0::DOUBLE AS epsilon, array_to_string(range(1, p_size + 1, 7), ',') AS range_ints FROM part""",
    "m02_normal": f"""WITH a AS (SELECT p_partkey, (p_size - 25) / 8.0::DOUBLE AS x, p_size / 51.0::DOUBLE AS p FROM part), b AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(p)) AS u, sqrt(-2 * ln(1 - p)) AS v FROM a)
SELECT p_partkey, round(CASE WHEN x >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END, 6) AS cnd,
round(CASE WHEN p < 0.02425 THEN {_QTAIL('u')} WHEN p > 0.97575 THEN -({_QTAIL('v')}) ELSE {_horner(st.QA, 'r')} * q / {_horner((*st.QB, 1.0), 'r')} END, 6) AS quantile FROM b""",
}

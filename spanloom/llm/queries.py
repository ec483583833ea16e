"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.leaks import leaks
from spanloom.llm.packing import fill_containers, token_counts
from spanloom.llm.percentiles import measured, merged, percentiles, summaries
from spanloom.llm.subjects import subjects
from spanloom.llm.topn import top_n
from spanloom.runtime import table, written

QS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _measures(s: SparkSession, d: str, dims: tuple[str, ...] = ("chr", "sample_id", "day")) -> DataFrame:
    of = {"chr": F.col("chr"), "sample_id": F.col("sample_id"), "day": F.to_date("called_at")}
    of = {k: of[k] for k in dims}
    return measured(table(s, d, "peaks"), "peaks.pileup", of, "pileup", "peak_id").unionByName(
        measured(table(s, d, "broad_peaks"), "broad_peaks.fold_change", of, "fold_change", "broad_id"))


def p1_percentiles(s: SparkSession, d: str) -> DataFrame:
    return percentiles(_measures(s, d), QS).withColumn("value", F.round("value", 8))


def p1_combined_days(s: SparkSession, d: str) -> DataFrame:
    """Summaries of separate days combined into the percentiles of all days."""
    return merged(summaries(_measures(s, d, ("day",))), ["src"], QS)


def p1_combined_bound(s: SparkSession, d: str) -> DataFrame:
    """Whether the true rank of each combined percentile lies within the stated bound: one step of the summaries, and a rank a summary."""
    rows = written(_measures(s, d, ("day",)).select("src", "id", "grp", "value").distinct(), "values")
    parts = summaries(_measures(s, d, ("day",)))
    got = merged(parts, ["src"], QS)
    days = parts.groupBy("src").agg(F.count("*").alias("summaries"), F.max("error").alias("error"))
    # a dozen percentiles, counted against all values
    both = rows.join(F.broadcast(got.withColumnRenamed("value", "v")), "src")
    ranks = both.groupBy("src", "n", "q").agg(F.count_if(F.col("value") < F.col("v")).alias("below"), F.count_if(F.col("value") <= F.col("v")).alias("upto")).join(days, "src")
    slack = F.col("error") * F.col("n") + F.col("summaries") + 1
    return ranks.select("src", "n", "q", ((F.col("below") <= F.col("q") * F.col("n") + slack) & (F.col("upto") >= F.col("q") * F.col("n") - slack)).alias("within"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "peaks").where("sample_id IS NOT NULL AND chr IS NOT NULL")
    return top_n(rows, ["sample_id", "chr"], ["log10qvalue", "fold_enrichment"], "peak_id", 5)


CAPACITY = 2048


def _filled(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return fill_containers(token_counts(docs, "doc_id", "text"), docs.count(), CAPACITY)


def p8_found(s: SparkSession, d: str) -> DataFrame:
    """Documents that had to be split."""
    return _filled(s, d).where("pieces > 1 AND piece = 0").select(F.col("id").alias("doc_id")).distinct()


def p8_containers(s: SparkSession, d: str) -> DataFrame:
    """Every piece with its container."""
    return _filled(s, d)


def p8_packing(s: SparkSession, d: str) -> DataFrame:
    """Whether no container overflows, every document is there with all its tokens and whole unless it exceeds a container, and at most a hundredth of the space is left over beside each shard's last container."""
    sizes = written(token_counts(table(s, d, "documents"), "doc_id", "text"), "sizes")
    n = sizes.count()
    put = written(fill_containers(sizes, n, CAPACITY), "containers")
    per = put.groupBy("id").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"), F.min("pieces").alias("said"))
    docs = sizes.join(per, "id", "left").agg(F.min((F.col("size") == F.col("tokens")) & (F.col("pieces") == F.greatest(F.ceil(F.col("tokens") / CAPACITY), F.lit(1))) & (F.col("pieces") == F.col("said"))).alias("nothing_lost"))
    bins = put.where("size > 0").groupBy("shard", "bin").agg(F.sum("size").alias("size"))
    filled = bins.agg((F.max("size") <= CAPACITY).alias("no_overflow"), (F.sum("size") >= 0.99 * CAPACITY * (F.count("*") - F.countDistinct("shard"))).alias("well_filled"))
    return docs.crossJoin(F.broadcast(filled))  # one row each


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leaks(table(s, d, "documents"), "doc_id", "text", table(s, d, "benchmark"), "item_id", "text")


def p10_found(s: SparkSession, d: str) -> DataFrame:
    names = sorted(r["subject"] for r in table(s, d, "subjects").where("subject IS NOT NULL").select("subject").distinct().collect())
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    return subjects(table(s, d, "documents"), "doc_id", "text", lang, table(s, d, "subject_labels"), "doc_id", "subject", names)


def queries() -> dict:
    return {
        "p1_percentiles": p1_percentiles, "p1_combined_days": p1_combined_days, "p1_combined_bound": p1_combined_bound, "p3_found": p3_found,
        "p8_found": p8_found, "p8_containers": p8_containers, "p8_packing": p8_packing, "p9_found": p9_found, "p10_found": p10_found,
    }


_VALUES = """
WITH one AS (
  SELECT DISTINCT 'peaks.pileup' AS src, peak_id AS id, chr, sample_id, called_at, pileup AS v FROM peaks
  WHERE pileup IS NOT NULL AND NOT isnan(pileup) AND pileup >= 0
  UNION ALL
  SELECT DISTINCT 'broad_peaks.fold_change', broad_id, chr, sample_id, called_at, fold_change FROM broad_peaks
  WHERE fold_change IS NOT NULL AND NOT isnan(fold_change) AND fold_change >= 0),
vals AS (
  SELECT src, 'chr' AS dim, chr AS grp, v FROM one
  UNION ALL SELECT src, 'sample_id', sample_id, v FROM one
  UNION ALL SELECT src, 'day', strftime(called_at, '%Y-%m-%d'), v FROM one)
"""

ORACLE = {
    "p1_percentiles": _VALUES
    + f", l AS (SELECT src, dim, grp, CAST(count(*) AS BIGINT) AS n, quantile_cont(v, {QS}) AS vs FROM vals WHERE grp IS NOT NULL GROUP BY ALL)\n"
    + f"SELECT src, dim, grp, n, CAST(unnest({QS}) AS DOUBLE) AS q, round(unnest(vs), 8) AS value FROM l",
    "p1_combined_bound": _VALUES + f", l AS (SELECT src, count(*) AS n FROM vals WHERE dim = 'day' AND grp IS NOT NULL GROUP BY src) SELECT src, CAST(n AS BIGINT) AS n, CAST(unnest({QS}) AS DOUBLE) AS q, true AS within FROM l",
    "p8_packing": "SELECT true AS nothing_lost, true AS no_overflow, true AS well_filled",
    "p3_found": """
SELECT sample_id, chr, rnk, peak_id FROM (
  SELECT sample_id, chr, peak_id, CAST(row_number() OVER (PARTITION BY sample_id, chr
    ORDER BY log10qvalue DESC, fold_enrichment DESC NULLS LAST, peak_id) AS INTEGER) AS rnk
  FROM (SELECT DISTINCT sample_id, chr, peak_id, log10qvalue, fold_enrichment FROM peaks
        WHERE log10qvalue IS NOT NULL AND NOT isnan(log10qvalue)))
WHERE rnk <= 5""",
}

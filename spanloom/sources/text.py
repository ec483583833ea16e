"""Line sources with positions, and sinks; formats are told from the suffix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """file, line_no (from 1), value of every line, without its end; gzip and other codecs are told by suffix.

    Files are read in splits. A line's number is its place in the split plus the lines of the file's earlier splits, of which only the counts are gathered.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__seq"), F.col("value"))
    per = raw.groupBy("file", "__at").agg(F.min("__seq").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    # one row a split of the input
    start = per.select("file", "__at", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    both = raw.join(F.broadcast(start), ["file", "__at"])
    return both.select("file", (F.col("__before") + F.col("__seq") - F.col("__first") + 1).alias("line_no"), "value")


def as_lines(df: DataFrame, file: Column, line_no: Column, value: Column) -> DataFrame:
    """Lines that stand in a table."""
    return df.select(file.cast("string").alias("file"), line_no.cast("bigint").alias("line_no"), value.cast("string").alias("value"))


def write_lines(df: DataFrame, value: Column, path: str, compression: str = "none") -> None:
    df.select(value.alias("value")).write.option("compression", compression).text(path)


def map_lines(spark: SparkSession, source: str, target: str, items: Callable[[Column], Column]) -> None:
    """Each line as the array of lines that ``items`` makes of it."""
    write_lines(lines(spark, source).select(F.explode(items(F.col("value"))).alias("v")), F.col("v"), target)


def format_of(path: str) -> str | None:
    """The format a path's suffix tells, below any .gz."""
    name = path.lower().removesuffix(".gz").removesuffix(".bgz")
    known = {"bed": "bed", "wig": "wig", "gff": "gff3", "gff3": "gff3", "gtf": "gtf", "sam": "sam", "bam": "bam", "fasta": "fasta", "fa": "fasta", "fastq": "fastq", "fq": "fastq", "vcf": "vcf", "psl": "psl", "sgr": "sgr", "bar": "bar", "cel": "cel", "bpmap": "bpmap", "xls": "xls", "broadpeak": "broad_peak", "tsv": "table", "track": "track"}
    return known.get(name.rpartition(".")[2])

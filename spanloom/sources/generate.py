"""Random records of the text formats: rows of a range with seeded expressions, so that any number is made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(seed: int, salt: int, n: int) -> Column:
    """A number from 0 to n - 1 that depends on the row's id alone."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(n))


def _letters(seed: int, salt: int, n: int, alphabet: str) -> Column:
    letter = lambda i: F.substr(F.lit(alphabet), (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt), i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), letter), "")


def fastq(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("read_"), F.col("id").cast("string")).alias("name"), _letters(seed, 1, length, "ACGT").alias("sequence"), F.lit("").alias("comment"), _letters(seed, 2, length, "".join(map(chr, range(33, 74)))).alias("qualities"))


def fasta(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("sequence_"), F.col("id").cast("string")).alias("description"), _letters(seed, 1, length, "ACGT").alias("sequence"))


def bed(spark: SparkSession, n: int, chromosomes: int, size: int, widest: int, seed: int = 0) -> DataFrame:
    lo = _pick(seed, 1, size)
    return spark.range(n).select(F.concat(F.lit("chr"), (_pick(seed, 3, chromosomes) + 1).cast("string")).alias("chrom"), lo.alias("chrom_start"), (lo + _pick(seed, 2, widest) + 1).alias("chrom_end"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), _pick(seed, 4, 1001).cast("int").alias("score"), F.array().cast("array<string>").alias("others"))


def table(spark: SparkSession, n: int, kinds: list[str], seed: int = 0) -> DataFrame:
    of = {"int": lambda i: _pick(seed, i, 1_000_000), "float": lambda i: _pick(seed, i, 1_000_000) / 1000.0, "string": lambda i: _letters(seed, i, 8, "abcdefghijklmnopqrstuvwxyz")}
    return spark.range(n).select(*(of[k](i).alias(f"c{i}") for i, k in enumerate(kinds)))


def alignments(spark: SparkSession, n: int, references: int, size: int, length: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("read_"), F.col("id").cast("string")).alias("qname"), (_pick(seed, 1, 2) * 16).cast("int").alias("flag"), F.concat(F.lit("chr"), (_pick(seed, 2, references) + 1).cast("string")).alias("rname"),
                                 (_pick(seed, 3, size) + 1).cast("int").alias("pos"), _pick(seed, 4, 61).cast("int").alias("mapq"), F.lit(f"{length}M").alias("cigar"), _letters(seed, 5, length, "ACGT").alias("seq"))

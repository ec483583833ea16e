"""Command line: python -m spanloom COMMAND ... (bed files of closed or half-open integer ranges, kept as they stand)."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import spanloom
from spanloom.functions.sequence import entrez_url
from spanloom.operators import intervals as iv
from spanloom.operators import streams
from spanloom.operators.demux import Barcode, Rule, demultiplex, statistics
from spanloom.sources import codecs, generate, readers
from spanloom.sources.text import lines, write_lines

_SETS = {"union": iv.union, "intersection": iv.intersection, "difference": iv.difference, "intersects": iv.overlapping}
_CONVERSIONS = ("fastq-to-fasta", "fastq-to-sam", "sam-to-fastq", "fasta-to-fastq", "bed-to-bed-graph", "wig-to-bed-graph", "gff3-to-gtf")


def _bed(spark: SparkSession, path: str) -> DataFrame:
    return codecs.with_mode(codecs.bed(lines(spark, path).where("trim(value) <> ''"), 3), "failfast").where("error IS NULL").select("chrom", F.col("chrom_start").alias("lo"), F.col("chrom_end").alias("hi"))


def _valid(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return readers.read(spark, path, kind).where("error IS NULL")


def _tabbed(df: DataFrame) -> tuple[DataFrame, F.Column]:
    return df, F.concat_ws("\t", *(F.col(c).cast("string") for c in df.columns))


def library(text: str) -> tuple[str, Barcode | Rule]:
    """``name=R1:ACGT:1:0`` (read, barcode, position, mismatches); ``+`` joins barcodes that must all match, ``|`` those of which one must, ``!`` negates one."""
    name, _, rule = text.partition("=")

    def one(x: str) -> Barcode | Rule:
        if x.startswith("!"):
            return Rule("not", (one(x[1:]),))
        read, barcode, *rest = x.split(":")
        return Barcode(read.lower(), barcode, *map(int, rest))

    if not name or not rule:
        raise ValueError(f"not a library: {text}")
    kind, sign = ("or", "|") if "|" in rule else ("and", "+")
    parts = tuple(map(one, rule.split(sign)))
    return name, parts[0] if len(parts) == 1 else Rule(kind, parts)


def _demultiplexed(spark: SparkSession, reads: list[str], libraries: list[str], inclusive: bool, output: str) -> tuple[DataFrame, F.Column]:
    """Writes the records of each read file, in a folder for each library; the statistics are the result."""
    both = None
    for i, path in enumerate(reads, 1):
        one = codecs.with_mode(codecs.fastq(lines(spark, path)), "permissive").select("record", F.col("sequence").alias(f"r{i}"), codecs.fastq_text().alias(f"t{i}"))
        both = one if both is None else both.join(one, "record", "full")
    whole = F.forall(F.array(*(F.col(f"r{i}") for i in range(1, len(reads) + 1))), lambda x: x.isNotNull())
    assigned = demultiplex(streams.demanded(both, whole, "the read files differ in length"), dict(map(library, libraries)), "inclusive" if inclusive else "exclusive")
    for i in range(1, len(reads) + 1):
        assigned.select("library", F.col(f"t{i}").alias("value")).write.partitionBy("library").text(f"{output}/read{i}")
    return _tabbed(statistics(assigned).orderBy("library"))


def _converted(spark: SparkSession, what: str, path: str, scores: str | None) -> tuple[DataFrame, F.Column]:
    if what == "fastq-to-fasta":
        return _valid(spark, path, "fastq").orderBy("file", "record"), F.concat_ws("\n", F.concat(F.lit(">"), F.col("name")), "sequence")
    if what == "fastq-to-sam":
        df = codecs.fastq_to_sam(_valid(spark, path, "fastq"))
        text = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
        return df, F.concat_ws("\t", "qname", text("flag", "4"), text("rname", "*"), text("pos", "0"), text("mapq", "255"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual")
    if what == "sam-to-fastq":
        return codecs.sam_to_fastq(_valid(spark, path, "sam")), codecs.fastq_text()
    if what == "fasta-to-fastq":
        if not scores:
            raise ValueError("scores are needed")
        return codecs.fasta_with_scores(_valid(spark, path, "fasta"), _valid(spark, scores, "fasta")).where("error IS NULL"), codecs.fastq_text()
    if what == "gff3-to-gtf":
        return _valid(spark, path, "gff3").orderBy("file", "line_no"), codecs.gff_line(2)
    if what == "wig-to-bed-graph":
        return _tabbed(codecs.wig_bed_graph(_valid(spark, path, "wig")).where("error IS NULL").orderBy("file", "line_no").select("chrom", "lo", "hi", "val"))
    return _tabbed(iv.depth(_bed(spark, path), ["chrom"]).orderBy("chrom", "lo"))


def _random(spark: SparkSession, kind: str, rows: int, seed: int) -> tuple[DataFrame, F.Column]:
    if kind == "fastq":
        return generate.fastq(spark, rows, 80, seed), codecs.fastq_text()
    if kind == "fasta":
        return generate.fasta(spark, rows, 200, seed), codecs.fasta_text()
    if kind == "sam":
        return generate.alignments(spark, rows, 22, 100_000_000, 80, seed), F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"))
    if kind == "table":
        return _tabbed(generate.table(spark, rows, ["int", "float", "string"], seed))
    return _tabbed(generate.bed(spark, rows, 22, 100_000_000, 5000, seed).select("chrom", F.col("chrom_start").alias("lo"), F.col("chrom_end").alias("hi")).orderBy("chrom", "lo"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("range-set", "coverage"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("output")
    for name in _SETS:
        c = sub.add_parser(name)
        c.add_argument("first")
        c.add_argument("second")
        c.add_argument("output")
    c = sub.add_parser("random")
    c.add_argument("kind", choices=["bed", "fastq", "fasta", "sam", "table"])
    c.add_argument("rows", type=int)
    c.add_argument("output")
    c.add_argument("--seed", type=int, default=0)
    c = sub.add_parser("demux", help="libraries as NAME=R1:BARCODE:POSITION:MISMATCHES, joined by + or |")
    c.add_argument("reads", nargs="+")
    c.add_argument("--library", action="append", required=True)
    c.add_argument("--inclusive", action="store_true")
    c.add_argument("--output", required=True)
    c = sub.add_parser("transform")
    c.add_argument("what", choices=_CONVERSIONS)
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--scores")
    c = sub.add_parser("alignments", help="depth of alignments (SAM or BAM) as bedGraph")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--by", choices=["cigar", "sequence"], default="cigar")
    c.add_argument("--dedup-events", action="store_true")
    c = sub.add_parser("entrez", help="prints the address of a search")
    c.add_argument("database", choices=["pubmed", "gene"])
    c.add_argument("term")
    c.add_argument("--most", type=int)
    sub.add_parser("info")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "info":
        print(f"spanloom: {spanloom.__doc__.strip().splitlines()[0]} Readers: {', '.join(sorted([*readers.READERS, 'bam']))}")
        return
    os.environ["PYTHONPATH"] = f"{os.getcwd()}:{os.environ.get('PYTHONPATH', '')}"
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    if a.command == "entrez":
        print(spark.range(1).select(entrez_url("esearch", db=a.database, term=F.lit(a.term), retmax=a.most).alias("u")).first()["u"])
        return
    if a.command == "random":
        out, value = _random(spark, a.kind, a.rows, a.seed)
    elif a.command == "demux":
        out, value = _demultiplexed(spark, a.reads, a.library, a.inclusive, a.output)
        a.output += "/statistics"
    elif a.command == "transform":
        out, value = _converted(spark, a.what, a.input, a.scores)
    elif a.command == "alignments":
        rows = readers.read(spark, a.input)
        rows = rows.where("error IS NULL") if "error" in rows.columns else rows.withColumn("cigar", codecs.cigar(F.col("cigar")))
        out, value = _tabbed(iv.depth(streams.covered(rows, a.by), ["chrom"], a.dedup_events).orderBy("chrom", "lo"))
    elif a.command in _SETS:
        out, value = _tabbed(_SETS[a.command](_bed(spark, a.first), _bed(spark, a.second), ["chrom"]).orderBy("chrom", "lo"))
    else:
        out, value = _tabbed((iv.merge if a.command == "range-set" else iv.depth)(_bed(spark, a.input), ["chrom"]).orderBy("chrom", "lo"))
    write_lines(out, value, a.output)


if __name__ == "__main__":
    main()

"""One reader for all line formats: the codec is told by the path's suffix, or named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.sources import bam, codecs, vcf
from spanloom.sources.text import format_of, lines

READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "bed": lambda x: codecs.bed(x.where("trim(value) <> '' AND NOT startswith(value, '#')"), 3), "wig": codecs.wig, "gff3": codecs.gff, "gtf": lambda x: codecs.gff(x, 2), "sam": codecs.sam, "fasta": codecs.fasta, "fastq": codecs.fastq, "vcf": vcf.rows, "psl": codecs.psl, "sgr": codecs.sgr,
    "bar": codecs.bar, "cel": codecs.cel, "bpmap": codecs.bpmap, "xls": codecs.macs2_xls, "broad_peak": codecs.broad_peaks, "track": codecs.track,
}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The rows of the file or files at ``path``, valid or with their ``error``. An unknown suffix raises; BAM goes to its data source."""
    kind = kind or format_of(path)
    if kind == "bam":
        bam.register(spark)
        return spark.read.format("spanloom-bam").load(path)
    if kind not in READERS:
        raise ValueError(f"no reader for {path}")
    return READERS[kind](lines(spark, path))

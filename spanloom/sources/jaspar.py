"""Motif databases of three tab-separated files: matrices, their counts, and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.wide import Attr, widen
from spanloom.sources.codecs import _f, _split, failures, integer

_LETTERS = "ACGT"


def matrices(df: DataFrame) -> DataFrame:
    """Lines ``id, collection, base id, version, name``: motif_id, motif_collection, jaspar_id, version, factor_name, error."""
    f = _split(df.where("trim(value) <> ''"))
    ident, version = integer(_f(0)), integer(_f(3))
    tests = [("column_count", F.size("__f") == 5), ("motif_id", ident.isNotNull()), ("version", version.isNotNull())]
    return f.select("file", "line_no", ident.alias("motif_id"), _f(1).alias("motif_collection"), _f(2).alias("jaspar_id"), version.alias("version"), _f(4).alias("factor_name"), failures(*tests).alias("error"))


def counts(df: DataFrame) -> DataFrame:
    """Lines ``id, base, position (from 1), count``: motif_id, base, pos, count, error."""
    f = _split(df.where("trim(value) <> ''"))
    ident, base, pos, n = integer(_f(0)), F.upper(_f(1)), integer(_f(2)), _f(3).try_cast("double")
    tests = [("column_count", F.size("__f") == 4), ("motif_id", ident.isNotNull()), ("base", base.isin(*_LETTERS)), ("position", pos >= 1), ("count", n >= 0)]
    return f.select("file", "line_no", ident.alias("motif_id"), base.alias("base"), pos.alias("pos"), n.cast("int").alias("count"), failures(*tests).alias("error"))


def pivoted(rows: DataFrame) -> DataFrame:
    """motif_id, matrix (a row for each position in order, counts of A, C, G and T) of valid rows of :func:`counts`; a position or base that is missing makes the matrix null."""
    at = rows.where("error IS NULL").groupBy("motif_id", "pos").agg(*(F.max(F.when(F.col("base") == b, F.col("count"))).alias(b) for b in _LETTERS))
    cells = F.array(*(F.col(b) for b in _LETTERS))
    got = at.groupBy("motif_id").agg(F.array_sort(F.collect_list(F.struct("pos", cells.alias("cells")))).alias("m"), F.max("pos").alias("width"))
    whole = (F.size("m") == F.col("width")) & F.forall("m", lambda r: F.forall(r["cells"], lambda c: c.isNotNull()))
    return got.select("motif_id", F.when(whole, F.transform("m", lambda r: r["cells"])).alias("matrix"))


def annotated(motifs: DataFrame, annotations: DataFrame) -> DataFrame:
    """``motifs`` with factor_class, family and medline; motifs without class or medline are left out, the annotation with the highest line decides.

    ``annotations``: motif_id, attr_name, attr_value, line_no.
    """
    attrs = {"factor_class": Attr(("class", "factorclass")), "family": Attr(("family",)), "medline": Attr(("medline",))}
    return motifs.join(widen(annotations, "motif_id", "attr_name", "attr_value", "line_no", attrs), "motif_id").where("factor_class IS NOT NULL AND medline IS NOT NULL")


def load(matrix_lines: DataFrame, count_lines: DataFrame, annotation_lines: DataFrame) -> DataFrame:
    """The three files joined: the columns of valid :func:`matrices`, matrix, factor_class, family, medline."""
    notes = _split(annotation_lines).select(integer(_f(0)).alias("motif_id"), _f(1).alias("attr_name"), _f(2).alias("attr_value"), "line_no").where("motif_id IS NOT NULL")
    known = matrices(matrix_lines).where("error IS NULL").drop("file", "line_no", "error")
    return annotated(known.join(pivoted(counts(count_lines)), "motif_id"), notes)

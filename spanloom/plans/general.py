"""Queries for packed fields, nested records, rejects, attribute rows and interval blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.dyadic import blocks_and_gaps
from spanloom.operators.nested import Edge, Shredded
from spanloom.operators.packed import split_packed
from spanloom.operators.rejects import Layout, bounded, digits, finite_decimal, load_lines, one_of
from spanloom.operators.wide import Attr, widen
from spanloom.runtime import table


def p2_found(s: SparkSession, d: str) -> DataFrame:
    gff = split_packed(table(s, d, "gff_records"), [F.lit("gff"), F.col("gff_id")], "attributes", ";|", pairs=True, decode=True)
    bed = split_packed(table(s, d, "bed_features"), [F.lit("bed"), F.col("bed_id")], "others", "\t;,|")
    return gff.unionByName(bed).toDF("src", "row_id", "pos", "tag", "val")


#: The part of the Entrez gene model that must have its tables whatever occurs in the data.
GENE_MODEL = {
    Edge("record", "answer", False), Edge("answer", "entrezgene_set", True), Edge("entrezgene_set", "entrezgene", False), Edge("entrezgene_set", "gene", False),
    Edge("entrezgene", "gene", False), Edge("gene", "gene_ref", False), Edge("gene", "db", True), Edge("gene_ref", "db", True), Edge("db", "tag", False), Edge("tag", "object_id", False),
}
#: The elements in p4_found's paths; one odd record that has them elsewhere or as lists mustn't move them in all others.
GENE_PATHS = {"answer", "entrezgene", "gene_ref", "tag", "object_id"}


def p4_found(s: SparkSession, d: str) -> DataFrame:
    sh = Shredded(table(s, d, "gene_sets"), "set_id", "payload", GENE_MODEL, GENE_PATHS)
    genes = sh.df("entrezgene_set").where("parent_tab = 'record' AND path = 'answer.entrezgene_set'").select("doc", F.col("row_id").alias("set_row"), F.col("ord").alias("gene_no"))
    refs = sh.df("gene", {"l1": "locus", "l2": "gene_ref.locus"}).where("parent_tab = 'entrezgene_set' AND path IN ('gene', 'entrezgene.gene')")
    refs = refs.select("doc", F.col("parent_id").alias("set_row"), F.col("row_id").alias("gene_row"), "l1", "l2")
    tag = {"t1": "tag.object_id.id", "t2": "tag.object_id.str", "t3": "tag.id", "t4": "tag.str", "t5": "tag.object_id", "t6": "tag"}
    tags = sh.df("db", {"db_name": "db", **tag}).where("parent_tab = 'gene' AND path IN ('db', 'gene_ref.db') AND shape = 'object'")
    tags = tags.select("doc", F.col("parent_id").alias("gene_row"), "path", F.col("ord").alias("db_no"), "db_name", F.coalesce(*tag).alias("tag"))
    got = tags.join(refs, ["doc", "gene_row"]).join(genes, ["doc", "set_row"])
    locus = F.when(F.col("path") == "db", F.col("l1")).otherwise(F.col("l2"))
    return got.select(F.col("doc").alias("set_id"), "gene_no", "db_no", *(F.coalesce(c, F.lit("")).alias(n) for n, c in (("locus", locus), ("db_name", F.col("db_name")), ("tag", F.col("tag")))))


_GFF = ("seqname", "source", "feature", "start_pos", "stop_pos", "score", "strand", "phase", "attributes")
_GFF_TESTS = (("start_pos", digits), ("strand", one_of("+", "-", ".", "?")))
LAYOUTS = {
    "gff3": Layout(_GFF, _GFF_TESTS),
    "gtf": Layout(_GFF, _GFF_TESTS),
    "bed5": Layout(("chrom", "chrom_start", "chrom_end", "feature_name", "score"), (("score", bounded(0, 1000)),), rest=True),
    "xls": Layout(("chr", "peak_start", "peak_end", "peak_length", "abs_summit", "pileup", "log10pvalue", "fold_enrichment", "log10qvalue", "peak_name"), (("pileup", finite_decimal),), header="chr\tstart\tend"),
}


def p5_found(s: SparkSession, d: str) -> DataFrame:
    got = load_lines(table(s, d, "raw_lines"), "line_id", "kind", "raw_line", LAYOUTS)
    return got.where("reason IS NOT NULL").select(F.col("id").alias("line_id"), "reason")


def p5_loaded(s: SparkSession, d: str) -> DataFrame:
    """The valid rows with their fields typed."""
    got = load_lines(table(s, d, "raw_lines"), "line_id", "kind", "raw_line", LAYOUTS).where("reason IS NULL")
    c = F.col("cells")
    return got.select(F.col("id").alias("line_id"), "kind", F.coalesce(c["seqname"], c["chrom"], c["chr"]).alias("chrom"), F.coalesce(c["start_pos"], c["chrom_start"], c["peak_start"]).try_cast("bigint").alias("lo"),
                      c["strand"].alias("strand"), F.when(F.col("kind") == "bed5", c["score"]).try_cast("int").alias("score"), c["pileup"].try_cast("double").alias("pileup"))


_ATTRS = {
    "factor_class": Attr(("class", "factorclass")),
    "family": Attr(("family",)),
    "motif_comment": Attr(("comment",)),
    "medline": Attr(("medline",), "bigint", r"(?<![0-9])[0-9]{7,8}(?![0-9])"),
}


def p6_found(s: SparkSession, d: str) -> DataFrame:
    wide = widen(table(s, d, "motif_annotations"), "motif_id", "attr_name", "attr_value", "line_no", _ATTRS)
    return wide.fillna("", ["factor_class", "family", "motif_comment"]).fillna(0, ["medline"])


def p7_found(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "bed_features").where("track_id IS NOT NULL AND chrom IS NOT NULL")
    return blocks_and_gaps(rows, ["track_id", "chrom"], "chrom_start", "chrom_end")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_loaded": p5_loaded, "p6_found": p6_found, "p7_found": p7_found}

_CONTENT = r"""
WITH l AS (SELECT line_id, kind, regexp_replace(raw_line, '\r$', '') AS x FROM raw_lines WHERE raw_line IS NOT NULL),
c AS (SELECT line_id, kind, x, string_split(x, chr(9)) AS f FROM l
      WHERE NOT regexp_full_match(x, '\s*') AND NOT starts_with(x, '#') AND NOT (kind = 'xls' AND starts_with(x, 'chr' || chr(9) || 'start' || chr(9) || 'end'))),
r AS (SELECT line_id, kind, f, CASE
  WHEN kind IN ('gff3', 'gtf') AND len(f) <> 9 OR kind = 'xls' AND len(f) <> 10 OR kind = 'bed5' AND len(f) < 5 THEN 'column_count'
  WHEN (length(x) - length(replace(x, '"', ''))) % 2 = 1 THEN 'quoting'
  WHEN kind IN ('gff3', 'gtf') AND NOT regexp_full_match(f[4], '[0-9]+') THEN 'start_pos'
  WHEN kind IN ('gff3', 'gtf') AND f[7] NOT IN ('+', '-', '.', '?') THEN 'strand'
  WHEN kind = 'bed5' AND NOT (regexp_full_match(f[5], '[0-9]+') AND coalesce(try_cast(f[5] AS HUGEINT), 9999) <= 1000) THEN 'score'
  WHEN kind = 'xls' AND NOT (regexp_full_match(f[6], '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(try_cast(f[6] AS DOUBLE)), false)) THEN 'pileup'
  END AS reason FROM c)
"""
_PICK = "nullif(nullif(coalesce(trim(regexp_replace(arg_max(coalesce(attr_value, ''), line_no) FILTER (WHERE a IN ({0})), '^\\s+|\\s+$', '', 'g')), ''), ''), '-')"

_AS_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN from_json({0}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{0}] ELSE [] END"

ORACLE = {
    "p4_found": f"""
WITH a AS (SELECT set_id, {_AS_LIST.format("json_extract(payload, '$.answer.entrezgene_set')")} AS l FROM gene_sets),
g AS (SELECT set_id, unnest(range(len(l))) AS gene_no, unnest(l) AS x FROM a),
w AS (SELECT set_id, gene_no, CASE WHEN json_type(x, '$.entrezgene') = 'OBJECT' THEN json_extract(x, '$.entrezgene.gene') ELSE json_extract(x, '$.gene') END AS x FROM g),
r AS (SELECT set_id, gene_no, CASE WHEN json_type(x, '$.gene_ref') = 'OBJECT' THEN json_extract(x, '$.gene_ref') ELSE x END AS x FROM w),
d AS (SELECT set_id, gene_no, x, {_AS_LIST.format("json_extract(x, '$.db')")} AS l FROM r),
t AS (SELECT set_id, gene_no, coalesce(json_extract_string(x, '$.locus'), '') AS locus, unnest(range(len(l))) AS db_no, unnest(l) AS y FROM d)
SELECT set_id, CAST(gene_no AS INTEGER) AS gene_no, CAST(db_no AS INTEGER) AS db_no, locus, coalesce(json_extract_string(y, '$.db'), '') AS db_name,
  coalesce(json_extract_string(y, '$.tag.object_id.id'), json_extract_string(y, '$.tag.object_id.str'), json_extract_string(y, '$.tag.id'), json_extract_string(y, '$.tag.str'),
    CASE WHEN json_type(y, '$.tag') <> 'OBJECT' THEN json_extract_string(y, '$.tag') END, '') AS tag
FROM t WHERE json_type(y) = 'OBJECT'""",
    "p5_found": _CONTENT + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p5_loaded": _CONTENT + """
SELECT line_id, kind, f[1] AS chrom, CASE WHEN kind IN ('gff3', 'gtf') THEN try_cast(f[4] AS BIGINT) ELSE try_cast(f[2] AS BIGINT) END AS lo,
  CASE WHEN kind IN ('gff3', 'gtf') THEN f[7] END AS strand, CASE WHEN kind = 'bed5' THEN try_cast(f[5] AS INTEGER) END AS score,
  CASE WHEN kind = 'xls' THEN try_cast(f[6] AS DOUBLE) END AS pileup FROM r WHERE reason IS NULL""",
    "p6_found": f"""
SELECT motif_id, coalesce({_PICK.format("'class', 'factorclass'")}, '') AS factor_class, coalesce({_PICK.format("'family'")}, '') AS family,
  coalesce({_PICK.format("'comment'")}, '') AS motif_comment,
  coalesce(try_cast(nullif(regexp_extract({_PICK.format("'medline'")}, '(^|[^0-9])([0-9]{{7,8}})($|[^0-9])', 2), '') AS BIGINT), 0) AS medline
FROM (SELECT *, regexp_replace(lower(attr_name), '[\\s_-]', '', 'g') AS a FROM motif_annotations) WHERE motif_id IS NOT NULL GROUP BY motif_id""",
    "p7_found": """
WITH v AS (SELECT track_id, chrom, chrom_start AS lo, chrom_end AS hi FROM bed_features
           WHERE chrom_start < chrom_end AND track_id IS NOT NULL AND chrom IS NOT NULL),
m AS (SELECT *, max(hi) OVER (PARTITION BY track_id, chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS grp FROM m),
b AS (SELECT track_id, chrom, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY track_id, chrom, grp)
SELECT track_id, chrom, 'block' AS kind, lo, hi FROM b
UNION ALL
SELECT track_id, chrom, 'gap', before, lo FROM (SELECT *, lag(hi) OVER (PARTITION BY track_id, chrom ORDER BY lo) AS before FROM b) WHERE before IS NOT NULL""",
}

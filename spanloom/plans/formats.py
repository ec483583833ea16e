"""Queries of sources, writers, conversions and folds: tables written as files or lines, read again and compared with what they were."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import streams
from spanloom.runtime import shared_dir, table
from spanloom.sources import bam, codecs
from spanloom.sources.text import as_lines, lines


def _s(c: str) -> F.Column:
    return F.col(c).cast("string")


def _table(df: DataFrame, ident: str, value: F.Column) -> DataFrame:
    return as_lines(df, F.lit("table"), F.col(ident), value)


def _files(s: SparkSession, d: str) -> DataFrame:
    """A gzipped text file for each nation's customers, read again with line numbers."""
    path = f"{shared_dir(s)}/lines-{uuid.uuid4().hex}"
    rows = table(s, d, "customer").select("c_nationkey", "c_custkey", F.concat_ws("\t", _s("c_custkey"), "c_name").alias("value"))
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.option("compression", "gzip").partitionBy("c_nationkey").text(path)
    return lines(s, path).select(F.regexp_extract("file", "c_nationkey=([0-9]+)", 1).cast("int").alias("nation"), "line_no", "value")


def _bed_typed(s: SparkSession, d: str) -> DataFrame:
    v = F.concat_ws("\t", F.lit("chr1"), _s("p_partkey"), _s("p_size"), "p_brand", _s("p_retailprice"), F.when(F.col("p_size") % 7 == 0, "bad").otherwise(_s("p_size")))
    return codecs.bed_typed(_table(table(s, d, "part"), "p_partkey", v), ["string", "float", "int"]).select("line_no", "chrom_start", "c0", "c1", "c2", "error")


def _gff_again(s: SparkSession, d: str, version: int) -> DataFrame:
    """Names with blanks, tabs or quotes written as GFF and read again."""
    name = F.concat("p_name", F.lit(' "x%"'))
    rows = table(s, d, "part").select(F.col("p_partkey").alias("line_no"), name.alias("seqname"), F.col("p_brand").alias("source"), F.col("p_name").alias("feature"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"),
                                      F.col("p_retailprice").alias("score"), F.lit("+").alias("strand"), F.lit(None).cast("int").alias("phase"), F.array(F.struct(F.lit("id").alias("key"), F.array("p_brand").alias("values"))).alias("attributes"))
    got = codecs.gff(_table(rows, "line_no", codecs.gff_line(version)), version)
    return got.select("line_no", "seqname", "source", "feature", "lo", "hi", "score", F.col("attributes")[0]["values"][0].alias("ident"), "error")


def _header(s: SparkSession, d: str) -> DataFrame:
    """@SQ lines of all suppliers in one file a nation; every seventh lacks a length, and each file repeats its first name."""
    sup = table(s, d, "supplier")
    v = F.concat(F.lit("@SQ\tSN:s"), _s("s_suppkey"), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.concat(F.lit("\tLN:"), F.col("s_suppkey").cast("string"))), F.lit("\tM5:"), "s_name")
    one = sup.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k"))
    again = as_lines(one, _s("s_nationkey"), F.col("k") + 10_000_000, F.concat(F.lit("@SQ\tLN:5\tSN:s"), _s("k")))
    rows = as_lines(sup, _s("s_nationkey"), F.col("s_suppkey"), v).unionByName(again).unionByName(as_lines(one, _s("s_nationkey"), F.lit(0), F.lit("@HD\tVN:1.6\tSO:coordinate")))
    got = codecs.sam_header_checked(rows)
    return got.select("file", "line_no", "record", "name", "length", "sort_order", F.when(F.col("error").isNull(), codecs.sam_header_line()).alias("line"), "error")


def _alignments(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    v = F.concat_ws("\t", F.concat(F.lit("r"), _s("l_orderkey")), _s("l_linenumber"), F.when(n == 7, "*").otherwise(F.concat(F.lit("chr"), _s("l_suppkey"))), _s("l_partkey"), F.when(n == 1, "255").otherwise("60"), F.lit("2S3M"),
                    F.when(n == 2, "=").otherwise("*"), F.lit("0"), (n - 3).cast("string"), F.lit("ACGTN"), F.when(n == 3, "*").otherwise("!5I5+"), F.concat(F.lit("NM:i:"), _s("l_linenumber")))
    return as_lines(table(s, d, "lineitem"), F.lit("f"), F.col("l_orderkey") * 10 + n, v)


def _sam_again(s: SparkSession, d: str) -> DataFrame:
    return codecs.sam(_alignments(s, d)).select("line_no", codecs.sam_line().alias("line"))


def _fastq(s: SparkSession, d: str) -> DataFrame:
    k = F.translate(_s("o_orderkey"), "0123456789", "ACGTACGTAC")
    return table(s, d, "orders").select(F.concat(F.lit("r"), _s("o_orderkey"), F.lit(" x")).alias("name"), k.alias("sequence"), F.repeat(F.lit("5"), F.length(k)).alias("qualities"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Reads parted into sequences and scores, and put together again."""
    fa = codecs.fastq_to_fasta(_fastq(s, d))
    return codecs.fasta_with_scores(fa.select(F.col("name").alias("description"), "sequence"), fa.select(F.col("name").alias("description"), F.col("scores").alias("sequence"))).select("name", "sequence", "qualities", "error")


def _track_content(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 5
    bed = F.concat_ws("\t", F.lit("chr1"), _s("p_partkey"), _s("p_size"), "p_brand", _s("p_size"))
    v = F.when(n == 0, F.concat(F.lit('track name="a\\"b\\\\c\\tq\\065" description='), "p_brand")).when(n == 1, "browser hide all").when(n == 2, "# x").otherwise(bed)
    rows = _table(table(s, d, "part"), "p_partkey", v)
    items = codecs.track_content(rows, codecs.bed).select("line_no", F.col("name"), "chrom_start", "error")
    heads = codecs.track(rows).where("kind = 'track'").select("line_no", F.col("attributes")[0]["value"].alias("name"), F.lit(None).cast("bigint").alias("chrom_start"), "error")
    return items.unionByName(heads)


def _bam(s: SparkSession, d: str) -> DataFrame:
    """Orders written as BAM files, a file a partition, and read in ranges of blocks."""
    k = _s("o_orderkey")
    seq = F.translate(F.concat(k, F.reverse(k)), "0123456789", "ACGTACGTAC")
    rows = table(s, d, "orders").select(F.concat(F.lit("r"), k).alias("qname"), (F.col("o_orderkey") % 4096).cast("int").alias("flag"), F.lit("chr1").alias("rname"), (F.col("o_custkey") + 1).cast("int").alias("pos"), F.when(F.col("o_orderkey") % 5 > 0, 60).alias("mapq"),
                                        F.concat(F.length(seq).cast("string"), F.lit("M")).alias("cigar"), F.lit(None).cast("string").alias("rnext"), F.lit(None).cast("int").alias("pnext"), F.lit(-7).alias("tlen"), seq.alias("seq"), F.repeat(F.lit("I"), F.length(seq)).alias("qual"))
    path = f"{shared_dir(s)}/bam-{uuid.uuid4().hex}"
    bam.write_bams(rows.repartition(4), path, [("chr1", 1_000_000)])
    bam.register(s)
    return s.read.format("spanloom-bam").schema("qname string, flag int, rname string, pos int, mapq int, cigar string, tlen int, seq string, qual string").option("splitBytes", 65_536).load(path)


def _zip3(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    parts = [(c.select("c_custkey"), ["c_custkey"]), (c.select("c_name"), ["c_name"]), (c.select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"])]
    return streams.zip_all(*parts).select("pos", "t0.c_custkey", "t1.c_name", "t2.c_acctbal")


def _fold(s: SparkSession, d: str) -> DataFrame:
    """A sum that is halved before each addition, so that order matters."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return streams.ordered_fold(rows, ["l_orderkey"], ["l_linenumber"], F.col("l_quantity").cast("double"), F.lit(0.0), lambda a, x: a / 2 + x, "value")


QUERIES = {
    "s01_lines": _files,
    "s18_bam": _bam,
    "s06_bed_typed": _bed_typed,
    "s10_gff3_again": lambda s, d: _gff_again(s, d, 3),
    "s10_gff2_again": lambda s, d: _gff_again(s, d, 2),
    "s12_track_content": _track_content,
    "s17_sam_header": _header,
    "s17_sam_again": _sam_again,
    "q06_fastq_to_sam": lambda s, d: codecs.fastq_to_sam(_fastq(s, d)).select("qname", "flag", "cigar", "seq", "qual"),
    "q06_fasta_with_scores": _scores,
    "j10_zip_exact": lambda s, d: streams.zip_exact(table(s, d, "customer").select("c_custkey"), ["c_custkey"], table(s, d, "customer").select("c_name"), ["c_name"]).select("pos", "a.c_custkey", "b.c_name"),
    "j11_zip_three": _zip3,
    "g18_ordered_fold": _fold,
    "t04_first_bytes": lambda s, d: streams.first_bytes(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), ["doc_id"], F.octet_length("text"), 100_000).select("doc_id"),
    "t07_shuffled": lambda s, d: streams.shuffled(table(s, d, "nation").select("n_nationkey"), 3),
    "c06_composed": lambda s, d: streams.compose(lambda x: x.where("value > 10"), lambda x: x.withColumn("twice", F.col("value") * 2))(table(s, d, "events").select("event_id", "value")),
    "c09_on_ok": lambda s, d: codecs.sgr(_table(table(s, d, "events"), "event_id", F.concat_ws("\t", _s("user_id"), _s("event_id"), F.when(F.col("event_id") % 10 == 3, "bad").otherwise(_s("value"))))).groupBy(F.col("error").isNull().alias("ok")).agg(F.count("*").alias("n")),
}

ORACLE = {
    "s01_lines": "SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line_no, c_custkey || chr(9) || c_name AS value FROM customer",
    "s18_bam": """WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders), q AS (SELECT *, translate(k || reverse(k), '0123456789', 'ACGTACGTAC') AS seq FROM o)
SELECT 'r' || k AS qname, CAST(o_orderkey % 4096 AS INTEGER) AS flag, 'chr1' AS rname, CAST(o_custkey + 1 AS INTEGER) AS pos, CASE WHEN o_orderkey % 5 > 0 THEN 60 END AS mapq, length(seq) || 'M' AS cigar, -7 AS tlen, seq, repeat('I', length(seq)) AS qual FROM q""",
    "s06_bed_typed": "SELECT p_partkey AS line_no, p_partkey AS chrom_start, p_brand AS c0, CAST(p_retailprice AS DOUBLE) AS c1, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS BIGINT) END AS c2, CASE WHEN p_size % 7 = 0 THEN 'c2' END AS error FROM part",
    "s12_track_content": """SELECT p_partkey AS line_no, CASE WHEN p_partkey % 5 = 0 THEN 'a"b\\c' || chr(9) || 'qA' ELSE p_brand END AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS chrom_start, CAST(NULL AS VARCHAR) AS error FROM part WHERE p_partkey % 5 IN (0, 3, 4)""",
    "s17_sam_header": """WITH l AS (SELECT CAST(s_nationkey AS VARCHAR) AS file, s_suppkey AS line_no, s_suppkey AS k, s_name AS p FROM supplier),
o AS (SELECT s_nationkey AS n, min(s_suppkey) AS k FROM supplier GROUP BY 1)
SELECT file, line_no, 'SQ' AS record, 's' || k AS name, CASE WHEN k % 7 <> 0 THEN k END AS length, CAST(NULL AS VARCHAR) AS sort_order, CASE WHEN k % 7 <> 0 THEN '@SQ' || chr(9) || 'SN:s' || k || chr(9) || 'LN:' || k || chr(9) || 'M5:' || p END AS line,
  CASE WHEN k % 7 = 0 THEN 'missing_tag' END AS error FROM l
UNION ALL SELECT CAST(n AS VARCHAR), k + 10000000, 'SQ', 's' || k, 5, NULL, NULL, 'duplicate' FROM o
UNION ALL SELECT CAST(n AS VARCHAR), 0, 'HD', NULL, NULL, 'coordinate', '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:coordinate', NULL FROM o""",
    "s17_sam_again": """SELECT l_orderkey * 10 + l_linenumber AS line_no, concat_ws(chr(9), 'r' || l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '*' ELSE 'chr' || l_suppkey END, l_partkey, CASE WHEN l_linenumber = 1 THEN '255' ELSE '60' END, '2S3M',
  CASE WHEN l_linenumber = 2 THEN '=' ELSE '*' END, '0', l_linenumber - 3, 'ACGTN', CASE WHEN l_linenumber = 3 THEN '*' ELSE '!5I5+' END, 'NM:i:' || l_linenumber) AS line FROM lineitem""",
    "q06_fastq_to_sam": "SELECT 'r' || o_orderkey AS qname, 4 AS flag, '*' AS cigar, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'ACGTACGTAC') AS seq, repeat('5', length(CAST(o_orderkey AS VARCHAR))) AS qual FROM orders",
    "q06_fasta_with_scores": "SELECT 'r' || o_orderkey || ' x' AS name, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'ACGTACGTAC') AS sequence, repeat('5', length(CAST(o_orderkey AS VARCHAR))) AS qualities, CAST(NULL AS VARCHAR) AS error FROM orders",
    "j10_zip_exact": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey, c_name FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) JOIN (SELECT c_name, row_number() OVER (ORDER BY c_name) AS i FROM customer) USING (i)",
    "j11_zip_three": """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), b AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS pos FROM customer), c AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer)
SELECT pos, c_custkey, c_name, c_acctbal FROM a JOIN b USING (pos) JOIN c USING (pos)""",
    "g18_ordered_fold": "SELECT l_orderkey, list_reduce(list(CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber, l_quantity), lambda a, x: a / 2 + x) AS value FROM lineitem GROUP BY 1",
    "t04_first_bytes": "SELECT doc_id FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n <= 100000",
    "t07_shuffled": "SELECT n_nationkey FROM nation",
    "c06_composed": "SELECT event_id, value, value * 2 AS twice FROM events WHERE value > 10",
    "c09_on_ok": "SELECT event_id % 10 <> 3 AS ok, count(*) AS n FROM events GROUP BY 1",
}
_GFF = """SELECT p_partkey AS line_no, p_name || ' "x%"' AS seqname, p_brand AS source, p_name AS feature, p_partkey AS lo, p_partkey + p_size AS hi, CAST(p_retailprice AS DOUBLE) AS score, p_brand AS ident, CAST(NULL AS VARCHAR) AS error FROM part"""
ORACLE |= {"s10_gff3_again": _GFF, "s10_gff2_again": _GFF}

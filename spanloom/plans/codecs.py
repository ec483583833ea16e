"""Queries of the text codecs: lines made of tables, or the raw lines, parsed and compared with what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.sequence import chunks
from spanloom.sources import codecs, vcf
from spanloom.sources.text import as_lines
from spanloom.runtime import spread, table


def _raw(s: SparkSession, d: str, kind: str) -> DataFrame:
    rows = table(s, d, "raw_lines").where((F.col("kind") == kind) & F.col("raw_line").isNotNull())
    return as_lines(rows, F.col("file_name"), F.col("line_id"), F.regexp_replace("raw_line", "\r$", ""))


def _lines(df: DataFrame, ident: str, value: F.Column) -> DataFrame:
    return as_lines(df, F.lit("table"), F.col(ident), value)


def _s(c: str) -> F.Column:
    return F.col(c).cast("string")


def _psl(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    n = _s("p_size")
    v = F.concat_ws("\t", n, *[F.lit("0")] * 7, F.lit("+-"), "p_brand", n, F.lit("0"), n, F.lit("chr1"), F.lit("1000"), _s("p_partkey"), _s("p_partkey"), F.lit("2"), F.concat(n, F.lit(",7,")), F.lit("0,8,"), F.lit("1,9,"))
    got = codecs.psl(_lines(p, "p_partkey", v))
    return got.select("line_no", "matches", "q_name", "q_strand", "t_strand", F.aggregate("block_sizes", F.lit(0), lambda a, x: a + x).alias("bases"), "error")


def _typed_rows(s: SparkSession, d: str) -> DataFrame:
    """A value that isn't there is a dot. Names stand in quotes, their tabs escaped, as a table has neither empty cells nor cells with separators."""
    ident, pileup, name = (F.coalesce(_s(c), F.lit(".")) for c in ("peak_id", "pileup", "peak_name"))
    bare = F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("\t"), F.lit("%09"))
    got = codecs.typed_rows(_lines(table(s, d, "peaks"), "peak_id", F.concat_ws("\t", ident, pileup, F.concat(F.lit('"'), bare, F.lit('"')))), ["int", "float", "string"], "\t")
    cell = F.substr("c2", F.lit(2), F.length("c2") - 2)
    return got.withColumn("c2", F.replace(F.replace(cell, F.lit("%09"), F.lit("\t")), F.lit("%25"), F.lit("%")))


def _sgr(s: SparkSession, d: str) -> DataFrame:
    v = F.concat_ws("\t", F.concat(F.lit("chr"), _s("user_id")), _s("event_id"), F.when(F.col("event_id") % 10 == 3, F.lit("bad")).otherwise(_s("value")))
    return codecs.sgr(_lines(table(s, d, "events"), "event_id", v), 1).select("line_no", "chrom", "pos", F.col("error"))


def _bpmap(s: SparkSession, d: str) -> DataFrame:
    v = F.concat_ws("\t", _s("p_size"), F.lit("1"), _s("p_size"), F.lit("2"), F.concat(F.lit("Hs:NCBI;chr"), _s("p_size")), _s("p_partkey"), F.translate(_s("p_partkey"), "0123456789", "ACGTACGTAC"))
    return codecs.bpmap(_lines(table(s, d, "part"), "p_partkey", v)).select("line_no", "pm_x", "org", "version", "chrom", "start", "sequence", "error")


def _wig_lines(s: SparkSession, d: str) -> DataFrame:
    """For each supplier a file: a declaration by its parity, then values; every eleventh line is faulty."""
    o = table(s, d, "orders")
    k = F.col("o_custkey")
    head = o.select(k.alias("c")).distinct().select(F.concat(F.lit("u"), F.col("c").cast("string")).alias("file"), F.lit(0).cast("bigint").alias("line_no"), F.when(F.col("c") % 2 == 0, F.concat(F.lit("variableStep chrom=chr"), F.col("c").cast("string"), F.lit(" span=5"))).otherwise(F.concat(F.lit("fixedStep chrom=chr"), F.col("c").cast("string"), F.lit(" start=100 step=10 span=4"))).alias("value"))
    body = o.select(F.concat(F.lit("u"), k.cast("string")).alias("file"), F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 11 == 0, "x y z").when(k % 2 == 0, F.concat_ws(" ", _s("o_orderkey"), F.lit("1.5"))).otherwise("2.5").alias("value"))
    return head.unionByName(body)


def _fasta(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")).where("seq <> ''")
    lines = b.select("doc_id", F.posexplode(F.concat(F.array(F.concat(F.lit(">"), F.col("doc_id").cast("string"))), chunks(F.col("seq"), 60))).alias("i", "value"))
    got = codecs.fasta(as_lines(lines, F.lit("f"), F.col("doc_id") * 100000 + F.col("i"), F.col("value")))
    return got.select(F.col("description").cast("bigint").alias("doc_id"), "sequence", "error")


def _fastq(s: SparkSession, d: str) -> DataFrame:
    seq = F.translate(_s("o_orderkey"), "0123456789", "ACGTACGTAC")
    four = F.array(F.concat(F.lit("@r"), _s("o_orderkey")), seq, F.lit("+"), F.when(F.col("o_orderkey") % 13 == 0, "I").otherwise(F.repeat(F.lit("I"), F.length(seq))))
    rows = table(s, d, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string")).alias("file"), F.col("o_orderkey").alias("k"), F.posexplode(four).alias("i", "value"))
    got = codecs.fastq(rows.select("file", (F.floor(F.col("k") / 50) * 4 + F.col("i") + 1).alias("line_no"), "value"))
    return got.select("name", "sequence", "qualities", "error")


def _sam(s: SparkSession, d: str) -> DataFrame:
    v = F.concat_ws("\t", F.concat(F.lit("r"), _s("l_orderkey")), ((F.col("l_orderkey") * 7) % 4096).cast("string"), F.when(F.col("l_linenumber") == 7, "*").otherwise(F.concat(F.lit("chr"), _s("l_suppkey"))), _s("l_partkey"), F.when(F.col("l_linenumber") == 1, "255").otherwise("60"),
                    F.when(F.col("l_orderkey") % 17 == 0, "8Q").otherwise("4M"), F.lit("="), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"), F.concat(F.lit("NM:i:"), _s("l_linenumber")))
    got = codecs.sam(_lines(table(s, d, "lineitem").withColumn("n", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "n", v))
    return got.select("line_no", "qname", "flag", "rname", "pos", "mapq", "rnext", "pnext", F.size("qual").alias("n_qual"), F.get("tags", F.lit(0)).getField("value").alias("nm"), "error")


def _sam_to_fastq(s: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_linenumber") % 2 == 0, "16").when(F.col("l_linenumber") == 3, "256").otherwise("0")
    v = F.concat_ws("\t", F.concat(F.lit("r"), _s("l_orderkey"), F.lit("."), _s("l_linenumber")), flag, F.lit("chr1"), F.lit("7"), F.lit("60"), F.lit("5M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("AACGT"), F.lit("!5I5+"))
    got = codecs.sam_to_fastq(codecs.sam(_lines(table(s, d, "lineitem"), "l_orderkey", v)))
    return got.select("name", "sequence", "qualities")


def _vcf(s: SparkSession, d: str) -> DataFrame:
    head = ["##fileformat=VCFv4.1", '##INFO=<ID=XX,Number=2,Type=Integer,Description="two">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="q">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]
    h = s.createDataFrame([("v", i - 10, x) for i, x in enumerate(head)], "file string, line_no bigint, value string")
    info = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("XX="), _s("p_size"))).when(F.col("p_size") % 5 == 1, F.lit("NOPE=1")).otherwise(F.concat(F.lit("DB;XX="), _s("p_size"), F.lit(",7;DP="), _s("p_size")))
    v = F.concat_ws("\t", F.lit("20"), _s("p_partkey"), F.lit("."), F.lit("G"), F.when(F.col("p_size") == 1, "<DEL>").otherwise("A,T"), F.lit("."), F.lit("PASS"), info, F.lit("GT:GQ"), F.concat(F.lit("0|1:"), _s("p_size")))
    got = vcf.rows(h.unionByName(as_lines(spread(table(s, d, "part").select("p_partkey", "p_size")), F.lit("v"), F.col("p_partkey"), v)))
    key = lambda k, field: F.get(F.filter("info", lambda x: x["key"] == k), F.lit(0)).getField("values").getItem(0).getField(field)
    return got.where("error IS NULL").select("line_no", "pos", F.size("alts").alias("n_alts"), key("DP", "i").alias("dp"), key("XX", "i").alias("xx"), F.get(F.get("samples", F.lit(0)).getField("values"), F.lit(1)).getField("values").getItem(0).getField("i").alias("gq")).unionByName(
        got.where("error IS NOT NULL").groupBy().agg(F.lit(-1).cast("bigint").alias("line_no"), F.count("*").alias("pos"), F.lit(0).alias("n_alts"), F.lit(0).cast("bigint").alias("dp"), F.lit(0).cast("bigint").alias("xx"), F.lit(0).cast("bigint").alias("gq")))


def _bar(s: SparkSession, d: str) -> DataFrame:
    """One file, a section for each nation's customers."""
    c = table(s, d, "customer")
    n = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    k = F.col("c_nationkey")
    head = n.select((k * 1000000).cast("bigint").alias("line_no"), F.posexplode(F.array(F.concat(F.lit("# Seq\t"), k.cast("string")), F.concat(F.lit("# Name\tchr"), k.cast("string")), F.concat(F.lit("# Number of hits\t"), F.col("n").cast("string")), F.lit(""))).alias("i", "value")).select(F.lit("b").alias("file"), (F.col("line_no") + F.col("i")).alias("line_no"), "value")
    body = c.select(F.lit("b").alias("file"), (k * 1000000 + 10 + F.col("c_custkey")).cast("bigint").alias("line_no"), F.concat_ws("\t", _s("c_custkey"), _s("c_acctbal")).alias("value"))
    return codecs.bar(head.unionByName(body)).select("section", "pos", "val", "error")


def _cel(s: SparkSession, d: str) -> DataFrame:
    head = s.createDataFrame([("c", 0, "[CEL]"), ("c", 1, "Version=3"), ("c", 2, "[INTENSITY]"), ("c", 3, "NumberCells=1"), ("c", 4, "CellHeader=X\tY\tMEAN\tSTDV\tNPIXELS"), ("c", 10**9, "[MASKS]"), ("c", 10**9 + 1, "1\t2\t3\t4\t5")], "file string, line_no bigint, value string")
    body = table(s, d, "part").select(F.lit("c").alias("file"), (F.col("p_partkey") + 10).alias("line_no"), F.concat_ws("\t", _s("p_partkey"), _s("p_size"), _s("p_retailprice"), F.lit("1.5"), F.lit(" 9")).alias("value"))
    return codecs.cel(head.unionByName(body)).select("x", "y", "mean", "npixels", "error")


def _track(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    v = F.when(n == 0, F.concat(F.lit('track name="'), F.col("p_brand"), F.lit(' x" type=wiggle_0'))).when(n == 1, F.concat(F.lit("browser position chr7:"), _s("p_size"), F.lit("-100"))).when(n == 2, "browser hide all").otherwise(F.concat(F.lit("chr1 "), _s("p_size")))
    return codecs.track(_lines(table(s, d, "part"), "p_partkey", v)).select("line_no", "kind", F.get("attributes", F.lit(0)).getField("value").alias("name"), "lo", "hi", "content", "error")


QUERIES = {
    "s05_bed": lambda s, d: codecs.bed(_raw(s, d, "bed5").where("value <> '' AND NOT startswith(value, '#')")).where("error IS NULL").select("line_no", "chrom", "chrom_start", "chrom_end", "name", "score", F.size("others").alias("more")),
    "s07_typed_rows": _typed_rows,
    "s08_wig": lambda s, d: codecs.wig(_wig_lines(s, d)).groupBy("kind", "error").agg(F.count("*").alias("n"), F.sum("val").alias("total")),
    "s09_wig_bed_graph": lambda s, d: codecs.wig_bed_graph(codecs.wig(_wig_lines(s, d))).where("error IS NULL").select("line_no", "chrom", "lo", "hi", "val"),
    "s11_gff3": lambda s, d: codecs.gff(_raw(s, d, "gff3")).where("error IS NULL").select("line_no", "seqname", "source", "lo", "hi", "score", "strand", "phase", F.get("attributes", F.lit(0)).getField("values").getItem(0).alias("ident")),
    "s11_gtf": lambda s, d: codecs.gff(_raw(s, d, "gtf"), 2).where("error IS NULL").select("line_no", "lo", "hi", "strand", F.size("attributes").alias("n"), F.get("attributes", F.lit(0)).getField("values").getItem(0).alias("gene")),
    "s12_track": _track,
    "s13_vcf": _vcf,
    "s14_psl": _psl,
    "s15_fasta": _fasta,
    "s16_fastq": _fastq,
    "s17_sam": _sam,
    "q06_sam_to_fastq": _sam_to_fastq,
    "s21_sgr": _sgr,
    "s22_bar": _bar,
    "s23_bpmap": _bpmap,
    "s24_cel": _cel,
    "s25_macs2": lambda s, d: codecs.macs2_xls(_raw(s, d, "xls")).where("error IS NULL").select("line_no", "chr", "peak_start", "peak_end", "abs_summit", "pileup", "log10qvalue", "peak_name"),
}

_X = r"WITH l AS (SELECT line_id AS line_no, kind, regexp_replace(raw_line, '\r$', '') AS x FROM raw_lines WHERE raw_line IS NOT NULL), c AS (SELECT *, string_split(x, chr(9)) AS f FROM l WHERE x <> '' AND NOT starts_with(x, '#'))"
_INT = lambda c: f"(regexp_full_match({c}, '[+-]?[0-9]+') AND try_cast({c} AS BIGINT) IS NOT NULL)"
_NUM = lambda c: f"regexp_full_match({c}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?([iI]nf(inity)?|nan|NaN)')"
_GFF_OK = f"len(f) = 9 AND {_INT('f[4]')} AND {_INT('f[5]')} AND (f[8] = '.' OR {_INT('f[8]')}) AND (f[6] = '.' OR {_NUM('f[6]')}) AND f[7] IN ('+', '-', '.', '?')"

ORACLE = {
    "s05_bed": _X + f"""SELECT line_no, f[1] AS chrom, CAST(f[2] AS BIGINT) AS chrom_start, CAST(f[3] AS BIGINT) AS chrom_end, f[4] AS name, CAST(f[5] AS INTEGER) AS score, CAST(len(f) - 5 AS INTEGER) AS more FROM c
WHERE kind = 'bed5' AND len(f) >= 5 AND {_INT('f[2]')} AND {_INT('f[3]')} AND {_INT('f[5]')} AND try_cast(f[2] AS BIGINT) >= 0 AND try_cast(f[3] AS BIGINT) >= 0 AND try_cast(f[5] AS BIGINT) BETWEEN 0 AND 1000""",
    "s07_typed_rows": "SELECT 'table' AS file, peak_id AS line_no, peak_id AS c0, pileup AS c1, coalesce(peak_name, '.') AS c2, CASE WHEN peak_id IS NULL THEN 'c0' WHEN pileup IS NULL THEN 'c1' END AS error FROM peaks",
    "s08_wig": """WITH o AS (SELECT o_custkey AS c, o_orderkey % 11 = 0 AS bad FROM orders), r AS (SELECT CASE WHEN bad THEN NULL WHEN c % 2 = 0 THEN 'variable_value' ELSE 'fixed_value' END AS kind, CASE WHEN bad THEN 'unrecognizable_line' END AS error, CASE WHEN bad THEN NULL WHEN c % 2 = 0 THEN 1.5::DOUBLE ELSE 2.5::DOUBLE END AS v FROM o
UNION ALL SELECT CASE WHEN c % 2 = 0 THEN 'variable' ELSE 'fixed' END, NULL, NULL FROM (SELECT DISTINCT c FROM o)) SELECT kind, error, count(*) AS n, sum(v) AS total FROM r GROUP BY 1, 2""",
    "s09_wig_bed_graph": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderkey % 11 <> 0)
SELECT k AS line_no, 'chr' || c AS chrom, CASE WHEN c % 2 = 0 THEN k ELSE 100 + 10 * n END AS lo, CASE WHEN c % 2 = 0 THEN k + 4 ELSE 103 + 10 * n END AS hi, CASE WHEN c % 2 = 0 THEN 1.5::DOUBLE ELSE 2.5::DOUBLE END AS val FROM o""",
    "s11_gff3": _X + f"""SELECT line_no, f[1] AS seqname, nullif(f[2], '.') AS source, CAST(f[4] AS BIGINT) AS lo, CAST(f[5] AS BIGINT) AS hi, try_cast(nullif(f[6], '.') AS DOUBLE) AS score, f[7] AS strand, try_cast(nullif(f[8], '.') AS INTEGER) AS phase,
regexp_extract(f[9], '^[^=]*=([^;,]*)', 1) AS ident FROM c WHERE kind = 'gff3' AND {_GFF_OK} AND contains(f[9], '=')""",
    "s11_gtf": _X + f"""SELECT line_no, CAST(f[4] AS BIGINT) AS lo, CAST(f[5] AS BIGINT) AS hi, f[7] AS strand, CAST(len(regexp_extract_all(f[9], '[a-z_]+ "[^"]*"')) AS INTEGER) AS n, regexp_extract(f[9], '^gene_id "([^"]*)"', 1) AS gene FROM c
WHERE kind = 'gtf' AND {_GFF_OK} AND regexp_full_match(f[9], '(\\s*[^\\s";]+\\s+("[^"]*"|[^\\s";]+)\\s*;)*(\\s*[^\\s";]+\\s+("[^"]*"|[^\\s";]+)\\s*;?)?\\s*')""",
    "s12_track": """SELECT p_partkey AS line_no, CASE p_partkey % 4 WHEN 0 THEN 'track' WHEN 1 THEN 'browser_position' WHEN 2 THEN 'browser_hide' ELSE 'content' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN p_brand || ' x' END AS name,
CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size AS BIGINT) END AS lo, CASE WHEN p_partkey % 4 = 1 THEN CAST(100 AS BIGINT) END AS hi, CASE WHEN p_partkey % 4 = 3 THEN 'chr1 ' || p_size END AS content, CAST(NULL AS VARCHAR) AS error FROM part""",
    "s13_vcf": """SELECT p_partkey AS line_no, p_partkey AS pos, CAST(CASE WHEN p_size = 1 THEN 1 ELSE 2 END AS INTEGER) AS n_alts, CAST(p_size AS BIGINT) AS dp, CAST(p_size AS BIGINT) AS xx, CAST(p_size AS BIGINT) AS gq FROM part WHERE p_size % 5 > 1
UNION ALL SELECT -1, count(*), 0, 0, 0, 0 FROM part WHERE p_size % 5 <= 1""",
    "s14_psl": "SELECT p_partkey AS line_no, CAST(p_size AS BIGINT) AS matches, p_brand AS q_name, '+' AS q_strand, '-' AS t_strand, CAST(p_size + 7 AS INTEGER) AS bases, CAST(NULL AS VARCHAR) AS error FROM part",
    "s15_fasta": "SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS sequence, CAST(NULL AS VARCHAR) AS error FROM documents WHERE regexp_replace(upper(text), '[^ACGT]', '', 'g') <> ''",
    "s16_fastq": """SELECT 'r' || o_orderkey AS name, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'ACGTACGTAC') AS sequence, CASE WHEN o_orderkey % 13 = 0 THEN 'I' ELSE repeat('I', length(CAST(o_orderkey AS VARCHAR))) END AS qualities,
CASE WHEN o_orderkey % 13 = 0 AND length(CAST(o_orderkey AS VARCHAR)) <> 1 THEN 'qualities' END AS error FROM orders""",
    "s17_sam": """SELECT l_orderkey * 10 + l_linenumber AS line_no, 'r' || l_orderkey AS qname, CAST((l_orderkey * 7) % 4096 AS INTEGER) AS flag, CASE WHEN l_linenumber <> 7 THEN 'chr' || l_suppkey END AS rname, CAST(nullif(l_partkey, 0) AS INTEGER) AS pos,
CASE WHEN l_linenumber <> 1 THEN 60 END AS mapq, CASE WHEN l_linenumber <> 7 THEN 'chr' || l_suppkey END AS rnext, CAST(NULL AS INTEGER) AS pnext, 4 AS n_qual, CAST(l_linenumber AS VARCHAR) AS nm, CASE WHEN l_orderkey % 17 = 0 THEN 'cigar' END AS error FROM lineitem""",
    "q06_sam_to_fastq": """SELECT 'r' || l_orderkey || '.' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'ACGTT' ELSE 'AACGT' END AS sequence, CASE WHEN l_linenumber % 2 = 0 THEN '+5I5!' ELSE '!5I5+' END AS qualities FROM lineitem WHERE l_linenumber <> 3""",
    "s21_sgr": "SELECT event_id AS line_no, 'chr' || user_id AS chrom, event_id + 1 AS pos, CASE WHEN event_id % 10 = 3 THEN 'val' END AS error FROM events",
    "s22_bar": "SELECT 'chr' || c_nationkey AS section, c_custkey AS pos, c_acctbal AS val, CAST(NULL AS VARCHAR) AS error FROM customer",
    "s23_bpmap": "SELECT p_partkey AS line_no, CAST(p_size AS BIGINT) AS pm_x, 'Hs' AS org, 'NCBI' AS version, 'chr' || p_size AS chrom, p_partkey AS start, translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ACGTACGTAC') AS sequence, CAST(NULL AS VARCHAR) AS error FROM part",
    "s24_cel": "SELECT CAST(p_partkey AS INTEGER) AS x, p_size AS y, p_retailprice AS mean, 9 AS npixels, CAST(NULL AS VARCHAR) AS error FROM part",
    "s25_macs2": _X + f"""SELECT line_no, f[1] AS chr, CAST(f[2] AS BIGINT) AS peak_start, CAST(f[3] AS BIGINT) AS peak_end, CAST(f[5] AS BIGINT) AS abs_summit, CAST(f[6] AS DOUBLE) AS pileup, CAST(f[9] AS DOUBLE) AS log10qvalue, f[10] AS peak_name FROM c
WHERE kind = 'xls' AND len(f) = 10 AND {' AND '.join(_INT(f'f[{i}]') for i in (2, 3, 4, 5))} AND {' AND '.join(_NUM(f'f[{i}]') for i in (6, 7, 8, 9))}""",
}

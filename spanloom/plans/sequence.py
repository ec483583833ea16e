"""Queries of sequence functions, motifs, demultiplexing, flags, combinators and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import sequence as sq
from spanloom.operators import motifs, streams
from spanloom.operators.demux import Barcode, Rule, demultiplex, statistics
from spanloom.runtime import table
from spanloom.sources import codecs, jaspar
from spanloom.sources.text import as_lines

# A motif of six positions, as counts of A, C, G and T.
MATRIX = [[12, 3, 1, 4], [1, 15, 2, 2], [0, 1, 18, 1], [9, 1, 1, 9], [3, 3, 13, 1], [2, 16, 1, 1]]


def _bases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def _reads(s: SparkSession, d: str) -> DataFrame:
    digits = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    return table(s, d, "orders").select("o_orderkey", F.translate(F.reverse(digits), "0123456789", "ACGTACGTAC").alias("r1"), F.translate(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), "0123456789", "TGCATGCATG").alias("r2"))


LIBRARIES = {"one": Barcode("r1", "ACG", 1, 1), "two": Rule("and", (Barcode("r1", "GT", 2, 0), Barcode("r2", "TT", 1, 1))), "three": Rule("and", (Barcode("r1", "TA", 1, 0), Rule("not", (Barcode("r2", "A", 6, 0),))))}


def _flags(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).bitwiseAND(F.lit(4095)).cast("int").alias("flag"), F.col("l_quantity").cast("int").alias("mapq"), (F.col("l_partkey") - F.col("l_suppkey")).alias("tlen"), F.col("l_returnflag").alias("rname"))


def _scalar(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    name = F.concat(F.element_at(F.array(F.lit("chr"), F.lit("Chr"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_size").cast("string"))
    return part.select("p_partkey", sq.chr_arabic(name).alias("arabic"), sq.chr_roman(name).alias("roman"), sq.to_roman(F.col("p_size")).alias("numeral"), sq.of_roman(F.lower(sq.to_roman(F.col("p_size")))).alias("back"))


def _quality(s: SparkSession, d: str) -> DataFrame:
    q = F.col("p_size")
    return table(s, d, "part").select(
        "p_partkey", F.round(sq.phred_probability(q), 10).alias("probability"), sq.phred_of_probability(F.lit(1.0) / q).alias("phred"), sq.phred_char(q).alias("symbol"), sq.phred_of_char(sq.phred_char(q)).alias("back"),
        sq.phred_of_solexa(q - 20).alias("of_solexa"), sq.solexa_of_phred(q).alias("to_solexa"), F.round(sq.solexa_probability(q), 10).alias("solexa_probability"), sq.solexa_of_probability(q / 60.0).alias("solexa"),
    )


def _text(s: SparkSession, d: str) -> DataFrame:
    b = _bases(s, d)
    x = F.col("seq")
    return b.select("doc_id", sq.nth(x, 3).alias("third"), sq.slice_(x, 2, 9).alias("slice"), sq.dna(F.concat(x, F.lit("N"))).isNotNull().alias("valid"), sq.dna(F.concat(x, F.lit("?"))).isNull().alias("invalid"),
                    F.concat_ws("\n", sq.chunks(x, 70)).alias("lines"), sq.reverse_complement(x).alias("rc"), *(F.round(c, 9).alias(f"share_{k.lower()}") for k, c in sq.composition(x, 1.0).items()))


def _cigars(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (F.col("l_orderkey") % 3).cast("string"), F.lit("D"), F.lit("5M"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text")).withColumn("ops", sq.cigar(F.col("text")))
    return rows.select("l_orderkey", "l_linenumber", F.size("ops").alias("n_ops"), sq.reference_length(F.col("ops")).alias("ref_len"), sq.cigar_text(F.col("ops")).alias("again"))


def _ids(s: SparkSession, d: str) -> DataFrame:
    i = F.concat(F.lit("EAS"), F.col("l_suppkey").cast("string"), F.lit(":136:FC706:2:"), F.concat(F.lit("1"), (F.col("l_linenumber") % 5).cast("string"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0")), F.lit(":"), F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_orderkey").cast("string"), F.lit(" 1:"), F.when(F.col("l_returnflag") == "R", "Y").otherwise("N"), F.lit(":18:ATCACG"))
    r = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", sq.illumina_id(i).alias("x"))
    return r.select("l_orderkey", "l_linenumber", F.col("x.instrument").alias("instrument"), F.col("x.swath").alias("swath"), F.col("x.tile").alias("tile"), F.col("x.x_pos").alias("x_pos"), F.col("x.is_filtered").alias("is_filtered"))


def _urls(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "part")
    return c.select("p_partkey", sq.track_line(name=F.col("p_brand"), visibility="dense", priority=3).alias("track"), sq.browser_url(F.lit("hg19"), F.lit("chr1"), F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), F.lit("http://example.org/x.bed")).alias("browser"),
                    sq.entrez_url("esearch", db="gene", term=F.concat(F.col("p_brand"), F.lit(" [x]")), retmax=F.col("p_size")).alias("search"),
                    sq.range_of(sq.range_text(F.lit("chr2"), F.col("p_size"), F.col("p_partkey"))).getField("hi").alias("hi"), sq.strand(F.element_at(F.array(F.lit("fwd"), F.lit("-"), F.lit("?")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("strand"))


def _bins(s: SparkSession, d: str) -> DataFrame:
    lo = F.col("chrom_start")
    return table(s, d, "bed_features").where("chrom_start >= 0 AND chrom_end > chrom_start").select("bed_id", sq.reg2bin(lo.cast("int"), (F.col("chrom_end") - 1).cast("int")).alias("bin"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


PWM = motifs.make(MATRIX, motifs.flat_background())

QUERIES = {
    "f01_bases": _text,
    "f03_chromosomes": _scalar,
    "f07_line_split": lambda s, d: table(s, d, "raw_lines").where("raw_line IS NOT NULL").select("line_id", F.size(F.split("raw_line", "\t")).alias("fields"), F.rtrim(F.substring_index("raw_line", "\t", -1)).alias("rightmost"), F.substring_index("raw_line", "\t", 1).alias("leftmost")),
    "f08_illumina_ids": _ids,
    "f09_cigar": _cigars,
    "f14_urls": _urls,
    "f16_quality_scores": _quality,
    "f17_reg2bin": _bins,
    "q01_pwm": lambda s, d: motifs.build(table(s, d, "motifs"), "motif_id", "matrix", motifs.flat_background()).select(F.col("id").alias("motif_id"), "pos", "base", F.round("score", 9).alias("score")),
    "q02_tandem": lambda s, d: motifs.scan(_bases(s, d), "doc_id", "seq", motifs.tandem(PWM, PWM, 2, "inverted"), 1.0).groupBy("id").agg(F.count("*").alias("n"), F.max("pos").alias("last")),
    "q03_scan": lambda s, d: motifs.scan(_bases(s, d), "doc_id", "seq", PWM, 2.0).select("id", "pos", F.round("score", 6).alias("score")),
    "q04_best_hit": lambda s, d: motifs.best_hit(_bases(s, d), "doc_id", "seq", PWM).select("id", "pos", F.round("score", 6).alias("score")),
    "q05_demux": lambda s, d: demultiplex(_reads(s, d), LIBRARIES, "inclusive").select("o_orderkey", "library", "mismatches"),
    "q05_demux_exclusive": lambda s, d: statistics(demultiplex(_reads(s, d), LIBRARIES, "exclusive")),
    "g13_alignment_stats": lambda s, d: streams.alignment_stats(_flags(s, d), "flag"),
    "g14_fragments": lambda s, d: streams.fragments(_flags(s, d), "flag", "mapq", 10).groupBy(F.abs("tlen").alias("length")).agg(F.count("*").alias("n")),
    "g14_chromosomes": lambda s, d: streams.fragments(_flags(s, d), "flag", "mapq", 10).groupBy("rname").agg(F.count("*").alias("n")),
    "g17_duplicates": lambda s, d: streams.first_duplicates(_events(s, d), "user_id"),
    "a11_flag_predicates": lambda s, d: _flags(s, d).select("l_orderkey", "l_linenumber", *(sq.flag(n, F.col("flag")).alias(n) for n in [*sq.FLAG_BITS, "is_primary"])),
    "t03_skip": lambda s, d: streams.skip(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100),
    "t05_take_while": lambda s, d: streams.take_while(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], F.col("o_totalprice") < 450000),
    "t05_drop_while": lambda s, d: streams.drop_while(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], F.col("o_totalprice") < 450000),
    "t06_extremes": lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("dearest")),
    "c07_filter_compose": lambda s, d: streams.filter_compose(_events(s, d).select("event_id", "event_type", "value"), F.col("value") > 50, lambda x: x.withColumn("value", F.col("value") * 2)),
    "c08_split_and_merge": lambda s, d: streams.split_and_merge(_events(s, d).select("event_id", "user_id"), F.col("user_id") % 2 == 0, lambda x: x.withColumn("side", F.lit("even")), lambda x: x.withColumn("side", F.lit("odd"))),
    "j07_probes": lambda s, d: _probes(s, d),
    "j08_motif_loader": lambda s, d: _motifs(s, d),
    "j09_product": lambda s, d: streams.product(table(s, d, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal"), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal"), ["k"], F.col("c_acctbal") > F.col("s_acctbal"), ["k"]),
    "j10_zip": lambda s, d: streams.mix(table(s, d, "customer").select("c_custkey"), ["c_custkey"], table(s, d, "part").select("p_partkey"), ["p_partkey"]).select("pos", "a.c_custkey", "b.p_partkey"),
    "j12_unknown_references": lambda s, d: _unknown(s, d),
    "j13_index_join": lambda s, d: codecs.reference_names(table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") - 3).alias("ref_id")), table(s, d, "nation").select(F.col("n_nationkey").alias("ref_id"), F.col("n_name").alias("rname"))).select("c_custkey", "rname"),
    "j15_metadata_merge": lambda s, d: _metadata(s, d),
    "u01_append": lambda s, d: table(s, d, "customer").select(F.col("c_acctbal").alias("x"), F.lit(0).alias("source")).unionAll(table(s, d, "supplier").select("s_acctbal", F.lit(1))).groupBy("source").agg(F.count("*").alias("n"), F.min("x").alias("least")),
    "u03_names": lambda s, d: table(s, d, "peaks").select("chr").union(table(s, d, "bed_features").select("chrom")).union(table(s, d, "gff_records").select("seqname")).where("chr IS NOT NULL").distinct(),
    "w08_group2": lambda s, d: streams.group2(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"]).select("pair", F.col("first.o_orderkey").alias("a"), F.col("second.o_orderkey").alias("b")),
    "w04_neighbours": lambda s, d: streams.neighbours(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "l_quantity"),
}


def _probes(s: SparkSession, d: str) -> DataFrame:
    """Two intensities per probe, found by coordinates: both must be there."""
    cells = table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("x"), F.col("l_linenumber").cast("bigint").alias("y")).agg(F.round(F.sum("l_quantity"), 2).alias("mean"))
    probes = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 500).alias("pm_x"), (F.col("p_size") % 7 + 1).cast("bigint").alias("pm_y"), ((F.col("p_partkey") + 3) % 500).alias("mm_x"), (F.col("p_size") % 5 + 1).cast("bigint").alias("mm_y"))
    return codecs.probe_intensities(probes, cells, strict=False).where("pm IS NOT NULL AND mm IS NOT NULL").select("p_partkey", "pm", "mm")


def _unknown(s: SparkSession, d: str) -> DataFrame:
    """Line items as alignments to suppliers, of whom those with a positive balance are declared."""
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    rows = table(s, d, "lineitem").select(F.lit("f").alias("file"), "l_orderkey", "l_linenumber", name("l_suppkey").alias("rname"))
    header = as_lines(table(s, d, "supplier").where("s_acctbal > 0"), F.lit("f"), F.col("s_suppkey"), F.concat(F.lit("@SQ\tSN:"), name("s_suppkey"), F.lit("\tLN:9")))
    return codecs.unknown_references(rows, codecs.sam_header(header)).select("l_orderkey", "l_linenumber", "rname")


def _motifs(s: SparkSession, d: str) -> DataFrame:
    """Motifs with their mandatory class and medline and optional family; the annotation with the highest line decides."""
    lines = lambda df, n, v: as_lines(df, F.lit("f"), n, v)
    m = table(s, d, "motifs")
    cells = m.select("motif_id", F.posexplode("matrix").alias("p", "row")).select("motif_id", "p", F.posexplode("row").alias("b", "n"))
    base = F.substr(F.lit("ACGT"), F.col("b") + 1, F.lit(1))
    tsv = lambda *cs: F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in cs))
    rows = jaspar.load(lines(m, F.col("motif_id"), tsv(F.col("motif_id"), F.col("motif_collection"), F.col("jaspar_id"), F.lit("1"), F.col("factor_name"))), lines(cells, F.col("motif_id") * 1000 + F.col("p") * 4 + F.col("b"), tsv(F.col("motif_id"), base, F.col("p") + 1, F.col("n"))),
                       lines(table(s, d, "motif_annotations").where("motif_id IS NOT NULL AND NOT coalesce(attr_value LIKE '%\t%', false)"), F.col("line_no"), tsv(F.col("motif_id"), F.col("attr_name"), F.col("attr_value"))))
    return rows.select("motif_id", "jaspar_id", "motif_collection", "factor_name", "factor_class", "family", F.size("matrix").alias("width"))


def _metadata(s: SparkSession, d: str) -> DataFrame:
    """Declared values win over reserved ones; either side may be missing."""
    mine = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("value"))
    theirs = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("value"))
    return streams.named_values(mine, theirs, "k")


def _sql_roman(n: str) -> str:
    arr = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return f"({arr(sq.HUNDREDS)}[(({n} // 100) % 10) + 1] || {arr(sq.TENS)}[(({n} // 10) % 10) + 1] || {arr(sq.ONES)}[({n} % 10) + 1])"


_SEQ = "WITH b AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL)"
_SCAN = _SEQ + """, c AS (SELECT doc_id, unnest(string_split(seq, '')) AS ch, unnest(range(length(seq))) AS pos FROM b WHERE length(seq) > 0),
m(j, base, w) AS (VALUES """ + ", ".join(f"({i}, '{b}', {float(x)!r})" for i, row in enumerate(PWM) for b, x in zip("ACGT", row)) + """),
h AS (SELECT doc_id, c.pos - m.j AS pos, sum(m.w) AS score, count(*) AS n FROM c JOIN m ON m.base = c.ch GROUP BY ALL HAVING count(*) = 6)"""  # fmt: skip
TANDEM = motifs.tandem(PWM, PWM, 2, "inverted")
# spacer positions score nothing, whatever the letter; a hit needs a letter at each of the others
_TANDEM = _SEQ + """, c AS (SELECT doc_id, length(seq) AS size, unnest(string_split(seq, '')) AS ch, unnest(range(length(seq))) AS pos FROM b WHERE length(seq) > 0),
m(j, base, w) AS (VALUES """ + ", ".join(f"({i}, '{b}', {float(x)!r}::DOUBLE)" for i, row in enumerate(TANDEM) for b, x in zip("ACGT", row)) + f"""),
h AS (SELECT doc_id, c.pos - m.j AS pos, sum(m.w ORDER BY m.j) AS score FROM c JOIN m ON m.base = c.ch GROUP BY ALL HAVING count(*) = {len(TANDEM)})"""  # fmt: skip
_FLAG = "WITH f AS (SELECT l_orderkey, l_linenumber, CAST((l_orderkey * 7 + l_linenumber) & 4095 AS INTEGER) AS flag, CAST(l_quantity AS INTEGER) AS mapq, l_partkey - l_suppkey AS tlen, l_returnflag AS rname FROM lineitem)"
_FRAG = _FLAG + ", k AS (SELECT * FROM f WHERE flag & 1 <> 0 AND flag & 4 = 0 AND flag & 2 <> 0 AND mapq >= 10)"
_READS = """WITH r AS (SELECT o_orderkey, translate(reverse(lpad(CAST(o_orderkey AS VARCHAR), 10, '0')), '0123456789', 'ACGTACGTAC') AS r1, translate(lpad(CAST(o_custkey AS VARCHAR), 6, '0'), '0123456789', 'TGCATGCATG') AS r2 FROM orders),
k AS (SELECT o_orderkey, (r1[1] <> 'A')::INT + (r1[2] <> 'C')::INT + (r1[3] <> 'G')::INT AS m1, (r1[2] <> 'G')::INT + (r1[3] <> 'T')::INT AS m2, (r2[1] <> 'T')::INT + (r2[2] <> 'T')::INT AS m3, (r1[1] <> 'T')::INT + (r1[2] <> 'A')::INT AS m4, (r2[6] <> 'A')::INT AS m5 FROM r),
h AS (SELECT o_orderkey, 'one' AS library, m1 AS mismatches FROM k WHERE m1 <= 1 UNION ALL SELECT o_orderkey, 'two', greatest(m2, m3) FROM k WHERE m2 = 0 AND m3 <= 1 UNION ALL SELECT o_orderkey, 'three', 0 FROM k WHERE m4 = 0 AND m5 > 0)"""

ORACLE = {
    "f01_bases": _SEQ + r"""SELECT doc_id, CASE WHEN length(seq) >= 3 THEN seq[3] END AS third, CASE WHEN length(seq) >= 9 THEN seq[2:9] END AS slice, true AS valid, true AS invalid,
array_to_string(regexp_extract_all(seq, '.{1,70}'), chr(10)) AS lines, translate(reverse(seq), 'ACGT', 'TGCA') AS rc,
round((length(seq) - length(replace(seq, 'A', '')) + 1) / (length(seq) + 4.0::DOUBLE), 9) AS share_a, round((length(seq) - length(replace(seq, 'C', '')) + 1) / (length(seq) + 4.0::DOUBLE), 9) AS share_c,
round((length(seq) - length(replace(seq, 'G', '')) + 1) / (length(seq) + 4.0::DOUBLE), 9) AS share_g, round((length(seq) - length(replace(seq, 'T', '')) + 1) / (length(seq) + 4.0::DOUBLE), 9) AS share_t FROM b""",
    "f03_chromosomes": f"SELECT p_partkey, CAST(p_size AS VARCHAR) AS arabic, CASE WHEN p_size NOT IN (5000, 10, 1000) THEN {_sql_roman('p_size')} END AS roman, {_sql_roman('p_size')} AS numeral, p_size AS back FROM part",
    "f07_line_split": "SELECT line_id, CAST(len(string_split(raw_line, chr(9))) AS INTEGER) AS fields, rtrim(string_split(raw_line, chr(9))[-1], ' ') AS rightmost, string_split(raw_line, chr(9))[1] AS leftmost FROM raw_lines WHERE raw_line IS NOT NULL",
    "f08_illumina_ids": """WITH x AS (SELECT *, l_linenumber % 5 BETWEEN 1 AND 3 AND CAST(l_quantity AS INTEGER) BETWEEN 1 AND 99 AS ok FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN 'EAS' || l_suppkey END AS instrument, CASE WHEN ok THEN CAST(l_linenumber % 5 AS INTEGER) END AS swath, CASE WHEN ok THEN CAST(l_quantity AS INTEGER) END AS tile,
CASE WHEN ok THEN l_partkey END AS x_pos, CASE WHEN ok THEN l_returnflag = 'R' END AS is_filtered FROM x""",
    "f09_cigar": """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 > 0 THEN 4 END AS n_ops, CASE WHEN l_orderkey % 3 > 0 THEN CAST(CAST(l_quantity AS INTEGER) + l_orderkey % 3 + 5 AS INTEGER) END AS ref_len,
CASE WHEN l_orderkey % 3 > 0 THEN l_linenumber || 'S' || CAST(l_quantity AS INTEGER) || 'M' || (l_orderkey % 3) || 'D5M' END AS again FROM lineitem""",
    "f14_urls": """SELECT p_partkey, 'track name="' || p_brand || '" visibility=dense priority=3' AS track, 'http://genome.ucsc.edu/cgi-bin/hgTracks?db=hg19&position=chr1:' || p_partkey || '-' || (p_partkey + p_size) || '&hgt.customText=http://example.org/x.bed' AS browser,
'http://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=gene&term=' || url_encode(p_brand || ' [x]') || '&retmax=' || p_size AS search, CASE WHEN p_size <= p_partkey THEN p_partkey END AS hi,
CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' END AS strand FROM part""",
    "f16_quality_scores": """WITH q AS (SELECT p_partkey, p_size AS q, -10 * log10(1.0::DOUBLE / p_size) AS a, 10 * log10(pow(10.0, (p_size - 20) / 10.0) + 1) AS b, 10 * log10(pow(10.0, p_size / 10.0) - 1) AS c FROM part)
SELECT p_partkey, round(pow(10.0, q / -10.0), 10) AS probability, CAST(CASE WHEN a - floor(a) < 0.5 THEN floor(a) ELSE ceil(a) END AS INTEGER) AS phred, chr(q + 33) AS symbol, q AS back,
CAST(CASE WHEN b - floor(b) < 0.5 THEN floor(b) ELSE ceil(b) END AS INTEGER) AS of_solexa, CAST(CASE WHEN c - floor(c) < 0.5 THEN floor(c) ELSE ceil(c) END AS INTEGER) AS to_solexa,
round(pow(10.0, q / -10.0) / (1 + pow(10.0, q / -10.0)), 10) AS solexa_probability, CAST(floor(-10 * log10((q / 60.0::DOUBLE) / (1 - q / 60.0::DOUBLE)) + 0.5) AS INTEGER) AS solexa FROM q""",
    "f17_reg2bin": """WITH r AS (SELECT bed_id, CAST(chrom_start AS INTEGER) AS a, CAST(chrom_end - 1 AS INTEGER) AS b FROM bed_features WHERE chrom_start >= 0 AND chrom_end > chrom_start)
SELECT bed_id, CASE WHEN a >> 14 = b >> 14 THEN 4681 + (a >> 14) WHEN a >> 17 = b >> 17 THEN 585 + (a >> 17) WHEN a >> 20 = b >> 20 THEN 73 + (a >> 20) WHEN a >> 23 = b >> 23 THEN 9 + (a >> 23) WHEN a >> 26 = b >> 26 THEN 1 + (a >> 26) ELSE 0 END AS bin FROM r""",
    "q03_scan": _SCAN + "SELECT doc_id AS id, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score FROM h WHERE score > 2.0",
    "q01_pwm": """WITH p AS (SELECT motif_id, unnest(matrix) AS r, unnest(range(len(matrix))) AS pos FROM motifs WHERE motif_id IS NOT NULL AND len(matrix) > 0),
s AS (SELECT motif_id, pos, list_transform(r, lambda x: ln((x + 0.25::DOUBLE) / list_sum(r) / 0.25::DOUBLE)) AS l FROM p), f AS (SELECT motif_id, pos, list_append(l, list_sum(l) * 0.25::DOUBLE) AS l FROM s)
SELECT motif_id, CAST(pos AS INTEGER) AS pos, unnest(['A', 'C', 'G', 'T', 'N']) AS base, round(unnest(l), 9) AS score FROM f""",
    "q02_tandem": _TANDEM + "SELECT doc_id AS id, count(*) AS n, CAST(max(pos) AS INTEGER) AS last FROM h WHERE score >= 1.0 GROUP BY 1",
    "q04_best_hit": _SCAN.replace("sum(m.w)", "sum(m.w::DOUBLE ORDER BY m.j)") + "SELECT doc_id AS id, round((max({'s': score, 'p': pos})).s, 6) AS score, (max({'s': score, 'p': pos})).p AS pos FROM h GROUP BY 1",
    "q05_demux": _READS + "SELECT * FROM h UNION ALL SELECT o_orderkey, 'undetermined', 0 FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM h)",
    "q05_demux_exclusive": _READS + """, s AS (SELECT o_orderkey, any_value(library) AS library, any_value(mismatches) AS mismatches, count(*) AS n FROM h GROUP BY 1),
a AS (SELECT o.o_orderkey, CASE WHEN n = 1 THEN library ELSE 'undetermined' END AS library, CASE WHEN n = 1 THEN mismatches ELSE 0 END AS mismatches FROM orders o LEFT JOIN s USING (o_orderkey))
SELECT library, CAST(count(*) AS BIGINT) AS read_count, CAST(count(*) FILTER (WHERE mismatches = 0) AS BIGINT) AS no_mismatch_read_count FROM a GROUP BY 1""",
    "g13_alignment_stats": _FLAG + """, k AS (SELECT *, flag & 512 = 0 AS ok, flag & 1 <> 0 AS multi, flag & 64 <> 0 AS first, flag & 4 = 0 AND flag & 256 = 0 AND flag & 2048 = 0 AS main FROM f)
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS qc_pass, count(*) FILTER (WHERE ok AND NOT multi) AS single_reads, count(*) FILTER (WHERE ok AND multi AND first) AS read_pairs,
count(*) FILTER (WHERE ok AND main) AS mapped_reads, count(*) FILTER (WHERE ok AND main AND multi AND first) AS mapped_pairs FROM k""",
    "g14_fragments": _FRAG + "SELECT abs(tlen) AS length, count(*) AS n FROM k GROUP BY 1",
    "g14_chromosomes": _FRAG + "SELECT rname, count(*) AS n FROM k GROUP BY 1",
    "g17_duplicates": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1",
    "a11_flag_predicates": _FLAG + "SELECT l_orderkey, l_linenumber, " + ", ".join(f"flag & {b} <> 0 AS {n}" for n, b in sq.FLAG_BITS.items()) + ", flag & 2304 = 0 AS is_primary FROM f",
    "t03_skip": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey OFFSET 100",
    "t05_take_while": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE NOT o_totalprice < 450000), 9e15)",
    "t05_drop_while": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE NOT o_totalprice < 450000)",
    "t06_extremes": "SELECT l_suppkey, min(l_shipdate) AS first, arg_max(l_orderkey, {'a': l_extendedprice, 'b': l_orderkey}) AS dearest FROM lineitem GROUP BY 1",
    "c07_filter_compose": "SELECT event_id, event_type, CASE WHEN value > 50 THEN value * 2 ELSE value END AS value FROM events",
    "c08_split_and_merge": "SELECT event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS side FROM events",
    "j07_probes": """WITH c AS (SELECT l_orderkey % 500 AS x, CAST(l_linenumber AS BIGINT) AS y, round(sum(l_quantity), 2) AS mean FROM lineitem GROUP BY 1, 2)
SELECT p_partkey, a.mean AS pm, b.mean AS mm FROM part JOIN c a ON a.x = p_partkey % 500 AND a.y = p_size % 7 + 1 JOIN c b ON b.x = (p_partkey + 3) % 500 AND b.y = p_size % 5 + 1""",
    "j08_motif_loader": """WITH n AS (SELECT motif_id, line_no, replace(replace(replace(lower(attr_name), ' ', ''), '-', ''), '_', '') AS a, nullif(nullif(regexp_replace(coalesce(attr_value, ''), '^\\s+|\\s+$', '', 'g'), ''), '-') AS v FROM motif_annotations),
w AS (SELECT motif_id, (max({'l': line_no, 'v': v}) FILTER (WHERE a IN ('class', 'factorclass'))).v AS factor_class, (max({'l': line_no, 'v': v}) FILTER (WHERE a = 'family')).v AS family, (max({'l': line_no, 'v': v}) FILTER (WHERE a = 'medline')).v AS medline FROM n GROUP BY 1)
SELECT motif_id, jaspar_id, motif_collection, factor_name, factor_class, family, CAST(len(matrix) AS INTEGER) AS width FROM motifs JOIN w USING (motif_id) WHERE factor_class IS NOT NULL AND medline IS NOT NULL""",
    "j09_product": "SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > s_acctbal GROUP BY 1",
    "j10_zip": """WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey FROM customer), b AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey FROM part)
SELECT pos, c_custkey, p_partkey FROM a FULL JOIN b USING (pos)""",
    "j12_unknown_references": "SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS rname FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    "j13_index_join": "SELECT c_custkey, coalesce(n_name, '*') AS rname FROM customer LEFT JOIN nation ON c_nationkey - 3 = n_nationkey",
    "j15_metadata_merge": """SELECT k, coalesce(a, b) AS value FROM (SELECT s_nationkey AS k, max(s_acctbal) AS a FROM supplier GROUP BY 1) x FULL JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS b FROM customer GROUP BY 1) y USING (k)""",
    "u01_append": "SELECT CAST(source AS INTEGER) AS source, count(*) AS n, min(x) AS least FROM (SELECT c_acctbal AS x, 0 AS source FROM customer UNION ALL SELECT s_acctbal, 1 FROM supplier) GROUP BY 1",
    "u03_names": "SELECT DISTINCT chr FROM (SELECT chr FROM peaks UNION SELECT chrom FROM bed_features UNION SELECT seqname FROM gff_records) WHERE chr IS NOT NULL",
    "w08_group2": """WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders)
SELECT CAST(pos // 2 AS BIGINT) AS pair, min(o_orderkey) FILTER (WHERE pos % 2 = 0) AS a, min(o_orderkey) FILTER (WHERE pos % 2 = 1) AS b FROM n GROUP BY 1""",
    "w04_neighbours": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, lag(l_quantity) OVER w AS previous, lead(l_quantity) OVER w AS next FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)",
}

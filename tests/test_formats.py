import base64
import gzip
import struct
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequence as sq
from spanloom.functions import stats
from spanloom.operators import motifs, streams
from spanloom.sources import bam, codecs, generate, vcf, xml
from spanloom.sources.text import format_of, lines, map_lines, write_lines
from spanloom.streaming import text as stream


def table(spark, text, file="f"):
    return spark.createDataFrame([(file, i + 1, x) for i, x in enumerate(text)], "file string, line_no bigint, value string")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_lines_of_files_in_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for f in range(2):
            (tmp_path / f"{f}.txt").write_text("".join(f"{f} {i}\n" for i in range(1500)) + "end")
        with gzip.open(tmp_path / "2.txt.gz", "wt") as z:
            z.write("2 0\n2 1\n")
        got = lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2 * 1501 + 2
    assert all(r["value"] == "end" or int(r["value"].split()[1]) + 1 == r["line_no"] for r in got)
    map_lines(spark, str(tmp_path / "0.txt"), str(tmp_path / "out"), lambda v: F.split(v, " "))
    assert lines(spark, str(tmp_path / "out")).count() == 3001
    write_lines(spark.range(3), F.col("id").cast("string"), str(tmp_path / "z"), "gzip")
    assert {r["value"] for r in lines(spark, str(tmp_path / "z")).collect()} == {"0", "1", "2"}
    assert format_of("a/B.bed.gz") == "bed" and format_of("x.unknown") is None


def test_wig_to_bed_graph(spark):
    text = ["# c", "variableStep chrom=chr19 span=150", "49304701 10.0", "49304901 12.5", "fixedStep chrom=chr19 start=49307401 step=300 span=200", "1000", "900", "800", "chrA 1 2 3.5", "x y z", "fixedStep chrom=c step=1"]
    items = codecs.wig(table(spark, text))
    got = codecs.wig_bed_graph(items).orderBy("line_no").collect()
    assert [(r["chrom"], r["lo"], r["hi"], r["val"]) for r in got if r["error"] is None] == [
        ("chr19", 49304701, 49304850, 10.0), ("chr19", 49304901, 49305050, 12.5), ("chr19", 49307401, 49307600, 1000.0), ("chr19", 49307701, 49307900, 900.0), ("chr19", 49308001, 49308200, 800.0), ("chrA", 1, 2, 3.5)]
    assert [r["error"] for r in got if r["error"]] == ["unrecognizable_line", "start"]
    assert codecs.wig_bed_graph(codecs.wig(table(spark, ["5 1.0"]))).first()["error"] == "not_in_variable_step_state"
    again = items.where("error IS NULL AND kind = 'variable'").select(codecs.wig_line().alias("x")).first()["x"]
    assert again == "variableStep chrom=chr19 span=150"


def test_modes(spark):
    rows = codecs.sgr(table(spark, ["a\t1\t2", "b 2 3", "bad", "c\t3\t4"]))
    assert [r["error"] for r in rows.orderBy("line_no").collect()] == [None, None, "column_count", None]
    assert codecs.with_mode(rows, "strict_prefix").count() == 2
    with pytest.raises(Exception, match="column_count"):
        codecs.with_mode(rows, "failfast").collect()


def test_fasta_and_fastq(spark):
    got = codecs.fasta(table(spark, [";c", ">a b", "ACG", "T", "", ">c", "GG", ">d"])).orderBy("record").collect()
    assert [(r["description"], r["sequence"], r["error"]) for r in got] == [("a b", "ACGT", None), ("c", "GG", None), ("d", "", "empty_sequence")]
    assert codecs.fasta(table(spark, ["ACG", ">x", "A"])).where("error = 'sequence_before_description'").count() == 1
    fq = codecs.fastq(table(spark, ["@r", "AC", "+", "II", "@s", "AC", "x", "I"])).orderBy("record").collect()
    assert [r["error"] for r in fq] == [None, "comment"]
    assert spark.createDataFrame([("d", "ACGTA")], "description string, sequence string").select(codecs.fasta_text(2).alias("x")).first()["x"] == ">d\nAC\nGT\nA"


def test_gff_round_trip(spark):
    row = codecs.gff(table(spark, ["c\ts\tf\t1\t2\t.\t+\t.\ta=2,3;b=%3D"])).first()
    assert [(a["key"], a["values"]) for a in row["attributes"]] == [("a", ["2", "3"]), ("b", ["="])]
    back = spark.createDataFrame([row], codecs.gff(table(spark, ["x"])).schema).select(codecs.gff_line().alias("x")).first()["x"]
    assert back == "c\ts\tf\t1\t2\t.\t+\t.\ta=2,3;b=%3D"


def test_vcf(spark):
    head = ["##fileformat=VCFv4.1", '##INFO=<ID=NS,Number=1,Type=Integer,Description="n">', '##FILTER=<ID=q10,Description="low">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"]
    rows = ["20\t14370\trs6\tG\tA\t29\tPASS\tNS=3;DB\tGT:GQ\t0|0:48\t1|0:8", "20\t2\t.\tT\tA\t3\tq10\tNS=x\tGT\t0|0\t0|1", "20\t3\t.\tT\t<DEL>\t.\tzzz\tNS=1\tGT\t0|0\t.", "20\t4"]
    got = vcf.rows(table(spark, head + rows)).orderBy("line_no").collect()
    assert [r["error"] for r in got] == [None, "info", "filter", "row_length"]
    assert got[0]["ids"] == ["rs6"] and got[0]["samples"][1]["name"] == "B" and got[0]["info"][0]["values"][0]["i"] == 3 and got[0]["info"][1]["type"] == "flag"


def test_vcf_types_are_merged_once_a_file(spark, monkeypatch):
    head = ["##fileformat=VCFv4.1", '##INFO=<ID=DP,Number=2,Type=String,Description="not the reserved one">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA"]
    rows = [f"20\t{i + 1}\t.\tG\tA\t.\tPASS\tDB;AN={i};DP=x,{i}\tGT:GQ\t0|1:{i}" if i % 3 else f"20\t{i + 1}\t.\tG\tA\t.\tPASS\tDP={i}\tGT\t0|1" for i in range(60)]
    lines = table(spark, head + rows)
    good = vcf.rows(lines).where("error IS NULL")
    # a filter on errors goes below the columns that it reads, and takes along what they are made of
    assert "map_zip_with" not in good._jdf.queryExecution().optimizedPlan().toString()
    got = good.orderBy("line_no").collect()
    assert [r["pos"] for r in got] == [i + 1 for i in range(60) if i % 3]
    assert [(x["key"], x["type"], [v["s"] for v in x["values"]]) for x in got[0]["info"]] == [("DB", "flag", []), ("AN", "integer", ["1"]), ("DP", "string", ["x", "1"])]
    monkeypatch.setattr(vcf, "BROADCAST_BYTES", -1)
    assert vcf.rows(lines).where("error IS NULL").orderBy("line_no").collect() == got


def test_headers_of_more_than_a_million_characters(spark):
    names = [f"{i}" + "x" * 100_000 for i in range(12)]
    head = ["##fileformat=VCFv4.1", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    got = vcf.rows(table(spark, [*head, "\t".join(["20", "1", ".", "G", "A", ".", "PASS", ".", "GT", *["0|1"] * 12])])).collect()
    assert [r["error"] for r in got] == [None] and [x["name"] for x in got[0]["samples"]] == names
    long = "y" * 1_000_001
    read = codecs.fastq(table(spark, ["@" + long, "AC", "+" + long, "II"])).collect()
    assert [(r["name"], r["comment"], r["error"]) for r in read] == [(long, long, None)]
    assert codecs.sam_header(table(spark, [f"@CO\tXX:{long}"])).first()["tags"] == {"XX": long}


def test_bam_round_trip(spark, tmp_path):
    rows = [{"qname": f"r{i}", "flag": 99, "rname": "chr1", "pos": i + 1, "mapq": 60 if i % 2 else None, "cigar": "3M1I", "rnext": "chr2", "pnext": 7, "tlen": -5, "seq": "ACGT" if i % 3 else "ACG", "qual": "IIII" if i % 3 else "III"} for i in range(25_000)]
    path = tmp_path / "x.bam"
    bam.write_bam(str(path), [("chr1", 1000), ("chr2", 10)], [*rows, {"flag": 4}])
    bam.register(spark)
    df = spark.read.format("spanloom-bam").load(str(path))
    got = df.where("flag = 99").orderBy("pos").limit(3).collect()
    assert [{k: v for k, v in r.asDict().items() if k not in ("tags", "voffset")} for r in got] == rows[:3] and got[0]["tags"] == []
    assert df.count() == 25_001 and df.where("rname IS NULL AND qname IS NULL AND cigar = '*'").count() == 1
    few = spark.read.format("spanloom-bam").schema("pos int, voffset bigint").option("splitBytes", 9_000).load(f"file://{tmp_path}")
    assert few.rdd.getNumPartitions() > 5
    at = few.where("pos IS NOT NULL").orderBy("pos").collect()
    assert [r["pos"] for r in at] == list(range(1, 25_001)) and [r["voffset"] for r in at] == sorted(r["voffset"] for r in at)
    assert bam.read_at(str(path), at[20_000]["voffset"], ["qname", "seq"]) == ("r20000", "ACGT")
    assert bam.read_header(str(path)) == ("@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:10\n", [("chr1", 1000), ("chr2", 10)])
    whole = path.read_bytes()
    path.write_bytes(whole[:-60])
    with pytest.raises(Exception, match="ends inside"):
        df.count()


def test_bam_writes_in_proportion_to_its_records(tmp_path):
    rows = [{"qname": f"r{i}", "flag": i % 4096, "rname": "chr1", "pos": i + 1, "cigar": "12M", "seq": "ACGTACGTACGN", "qual": "I" * 12} for i in range(60_000)]
    began = time.time()
    bam.write_bam(str(tmp_path / "x.bam"), [("chr1", 100_000)], rows)
    # copying all that was written for each record took minutes
    assert time.time() - began < 20
    got = [r for lo in range(0, (tmp_path / "x.bam").stat().st_size, 50_000) for b in bam.records(str(tmp_path), str(tmp_path / "x.bam"), ["qname", "flag", "pos", "seq", "qual"], lo, lo + 50_000) for r in b.to_pylist()]
    assert got == [{k: r[k] for k in ("qname", "flag", "pos", "seq", "qual")} for r in rows]
    with pytest.raises(ValueError, match="as many as bases"):
        bam.write_bam(str(tmp_path / "bad.bam"), [], [{"flag": 4, "seq": "ACGT", "qual": "I"}])
    assert [p.name for p in tmp_path.iterdir()] == ["x.bam"]


def test_bam_tags_and_very_long_records(spark, tmp_path):
    raw = b"NMc\xff" + b"XAAq" + b"XZZa b\0" + b"XBBS" + struct.pack("<i", 2) + struct.pack("<2H", 7, 65535) + b"XFf" + struct.pack("<f", 0.5)
    assert [(t["tag"], t["type"], t["value"]) for t in bam._tags(raw, 0)] == [("NM", "i", "-1"), ("XA", "A", "q"), ("XZ", "Z", "a b"), ("XB", "B", "S,7,65535"), ("XF", "f", "0.5")]
    rows = [{"qname": f"r{i}", "flag": 4, "seq": "ACGTTGCA" * (30_000 + i), "qual": "".join(chr(33 + (i * j) % 90) for j in range(8)) * (30_000 + i)} for i in range(40)]
    bam.write_bam(str(tmp_path / "l.bam"), [("c", 9)], rows)
    bam.register(spark)
    df = spark.read.format("spanloom-bam").option("splitBytes", 100_000).load(str(tmp_path))
    assert sorted((r["qname"], r["seq"], r["qual"]) for r in df.select("qname", "seq", "qual").collect()) == sorted((r["qname"], r["seq"], r["qual"]) for r in rows)


def test_mass_spectra_and_models(spark):
    vec = lambda xs, k: base64.b64encode(struct.pack(k, *xs)).decode()
    spec = f"""<mzData><spectrumList><spectrum id="3"><spectrumDesc><spectrumSettings><spectrumInstrument msLevel="2"/></spectrumSettings><precursorList><precursor msLevel="1"><ionSelection><cvParam name="MassToChargeRatio" value="500.5"/><cvParam name="ChargeState" value="2"/></ionSelection></precursor></precursorList></spectrumDesc>
<mzArrayBinary><data precision="64" endian="big" length="2">{vec([1.5, 2.5], ">2d")}</data></mzArrayBinary><intenArrayBinary><data precision="32" endian="little" length="2">{vec([3, 4], "<2f")}</data></intenArrayBinary></spectrum>
<spectrum id="4"><mzArrayBinary><data precision="32" endian="little" length="9">{vec([1], "<f")}</data></mzArrayBinary></spectrum></spectrumList></mzData>"""
    got = xml.mz_data(spark.createDataFrame([("a", spec), ("b", "<x"), ("c", None)], "file string, content string")).collect()
    good = next(r for r in got if r["error"] is None)
    assert (good["id"], good["mslevel"], good["mz"], good["intensity"], good["precursors"][0]["z"]) == (3, 2, [1.5, 2.5], [3.0, 4.0], 2.0) and len(got) == 3
    model = '<sbml xmlns="http://www.sbml.org/sbml/level2/version4"><model id="m"><listOfSpecies><species id="s1" compartment="c"/></listOfSpecies><listOfReactions><reaction id="r"><kineticLaw><math xmlns="http://www.w3.org/1998/Math/MathML"><apply><times/><ci>k</ci><ci>s1</ci></apply></math></kineticLaw></reaction></listOfReactions></model></sbml>'
    parts = {r["element"]: r for r in xml.sbml(spark.createDataFrame([("a", model)], "file string, content string")).collect()}
    assert parts["species"]["attributes"]["compartment"] == "c" and parts["kineticLaw"]["math"] == "times(k, s1)" and parts["kineticLaw"]["parent"] == "r"
    assert one(spark, xml.search_answer(F.lit("<eSearchResult><Count>2</Count><RetMax>2</RetMax><RetStart>0</RetStart><IdList><Id>5</Id><Id>6</Id></IdList></eSearchResult>")))["ids"] == ["5", "6"]


def test_scalars(spark):
    assert one(spark, F.array(*(sq.of_roman(sq.to_roman(F.lit(n))) for n in range(1, 60)))) == list(range(1, 60))
    assert one(spark, sq.chr_arabic(F.lit("ChrIV"))) == "4" and one(spark, sq.chr_roman(F.lit("chr10"))) is None and one(spark, sq.chr_arabic(F.lit("odd"))) == "odd"
    assert one(spark, sq.cigar_text(sq.cigar(F.lit("3M1I2S")))) == "3M1I2S" and one(spark, sq.cigar(F.lit("0M"))) is None
    assert one(spark, sq.percent_encoded(F.lit("a b*~é"))) == "a%20b%2A~%C3%A9"
    assert abs(one(spark, stats.ltqnorm(F.lit(0.975))) - 1.959964) < 1e-5 and one(spark, stats.ltqnorm(F.lit(1.0))) is None


def test_motif_reverse_complement_and_scan(spark):
    m = motifs.make([[5, 1, 1, 1], [1, 5, 1, 1], [1, 1, 1, 5]], motifs.flat_background())
    assert (motifs.reverse_complement(motifs.reverse_complement(m)) == m).all()
    df = spark.createDataFrame([(1, "ACTNNACT"), (2, "A"), (3, None)], "i int, s string")
    assert [(r["id"], r["pos"]) for r in motifs.best_hit(df, "i", "s", m).collect()] == [(1, 5)]
    assert sorted(r["pos"] for r in motifs.scan(df, "i", "s", m, 1.0).collect()) == [0, 5]
    assert motifs.tandem(m, m, 2).shape == (8, 5)


def test_sequence_queries_do_the_whole_job(spark, tmp_path):
    import math

    from spanloom import catalog
    from spanloom.plans import sequence

    seq = "ACGTTGCAACGGTACC" * 4
    spark.createDataFrame([(1, seq), (2, "GG")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, [[1, 2, 3, 4], [8, 0, 0, 0]]), (9, [[5, 5, 5, 5]]), (10, None)], "motif_id bigint, matrix array<array<int>>").write.parquet(f"{tmp_path}/motifs.parquet")
    spark.createDataFrame([(7, 1.5, "a b whole name"), (8, None, "x")], "peak_id bigint, pileup double, peak_name string").write.parquet(f"{tmp_path}/peaks.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["rc"] for r in run("f01_bases")} == {1: seq[::-1].translate(str.maketrans("ACGT", "TGCA")), 2: "CC"}
    got = {(r["motif_id"], r["pos"], r["base"]): r["score"] for r in run("q01_pwm")}
    assert len(got) == 15 and {k[0] for k in got} == {4, 9} and got[4, 0, "C"] == round(math.log(2.25 / 10 / 0.25), 9) and got[4, 1, "A"] == round(math.log(8.25 / 8 / 0.25), 9)
    best = run("q04_best_hit")
    x = motifs.scores(sequence.PWM, seq)
    assert [(r["id"], r["pos"]) for r in best] == [(1, max(i for i, v in enumerate(x) if v == max(x)))] and best[0]["pos"] >= 48 - 6
    assert [(r["c0"], r["c1"], r["c2"], r["error"]) for r in sorted(run("s07_typed_rows"))] == [(7, 1.5, "a b whole name", None), (8, None, "x", "c1")]


def test_typed_rows_keep_any_name_and_nan(spark, tmp_path):
    import math

    from spanloom import catalog

    names = ["", "\t", "a\tb", " a ", "%09", "%2509\t%", '"', "a\nb", ".", "é"]
    rows = [(i, 1.5, n) for i, n in enumerate(names)] + [(20, math.nan, ""), (21, None, ""), (22, math.nan, None), (23, -math.inf, "x")]
    spark.createDataFrame(rows, "peak_id bigint, pileup double, peak_name string").write.parquet(f"{tmp_path}/peaks.parquet")
    got = {r["c0"]: r for r in catalog.queries()["s07_typed_rows"](spark, str(tmp_path)).collect()}
    assert [(got[i]["c1"], got[i]["c2"], got[i]["error"]) for i in range(len(names))] == [(1.5, n, None) for n in names]
    assert all(math.isnan(got[i]["c1"]) and got[i]["error"] is None for i in (20, 22))
    assert [(got[i]["c1"], got[i]["c2"], got[i]["error"]) for i in (21, 23)] == [(None, "", "c1"), (-math.inf, "x", None)] and (got[20]["c2"], got[22]["c2"]) == ("", ".")


def test_curves_of_empty_classes(spark):
    df = spark.createDataFrame([(0.5, True), (0.1, True)], "s double, l boolean")
    r = stats.areas(df, F.col("s"), F.col("l")).first()
    assert r["auc"] != r["auc"] and r["average_precision"] == 1.0


def test_pseudomedian_forms_no_pairs():
    import numpy as np

    x = np.random.default_rng(1).normal(size=301)
    i, j = np.triu_indices(301, 1)
    assert abs(stats._pair_median(x) - np.median((x[i] + x[j]) / 2)) < 1e-9
    assert stats._pair_median(np.array([4.0])) == 4.0


def test_combinators(spark):
    a = spark.range(5).withColumnRenamed("id", "x")
    assert [(r["pos"], r["a"] and r["a"]["x"], r["b"] and r["b"]["x"]) for r in streams.mix(a, ["x"], a.limit(3), ["x"]).orderBy("pos").collect()][3:] == [(3, 3, None), (4, 4, None)]
    with pytest.raises(Exception, match="differ in length"):
        streams.zip_exact(a, ["x"], a.limit(3), ["x"]).collect()
    assert streams.group2(a, ["x"]).count() == 3 and streams.skip(a, ["x"], 4).count() == 1
    assert streams.compose(lambda d: d.where("x > 1"), lambda d: d.where("x < 4"))(a).count() == 2


def test_generators_are_stable(spark):
    assert generate.bed(spark, 20, 3, 100, 5, 7).collect() == generate.bed(spark, 20, 3, 100, 5, 7).collect()
    r = generate.fastq(spark, 5, 12, 1).collect()
    assert all(len(x["sequence"]) == len(x["qualities"]) == 12 for x in r)
    assert generate.fasta(spark, 2, 5).count() == 2 and generate.alignments(spark, 2, 2, 50, 5).count() == 2 and len(generate.table(spark, 3, ["int", "string"]).columns) == 2


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("x\ny\nx\n")
    q = stream.counts(stream.stream_lines(spark, str(src)), F.col("value")).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    (src / "b.txt").write_text("x\n")
    q.processAllAvailable()
    q.stop()
    assert {r["key"]: r["n"] for r in spark.table("counted").collect()} == {"x": 3, "y": 1}
    fq = tmp_path / "fq"
    fq.mkdir()
    schema = "source string, n int, value string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(fq))
    write([("s", 0, "@a"), ("s", 1, "AC")])
    q = stream.fastq_records(spark.readStream.schema(schema).parquet(str(fq)), "source", "n").writeStream.outputMode("append").format("memory").queryName("reads").start()
    q.processAllAvailable()
    write([("s", 2, "+"), ("s", 3, "II"), ("s", 4, "@b")])
    q.processAllAvailable()
    q.stop()
    assert [(r["name"], r["error"]) for r in spark.table("reads").collect()] == [("a", None)]


def test_conversions(spark):
    al = codecs.sam(table(spark, ["r\t16\tc\t1\t60\t3M\t*\t0\t0\tAAC\t!5I"]))
    assert [tuple(r) for r in codecs.sam_to_fastq(al).collect()] == [("r", "GTT", "", "I5!")]
    fq = spark.createDataFrame([("r x", "AC", "", "II")], "name string, sequence string, comment string, qualities string")
    assert codecs.fastq_to_sam(fq).first()["qname"] == "r"
    seqs, scores = (spark.createDataFrame(x, "description string, sequence string") for x in ([("a", "AC"), ("b", "A")], [("a", "40 0"), ("b", "1 2")]))
    assert {r["name"]: (r["qualities"], r["error"]) for r in codecs.fasta_with_scores(seqs, scores).collect()} == {"a": ("I!", None), "b": ('"#', "qualities")}


def test_command_line(spark, tmp_path):
    from spanloom.__main__ import main

    (tmp_path / "a.bed").write_text("c\t1\t5\nc\t6\t9\nd\t1\t2\n")
    (tmp_path / "b.bed").write_text("c\t4\t7\n")
    out = lambda *args: (main([*args, str(tmp_path / "_".join(args[:1]))]), sorted(r["value"] for r in lines(spark, str(tmp_path / args[0])).collect()))[1]
    a, b = str(tmp_path / "a.bed"), str(tmp_path / "b.bed")
    assert out("range-set", a) == ["c\t1\t9", "d\t1\t2"]
    assert out("intersection", a, b) == ["c\t4\t7"]
    assert out("intersects", a, b) == ["c\t1\t5", "c\t6\t9"]
    for kind in ("bed", "fastq", "fasta", "sam", "table"):
        main(["random", kind, "5", str(tmp_path / f"r_{kind}")])
    text = lambda path: [r["value"] for r in lines(spark, str(tmp_path / path)).orderBy("file", "line_no").collect()]
    assert len(text("r_bed")) == 5 and len(text("r_fastq")) == 20 and len(text("r_sam")) == 5 and len(text("r_table")) == 5
    (tmp_path / "r1.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nACCC\n+\nII5I\n@c\nTTTT\n+\nIIII\n")
    (tmp_path / "r2.fastq").write_text("@a\nGG\n+\nII\n@b\nGG\n+\nII\n@c\nGA\n+\nII\n")
    reads = [str(tmp_path / "r1.fastq"), str(tmp_path / "r2.fastq")]
    main(["demux", *reads, "--library", "one=R1:ACG:1:0", "--library", "two=R1:CC:2:0+R2:GG:1:0", "--output", str(tmp_path / "demux")])
    assert text("demux/statistics") == ["one\t1\t1", "two\t1\t1", "undetermined\t1\t1"]
    assert text("demux/read1/library=two") == ["@b", "ACCC", "+", "II5I"] and text("demux/read2/library=one")[1] == "GG"
    (tmp_path / "short.fastq").write_text("@a\nGG\n+\nII\n")
    with pytest.raises(Exception, match="differ in length"):
        main(["demux", reads[0], str(tmp_path / "short.fastq"), "--library", "one=R1:ACG", "--output", str(tmp_path / "demux2")])
    main(["transform", "fastq-to-fasta", reads[0], str(tmp_path / "t1")])
    assert text("t1")[:2] == [">a", "ACGT"]
    main(["transform", "fastq-to-sam", reads[0], str(tmp_path / "t2.sam")])
    assert text("t2.sam")[0].split("\t")[:2] == ["a", "4"]
    main(["transform", "sam-to-fastq", str(tmp_path / "t2.sam"), str(tmp_path / "t3")])
    assert {"ACCC", "ACGT", "TTTT"} <= set(text("t3"))
    (tmp_path / "x.sam").write_text("r\t0\tc\t5\t60\t2M2D1M\t*\t0\t0\tACG\t*\nq\t0\tc\t5\t60\t3M\t*\t0\t0\tACG\t*\n")
    main(["alignments", str(tmp_path / "x.sam"), str(tmp_path / "t5")])
    assert text("t5") == ["c\t5\t7\t2", "c\t8\t9\t1"]
    main(["alignments", str(tmp_path / "x.sam"), str(tmp_path / "t6"), "--by", "sequence", "--dedup-events"])
    assert text("t6") == ["c\t5\t7\t1"]
    main(["info"])
    main(["entrez", "gene", "a b", "--most", "5"])


def test_reader_of_any_suffix(spark, tmp_path):
    from spanloom.sources.readers import read

    (tmp_path / "a.gff3").write_text("c%20d\ts\tf\t1\t2\t.\t+\t.\tID=x\n")
    assert read(spark, str(tmp_path / "a.gff3")).first()["seqname"] == "c d"
    with pytest.raises(ValueError):
        read(spark, str(tmp_path / "a.what"))


def test_matrices(spark):
    from spanloom.functions import matrix

    df = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],), ([[1], [2, 3]],), ([],), ([[], []],)], "m array<array<int>>").select(
        matrix.row(F.col("m"), 1).alias("r"), matrix.column(F.col("m"), 1).alias("c"), matrix.transposed(F.col("m")).alias("t"))
    got = df.collect()
    assert got[0]["r"] == [4, 5, 6] and got[0]["c"] == [2, 5] and got[0]["t"] == [[1, 4], [2, 5], [3, 6]]
    assert got[1]["t"] is None and got[1]["c"] == [None, 3] and got[2]["t"] == [] and got[3]["t"] == [] and got[2]["r"] is None


def test_answers_and_formula_trees(spark):
    docs = spark.createDataFrame([("a", """<eSummaryResult><DocSum><Id>7</Id><Item Name="T" Type="String">x</Item><Item Name="L" Type="List"><Item Name="P" Type="String">p</Item></Item></DocSum></eSummaryResult>"""), ("b", "<")], "file string, content string")
    got = xml.summary_answers(docs).collect()
    assert [(r["id"], r["item"], r["value"]) for r in got if r["error"] is None] == [("7", "T", "x"), ("7", "L/P", "p")] and sum(r["error"] is not None for r in got) == 1
    arts = spark.createDataFrame([("a", "<S><MedlineCitation><PMID>12</PMID><ArticleTitle>A <i>b</i></ArticleTitle><AbstractText>x</AbstractText><AbstractText>y</AbstractText></MedlineCitation></S>")], "file string, content string")
    assert [tuple(r)[1:4] for r in xml.article_answers(arts).collect()] == [(12, "A b", "x\ny")]
    genes = spark.createDataFrame([("a", "<S><Gene-ref><Gene-ref_locus>TP53</Gene-ref_locus><Gene-ref_db><Dbtag><Dbtag_db>HGNC</Dbtag_db><Dbtag_tag><Object-id><Object-id_id>11998</Object-id_id></Object-id></Dbtag_tag></Dbtag></Gene-ref_db></Gene-ref></S>")], "file string, content string")
    g = xml.gene_answers(genes).first()
    assert g["locus"] == "TP53" and [tuple(x) for x in g["db"]] == [("HGNC", "11998")]
    model = spark.createDataFrame([("m", """<sbml><model id="m"><species id="s" compartment="c" initialAmount="1.5" constant="true"/><reaction id="r"><kineticLaw><math><apply><times/><ci>k</ci><apply><plus/><cn>1</cn><ci>s</ci></apply></apply></math></kineticLaw></reaction></model></sbml>""")], "file string, content string")
    nodes = xml.math_nodes(model).orderBy("node").collect()
    assert [(r["node"], r["parent"], r["operator"], r["text"]) for r in nodes] == [(0, None, "times", None), (1, 0, "ci", "k"), (2, 0, "plus", None), (3, 2, "cn", "1"), (4, 2, "ci", "s")]
    s = xml.typed_parts(xml.sbml(model), "species").first()
    assert (s["id"], s["initialAmount"], s["constant"], s["charge"]) == ("s", 1.5, True, None)


def test_streams_of_sequences_and_steps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parts = [[">a", "AC", "GT"], ["TT", ">b", "G"], [">"]]
    wigs = [["fixedStep chrom=c start=10 step=5 span=2", "1"], ["2", "variableStep chrom=d"], ["7 3", "9"]]
    src = "file string, line_no bigint, value string"
    for name, frames, run in (("fa", parts, lambda x: stream.fasta_records(x, "file", "line_no")), ("wig", wigs, lambda x: stream.wig_values(codecs.wig(x), "file", "line_no"))):
        folder, n = tmp_path / "in" / name, 0
        for i, part in enumerate(frames):
            spark.createDataFrame([("f", n + k, v) for k, v in enumerate(part)], src).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
            n += len(part)
        raw = spark.readStream.schema(src).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
        q = run(raw).writeStream.format("memory").queryName(f"q_{name}").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r["description"], r["sequence"]) for r in spark.table("q_fa").collect()) == [("a", "ACGTTT"), ("b", "G")]
    got = sorted(map(tuple, spark.table("q_wig").collect()), key=str)
    assert got == sorted([("f", "c", 10, 11, 1.0, None), ("f", "c", 15, 16, 2.0, None), ("f", "d", 7, 7, 3.0, None), ("f", None, None, None, None, "not_in_fixed_step_state")], key=str)

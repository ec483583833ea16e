import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.dyadic import blocks_and_gaps, condensed, decomposed
from spanloom.operators.nested import Edge, Shredded, tables_of
from spanloom.operators.packed import split_packed
from spanloom.operators.rejects import Layout, bounded, digits, finite_decimal, load_lines, one_of
from spanloom.operators.wide import Attr, widen
from spanloom.plans.general import LAYOUTS, QUERIES


def packed(spark, values, **kw):
    df = spark.createDataFrame([(i, v, "a", 0) for i, v in enumerate(values)], "pos bigint, val string, tag string, k0 int")
    got = split_packed(df, [F.col("pos")], "val", kw.pop("delimiters", ",;|\t"), **kw).orderBy("k0", "pos").collect()
    out = {}
    for r in got:
        out.setdefault(r["k0"], []).append((r["tag"], r["val"]) if kw.get("pairs") else r["val"])
    return out


def test_packed_fields(spark):
    private = ""
    values = ['a;"b,c";d', ',x,,y,', None, "", " . ", '"the ""q"" x" , z', '"so \\"called\\""', 'a "b', '""', f'{private}0,"{private};"', "a b c", '"a";', "\t", "x" * 300_000 + ",y", '""""']
    got = packed(spark, values)
    assert got == {0: ["a", "b,c", "d"], 1: ["", "x", "", "y"], 5: ['the "q" x', "z"], 6: ['so "called"'], 7: ['a "b'], 8: [""], 9: [f"{private}0", f"{private};"], 10: ["a b c"], 11: ["a"], 13: ["x" * 300_000, "y"], 14: ['"']}


def test_packed_pairs(spark):
    values = ['ID=a%2Cb,c;Note="x%20;y",z;E=;;F', 'gene_id "G=1"; n 5; tag "a,b"; t=q', "a%20b = 1%zz"]
    got = packed(spark, values, delimiters=";|", pairs=True, decode=True)
    assert got[0] == [("ID", "a,b"), ("ID", "c"), ("Note", "x%20;y"), ("Note", "z"), ("E", ""), ("", ""), ("F", "")]
    assert got[1] == [("gene_id", "G=1"), ("n", "5"), ("tag", "a,b"), ("t", "q")]
    assert got[2] == [("a b", "1%zz")]
    assert packed(spark, []) == {}


def test_schema_graph_tables():
    e = {Edge("record", "a", False), Edge("a", "b", False), Edge("record", "c", True), Edge("c", "d", False), Edge("a", "d", False), Edge("b", "b", False)}
    assert tables_of(e) == {"record", "c", "d", "b"}


def test_shredding_keeps_links(spark):
    docs = [
        (1, json.dumps({"x": {"y": 1.5, "items": [{"n": "a", "sub": {"v": None, "w": True}}, None, {"n": "b", "list": [1, "two", None]}]}})), (2, json.dumps({"x": {"items": {"n": "lone"}}})), (3, "{broken"), (4, None), (None, "{}"), (5, "[]"),
        (6, json.dumps([{"x": {}}, {"x": {}}])), (7, "[" * 200_000 + "]" * 200_000),
    ]
    sh = Shredded(spark.createDataFrame([(d, p, 1, "t") for d, p in docs], "id bigint, p string, doc int, tab string"), "id", "p")
    assert sh.tables == {"record", "items", "list"}
    rec = {(r["doc"], r["ord"]): r for r in sh.df("record", {"y": "x.y"}).collect()}
    assert rec[1, 0]["y"] == "1.5" and set(rec) == {(1, 0), (2, 0), (6, 0), (6, 1)}
    items = {(r["doc"], r["ord"]): r for r in sh.df("items", {"n": "n", "w": "sub.w"}).collect()}
    assert {k: (r["n"], r["w"]) for k, r in items.items()} == {(1, 0): ("a", "true"), (1, 2): ("b", None), (2, 0): ("lone", None)}
    assert all(r["parent_tab"] == "record" and r["path"] == "x.items" for r in items.values())
    scalars = sh.df("list", {"v": "value"}).orderBy("ord").collect()
    assert [(r["ord"], r["v"]) for r in scalars] == [(0, "1"), (1, "two")] and {r["parent_id"] for r in scalars} == {items[1, 2]["row_id"]}
    assert {r["doc"] for r in sh.df("_invalid").collect()} == {3, 4, 7}


def test_lists_in_lists_and_dots_in_names(spark):
    docs = [(1, '{"w": [[{"k": "v", "m": [{"z": 1}]}, 2, null], "x", [[]]]}'), (2, '{"a.b": "x", "a": {"b": "y", "c\\\\.": {"d": 1}}}')]
    sh = Shredded(spark.createDataFrame(docs, "id bigint, p string"), "id", "p")
    w = {r["row_id"]: r for r in sh.df("w", {"k": "k", "v": "value"}).collect()}
    outer = next(r for r in w.values() if r["parent_tab"] == "record" and r["ord"] == 0)
    assert outer["shape"] == "list" and outer["path"] == "w"
    inner = sorted((r["ord"], r["shape"], r["k"], r["v"]) for r in w.values() if r["parent_id"] == outer["row_id"] and r["parent_tab"] == "w")
    assert inner == [(0, "object", "v", None), (1, "value", None, "2")]
    assert sorted((r["ord"], r["shape"]) for r in w.values() if r["parent_tab"] == "record") == [(0, "list"), (1, "value"), (2, "list")]
    m = sh.df("m", {"z": "z"}).collect()
    assert [(r["z"], w[r["parent_id"]]["k"]) for r in m] == [("1", "v")]
    rec = sh.df("record", {"x": r"a\.b", "y": "a.b", "d": r"a.c\\\..d"}).where("doc = 2").collect()
    assert [(r["x"], r["y"], r["d"]) for r in rec] == [("x", "y", "1")]


def test_shredding_an_empty_table(spark):
    assert Shredded(spark.createDataFrame([], "id bigint, p string"), "id", "p").df("record").collect() == []


def test_an_odd_record_changes_no_other_genes(spark, tmp_path):
    import json

    ref = {"locus": "L", "db": [{"db": "MIM", "tag": {"object_id": {"id": 7}}}, None, {"db": "X", "tag": {"object_id": {"str": "s"}}}]}
    plain = {"answer": {"entrezgene_set": [{"entrezgene": {"gene": {"gene_ref": ref}}}, {"gene": {"locus": "M", "db": {"db": "Y", "tag": "t"}}}]}}
    other = {"gene_ref": ref, "tag": {"object_id": {"id": 1}}, "object_id": [{"id": 2}], "answer": {"x": 1}, "entrezgene": [{"gene": {"gene_ref": [ref], "tag": [{"id": 3}]}}]}
    odd = {"answer": {"entrezgene_set": [{"gene": {"gene_ref": ref, "other": other}}, {"other": other}]}, "other": other}
    rows = [(0, "L", "MIM", "7", 0), (0, "L", "X", "s", 2), (1, "M", "Y", "t", 0)]
    for name, records in (("plain", [plain]), ("both", [plain, odd, plain])):
        df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)], "set_id bigint, payload string")
        df.write.parquet(f"{tmp_path}/{name}/gene_sets.parquet")
        got = sorted((r["set_id"], r["gene_no"], r["locus"], r["db_name"], r["tag"], r["db_no"]) for r in QUERIES["p4_found"](spark, f"{tmp_path}/{name}").collect())
        assert got == [(i, *r) for i, x in enumerate(records) for r in (rows if x is plain else rows[:2])]


def test_rejects_keep_private_and_control_characters(spark):
    own = "".join(map(chr, (0xE009, 0xE00D, 0xE00A, 0xE010)))
    lines = [("bed5", f"c{own}\rr\0\t1\t2\tn\t5\tx\ty\ue00dt"), ("bed5", "c\t1\t2\tn\t5\ue009z"), ("bed5", "c\t1\t2\tn\t5\ue00dt"), ("bed5", "c\t1\t2\tn\t5"), ("bed5", "c\t1\t2\tn\t5\t"), ("bed5", "c\t1\t2\tn\t")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "i bigint, k string, l string")
    got = {r["id"]: r for r in load_lines(df, "i", "k", "l", LAYOUTS).collect()}
    assert [got[i]["reason"] for i in range(6)] == [None, "score", "score", None, None, "score"]
    assert got[0]["cells"]["chrom"] == f"c{own}\rr\0" and got[0]["cells"]["others"] == "x\ty\ue00dt"
    assert got[3]["cells"]["others"] is None and got[4]["cells"]["others"] == "" and got[1]["cells"]["score"] == "5\ue009z"


def test_finite_decimals():
    import pyarrow as pa

    ok = ["1", "+1", "-1.", ".5", "1.e5", "1e300", "5E-324", "00.10"]
    assert finite_decimal(pa.array(ok)).all()
    assert not finite_decimal(pa.array(["", "1e400", "nan", "inf", "1 ", "+", ".", "1e", "0x1", "１"])).any()


def test_rejects(spark):
    g = "chr1\ts\tf\t{}\t9\t.\t{}\t.\t{}"
    lines = [
        ("gff3", g.format("1", "+", "a=1")), ("gff3", g.format("1", "+", "a=1") + "\r"), ("gff3", "a\tb"), ("gff3", g.format("x", "*", 'a="')), ("gff3", g.format("１", "*", "a")), ("gff3", g.format("1", "*", "a")), ("gff3", "# c"), ("gff3", " "), ("gff3", None),
        ("bed5", "c\t1\t2\tn\t1000"), ("bed5", "c\t1\t2\tn\t1001"), ("bed5", "c\t1\t2\tn\t0005\tx\ty"), ("bed5", "c\t1\t2\tn"), ("bed5", "c\t1\t2\tn\t" + "9" * 400),
        ("xls", "chr\tstart\tend\tl\ta\tp\tq\tf\tq\tn"), ("xls", "c\t1\t2\t3\t4\t1e3\t0\t0\t0\tn"), ("xls", "c\t1\t2\t3\t4\t1e999\t0\t0\t0\tn"), ("xls", "c\t1\t2\t3\t4\tnan\t0\t0\t0\tn"), ("other", "x"), (None, "x"), ("gtf", g.format("1", ".", "y" * 200_000)),
        ("gff3", g.format("1", "+", "a\rb\nc")),
    ]
    df = spark.createDataFrame([(i, k, v, "r", "c") for i, (k, v) in enumerate(lines)] + [(None, "gff3", "x", "r", "c")], "line_id bigint, kind string, raw_line string, reason string, cells string")
    got = {r["id"]: (r["reason"], r["cells"]) for r in load_lines(df, "line_id", "kind", "raw_line", LAYOUTS).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: None, 1: None, 2: "column_count", 3: "quoting", 4: "start_pos", 5: "strand", 9: None, 10: "score", 11: None, 12: "column_count", 13: "score", 15: None, 16: "pileup", 17: "pileup", 20: None, 21: None}
    assert got[0][1]["attributes"] == "a=1" and got[11][1]["others"] == "x\ty" and got[11][1]["score"] == "0005" and got[9][1]["others"] is None and got[2][1] == {} and got[21][1]["attributes"] == "a\rb\nc"
    assert load_lines(df.limit(0), "line_id", "kind", "raw_line", LAYOUTS).collect() == []


def test_vector_tests():
    import pyarrow as pa

    v = pa.array(["1", "-1", "x", "", "1.5", "1e5", ".5", "inf"])
    assert digits(v).tolist() == [True] + [False] * 7
    assert bounded(0, 3)(v).tolist() == [True] + [False] * 7
    assert finite_decimal(v).tolist() == [True, True, False, False, True, True, True, False]
    assert one_of("x")(v).tolist() == [False, False, True, False, False, False, False, False]
    assert Layout(("a",)).rest is False


def test_wide(spark):
    rows = [
        (1, "Class", "a", 1), (1, "factor-class ", " b ", 5), (1, "class", "c", 3), (1, "n", "12", 1), (2, "other", "x", 1), (3, "n", "x", 1), (3, "class", "-", 9), (3, "class", "old", 2), (None, "class", "z", 1), (4, None, "q", 1), (5, "n", None, 7), (5, "n", "+8", 6),
        (6, "class", "x" * 100_000, 1), (6, "class", "x" * 100_000, 1),
    ] + [(7, "class", str(i), i) for i in range(3000)]
    df = spark.createDataFrame([(*r, "e", 0) for r in rows], "id bigint, a string, v string, o bigint, entity string, c int").repartition(5)
    got = {r["id"]: (r["cls"], r["n"]) for r in widen(df, "id", "a", "v", "o", {"cls": Attr(("class", "factorclass")), "n": Attr(("n",), "bigint")}).collect()}
    assert got == {1: ("b", 12), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("x" * 100_000, None), 7: ("2999", None)}
    assert widen(df.limit(0), "id", "a", "v", "o", {"cls": Attr(("class",))}).collect() == []


def brute(rows):
    out = set()
    keys = {}
    for k, lo, hi in rows:
        if lo is not None and hi is not None and lo < hi:
            keys.setdefault(k, []).append((lo, hi))
    for k, xs in keys.items():
        xs.sort()
        blocks = [list(xs[0])]
        for lo, hi in xs[1:]:
            if lo <= blocks[-1][1]:
                blocks[-1][1] = max(blocks[-1][1], hi)
            else:
                blocks.append([lo, hi])
        out |= {(k, "block", a, b) for a, b in blocks} | {(k, "gap", a[1], b[0]) for a, b in zip(blocks, blocks[1:])}
    return out


@pytest.mark.parametrize("seed,span", [(1, 60), (2, 3000), (3, 10**12)])
def test_blocks_and_gaps(spark, seed, span):
    r = random.Random(seed)
    rows = []
    for _ in range(3000):
        lo = r.randrange(-span, span)
        rows.append((r.choice(["hot", "hot", None, "b", "c"]), r.choice([lo, lo, lo, lo, None]), lo + r.choice([0, 1, 2, -3, r.randrange(1, max(2, span // 300))])))
    df = spark.createDataFrame([(*x, 0, "z") for x in rows], "k string, s bigint, e bigint, lo int, kind string").repartition(6)
    got = blocks_and_gaps(df, ["k"], "s", "e").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(rows)


def test_blocks_of_nothing(spark):
    df = spark.createDataFrame([("a", 5, 5), ("a", None, 3)], "k string, s bigint, e bigint")
    assert blocks_and_gaps(df, ["k"], "s", "e").collect() == []


def test_blocks_beyond_the_zones(spark):
    m, far = 1 << 61, 1 << 62
    rows = [("a", -far, 5), ("a", -far + 1, -far + 9), ("a", 7, 9), ("a", m - 3, far), ("a", far + 10, far + 20), ("a", far + 12, far + 15), ("a", far + 18, far + 25), ("b", far, far + 5), ("c", -far, far), ("d", m, far), ("d", 1, m), ("e", 1, 2)]
    got = sorted(tuple(r) for r in blocks_and_gaps(spark.createDataFrame(rows, "k string, s bigint, e bigint"), ["k"], "s", "e").collect())
    a = [("block", -far, 5), ("block", 7, 9), ("block", m - 3, far), ("block", far + 10, far + 25), ("gap", 5, 7), ("gap", 9, m - 3), ("gap", far, far + 10)]
    assert got == [*(("a", *x) for x in a), ("b", "block", far, far + 5), ("c", "block", -far, far), ("d", "block", 1, far), ("e", "block", 1, 2)]


def test_dyadic_blocks_are_canonical():
    import numpy as np

    g, s, n = decomposed(np.array([0]), np.array([5]), np.array([23]))
    assert sorted(zip(s.tolist(), n.tolist())) == [(5, 1), (6, 2), (8, 8), (16, 4), (20, 2), (22, 1)]
    g, s, n = condensed(np.zeros(4, int), np.array([0, 4, 6, 0]), np.array([4, 2, 2, 2]))
    assert list(zip(s.tolist(), n.tolist())) == [(0, 8)]

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.operators import intervals as iv


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, lo bigint, hi bigint")


def made(seed, n=150, span=200):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        lo = r.randrange(span)
        out.append((r.choice("ab"), lo, lo + r.choice([0, 1, 5, 20, -1])))
    return out


def points(rows):
    out = {}
    for c, lo, hi in rows:
        out.setdefault(c, set()).update(range(lo, hi + 1))
    return {c: p for c, p in out.items() if p}


def canonical(df):
    rows = sorted(map(tuple, df.select("chrom", "lo", "hi").collect()))
    for (c, _, hi), (d, lo, _) in zip(rows, rows[1:]):
        assert c != d or lo > hi + 1
    return points(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_set_operations_match_integer_sets(spark, seed):
    a, b = made(seed), made(seed + 50, 30)
    x, y = frame(spark, a), frame(spark, b)
    pa, pb = points(a), points(b)
    both = {c: (pa.get(c, set()), pb.get(c, set())) for c in set(pa) | set(pb)}
    clean = lambda f: {c: f(*p) for c, p in both.items() if f(*p)}
    assert canonical(iv.union(x, y, ["chrom"])) == clean(lambda p, q: p | q)
    assert canonical(iv.intersection(x, y, ["chrom"])) == clean(lambda p, q: p & q)
    assert canonical(iv.difference(x, y, ["chrom"])) == clean(lambda p, q: p - q)
    assert canonical(iv.complement(x, ["chrom"], -5, 300)) == {c: set(range(-5, 301)) - p for c, p in pa.items()}
    assert {r["chrom"]: r["points"] for r in iv.cardinality(x, ["chrom"]).collect()} == {c: len(p) for c, p in pa.items()}
    for r in iv.subset(y, x, ["chrom"]).collect():
        assert r["is_subset"] == (pb[r["chrom"]] <= pa.get(r["chrom"], set()))
    for r in iv.depth(x, ["chrom"]).collect():
        assert r["depth"] == sum(c == r["chrom"] and lo <= r["lo"] and r["hi"] <= hi for c, lo, hi in a)


def test_joins_match_brute_force(spark):
    a, b = made(7, 80), made(8, 60)
    x = frame(spark, a).withColumn("id", F.monotonically_increasing_id()).cache()
    y = frame(spark, b)
    good_a, good_b = [r for r in x.collect() if r["lo"] <= r["hi"]], [r for r in b if r[1] <= r[2]]
    meet = lambda r, t: r["chrom"] == t[0] and r["lo"] <= t[2] and t[1] <= r["hi"]
    got = sorted((r["id"], r["lo_b"], r["hi_b"]) for r in iv.overlaps(x, y, ["chrom"]).collect())
    assert got == sorted((r["id"], t[1], t[2]) for r in good_a for t in good_b if meet(r, t))
    assert sorted(r["id"] for r in iv.overlapping(x, y, ["chrom"]).collect()) == sorted(r["id"] for r in good_a if any(meet(r, t) for t in good_b))
    near = {r["id"]: (r["distance"], r["near_lo"], r["near_hi"]) for r in iv.nearest(x, y, ["chrom"], "id").collect()}
    for r in good_a:
        want = min(((0 if meet(r, t) else max(t[1] - r["hi"], r["lo"] - t[2])), t[1], t[2]) for t in good_b if t[0] == r["chrom"])
        assert near[r["id"]] == want


def test_nearest_without_target(spark):
    q = spark.createDataFrame([(1, "z", 1, 2)], "id int, chrom string, lo bigint, hi bigint")
    assert [tuple(r) for r in iv.nearest(q, frame(spark, [("a", 1, 2)]), ["chrom"], "id").collect()] == [(1, None, None, None)]


def test_regions_tolerate_gaps(spark):
    rows = spark.createDataFrame([("a", i, i, v) for i, v in enumerate([1, 0, 1, 0, 0, 1, 1, 0, 0, 0, 1])], "chrom string, lo bigint, hi bigint, ok int")
    got = lambda g: sorted((r["lo"], r["hi"]) for r in iv.regions(rows, ["chrom"], F.col("ok") == 1, g).collect())
    assert got(0) == [(0, 0), (2, 2), (5, 6), (10, 10)] and got(1) == [(0, 2), (5, 6), (10, 10)] and got(2) == [(0, 6), (10, 10)]


def test_empty_sets(spark):
    e = frame(spark, [])
    x = frame(spark, [("a", 1, 5)])
    assert iv.merge(e, ["chrom"]).collect() == [] and iv.depth(e, ["chrom"]).collect() == []
    assert [tuple(r) for r in iv.difference(x, e, ["chrom"]).collect()] == [("a", 1, 5)]
    assert iv.intersection(x, e, ["chrom"]).collect() == [] and iv.overlaps(x, e, ["chrom"]).collect() == []


def test_keyed_joins_have_no_nested_loop(spark):
    x = frame(spark, made(1))
    plan = iv.overlaps(x, x, ["chrom"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_joins_over_all_loci_match_brute_force(spark, tmp_path):
    r = random.Random(11)
    days = [r.randrange(9000, 9400) for _ in range(120)]
    loci = [(r.choice([1, 2]), d, r.choice([1, 5, 30, 50])) for d in days[:90]]
    orders = [(i, r.choice([1, 2, 3]), d) for i, d in enumerate(days[90:])]
    date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    spark.createDataFrame(loci, "l_suppkey bigint, d int, l_quantity int").withColumn("l_shipdate", date("d")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, d int").withColumn("o_orderdate", date("d")).write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: {x["id"]: x for x in entry.queries()[name](spark, str(tmp_path)).collect()}
    semi, near, size = run("j01_overlap_semi"), run("j04_nearest"), run("j05_overlap_size")
    assert set(near) == set(size) == {i for i, _, _ in orders}
    for i, chrom, lo in orders:
        hi, mine = lo + 30, [(d, d + q) for c, d, q in loci if c == chrom]
        want = min(((max(a - hi, lo - b, 0), a, b) for a, b in mine), default=(None, None, None))
        assert (near[i]["distance"], near[i]["near_lo"], near[i]["near_hi"]) == want
        assert size[i]["shared"] == len({p for a, b in mine for p in range(max(a, lo), min(b, hi) + 1)})
        assert (i in semi) == (size[i]["shared"] > 0)


def test_one_far_interval_leaves_stretches_even(spark, monkeypatch):
    from spanloom.operators import ordered

    monkeypatch.setattr(ordered, "ROWS", 500)
    r = random.Random(2)
    rows = [(7, a, a + r.randrange(1, 40)) for a in (r.randrange(600_000) for _ in range(20_000))]
    df = spark.createDataFrame([*rows, (7, 1 << 40, (1 << 40) + 5)], "k bigint, lo bigint, hi bigint")
    at = ordered.borders(df, "lo")
    per = sorted(x["n"] for x in df.groupBy(ordered.stretch_of(F.col("lo"), at).alias("b")).agg(F.count("*").alias("n")).collect())
    assert len(per) >= 20 and per[-1] <= 2 * per[len(per) // 2]
    got = iv.merge(df, ["k"])
    assert dict(got.dtypes)["k"] == "bigint"
    points = sorted({p for _, a, b in rows for p in range(a, b + 1)})
    want = [(a, b) for a, b in _runs(points)] + [(1 << 40, (1 << 40) + 5)]
    assert sorted((x["lo"], x["hi"]) for x in got.collect()) == want
    other = df.select("k", (F.col("lo") + 10).alias("lo"), (F.col("hi") + 25).alias("hi"))
    more = {p for _, a, b in rows for p in range(a + 10, b + 26)}
    mine = set(points)
    assert sorted((x["lo"], x["hi"]) for x in iv.intersection(df, other, ["k"]).where("lo < 1000000").collect()) == _runs(sorted(mine & more))
    assert sorted((x["lo"], x["hi"]) for x in iv.difference(df, other, ["k"]).where("lo < 1000000").collect()) == _runs(sorted(mine - more))


def _runs(points):
    out = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def test_borders_are_found_by_two_rounds_of_comparisons(spark):
    from spanloom.operators import ordered

    for at in ([], [5], list(range(-40, 60, 3)), list(range(0, 1 << 40, 1 << 30))):
        xs = sorted({x + e for x in [*at, 0] for e in (-1, 0, 1)})
        got = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", ordered.stretch_of(F.col("x"), at).alias("b")).collect()
        assert all(r["b"] == sum(a <= r["x"] for a in at) for r in got)


def test_a_range_of_many_bins(spark, monkeypatch):
    monkeypatch.setattr(iv, "PART", 8)
    rows = [("a", i * 10, i * 10 + 4) for i in range(300)] + [("a", -50, 1 << 20)]
    df = frame(spark, rows)
    assert iv.bin_width(df)[1]
    assert iv.overlaps(df, frame(spark, [("a", 2000, 2020)]), ["chrom"]).count() == 4
    assert iv.overlaps(df, df, ["chrom"]).count() == 301 + 2 * 300


def test_points_and_single_ranges(spark):
    x = spark.createDataFrame([(1, 1, 3), (1, 2, 9), (2, 4, 4), (3, 5, 4)], "k bigint, lo bigint, hi bigint")
    got = {r["k"]: r for r in iv.adjacency(x.withColumn("p", F.lit(0)), ["k"], "p").collect()}
    assert (got[2]["any_overlap"], got[2]["all_positional"], got[2]["max_gap"]) == (False, True, None) and got[1]["any_overlap"] and set(got) == {1, 2}
    yes, no = iv.partition(x, ["k"], F.col("point") % 4 != 0)
    assert sorted(map(tuple, yes.collect())) == [(1, 1, 3), (1, 5, 7), (1, 9, 9)] and sorted(map(tuple, no.collect())) == [(1, 4, 4), (1, 8, 8), (2, 4, 4)]
    assert sorted(map(tuple, iv.quantified(x, ["k"], F.col("point") < 5).collect())) == [(1, False, True), (2, True, True)]
    assert {r["pos"]: r["payloads"] for r in iv.expanded(x, ["k"], "hi").where("k = 1").collect()}[2] == [3, 9]


def test_shared_folder(spark, monkeypatch):
    from spanloom import runtime

    df = runtime.written(spark.range(3).toDF("id"), "t")
    assert df.count() == 3 and runtime.clear(spark) >= 1 and runtime.clear(spark) == 0
    with pytest.raises(Exception):
        df.count()

    class Far:
        class sparkContext:
            applicationId, master = "x", "spark://h:1"

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        runtime.shared_dir(Far)


def test_very_wide_intervals_have_borders_too(spark, monkeypatch):
    from spanloom.operators import ordered

    monkeypatch.setattr(ordered, "ROWS", 1)
    monkeypatch.setattr(ordered, "SAMPLE", 1.0)
    far = 1 << 61
    rows = [("a", -far, -far // 2), ("a", -far // 2 + 2, 5), ("a", 0, far), ("a", far - 3, (1 << 62)), ("b", 1, 2)]
    got = sorted(map(tuple, iv.merge(frame(spark, rows), ["chrom"]).select("chrom", "lo", "hi").collect()))
    assert got == [("a", -far, -far // 2), ("a", -far // 2 + 2, 1 << 62), ("b", 1, 2)]


def test_states_carried_over_partitions_and_batches(spark):
    from spanloom.operators.ordered import carried

    r = random.Random(5)
    rows = [(r.choice("abb"), i, r.choice(["m", "c", "c", "x"]) if i > 60 else r.choice("cx")) for i in range(600)]
    rows = [(f, i, "x" if f == "a" and k == "m" else k) for f, i, k in rows]
    want, state, n = {}, {}, {}
    for f, i, k in sorted(rows):
        if k == "m":
            state[f], n[f] = i, 0
        elif k == "c":
            n[f] = n.get(f, 0) + 1
        want[f, i] = (state.get(f), n.get(f, 0))
    df = spark.createDataFrame(rows, "f string, i bigint, k string")
    for parts, batch in ((1, 1000), (7, 1000), (7, 10), (40, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = carried(df, ["f", "i"], F.col("k") == "m", F.struct("i"), ["f"], F.col("k") == "c").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(x["f"], x["i"]): (x["carried"]["i"] if x["carried"] else None, x["since"]) for x in got} == want and len(got) == len(rows)

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.percentiles import measured, merged, percentiles, summaries
from spanloom.llm import topn
from spanloom.llm.topn import top_n
from spanloom.runtime import written

S = "pid bigint, g string, h string, v double, w double, value double, n bigint, q double, id bigint, src string"


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if r.random() < 0.4 else r.choice("abcdefgh") + str(r.randrange(20))
        v = r.choice([None, math.nan, -1.0, float(round(r.random() * 50)), r.random() * 1e6, 7.0, 7.0])
        out.append((i, g, r.choice([None, "x"]), v, r.choice([None, 1.0, 2.0]), 0.0, 1, 0.5, i, "z"))
    return out + out[: n // 10]


def test_percentiles_are_exact_under_skew_ties_and_repeats(spark):
    data = rows(6000)
    df = spark.createDataFrame(data, S).repartition(7)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["grp"], r["q"]): (r["n"], r["value"]) for r in percentiles(measured(df, "s", {"g": F.col("g")}, "v", "pid"), qs).collect()}
    want = {}
    for r in dict((x[0], x) for x in data).values():
        if r[3] is not None and not math.isnan(r[3]) and r[3] >= 0:
            want.setdefault(r[1], []).append(r[3])
    assert len(got) == len(want) * len(qs)
    for g, vs in want.items():
        for q in qs:
            n, v = got[g, q]
            assert n == len(vs)
            assert math.isclose(v, float(np.quantile(vs, q)), rel_tol=1e-12, abs_tol=1e-12)


def test_percentiles_of_partitions_read_by_several_tasks(spark, monkeypatch):
    from spanloom.llm import percentiles as module

    # many row groups a file, each read by a task of its own
    monkeypatch.setattr(module, "written", lambda df, name, **_: written(df, name, **{"parquet.block.size": "2000", "parquet.page.size": "1000"}))
    data = [(i, "whole" if i % 3 else "part", "x", float(i * 7919 % 9001), 0.0, 0.0, 1, 0.5, i, "z") for i in range(9000)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {(r["grp"], r["q"]): (r["n"], r["value"]) for r in percentiles(measured(spark.createDataFrame(data, S), "s", {"g": F.col("g")}, "v", "pid"), [0.1, 0.5, 0.9]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for g in ("whole", "part"):
        vs = [x[3] for x in data if x[1] == g]
        for q in (0.1, 0.5, 0.9):
            assert got[g, q][0] == len(vs) and math.isclose(got[g, q][1], float(np.quantile(vs, q)), rel_tol=1e-12)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None)], S)
    assert percentiles(measured(df, "s", {"g": F.col("g")}, "v", "pid"), [0.5]).collect() == []
    assert percentiles(measured(df.limit(0), "s", {"g": F.col("g")}, "v", "pid"), [0.5]).collect() == []


def test_summaries_of_days_combine_within_the_bound(spark):
    r = random.Random(3)
    data = [(i, f"d{i % 9}", "x", r.gauss(100, 30) ** 2 if i % 9 else r.random(), 0.0, 0.0, 1, 0.5, i, "z") for i in range(9000)]
    df = spark.createDataFrame(data, S)
    points = 50
    got = merged(summaries(measured(df, "s", {"day": F.col("g")}, "v", "pid"), points), ["src"], [0.05, 0.5, 0.95]).collect()
    vs = sorted(x[3] for x in data)
    for x in got:
        rank = np.searchsorted(vs, x["value"]) / len(vs)
        assert abs(rank - x["q"]) <= 1 / points + 9 / len(vs)


@pytest.mark.parametrize("most", [0, 1 << 25])
def test_top_n_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(topn, "BROADCAST_BYTES", most)
    data = rows(5000, 2)
    got = sorted((r["g"], r["h"] or "", r["rnk"], r["pid"]) for r in top_n(spark.createDataFrame(data, S).repartition(9), ["g", "h"], ["v", "w"], "pid", 5).collect())
    groups = {}
    for r in {(x[0], x[1], x[2], str(x[3]), x[4]): x for x in data}.values():
        if r[3] is not None and not math.isnan(r[3]):
            groups.setdefault((r[1], r[2] or ""), []).append((-r[3], r[4] is None, -(r[4] or 0), r[0]))
    want = sorted((*k, i + 1, x[3]) for k, xs in groups.items() for i, x in enumerate(sorted(xs)[:5]))
    assert got == want


def test_top_n_when_all_scores_tie_and_one_item_repeats(spark):
    data = [(i % 50, "g", "h", 1.0, None, 0.0, 1, 0.0, 0, "z") for i in range(4000)]
    got = top_n(spark.createDataFrame(data, S).repartition(8), ["g"], ["v", "w"], "pid", 3).orderBy("rnk").collect()
    assert [(r["rnk"], r["pid"]) for r in got] == [(1, 0), (2, 1), (3, 2)]
    assert top_n(spark.createDataFrame([], S), ["g"], ["v"], "pid", 3).collect() == []


def test_wrong_parameters(spark):
    df = spark.createDataFrame([], S)
    with pytest.raises(ValueError):
        top_n(df, ["g"], ["v"], "pid", 0)
    with pytest.raises(ValueError):
        percentiles(measured(df, "s", {"g": F.col("g")}, "v", "pid"), [1.5])

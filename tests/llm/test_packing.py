import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.packing import TOKENIZER, fill_containers, packed, token_counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_no_container_overflows_and_no_item_is_lost(sizes):
    s = np.array(sizes, np.int64)
    bins, n = packed(s, 100)
    assert (bins >= 0).all() and (len(bins) == 0 or len(np.unique(bins)) == n)
    assert np.bincount(bins, weights=s, minlength=n).max(initial=0) <= 100
    # within the bound of best fit decreasing
    assert n <= max(1, 1.7 * s.sum() / 100 + 1) or (s > 50).sum() >= n - 1 or n <= -(-11 * len(s) // 9)


def test_pairs_of_large_items_are_best():
    bins, n = packed(np.array([60, 55, 45, 40]), 100)
    assert n == 2
    bins, n = packed(np.full(30, 34), 100)
    assert n == 15


def test_little_space_is_left():
    s = np.clip(np.random.default_rng(5).lognormal(5, 1.2, 20000).astype(int), 1, 2048)
    _, n = packed(s, 2048)
    assert n <= 1.002 * s.sum() / 2048 + 1


def test_only_items_above_the_capacity_are_split(spark):
    rows = [(1, 10), (2, 2048), (3, 2049), (4, 6000), (5, 0), (6, 10), (6, 10)]
    got = fill_containers(spark.createDataFrame(rows, "id bigint, tokens bigint"), len(rows), 2048, shard_items=3).collect()
    pieces = {i: sorted(r["size"] for r in got if r["id"] == i) for i in range(1, 7)}
    assert pieces == {1: [10], 2: [2048], 3: [1, 2048], 4: [1904, 2048, 2048], 5: [0], 6: [10, 10]}
    load = {}
    for r in got:
        load[r["shard"], r["bin"]] = load.get((r["shard"], r["bin"]), 0) + r["size"]
    assert max(load.values()) <= 2048


def test_token_counts(spark):
    import tokenizers

    long = "word, and another one. " * 20000
    rows = [(1, "Hello there, world"), (2, ""), (3, None), (None, "x"), (4, long), (5, "Überraschung für alle\n\n  zwei")]
    got = {r["id"]: r["tokens"] for r in token_counts(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()}
    assert got[2] == got[3] == 0 and None not in got
    other = tokenizers.Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    for i, t in rows:
        if i and t:
            assert got[i] == len(other.encode(t, add_special_tokens=False).ids)


def test_empty_table(spark):
    assert fill_containers(spark.createDataFrame([], "id bigint, tokens bigint"), 0, 10).collect() == []
    assert token_counts(spark.createDataFrame([], "id bigint, t string"), "id", "t").collect() == []


@pytest.mark.parametrize("n", [1, 2])
def test_single_items(n):
    assert packed(np.full(n, 5), 5)[1] == n

"""Filling fixed-capacity containers with items, by large-item matching.

At most two items above a third of the capacity fit into one container, so these are paired first: each, from the largest down, with the
largest unpaired one that still fits. Smaller items then go, from the largest down, into the container whose gap they fit best. Items are
spread over shards of bounded size by a hash, and each shard is packed by itself: a shard leaves about one container partly filled, so the
space lost by sharding is at most one container in some thousands of items.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.arrow import starts
from spanloom.runtime import spread

#: Items of one shard; what a task holds is a few numbers an item.
SHARD_ITEMS = 50_000
#: Pieces longer than this are tokenised part by part at white space, which no public pattern crosses with a letter.
PART_CHARS = 100_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _counter(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(text: str) -> Iterator[str]:
        """Cut before a lone blank that precedes a letter: the blank belongs to the following token in any case."""
        at = 0
        while len(text) - at > PART_CHARS:
            cut = at + PART_CHARS
            while cut < len(text) - 1 and not (text[cut] == " " and text[cut + 1].isalpha() and not text[cut - 1].isspace()):
                cut += 1
            if cut >= len(text) - 1:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def count(text: str | None) -> int:
        return 0 if not text else len(enc.encode_ordinary(text)) if len(text) <= PART_CHARS else sum(len(enc.encode_ordinary(p)) for p in parts(text))

    return count


def token_counts(df: DataFrame, ident: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, tokens of each document, by the public vocabulary file ``tokenizer`` (a path every executor can read).

    Null and empty texts have no tokens; rows with a null id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in batches:
            count = count or _counter(tokenizer)
            yield pa.record_batch([b.column("id"), pa.array([count(t) for t in b.column("t").to_pylist()], pa.int64())], ["id", "tokens"])

    src = df.where(F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(text).cast("string").alias("t"))
    return spread(src).mapInArrow(run, "id bigint, tokens bigint")


def packed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container number of each item (all sizes from 1 to ``capacity``) and how many containers there are."""
    n = len(sizes)
    bins = np.full(n, -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    size = sizes.tolist()
    large = [i for i in order.tolist() if 3 * size[i] > capacity]
    # unpaired large items by size; from the largest down, each takes the largest partner that fits
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in reversed(large):
        stacks[size[i]].append(i)
    below = list(range(-1, capacity))  # the next lower size that may hold items, found by path halving

    def top(s: int) -> int:
        while s > 0 and not stacks[s]:
            below[s] = below[below[s]] if below[s] > 0 and not stacks[below[s]] else below[s]
            s = below[s]
        return s

    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in large:
        if bins[i] >= 0:
            continue
        stacks[size[i]].remove(i) if stacks[size[i]][-1] != i else stacks[size[i]].pop()
        bins[i] = used
        gap = capacity - size[i]
        s = top(gap)
        if 3 * s > capacity:
            j = stacks[s].pop()
            bins[j] = used
            gap -= s
        gaps[gap].append(used)
        used += 1
    # small items: best fit by exact gaps, found through a bit set of the gaps that occur
    have = sum(1 << g for g in range(1, capacity + 1) if gaps[g])
    for i in order[len(large):].tolist():
        s = size[i]
        fit = have >> s
        if fit:
            g = s + (fit & -fit).bit_length() - 1
            b = gaps[g].pop()
            if not gaps[g]:
                have ^= 1 << g
        else:
            g, b = capacity, used
            used += 1
        bins[i] = b
        if g > s:
            gaps[g - s].append(b)
            have |= 1 << (g - s)
    return bins, used


def _packer(capacity: int):
    def shard(s: int, ident: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(ident, kind="stable")
        ident, tokens = ident[by], tokens[by]
        whole = np.maximum(-(-tokens // capacity), 1)  # an item above the capacity is split into full pieces and a rest
        row = np.repeat(np.arange(len(ident)), whole)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        size = np.minimum(tokens[row] - piece * capacity, capacity)
        bins = np.full(len(row), -1, np.int64)
        some = size > 0
        bins[some], _ = packed(size[some], capacity)
        bins[~some] = 0  # empty documents take no space
        return pa.record_batch([pa.array(ident[row]), pa.array(piece.astype(np.int32)), pa.array(whole[row].astype(np.int32)), pa.array(size), pa.array(np.full(len(row), s, np.int64)), pa.array(bins)],
                               ["id", "piece", "pieces", "size", "shard", "bin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            s = b.column("shard").to_numpy()
            at = np.append(np.flatnonzero(starts(s)), len(s))
            for lo, hi in zip(at, at[1:]):
                if held and s[lo] != now:
                    t = pa.Table.from_batches(held)
                    yield shard(now, t.column("id").to_numpy(), t.column("tokens").to_numpy())
                    held = []
                now = int(s[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            t = pa.Table.from_batches(held)
            yield shard(now, t.column("id").to_numpy(), t.column("tokens").to_numpy())

    return run


def fill_containers(sizes: DataFrame, rows: int, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``sizes`` (id, tokens) packed: id, piece, pieces, size, shard, bin; (shard, bin) names a container.

    An item is split only if it exceeds ``capacity``: into full containers and a rest that is packed like any item. Items of size 0 lie in
    container 0 of their shard. Repeated ids are items of their own. ``rows``: the number of items, which sets the number of shards.
    """
    shards = max(1, -(-rows // shard_items))
    put = sizes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("bigint"))
    put = put.repartition("shard").sortWithinPartitions("shard")
    return put.mapInArrow(_packer(capacity), "id bigint, piece int, pieces int, size bigint, shard bigint, bin bigint")

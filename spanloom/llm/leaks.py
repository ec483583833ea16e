"""Passages of held-out items in a large corpus, by the q-gram lemma and banded alignment.

Items and documents become streams of letters and digits: case, punctuation, spacing, line ends and interruptions in brackets fall away.
Every gram of eight bytes that a document shares with an item lies on a diagonal (document minus item position). A passage with few
altered words leaves at least a known number of shared grams in one of the overlapping bands of diagonals; only bands that reach the
bound of their item are aligned. The alignment, within the band, finds the fewest item words that are altered, and from these the
longest stretches that satisfy the rule.

The items are the stated query set: they are sent to all executors in blocks of bounded size, and every block meets every document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.arrow import rank_in_run, starts
from spanloom.runtime import spread

Q = 8
#: Least half width of a band in diagonals; bands overlap by it.
HALF = 32
#: Diagonals added on both sides of a band when it is aligned.
MARGIN = 8
#: Characters of text scanned, candidates aligned, and characters of items held by one block.
SCAN_CHARS, ALIGN_ROWS, BLOCK_CHARS = 4_000_000, 512, 4_000_000
#: Ends a document while many are read as one string.
_STOP = "\x00"
_BRACKETS = re.compile(r"\([^()\[\]\x00]*\)|\[[^()\[\]\x00]*\]")
_PARTED = re.compile(r"[-­‐‑]\s*\n\s*")
_WORD = re.compile(r"\S+")
_OTHER = re.compile(r"[\W_]+")


_known: dict[int, bytes] = {}


def _folded(code: int) -> bytes:
    """What remains of a character: letters and digits, without case and marks, as UTF-8."""
    if code not in _known:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).casefold()
        _known[code] = _OTHER.sub("", bare).encode("utf-8", "ignore")
    return _known[code]


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits only, folded, as UTF-8, of all texts in a row; and the start of each, and the end of the last."""
    cp = np.frombuffer((_STOP.join(texts) + _STOP).encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.flatnonzero(np.bincount(cp))
    pool = [_folded(c) for c in present.tolist()]
    size, at = np.zeros(int(present[-1]) + 1, np.int64), np.zeros(int(present[-1]) + 1, np.int64)
    size[present] = [len(x) for x in pool]
    at[present] = np.cumsum(size[present]) - size[present]
    n = size[cp]
    start = np.concatenate([[0], np.cumsum(n)[cp == 0]])
    cp, n = cp[n > 0], n[n > 0]
    where = at[cp] if len(n) and n.max() == 1 else np.repeat(at[cp], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(b"".join(pool), np.uint8)[where], start


def stream(text: str) -> bytes:
    return streams([text.replace(_STOP, " ")])[0].tobytes()


def without_brackets(texts: list[str]) -> list[str]:
    """The texts (without NUL characters) without what stands in brackets, however nested."""
    text, held = _STOP.join(texts), None
    while text != held:
        held, text = text, _BRACKETS.sub(" ", text)
    return text.split(_STOP)


def words(text: str) -> list[bytes]:
    return [w for w in (stream(x) for x in _WORD.findall(_PARTED.sub("", text))) if w]


@dataclass
class Items:
    """A block of items ready to be searched for."""

    ident: np.ndarray
    text: np.ndarray  # bytes of all items
    start: np.ndarray  # of each item in text, and the end of the last
    word: np.ndarray  # number of the word within its item, for each byte
    need: np.ndarray  # least shared grams of a passage
    shortest: np.ndarray  # words of the shortest passage
    half: int  # half the width of a band: the drift that the allowed number of altered words can cause
    short: dict[int, dict[tuple[bytes, ...], list[int]]]  # items of fewer letters than a gram, by their words, by the number of these
    grams: np.ndarray  # sorted distinct grams
    first: np.ndarray  # into where
    where: np.ndarray  # positions of the grams in text
    seen: np.ndarray  # bit table of hashed grams


def _grams(b: np.ndarray) -> np.ndarray:
    """Each position's eight bytes as one number; shorter streams have none."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    raw = b.tobytes()
    for s in range(Q):
        m = (len(raw) - s) // Q
        v = np.frombuffer(raw, np.uint64, m, s)
        out[s::Q] = v[: len(out[s::Q])]
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(41)


def prepared(ident: list[int], texts: list[str], least_words: int, one_in: int, grow: int) -> Items | None:
    """Index of a block; items of no word are left out, as they can't be held by anything."""
    kept, parts, numbers, need, shortest, half, short = [], [], [], [], [], HALF, {}
    for i, t in zip(ident, texts, strict=True):
        ws = words(t)
        total = sum(map(len, ws))
        if not ws:
            continue
        if total < Q:
            short.setdefault(len(ws), {}).setdefault(tuple(ws), []).append(i)
            continue
        m = min(least_words, len(ws))
        size = np.array([len(w) for w in ws])
        # of the windows of m words: their grams less those that the largest allowed number of altered words can spoil
        bound = min(int(size[k : k + m].sum()) - Q + 1 - int(np.sort(size[k : k + m])[::-1][: m // one_in].sum() + (m // one_in) * (Q - 1)) for k in range(len(ws) - m + 1))
        drift = max(int(np.sort(size[k : k + m])[::-1][: m // one_in].sum()) for k in range(len(ws) - m + 1))
        half = max(half, drift, m // one_in * grow)
        kept.append(i)
        parts.append(b"".join(ws))
        numbers.append(np.repeat(np.arange(len(ws)), size))
        need.append(max(1, bound))
        shortest.append(m)
    if not kept and not short:
        return None
    start = np.cumsum([0, *map(len, parts)])
    text = np.frombuffer(b"".join(parts), np.uint8)
    g = _grams(text)
    pos = np.arange(len(g))
    own = np.searchsorted(start, pos, "right") - 1
    inside = pos + Q <= start[own + 1]
    g, pos = g[inside], pos[inside]
    by = np.argsort(g, kind="stable")
    g, pos = g[by], pos[by]
    grams, first = np.unique(g, return_index=True)
    seen = np.zeros(1 << 23, bool)
    seen[_slot(grams)] = True
    return Items(np.array(kept), text, start, np.concatenate([np.zeros(0, np.int64), *numbers]), np.array(need), np.array(shortest), half, short, grams, np.append(first, len(g)), pos, seen)


def _candidates(it: Items, text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, first diagonal, shared grams) of bands with enough shared grams. ``doc``: start of each document in text, and the end."""
    g = _grams(text)
    p = np.flatnonzero(it.seen[_slot(g)])
    at = np.searchsorted(it.grams, g[p])
    real = (at < len(it.grams)) & (it.grams[np.minimum(at, len(it.grams) - 1)] == g[p])
    p, at = p[real], at[real]
    n = it.first[at + 1] - it.first[at]
    w = it.where[np.repeat(it.first[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    p = np.repeat(p, n)
    d = np.searchsorted(doc, p, "right") - 1
    inside = p + Q <= doc[d + 1]
    p, w, d = p[inside], w[inside], d[inside]
    item = np.searchsorted(it.start, w, "right") - 1
    low = int(it.start[-1])
    band = (p - (w - it.start[item]) + low) // it.half
    bands, items = (len(text) + low) // it.half + 2, len(it.ident)
    key, count = np.unique((d * items + item) * bands + band, return_counts=True)
    # a band is two neighbouring halves
    nxt = np.zeros(len(key), np.int64)
    if len(key) > 1:
        nxt[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
    lone = np.ones(len(key), bool)
    lone[1:] = key[1:] != key[:-1] + 1
    who = key // bands
    both, only = count + nxt >= it.need[who % items], lone & (count >= it.need[who % items])
    keep = both | only
    who, b = who[keep], key[keep] % bands
    return who // items, who % items, b * it.half - low, (count + nxt)[keep]


def _altered(it: Items, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, diag: np.ndarray, grow: int) -> tuple[np.ndarray, np.ndarray]:
    """Banded alignment of candidates: for each of their words, altered in the alignment with the fewest altered words; and word counts.

    A column is a diagonal of the band. A word of the item is whole where all its bytes stand in the document on its column; an altered
    word may stand for any bytes of the document, from none to ``grow`` more than it has, and so leads to the columns in that reach.
    """
    n, width = len(item), 2 * it.half + 2 * MARGIN
    base, col, idx = diag - MARGIN, np.arange(width, dtype=np.int32), np.arange(n)
    first, past = it.start[item], it.start[item + 1]
    count = it.word[past - 1] + 1
    words = int(count.max())
    far = np.int32(1 << 30)
    size = np.zeros((n, words), np.int64)
    for k, (a, b) in enumerate(zip(first, past, strict=True)):
        size[k, : count[k]] = np.bincount(it.word[a:b])
    at = np.cumsum(size, axis=1) - size
    cost = np.zeros((n, width), np.int32)
    came = np.full((words, n, width), -1, np.int16)  # -1: the word is whole; else the column before it
    entire = np.zeros((words, n, width), bool)  # all bytes of the word stand on the column
    for i in range(n):
        span = int(past[i] - first[i])
        near = np.zeros(width + span - 1, np.uint8)
        a, z = max(int(base[i]), int(lo[i])), min(int(base[i]) + len(near), int(hi[i]))
        if a < z:
            near[a - base[i] : z - base[i]] = text[a:z]
        met = np.lib.stride_tricks.sliding_window_view(near, width).T == it.text[first[i] : past[i]]
        entire[: count[i], i] = np.logical_and.reduceat(met, at[i, : count[i]], axis=1).T
    for k in range(words):
        whole = entire[k]
        best = np.full((n, width), far, np.int32)
        state = cost * np.int32(width) + col
        for shift in range(-int(size[:, k].max()), 0):
            best[:, :shift] = np.minimum(best[:, :shift], np.where((shift >= -size[:, k])[:, None], state[:, -shift:], far))
        # the least of the columns up to ``grow`` to the left, by doubling the reach
        reach, most = 1, grow + 1
        while reach < most:
            step = min(reach, most - reach)
            state[:, step:] = np.minimum(state[:, step:], state[:, :-step])
            reach += step
        best = np.minimum(best, state)
        column = best % np.int32(width)
        changed = (best - column) // np.int32(width) + np.int32(1)
        pick = whole & (cost <= changed)
        came[k] = np.where(pick, -1, column)
        live = (k < count)[:, None]
        cost = np.where(live, np.where(pick, cost, changed), cost)
    out = np.ones((n, words), bool)
    c = cost.argmin(1)
    for k in range(words - 1, -1, -1):
        live = k < count
        step = came[k, idx, c]
        out[live & (step < 0), k] = False
        c = np.where(live & (step >= 0), step, c)
    return out, count


def _holds(altered: np.ndarray, count: np.ndarray, least: np.ndarray, one_in: int) -> np.ndarray:
    """Whether some stretch of at least ``least`` words, whole at both ends, has at most one altered word in ``one_in``."""
    n, words = altered.shape
    s = np.zeros((n, words + 1), np.int64)
    s[:, 1:] = np.cumsum(np.where(altered, one_in - 1, -1), axis=1)
    # the highest sum before a stretch may begin
    floor = -(1 << 40)
    begin = np.full((n, words + 1), floor, np.int64)
    begin[:, :-1] = s[:, :-1]
    high = np.maximum.accumulate(begin, axis=1)
    end = np.arange(words + 1)[None, :] - least[:, None]
    ok = (end >= 0) & (np.arange(words + 1)[None, :] <= count[:, None])
    reach = np.take_along_axis(high, np.maximum(end, 0), axis=1)
    return (ok & (s <= reach)).any(1)


def _searcher(items: Items, one_in: int, grow: int):
    def scan(ident: list[int], texts: list[str], found: set[tuple[int, int]]) -> None:
        """Adds the pairs that aren't in ``found`` yet; of the bands of a pair, the one that shares most is aligned first."""
        text, doc = streams(texts)
        if len(text) < Q or not len(items.ident):
            return
        d, item, diag, shared = _candidates(items, text, doc)
        by = np.lexsort((-shared, item, d))
        d, item, diag = d[by], item[by], diag[by]
        turn = rank_in_run(starts(d, item))
        while len(d):
            new = np.array([(ident[a], b) not in found for a, b in zip(d.tolist(), items.ident[item].tolist(), strict=True)], bool)
            d, item, diag, turn = d[new], item[new], diag[new], turn[new]
            now = np.flatnonzero(turn == 0) if (turn == 0).any() else np.arange(len(d))
            # items of like numbers of words together
            now = now[np.argsort(items.start[item[now] + 1] - items.start[item[now]], kind="stable")]
            for k in range(0, len(now), ALIGN_ROWS):
                at = now[k : k + ALIGN_ROWS]
                altered, count = _altered(items, text, doc[d[at]], doc[d[at] + 1], item[at], diag[at], grow)
                hit = at[_holds(altered, count, items.shortest[item[at]], one_in)]
                found |= {(ident[a], b) for a, b in zip(d[hit].tolist(), items.ident[item[hit]].tolist(), strict=True)}
            rest = np.ones(len(d), bool)
            rest[now] = False
            d, item, diag, turn = d[rest], item[rest], diag[rest], turn[rest]

    def exact(ident: list[int], texts: list[str], found: set[tuple[int, int]]) -> None:
        for i, t in zip(ident, texts, strict=True):
            ws = words(t)
            for n, of in items.short.items():
                for k in range(len(ws) - n + 1):
                    found |= {(i, item) for item in of.get(tuple(ws[k : k + n]), ())}

    def search(ident: list[int], texts: list[str]) -> pa.RecordBatch:
        found: set[tuple[int, int]] = set()
        bare = without_brackets(texts)
        # where something stood in brackets, the text is read as it stands too
        full = [k for k, (a, b) in enumerate(zip(texts, bare, strict=True)) if len(a) != len(b)]
        for who, what in ((ident, bare), ([ident[k] for k in full], [texts[k] for k in full])):
            if who:
                scan(who, what, found)
                if items.short:
                    exact(who, what, found)
        a, b = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), strict=True):
                ident.append(i)
                texts.append(t.replace(_STOP, " "))
                held += len(t)
                if held >= SCAN_CHARS:
                    yield search(ident, texts)
                    ident, texts, held = [], [], 0
        if texts:
            yield search(ident, texts)

    return run


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least_words: int = 20, one_in: int = 10, grow: int = 24) -> DataFrame:
    """doc_id, item_id of every document that holds a passage of an item, once each.

    A passage is at least ``least_words`` consecutive words of the item, or the whole item if that is shorter, with at most one altered word
    in ``one_in``. Null or empty texts hold nothing and are held by nothing; rows with null ids are left out; items with equal texts or shared
    passages each count. What stands for an altered word has at most ``grow`` bytes more than it. Documents are read both without what stands in
    brackets and as they stand. Items of fewer than eight letters have no gram; they are held where all their words follow each other unaltered.
    """
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t"))
    src = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("t"))
    src = spread(src)
    out, ident, texts, held = None, [], [], 0

    def block() -> None:
        nonlocal out, ident, texts, held
        made = prepared(ident, texts, least_words, one_in, grow)
        ident, texts, held = [], [], 0
        if made is not None:
            part = src.mapInArrow(_searcher(made, one_in, grow), "doc_id bigint, item_id bigint")
            out = part if out is None else out.unionByName(part)

    for r in rows.toLocalIterator():
        ident.append(r["i"])
        texts.append(r["t"])
        held += len(r["t"])
        if held >= BLOCK_CHARS:
            block()
    block()
    if out is None:
        return src.select(F.col("id").alias("doc_id"), F.col("id").alias("item_id")).limit(0)
    return out.distinct()

"""Subjects of documents: term weighting, truncated SVD, and cosine to seed centroids that are refined in rounds.

1. Words become hashed terms, sentence by sentence; document frequencies are counted over all documents.
2. Documents are rows of terms. A term first weighs as much as it is rare in the kind of text in which it is commonest. The weighted matrix of all
   documents is reduced by a truncated SVD: its product with random directions is summed over all documents in one pass, and the components follow
   from that sum (a Nystrom approximation). What is gathered is terms x components, whatever the number of documents.
3. Seed centroids, one for each subject and kind, come from labelled documents. All documents that lie clearly nearest to one of them refine it, in rounds.
4. The documents so assigned give every term its distribution over subjects. Terms are weighed again by how far it diverges from that of all terms,
   and the SVD and the centroids are computed anew with these weights.
5. A document is assigned to the subjects whose centroids lie within a cosine of it. An exact check follows: of these subjects it keeps those that at
   least ``least`` of its sentences are nearest to.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import spread, written

#: Ends a document while a batch is read as one string.
_STOP = "\x00"
_BRACKETS = re.compile(r"\([^()\[\]\x00]*\)|\[[^()\[\]\x00]*\]")
_PARTED = re.compile(r"[-­‐]\s*\n\s*")
#: Terms handled at once when documents are embedded, and terms of one block when partial sums meet.
CHUNK, BLOCK = 65_536, 1024
#: Documents a Python worker reads at once; letters read at once are bounded by LETTERS or one document.
DOCS, LETTERS = 2000, 4_000_000
#: Cells of a table of documents and terms; larger ones are sorted instead.
TABLE = 16_000_000
#: Partial sums: so many tasks a core at most, whatever the number of files.
TASKS = 4


@dataclass(frozen=True)
class Settings:
    """``labelled``: the most labelled documents the seeds are fitted on (those with the lowest hashes of their ids); all else covers all documents.

    ``buckets`` bounds the hashed terms, so that what is broadcast is at most buckets x (components + extra) x 4 bytes. Kinds of text beyond the
    ``kinds`` commonest count as unknown.
    """

    components: int = 64
    extra: int = 32  # random directions beyond the components
    rounds: int = 2  # of refinement before terms are weighed again
    labelled: int = 50_000
    buckets: int = 1 << 17
    kinds: int = 200
    common: float = 1.5  # terms in more of a kind's documents than this over the number of subjects (half at most) stand beside any subject and never weigh
    prior: float = 2.0  # pseudo-counts of a term's distribution over subjects
    floor: float = 0.02  # least second weight
    cosine: float = 0.4  # documents refine a centroid at this cosine at least
    margin: float = 0.15  # and if the next subject is so much further off
    near: float = 0.1  # least cosine of a document to the subjects it is assigned to
    least: int = 3  # sentences that a subject has at least
    s_cosine: float = 0.15  # a sentence belongs to the nearest subject from this cosine on
    s_margin: float = 0.08  # if the next is so much further off
    s_mass: float = 0.1  # and if it holds a term of this weight


_classes: dict[str, np.ndarray] = {}


def _class(name: str, cp: np.ndarray) -> np.ndarray:
    """Mask of code points that are letters or spaces."""
    if name not in _classes:
        _classes[name] = np.array([getattr(chr(i), name)() for i in range(0x10000)])
    low = _classes[name][np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp > 0xFFFF)
    if len(high):
        low[high] = [getattr(chr(i), name)() for i in cp[high].tolist()]
    return low


_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of two letters or more in ``texts``: a 64-bit hash, the number of the sentence (over all texts), and the number of the text.

    Case, line breaks within words, and what stands in brackets don't count. Sentences end at a full stop, exclamation or question mark before a
    blank, or at an empty line.
    """
    text = _STOP.join(x.replace(_STOP, " ") for x in texts).casefold() + _STOP
    text, held = _PARTED.sub("", text), None
    while text != held:
        held, text = text, _BRACKETS.sub(" ", text)
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter, space = _class("isalpha", cp), _class("isspace", cp)
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    if not len(lo):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_mixed(cp.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(cp)), out=sums[1:])
    hashed = _mixed((sums[hi] - sums[lo]) * _powers(_INVERSE, len(cp))[lo])
    stop = cp == 0
    end = stop.copy()
    end[:-1] |= ((cp == 46) | (cp == 33) | (cp == 63))[:-1] & space[1:]
    line = np.flatnonzero(cp == 10)
    inked = np.cumsum(~space)[line]
    end[line[1:][inked[1:] == inked[:-1]]] = True
    return hashed, np.cumsum(end)[lo], np.cumsum(stop)[lo]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _distinct(doc: np.ndarray, term: np.ndarray, docs: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of document and term."""
    there = np.flatnonzero(np.bincount(term, minlength=buckets))
    if docs * len(there) > TABLE:
        cell = np.unique(doc * buckets + term)
        return cell // buckets, cell % buckets
    place = np.zeros(buckets, np.int64)
    place[there] = np.arange(len(there))
    seen = np.zeros((docs, len(there)), bool)
    seen[doc, place[term]] = True
    doc, term = np.nonzero(seen)
    return doc, there[term]


_TERMS = "id bigint, kind string, lens array<int>, ids array<int>"


def _hashed(buckets: int):
    """Documents as terms with the lengths of their sentences; rows without an id state in how many documents of a kind and batch a term occurs."""

    def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum([0 if x is None else x for x in pa.compute.utf8_length(b.column("t")).to_pylist()])
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, min(at + DOCS, int(np.searchsorted(size, before + LETTERS, "right"))))
            yield b.slice(at, to - at)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            n, kinds = b.num_rows, b.column("kind").to_pylist()
            hashed, sent, doc = words(b.column("t").to_pylist())
            ids = (hashed % np.uint64(buckets)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]]) if len(sent) else np.zeros(0, np.int64)
            lens = np.diff(np.r_[first, len(sent)])
            yield pa.record_batch([b.column("id"), b.column("kind"), _lists(lens, np.bincount(doc[first], minlength=n)), _lists(ids, np.bincount(doc, minlength=n))], ["id", "kind", "lens", "ids"])
            names = sorted({k or "" for k in kinds})
            of = np.array([names.index(k or "") for k in kinds])
            doc, term = _distinct(doc, ids, n, buckets)
            cell, count = np.unique(of[doc] * buckets + term, return_counts=True)
            per = np.bincount(cell // buckets, minlength=len(names))
            yield pa.record_batch([pa.nulls(len(names), pa.int64()), pa.array([k or None for k in names], pa.string()), _lists(count, per), _lists(cell % buckets, per)], ["id", "kind", "lens", "ids"])

    return run


@dataclass
class _Batch:
    """Documents of one batch: terms of all sentences in a row, the sentence of each, and the document of each sentence."""

    ident: np.ndarray
    kind: list
    ids: np.ndarray
    sent: np.ndarray
    sent_doc: np.ndarray


def _active(slot: np.ndarray):
    """``slot``: place of each bucket among the terms that weigh, -1 for the others, which are left out, as are sentences without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = b.column("lens").flatten().to_numpy()
            ids = slot[b.column("ids").flatten().to_numpy()]
            there = ids >= 0
            left = np.bincount(np.repeat(np.arange(len(lens)), lens)[there], minlength=len(lens))
            doc = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(b.column("lens")).to_numpy())
            tokens = np.bincount(doc, left, minlength=b.num_rows).astype(np.int64)
            yield pa.record_batch([b.column("id"), b.column("kind"), _lists(left[left > 0], np.bincount(doc[left > 0], minlength=b.num_rows)), _lists(ids[there], tokens)], ["id", "kind", "lens", "ids"])

    return run


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    for b in (big.slice(k, DOCS) for big in batches for k in range(0, big.num_rows, DOCS)):
        lens = b.column("lens").flatten().to_numpy()
        per = pa.compute.list_value_length(b.column("lens")).to_numpy()
        yield _Batch(b.column("id").to_numpy(), b.column("kind").to_pylist(), b.column("ids").flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lens)), lens), np.repeat(np.arange(b.num_rows), per))


def _summed(ids: DataFrame, fn: Callable[..., None], *shapes: tuple[int, int]) -> list[np.ndarray]:
    """Sums over all documents of matrices that ``fn(batch, *matrices)`` adds to; partial matrices meet block by block of rows, on the executors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(x) for x in shapes]
        for b in _batches(batches):
            fn(b, *totals)
        for m, total in enumerate(totals):
            for k in range(0, len(total), BLOCK):
                if total[k : k + BLOCK].any():
                    yield pa.record_batch([pa.array([m], pa.int32()), pa.array([k], pa.int64()), pa.array([total[k : k + BLOCK].tobytes()], pa.binary())], ["m", "k", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for m, k, v in zip(b.column("m").to_pylist(), b.column("k").to_pylist(), b.column("v"), strict=True):
                x = np.frombuffer(v.as_buffer(), float)
                total[m, k] = total[m, k] + x if (m, k) in total else x.copy()
        for (m, k), x in total.items():
            yield pa.record_batch([pa.array([m], pa.int32()), pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["m", "k", "v"])

    out = [np.zeros(x) for x in shapes]
    schema = "m int, k bigint, v binary"
    few = ids.coalesce(TASKS * ids.sparkSession.sparkContext.defaultParallelism)
    for r in few.mapInArrow(part, schema).repartition("m", "k").mapInArrow(meet, schema).collect():
        x = np.frombuffer(bytes(r["v"]), float).reshape(-1, shapes[r["m"]][1])
        out[r["m"]][r["k"] : r["k"] + len(x)] = x
    return out


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, where rows of ``at`` may repeat."""
    if len(at):
        by = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.r_[True, at[by][1:] != at[by][:-1]])
        total[at[by][cuts]] += np.add.reduceat(rows[by], cuts, axis=0)


@dataclass
class _Rows:
    """Documents as sparse weighted rows of unit length: documents, start of each in the cells, terms and values of the cells."""

    docs: np.ndarray
    cuts: np.ndarray
    term: np.ndarray
    value: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(np.r_[self.cuts, len(self.term)])

    def embedded(self, basis: np.ndarray) -> np.ndarray:
        return np.add.reduceat(basis[self.term] * self.value[:, None], self.cuts, axis=0)

    def spread_to(self, total: np.ndarray, of_docs: np.ndarray) -> None:
        """total[term] += value x the row of ``of_docs`` of the cell's document."""
        _add_rows(total, self.term, np.repeat(of_docs, self.count, axis=0) * self.value[:, None])


def _rows(b: _Batch, weight: np.ndarray) -> Iterator[_Rows]:
    """Documents without a term that weighs are left out."""
    used = weight[b.ids] > 0
    kept, owner = b.ids[used], b.sent_doc[b.sent[used]]
    first = np.searchsorted(owner, np.arange(len(b.ident) + 1))
    lo = 0
    while lo < len(b.ident):
        hi = min(len(b.ident), max(lo + 1, int(np.searchsorted(first, first[lo] + CHUNK, "right")) - 1))
        cell, count = np.unique(owner[first[lo] : first[hi]] * len(weight) + kept[first[lo] : first[hi]], return_counts=True)
        if len(cell):
            doc, term = cell // len(weight), cell % len(weight)
            value = np.log1p(count) * weight[term]
            cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            norm = np.sqrt(np.add.reduceat(value * value, cuts))
            yield _Rows(doc[cuts], cuts, term, (value / np.repeat(norm, np.diff(np.r_[cuts, len(doc)]))).astype(np.float32))
        lo = hi


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def components(directions: np.ndarray, image: np.ndarray, k: int) -> np.ndarray:
    """The leading ``k`` right singular vectors of A from ``image`` = A'A x ``directions`` (orthonormal): Nystrom approximation of A'A."""
    shift = 1e-6 * np.linalg.norm(image)
    if not shift:
        return np.zeros((len(image), k))
    image = image + shift * directions
    core = directions.T @ image
    value, turn = np.linalg.eigh((core + core.T) / 2)
    keep = value > 1e-9 * value.max()
    return np.linalg.svd(image @ (turn[:, keep] / np.sqrt(value[keep])), full_matrices=False)[0][:, :k]


def _directions(terms: int, n: int, seeds: np.ndarray) -> np.ndarray:
    """Orthonormal directions: those of the seeds, and random ones."""
    given = seeds[np.linalg.norm(seeds, axis=1) > 0][: n // 2].T
    return np.linalg.qr(np.c_[given, np.random.default_rng(7).standard_normal((terms, n))][:, : min(n, terms)])[0]


def term_weights(count: np.ndarray, prior: float, floor: float) -> np.ndarray:
    """Divergence of each term's distribution over subjects from that of all terms, shrunk by ``prior`` pseudo-counts.

    1 is the highest; weights under ``floor`` are 0, as such terms stand beside any subject.
    """
    p = (count.sum(0) + 1e-9) / (count.sum() + 1e-9 * count.shape[1])
    q = (count + prior * p) / (count.sum(1, keepdims=True) + prior)
    kl = (q * np.log(np.maximum(q, 1e-12) / p)).sum(1)
    w = np.maximum(kl, 0) / max(float(kl.max(initial=0)), 1e-9)
    return np.where(w < floor, 0.0, w)


@dataclass
class _Model:
    weight: np.ndarray
    basis: np.ndarray
    centre: np.ndarray  # unit centroids, in order of their subjects
    subject: np.ndarray  # subject of each centroid

    def cosines(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of rows ``x``: cosine to each centroid, the best to each subject (those of :meth:`listed`), the best of all, and the lead over the next subject."""
        c = _unit(x) @ self.centre.T
        per = np.maximum.reduceat(c, np.flatnonzero(np.r_[True, self.subject[1:] != self.subject[:-1]]), axis=1)
        top = per.max(1)
        second = np.partition(per, -2, axis=1)[:, -2] if per.shape[1] > 1 else np.full(len(per), -1.0)
        return c, per, top, top - second

    @property
    def listed(self) -> np.ndarray:
        return np.unique(self.subject)

    def clear(self, x: np.ndarray, cosine: float, margin: float) -> np.ndarray:
        """Centroid of each row that lies clearly nearest to one subject, -1 otherwise."""
        c, _, top, lead = self.cosines(x)
        return np.where((top >= cosine) & (lead >= margin), c.argmax(1), -1)


def subjects(docs: DataFrame, doc_id: str, text: str, kind: Column, labels: DataFrame, label_id: str, label: str, names: list[str], cfg: Settings = Settings()) -> DataFrame:
    """doc_id, subject of every document and each subject it treats; a document may have none.

    ``kind``: a variety of texts (such as the language) that has centroids of its own; null where unknown. ``labels`` may be wrong or repeated;
    labels not among ``names`` are left out. A subject without a labelled document in a kind has no centroid there. Null or empty texts and rows with
    a null id give no rows; without any usable label the result is empty. Repeated ids are documents of their own, their rows come out once.
    """
    src = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.nullif(kind.cast("string"), F.lit("")).alias("kind"), F.col(text).cast("string").alias("t"))
    empty = src.select(F.col("id").alias("doc_id"), F.lit("").alias("subject")).limit(0)
    names = sorted(set(names))
    index = {s: i for i, s in enumerate(names)}
    given = labels.join(F.broadcast(labels.sparkSession.createDataFrame([(x,) for x in names], "__name string")), F.col(label) == F.col("__name")) if names else labels.limit(0)
    given = given.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("bigint").alias("id")).agg(F.collect_set(label).alias("s"))
    known = {r["id"]: [index[s] for s in r["s"]] for r in given.orderBy(F.xxhash64("id"), "id").limit(cfg.labelled).collect()}
    if not known:
        return empty
    terms = written(spread(src).mapInArrow(_hashed(cfg.buckets), _TERMS), "terms")
    ids = terms.where("id IS NOT NULL")

    # the kinds, and of each term the largest share of a kind's documents that hold it
    per_kind = ids.groupBy("kind").count()
    often = {r["kind"]: r["count"] for r in per_kind.where("kind IS NOT NULL").orderBy(F.desc("count"), "kind").limit(cfg.kinds).collect()}
    kinds = sorted(often) or [None]
    place = {k: i for i, k in enumerate(kinds)}
    total = sum(often.values())
    scale = {k: (v / total) ** -0.5 for k, v in often.items()}
    df = terms.where("id IS NULL").select("kind", F.inline(F.arrays_zip("ids", "lens"))).groupBy("kind", "ids").agg(F.sum("lens").alias("df"))
    share = F.when(F.col("kind").isin(kinds) if often else F.lit(True), F.col("df") / F.col("count"))
    counted = df.join(per_kind.select(F.col("kind").alias("k"), "count"), F.col("kind").eqNullSafe(F.col("k"))).groupBy("ids").agg(F.sum("df").alias("df"), F.max(share).alias("share"))
    # a term of one document alone says nothing about which documents belong together; at most one row a bucket
    found = sorted(counted.where("df > 1").collect(), key=lambda r: r["ids"])
    if not found:
        return empty
    idf = -np.log(np.array([r["share"] if r["share"] else 1.0 for r in found]))
    idf = idf if idf.max() > 0 else np.ones(len(idf))
    many = len(names)
    weighs = idf >= -np.log(min(0.5, cfg.common / many))
    weighs = weighs if weighs.any() else idf > 0  # few documents: every term is common
    weight = (idf[weighs] / idf.max()).astype(np.float32)
    size = len(weight)
    slot = np.full(cfg.buckets, -1, np.int32)
    slot[np.array([r["ids"] for r in found])[weighs]] = np.arange(size)
    active = written(ids.mapInArrow(_active(slot), _TERMS), "active")
    groups = [(s, k) for s in range(many) for k in range(len(kinds))]

    def decomposed(weight: np.ndarray, member: Callable[[_Batch], tuple[np.ndarray, np.ndarray, np.ndarray]], start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Basis of the weighted documents, and sums of the rows of each group's documents, in one pass."""
        way = _directions(size, cfg.components + cfg.extra, start)
        small = way.astype(np.float32)

        def add(b: _Batch, image: np.ndarray, sums: np.ndarray) -> None:
            by_kind = np.array([scale.get(k, 1.0) for k in b.kind], np.float32) ** 2
            d, g, v = member(b)
            for r in _rows(b, weight):
                r.spread_to(image, r.embedded(small) * by_kind[r.docs][:, None])
                at = np.searchsorted(r.docs, d)
                ok = (at < len(r.docs)) & (r.docs[np.minimum(at, len(r.docs) - 1)] == d)
                for row, group, part in zip(at[ok].tolist(), g[ok].tolist(), v[ok].tolist(), strict=True):
                    cells = slice(r.cuts[row], r.cuts[row] + r.count[row])
                    sums[r.term[cells], group] += part * r.value[cells]

        image, sums = _summed(active, add, (size, way.shape[1]), (size, n))
        return components(way, image, cfg.components), sums.T

    def labelled(b: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [(d, s * len(kinds) + place[k], 1 / len(known[i])) for d, (i, k) in enumerate(zip(b.ident.tolist(), b.kind, strict=True)) if i in known and k in place for s in known[i]]
        return tuple(np.array([x[j] for x in got], t) for j, t in enumerate((np.int64, np.int64, float)))

    basis, sums = decomposed(weight, labelled, np.zeros((0, size)), len(groups))
    seeds = sums @ basis
    there = np.flatnonzero(np.linalg.norm(seeds, axis=1) > 0)
    if not len(there):
        return empty
    model = _Model(weight, basis.astype(np.float32), _unit(seeds[there]).astype(np.float32), there // len(kinds))

    def refine(m: _Model):
        def add(b: _Batch, sums: np.ndarray, count: np.ndarray) -> None:
            for r in _rows(b, m.weight):
                e = r.embedded(m.basis)
                who = m.clear(e, cfg.cosine, cfg.margin)
                _add_rows(sums, who[who >= 0], _unit(e)[who >= 0])
                doc = np.full(len(b.ident), many)
                doc[r.docs] = np.where(who >= 0, m.subject[who], many)
                part = slice(*np.searchsorted(b.sent_doc[b.sent], [r.docs[0], r.docs[-1] + 1]))
                cell = np.unique(b.sent_doc[b.sent[part]] * size + b.ids[part])
                of = doc[cell // size]
                count += np.bincount((cell % size * (many + 1) + of), minlength=count.size).reshape(count.shape)

        return add

    for _ in range(cfg.rounds):
        fresh, count = _summed(active, refine(model), model.centre.shape, (size, many + 1))
        moved = np.linalg.norm(fresh, axis=1, keepdims=True) > 0
        model.centre = np.where(moved, _unit(fresh), model.centre).astype(np.float32)

    weight = term_weights(count[:, :many], cfg.prior, cfg.floor).astype(np.float32)

    def assigned(b: _Batch, m=model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [(r.docs, m.clear(r.embedded(m.basis), cfg.cosine, cfg.margin)) for r in _rows(b, m.weight)]
        d, g = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
        return d[g >= 0], g[g >= 0], np.ones(int((g >= 0).sum()))

    basis, sums = decomposed(weight, assigned, sums[there] * (weight > 0), len(there))
    seeds = sums @ basis
    kept = np.linalg.norm(seeds, axis=1) > 0
    if not kept.any():
        return empty
    last = _Model(weight, basis.astype(np.float32), _unit(seeds[kept]).astype(np.float32), model.subject[kept])

    def treated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = last.weight[:, None] ** 2 * last.basis
        for b in _batches(batches):
            near = np.zeros((len(b.ident), many), bool)
            for r in _rows(b, last.weight):
                near[np.ix_(r.docs, last.listed)] = last.cosines(r.embedded(last.basis))[1] >= cfg.near
            per = np.zeros((len(b.ident), many), np.int64)
            used = np.flatnonzero((last.weight[b.ids] > 0) & near.any(1)[b.sent_doc[b.sent]])
            first = used[np.r_[True, b.sent[used][1:] != b.sent[used][:-1]]] if len(used) else used
            ends = np.r_[np.searchsorted(used, first), len(used)]
            for k in range(0, len(first), CHUNK):
                part = used[ends[k] : ends[min(k + CHUNK, len(first))]]
                cuts = ends[k : min(k + CHUNK, len(first))] - ends[k]
                who = last.clear(np.add.reduceat(vectors[b.ids[part]], cuts, axis=0), cfg.s_cosine, cfg.s_margin)
                ok = (who >= 0) & (np.maximum.reduceat(last.weight[b.ids[part]], cuts) >= cfg.s_mass)
                np.add.at(per, (b.sent_doc[b.sent[first[k : k + CHUNK]]][ok], last.subject[who[ok]]), 1)
            d, s = np.nonzero(near & (per >= cfg.least))
            yield pa.record_batch([pa.array(b.ident[d]), pa.array([names[x] for x in s.tolist()], pa.string())], ["doc_id", "subject"])

    return active.mapInArrow(treated, "doc_id bigint, subject string").distinct()

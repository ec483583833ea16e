"""BAM over BGZF as a Python data source: ranges of blocks are the partitions, and only the columns of the schema asked for are decoded.

``register(spark)`` then ``spark.read.format("spanloom-bam").load(path)``; ``.schema("qname string, flag int")`` names the columns to decode and
``.option("splitBytes", n)`` the compressed bytes of a partition. Paths are local ones or URIs that pyarrow opens, folders or single files.

A range begins with the first block at or after its first byte, and with the first record that begins in it. Where that is isn't stated in the file, so
it is found by the form of records, a chain of which must follow each other; the range before it ends at a known place, and a difference raises an error.
A record's virtual offset is that of its block in the file, shifted by 16 bits, plus its place within the inflated block.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags array<struct<tag:string,type:string,value:string>>, voffset bigint"
# Letters of packed bases and of alignment operations, formats of optional fields, and the empty block that ends a file.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAGS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00
SPLIT = 64 << 20
#: Records that must follow each other where a range begins.
CHAIN = 12
#: Bytes looked at for them at most.
LOOK = 1 << 24
#: Inflated bytes, or bases to write, that are worked on at once, if records aren't longer.
RUN = 1 << 20
_CODES = np.full(256, 255, np.uint8)
_CODES[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(16)
_WRITTEN = pa.schema([(n, pa.int64() if n in ("flag", "pos", "mapq", "pnext", "tlen") else pa.large_string()) for n in "qname flag rname pos mapq cigar rnext pnext tlen seq qual".split()])
_PAIRS = np.array([[ord(BASES[x >> 4]), ord(BASES[x & 15])] for x in range(256)], np.uint8)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _size_at(f, at: int) -> tuple[int, int] | None:
    """Length of the header and of the whole block that begins at ``at``; None at the end or where no block begins."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    n = struct.unpack("<H", head[10:])[0]
    extra, k = f.read(n), 0
    while k + 4 <= len(extra):
        size = struct.unpack_from("<H", extra, k + 2)[0]
        if extra[k : k + 2] == b"BC" and size == 2:
            return 12 + n, struct.unpack_from("<H", extra, k + 4)[0] + 1
        k += 4 + size
    return None


def block_at(f, at: int) -> tuple[bytes, int]:
    """The inflated block that begins at ``at`` and its length in the file; a damaged or cut block raises."""
    got = _size_at(f, at)
    if got is None:
        raise ValueError(f"no BGZF block at {at}")
    f.seek(at + got[0])
    data = f.read(got[1] - got[0])
    if len(data) != got[1] - got[0]:
        raise ValueError("the file ends inside a block")
    out = zlib.decompress(data[:-8], -15)
    if (zlib.crc32(out), len(out)) != struct.unpack("<II", data[-8:]):
        raise ValueError("a block's checksum is wrong")
    return out, got[1]


def first_block(f, at: int, end: int) -> int:
    """Start of the first block at or after ``at``: a block header that another one, or the end of the file, follows."""
    while at < end:
        f.seek(at)
        data = f.read(min(end - at, 2 * 65_536 + 64))
        k = data.find(b"\x1f\x8b\x08\x04")
        while k >= 0:
            size = _size_at(f, at + k)
            if size is not None and (at + k + size[1] == end or _size_at(f, at + k + size[1]) is not None):
                return at + k
            k = data.find(b"\x1f\x8b\x08\x04", k + 1)
        at += max(1, len(data) - 3)
    return end


class Reader:
    """Bytes of a BGZF file from a virtual offset on."""

    def __init__(self, f, end: int, block: int = 0, inner: int = 0):
        self.f, self.end, self.starts, self.held, self.at = f, end, [], b"", 0
        self.next = block
        if inner:
            self._more()
            self.at = inner

    def _more(self) -> bool:
        if self.next >= self.end:
            return False
        out, size = block_at(self.f, self.next)
        keep = self.starts and [(b, o - self.at) for b, o in self.starts if o + 65_536 > self.at] or []
        self.held = self.held[self.at :] + out
        self.starts = [*keep, (self.next, len(self.held) - len(out))]
        self.at, self.next = 0, self.next + size
        return True

    def voffset(self) -> int | None:
        """Where the next byte stands; None at the end."""
        while self.at >= len(self.held):
            if not self._more():
                return None
        block, o = next((b, o) for b, o in reversed(self.starts) if o <= self.at)
        return block << 16 | self.at - o

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more():
            pass
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> bytes | None:
        """``n`` bytes, or None at the end."""
        out = self.peek(n)
        if not out and n:
            return None
        if len(out) < n:
            raise ValueError("the file ends inside a record")
        self.at += n
        return out


def header(b: Reader) -> tuple[str, list[tuple[str, int]]]:
    """The header's text, and names and lengths of the references; the reader then stands at the first record."""
    if b.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = b.take(struct.unpack("<i", b.take(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", b.take(4))[0]):
        name = b.take(struct.unpack("<i", b.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", b.take(4))[0]))
    return (text or b"").rstrip(b"\0").decode(), refs


def _plausible(data: bytes, at: int, refs: list[tuple[str, int]]) -> int | None:
    """Length of what looks like a record at ``at``, -1 if the data end before that is known, None if it isn't one."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, nref, npos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fits = lambda r, p: -1 <= r < len(refs) and p >= -1
    if not (l_name >= 1 and l_seq >= 0 and fits(ref, pos) and fits(nref, npos) and 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size):
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar]
    if any(c & 15 > 8 for c in ops[::4]):
        return None
    return size + 4


def first_record(f, end: int, start: int, refs: list[tuple[str, int]]) -> int | None:
    """Virtual offset of the first record that begins in the block at ``start`` or a later one; None if there is none."""
    b, want = Reader(f, end, start), LOOK >> 6
    while b.voffset() is not None:
        data = b.peek(want)
        for at in range(min(len(data), 65_536)):
            to, n = at, 0
            while n < CHAIN and to < len(data):
                size = _plausible(data, to, refs)
                if size is None or size < 0:
                    break
                to, n = to + size, n + 1
            else:
                size = -1
            # the chain is long enough, or all that is left follows it, or it is of very long records
            if n >= CHAIN or to == len(data) and n and len(data) < want or size == -1 and n > 1 and want == LOOK:
                b.take(at)
                return b.voffset()
            if size == -1 and to > at and len(data) == want and want < LOOK:
                want *= 4  # long records: look further
                break
        else:
            if len(data) < want:
                return None
            b.take(65_536)
    return None


def _tags(r: bytes, at: int) -> list[dict]:
    out = []
    while at < len(r):
        tag, kind = r[at : at + 2].decode(), chr(r[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(r[at]), at + 1
        elif kind in "ZH":
            end = r.index(b"\0", at)
            value, at = r[at:end].decode("latin-1"), end + 1
        elif kind == "B":
            inner, n = chr(r[at]), struct.unpack_from("<i", r, at + 1)[0]
            xs = struct.unpack_from(f"<{n}{TAGS[inner]}", r, at + 5)
            value, at = ",".join([inner, *map(_number, xs)]), at + 5 + n * struct.calcsize(TAGS[inner])
        else:
            value, kind, at = _number(struct.unpack_from("<" + TAGS[kind], r, at)[0]), "f" if kind == "f" else "i", at + struct.calcsize(TAGS[kind])
        out.append({"tag": tag, "type": kind, "value": value})
    return out


def _number(x: float) -> str:
    return f"{x:.9g}" if isinstance(x, float) else str(x)


# Fixed fields of a record: its length, ref, pos, length of the name, mapq, bin, operations, flag, length of the sequence, next ref, next pos, template length
_FIXED = np.dtype([(n, "<" + k) for n, k in zip("size ref pos l_name mapq bin ops flag l_seq nref npos tlen".split(), "i4 i4 i4 u1 u1 u2 u2 u2 i4 i4 i4 i4".split(), strict=True)])


def _places(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each run in turn."""
    to = np.cumsum(lens)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - lens), lens)


def _texts(data: np.ndarray, lens: np.ndarray, missing: np.ndarray | None = None, kind: pa.DataType | None = None) -> pa.Array:
    """Strings of ``lens`` bytes each, which stand in ``data`` one after the other; UTF-8 is checked."""
    offsets = np.concatenate([[0], np.cumsum(lens)])
    out = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    out = out.cast(kind or pa.string())
    return out if missing is None or not missing.any() else pc.if_else(pa.array(missing), pa.scalar(None, out.type), out)


def _decoded(names: list[str], refs: list[tuple[str, int]], held: bytes, at: np.ndarray, voffsets: np.ndarray) -> pa.RecordBatch:
    """The named columns of the whole records at ``at``."""
    data = np.frombuffer(held, np.uint8)
    if len(at) and int(at[-1]) + _FIXED.itemsize > len(data):
        raise ValueError("a record is too short")
    x = data[at[:, None] + np.arange(_FIXED.itemsize)].view(_FIXED)[:, 0]
    size, l_name, n_ops, l_seq = (x[n].astype(np.int64) for n in ("size", "l_name", "ops", "l_seq"))
    l_packed = (l_seq + 1) // 2
    if ((l_name < 1) | (l_seq < 0) | (32 + l_name + 4 * n_ops + l_packed + l_seq > size)).any():
        raise ValueError("a record's fields are longer than it")
    ops_at = at + 36 + l_name
    seq_at = ops_at + 4 * n_ops
    qual_at = seq_at + l_packed
    known = pa.array([n for n, _ in refs], pa.string())
    ints = lambda v, missing=None: pa.array(v.astype(np.int32), mask=missing)
    ref = lambda i: known.take(pa.array(i, mask=i < 0))

    def qname() -> pa.Array:
        return _texts(data[_places(at + 36, l_name - 1)], l_name - 1, (l_name == 2) & (data[at + 36] == ord("*")))

    def cigar() -> pa.Array:
        d = _texts(data[_places(ops_at, 4 * n_ops)], 4 * n_ops, kind=pa.binary()).dictionary_encode()
        said = ["".join(f"{o >> 4}{OPS[o & 15]}" for o in struct.unpack(f"<{len(v) // 4}I", v)) or "*" for v in d.dictionary.to_pylist()]
        return pa.array(said, pa.string()).take(d.indices)

    def seq() -> pa.Array:
        letters = _PAIRS[data[_places(seq_at, l_packed)]].reshape(-1)
        return _texts(letters[_places(2 * (np.cumsum(l_packed) - l_packed), l_seq)], l_seq, l_seq == 0)

    def qual() -> pa.Array:
        first = np.full(len(at), 255, np.uint8)
        first[l_seq > 0] = data[qual_at[l_seq > 0]]
        # a missing one is empty here, as its bytes are no text
        lens = np.where(first == 255, 0, l_seq)
        letters = data[_places(qual_at, lens)] + np.uint8(33)
        if (letters >= 128).any():
            return pa.array([None if f == 255 else v.decode("latin-1") for f, v in zip(first, _texts(letters, lens, kind=pa.binary()).to_pylist(), strict=True)], pa.string())
        return _texts(letters, lens, first == 255)

    of = {
        "qname": qname, "flag": lambda: ints(x["flag"]), "rname": lambda: ref(x["ref"]), "pos": lambda: ints(x["pos"] + 1, x["pos"] < 0), "mapq": lambda: ints(x["mapq"], x["mapq"] == 255), "cigar": cigar,
        "rnext": lambda: ref(x["nref"]), "pnext": lambda: ints(x["npos"] + 1, x["npos"] < 0), "tlen": lambda: ints(x["tlen"], x["tlen"] == 0), "seq": seq, "qual": qual,
        "tags": lambda: pa.array([_tags(held[a:b], 0) for a, b in zip((qual_at + l_seq).tolist(), (at + 4 + size).tolist(), strict=True)], _TAGS), "voffset": lambda: pa.array(voffsets, pa.int64()),
    }
    return pa.record_batch([of[n]() for n in names], names)


_TAGS = pa.list_(pa.struct([("tag", pa.string()), ("type", pa.string()), ("value", pa.string())]))


def _runs(b: Reader, hi: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Bytes, places in them and virtual offsets of the records that begin in blocks which begin before ``hi``, some at a time."""
    length = struct.Struct("<i").unpack_from
    while (v := b.voffset()) is not None and v >> 16 < hi:
        while len(b.held) - b.at < RUN and b.next < hi and b._more():
            pass
        if len(b.peek(4)) == 4:
            b.peek(4 + struct.unpack("<i", b.peek(4))[0])  # one at least is whole
        blocks, first = (np.array(c, np.int64) for c in zip(*b.starts, strict=True))
        limit, end, at, found = int(min(first[blocks >= hi], default=len(b.held))), len(b.held), b.at, []
        while at < limit and at + 4 <= end:
            size = length(b.held, at)[0]
            if size < 32:
                raise ValueError("a record's length is wrong")
            if at + 4 + size > end:
                break
            found.append(at)
            at += 4 + size
        if not found:
            raise ValueError("the file ends inside a record")
        places = np.array(found, np.int64)
        k = np.searchsorted(first, places, "right") - 1
        yield b.held, places, blocks[k] << 16 | places - first[k]
        b.at = at


def records(root: str, path: str, names: list[str], lo: int = 0, hi: int | None = None) -> Iterator[pa.RecordBatch]:
    """The named columns of the records that begin in blocks which begin in [lo, hi) of the file ``path`` on the file system of ``root``."""
    with filesystem(root)[0].open_input_file(path) as f:
        end = f.size()
        hi = end if hi is None else min(hi, end)
        b = Reader(f, end)
        _, refs = header(b)
        if lo > 0:
            start = first_block(f, lo, end)
            at = first_record(f, end, start, refs) if start < hi else None
            # no later than the records themselves begin
            if at is None or at >> 16 >= hi:
                return
            if at >= (b.voffset() or 0):
                b = Reader(f, end, at >> 16, at & 0xFFFF)
        for run in _runs(b, hi):
            yield _decoded(names, refs, *run)
        v = b.voffset()
        if v is not None and hi < end:
            start = first_block(f, hi, end)
            if start < end and v >> 16 >= start and first_record(f, end, start, refs) != v:
                raise ValueError(f"the records after byte {hi} can't be told apart; read the file with larger splits")


@dataclass
class _Range(InputPartition):
    path: str
    lo: int
    hi: int


def read_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Text and references of one file."""
    fs, bare = filesystem(path)
    with fs.open_input_file(bare) as f:
        return header(Reader(f, f.size()))


def read_at(path: str, voffset: int, names: list[str]) -> tuple:
    """The named columns of the record at a virtual offset."""
    fs, bare = filesystem(path)
    with fs.open_input_file(bare) as f:
        refs = header(Reader(f, f.size()))[1]
        b = Reader(f, f.size(), voffset >> 16, voffset & 0xFFFF)
        size = b.take(4)
        one = _decoded(names, refs, size + b.take(struct.unpack("<i", size)[0]), np.zeros(1, np.int64), np.array([voffset]))
        return tuple(c[0].as_py() for c in one.columns)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int):
        self.path, self.names, self.split = path, schema.names, split

    def partitions(self) -> list[InputPartition]:
        fs, bare = filesystem(self.path)
        info = fs.get_file_info(bare)
        files = [info] if info.is_file else sorted((x for x in fs.get_file_info(pafs.FileSelector(bare, recursive=True)) if x.path.endswith(".bam")), key=lambda x: x.path)
        return [_Range(x.path, k, k + self.split) for x in files for k in range(0, x.size, self.split)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from records(self.path, partition.path, self.names, partition.lo, partition.hi)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spanloom-bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def _block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4sIBBHBBHH", b"\x1f\x8b\x08\x04", 0, 0, 0xFF, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzip(data: bytes) -> bytes:
    return b"".join(_block(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK)) + EOF


def _bins(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    from spanloom.functions.sequence import BIN_LEVELS

    out = np.zeros(len(first), np.int64)
    for shift, base in reversed(BIN_LEVELS):
        out = np.where(first >> shift == last >> shift, base + (first >> shift), out)
    return out


def _within(name: str, v: np.ndarray, most: int, least: int = 0) -> np.ndarray:
    if len(v) and not (least <= v.min() and v.max() <= most):
        raise ValueError(f"{name} must lie in {least} to {most}")
    return v


def _ints(col: pa.Array, absent: int) -> np.ndarray:
    return pc.fill_null(col.cast(pa.int64()), absent).to_numpy(zero_copy_only=False)


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and how many each has."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    whole = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return (whole[offsets[0] : offsets[-1]], np.diff(offsets)) if len(col) else (whole[:0], np.zeros(0, np.int64))


def _operations(text: str | None) -> bytes:
    if text in (None, "*"):
        return b""
    return b"".join(struct.pack("<I", int(n) << 4 | OPS.index(o)) for n, o in re.findall(r"(\d+)(.)", text))


def _encoded(b: pa.RecordBatch, references: list[tuple[str, int]]) -> bytes:
    """The records of a batch with the columns of ``_WRITTEN``."""
    c = {n: b.column(n) for n in b.schema.names}
    # the last of several references of one name counts
    names, last = pa.array([n for n, _ in references], pa.large_string()), {n: i for i, (n, _) in enumerate(references)}
    ident = np.array([*(last[n] for n, _ in references), -1], np.int64)
    ref = lambda n: ident[_ints(pc.index_in(c[n], value_set=names), len(references))]
    name, l_name = _bytes(pc.fill_null(pc.if_else(pc.equal(c["qname"], ""), "*", c["qname"]), "*"))
    seq, l_seq = _bytes(c["seq"])
    if c["flag"].null_count:
        raise ValueError("a flag is missing")
    code = _CODES[seq]
    if (code > 15).any():
        raise ValueError(f"a base is none of {BASES}")
    l_packed = (l_seq + 1) // 2
    pairs = np.zeros(2 * int(l_packed.sum()), np.uint8)
    pairs[_places(2 * (np.cumsum(l_packed) - l_packed), l_seq)] = code
    packed = pairs[::2] << 4 | pairs[1::2]
    qual, l_qual = _bytes(c["qual"])
    if (qual >= 128).any():
        qual, l_qual = _bytes(pa.array([None if q is None else q.encode("latin-1") for q in c["qual"].to_pylist()], pa.binary()))
    if ((l_qual > 0) & (l_qual != l_seq)).any() or (qual < 33).any():
        raise ValueError("qualities must be as many as bases, from !")
    scores = np.full(int(l_seq.sum()), 255, np.uint8)
    scores[np.repeat(l_qual > 0, l_seq)] = qual - np.uint8(33)
    d = c["cigar"].dictionary_encode(null_encoding="encode")
    ops, l_ops = _bytes(pa.array([_operations(t) for t in d.dictionary.to_pylist()], pa.binary()).take(d.indices))
    pos = _ints(c["pos"], 0) - 1
    x = np.zeros(b.num_rows, _FIXED)
    at = np.maximum(pos, 0)
    int32 = (2**31 - 1, -(2**31))
    size = 32 + l_name + 1 + l_ops + l_packed + l_seq
    for n, v, most in (
        ("size", size, int32), ("ref", ref("rname"), int32), ("pos", pos, int32), ("l_name", l_name + 1, (255,)), ("mapq", _ints(c["mapq"], 255), (255,)), ("bin", _bins(at, at + l_seq), (65_535,)), ("ops", l_ops // 4, (65_535,)), ("flag", _ints(c["flag"], 0), (65_535,)),
        ("l_seq", l_seq, int32), ("nref", ref("rnext"), int32), ("npos", _ints(c["pnext"], 0) - 1, int32), ("tlen", _ints(c["tlen"], 0), int32),
    ):
        x[n] = _within(n, v, *most)
    out = np.zeros(int((size + 4).sum()), np.uint8)
    to = np.cumsum(size + 4) - size - 4
    out[to[:, None] + np.arange(_FIXED.itemsize)] = x.view(np.uint8).reshape(len(x), _FIXED.itemsize)
    to += _FIXED.itemsize
    for part, lens, gap in ((name, l_name, 1), (ops, l_ops, 0), (packed, l_packed, 0), (scores, l_seq, 0)):
        out[_places(to, lens)] = part
        to += lens + gap
    return out.tobytes()


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``RUN`` bases each, or of one record."""
    total, at = np.cumsum(_ints(pc.binary_length(b.column("seq")), 0)), 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + RUN, "right")))
        yield b.slice(at, to - at)
        at = to


def _write(path: str, references: list[tuple[str, int]], batches: Iterable[pa.RecordBatch]) -> int:
    """Blocks go out as they are filled; the file has its name when it is whole. Returns the number of records."""
    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references).encode()
    head = [b"BAM\x01", struct.pack("<i", len(text)), text, struct.pack("<i", len(references))]
    for n, size in references:
        head.append(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size))
    rest, rows = b"".join(head), 0
    fs, bare = filesystem(path)
    part = f"{bare}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(part, compression=None) as f:
            for b in batches:
                b = pa.RecordBatch.from_arrays([b.column(x.name).cast(x.type) if x.name in b.schema.names else pa.nulls(b.num_rows, x.type) for x in _WRITTEN], schema=_WRITTEN)
                rows += b.num_rows
                for piece in _pieces(b):
                    rest += _encoded(piece, references)
                    whole = len(rest) // BLOCK * BLOCK
                    for i in range(0, whole, BLOCK):
                        f.write(_block(rest[i : i + BLOCK]))
                    rest = rest[whole:]
            f.write(bgzip(rest))
        fs.move(part, bare)
    except BaseException:
        if fs.get_file_info(part).type != pafs.FileType.NotFound:
            fs.delete_file(part)
        raise
    return rows


def write_bam(path: str, references: list[tuple[str, int]], rows: list[dict]) -> None:
    """A BAM file of a few records (columns of ``SCHEMA``)."""
    _write(path, references, [pa.RecordBatch.from_pylist(rows, _WRITTEN)])


def write_bams(df: DataFrame, folder: str, references: list[tuple[str, int]]) -> int:
    """One BAM file a partition of ``df`` (columns of ``SCHEMA`` but tags and voffset), as the sink of a job. Returns the number of records."""
    fs, bare = filesystem(folder)
    fs.create_dir(bare, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        # a task that is run again writes the same file
        rows = 0 if first is None else _write(f"{folder}/part-{TaskContext.get().partitionId():05d}.bam", references, itertools.chain([first], batches))
        yield pa.record_batch([pa.array([rows], pa.int64())], ["n"])

    return sum(r["n"] for r in df.mapInArrow(write, "n bigint").collect())

"""Repeated substrings by a distributed difference-cover algorithm.

Suffixes are sampled at the positions whose residue modulo PERIOD lies in a difference cover, so any two equal windows
have a sampled position at the same place.  As in difference-cover suffix sorting:

1. the samples are named by their first NAME bytes, the names are sorted in ranges over the cluster and adjacent
   ones compared; a window without a name that occurs twice cannot repeat and its suffixes are discarded (a few
   hundredths of the corpus by name, most of its bytes);
2. in what is left the algorithm recurses on longer names, of a window and PERIOD - 1 bytes more, at the samples of each
   region: one that repeats settles all windows in it, which are the insides of all long repeats;
3. the remaining suffixes, near the ends of repeats, are merged in by the names of their windows, and adjacent
   prefixes of window length compared.

Names are 64-bit fingerprints rather than lexicographic ranks: the sorted order is one of fingerprints, in which
equal prefixes are adjacent just the same, and which is all that finding repeats needs.  Among 10**9 distinct
windows an error is expected with a chance of 3 %.

Texts are UTF-8 bytes (null: empty); matches never cross documents; every copy of a repeat is removed, overlaps too, as
judged on the input.  Rows that repeat are each other's copies.  Null doc_ids stay null; an empty table gives an
empty result; other columns are not carried.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import REPLY, SENT, TABLE, Rolling, U, chunk_count, read_bits, reply_bits, sent, text_buffer, tidy
from .relative_lz import covered

#: A perfect difference set modulo 133: every difference occurs among these.
COVER, PERIOD = np.array([1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121]), 133
LEFT = "chunk int, owner binary, start binary, size binary, data binary"
MARKS = "chunk int, owner binary, start binary, stop binary"


def ordered(table: pa.Table) -> pa.Table:
    """A chunk's documents in an order that is the same in every pass."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def samples(offsets: np.ndarray, length: int) -> np.ndarray:
    """Sampled positions of each run between offsets from which `length` bytes of the run follow."""
    sizes = np.diff(offsets)
    blocks = -(-sizes // PERIOD)
    run = np.repeat(np.arange(len(sizes)), blocks)
    at = (np.arange(len(run)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * PERIOD + offsets[run]
    out = (at[:, None] + COVER).ravel()
    return out[out + length <= np.repeat(offsets[run + 1], len(COVER))]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true flags."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Names:
    """Sorted distinct names of spans, and which span has which."""

    def __init__(self, rolling: Rolling, at: np.ndarray, length: int, bits: int = 64):
        """bits: of each fingerprint that are compared; fewer will do where a chance repeat is harmless."""
        self.at = at
        self.keys, head, self.of, n = np.unique(rolling.of(at, at + length) >> U(64 - bits) << U(64 - bits), return_index=True, return_inverse=True, return_counts=True)
        self.many = n > 1
        self.again = np.ones(len(at), bool)  # a span before it in this chunk has its name
        self.again[head] = False

    def repeated(self, replies: pa.Table, phase: int, parts: int) -> np.ndarray:
        """The spans whose name occurs twice in the corpus."""
        return self.at[(read_bits(replies, phase, self.keys, parts) | self.many)[self.of]]

    def later(self, replies: pa.Table, phase: int, parts: int) -> np.ndarray:
        """The spans whose name occurs before them, in order of chunk and place."""
        return self.at[read_bits(replies, phase, self.keys, parts)[self.of] | self.again]


def fits(offsets: np.ndarray, window: int) -> np.ndarray:
    """Whether a window that starts there ends in the same run."""
    out = np.zeros(offsets[-1], bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out[a : max(a, b - window + 1)] = True
    return out


class Regions:
    """What is left of a chunk: regions in which windows may repeat."""

    def __init__(self, row: pa.Table, window: int):
        get = lambda c, t: np.frombuffer(row[c][0].as_py(), t)
        self.chunk = row["chunk"][0].as_py()
        self.owner, self.start, sizes = get("owner", "<i4"), get("start", "<i8"), get("size", "<i8")
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.window = window
        self.buf = np.frombuffer(zstandard.decompress(row["data"][0].as_py(), max_output_size=int(self.offsets[-1]) + 1), np.uint8)
        self.rolling = Rolling(TABLE[self.buf])
        self.long = Names(self.rolling, samples(self.offsets, window + PERIOD - 1), window + PERIOD - 1)

    def rest(self, replies: pa.Table, parts: int) -> None:
        """settled: windows in long names that repeat; others: the names of windows that no earlier copy of a long name holds too, so that each name is sent by its first place at least."""
        self.settled = covered(len(self.buf), self.long.repeated(replies, 1, parts), PERIOD)
        copied = covered(len(self.buf), self.long.later(replies, 2, parts), PERIOD)
        self.others = Names(self.rolling, np.flatnonzero(fits(self.offsets, self.window) & ~copied), self.window)

    def marks(self, replies: pa.Table, parts: int) -> pa.Table:
        start = self.settled.copy()
        start[self.others.repeated(replies, 3, parts)] = True
        gone = covered(len(self.buf), np.flatnonzero(start), self.window)
        a, b = [], []
        for lo, hi in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            x, y = runs(gone[lo:hi])
            a.append(x), b.append(y)
        n = [len(x) for x in a]
        own, shift = np.repeat(self.owner, n), np.repeat(self.start, n)
        flat = lambda xs: (np.concatenate(xs) + shift).astype("<i8").tobytes() if xs else b""
        return pa.table({"chunk": pa.array([self.chunk], pa.int32()), "owner": [own.astype("<i4").tobytes()], "start": [flat(a)], "stop": [flat(b)]})


def _left(table: pa.Table, replies: pa.Table, window: int, parts: int) -> pa.Table:
    """The regions of a chunk whose windows hold a name that occurs twice."""
    buf, offsets = text_buffer(table["text"])
    name = window - PERIOD + 1
    names = Names(Rolling(TABLE[buf]), samples(offsets, name), name, 48)
    named = np.zeros(len(buf) + PERIOD + 1, np.int32)
    named[names.repeated(replies, 0, parts) + 1] = 1
    named = np.cumsum(named, dtype=np.int32)
    n = len(buf)
    keep = fits(offsets, window) & (named[PERIOD : PERIOD + n] > named[:n])
    keep = covered(n, np.flatnonzero(keep), window)
    cut = offsets[1:-1][(offsets[1:-1] < n) & (offsets[1:-1] > 0)]
    a, b = runs(keep)
    inner = np.unique(cut[keep[cut] & keep[cut - 1]]) if len(cut) else cut  # a region ends with its document
    a, b = np.sort(np.concatenate((a, inner))), np.sort(np.concatenate((b, inner)))
    owner = np.searchsorted(offsets, a, side="right") - 1
    data = zstandard.ZstdCompressor(level=1).compress(buf[keep].tobytes())
    as_bytes = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
    return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "owner": as_bytes(owner, "<i4"), "start": as_bytes(a - offsets[owner], "<i8"), "size": as_bytes(b - a, "<i8"), "data": pa.array([data], pa.binary())})


def _finished(docs: DataFrame, window: int, chunk_bytes: int, finish, schema: str, *carried) -> DataFrame:
    """finish(documents, owner, start, stop): the rows of a chunk, given its maximal removed runs in bytes.  carried: columns that finish wants besides doc_id and text."""
    name = window - PERIOD + 1
    if name < 16:
        raise ValueError(f"a window has {PERIOD + 15} bytes at least")
    chunks = chunk_count(docs, chunk_bytes)
    parts = max(1, chunks // 4)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), *carried)

    def first(table: pa.Table) -> pa.Table:
        table = ordered(table)
        buf, offsets = text_buffer(table["text"])
        return sent(table["chunk"][0].as_py(), Names(Rolling(TABLE[buf]), samples(offsets, name), name, 48).keys, parts)

    def left(table: pa.Table, replies: pa.Table) -> pa.Table:
        return _left(ordered(table), replies, window, parts)

    def second(table: pa.Table) -> pa.Table:
        r = Regions(table, window)
        return sent(r.chunk, r.long.keys, parts)

    def third(table: pa.Table, replies: pa.Table) -> pa.Table:
        r = Regions(table, window)
        r.rest(replies, parts)
        return sent(r.chunk, r.others.keys, parts)

    def mark(table: pa.Table, replies: pa.Table) -> pa.Table:
        r = Regions(table, window)
        r.rest(replies, parts)
        return r.marks(replies, parts)

    def last(table: pa.Table, marks: pa.Table) -> pa.Table:
        get = lambda c, t: np.frombuffer(marks[c][0].as_py(), t) if marks.num_rows else np.zeros(0, t)
        return finish(ordered(table), get("owner", "<i4"), get("start", "<i8"), get("stop", "<i8"))

    answers = lambda asked, **phases: asked.groupBy("part").applyInArrow(tidy(reply_bits(**phases)), REPLY)
    by_chunk = text.groupBy("chunk")
    names = answers(by_chunk.applyInArrow(tidy(first), SENT), repeated=0)
    regions = by_chunk.cogroup(names.groupBy("chunk")).applyInArrow(tidy(left), LEFT)
    long = answers(regions.groupBy("chunk").applyInArrow(tidy(second), SENT), repeated=1, earlier=2)
    others = answers(regions.groupBy("chunk").cogroup(long.groupBy("chunk")).applyInArrow(tidy(third), SENT), repeated=3)
    marks = regions.groupBy("chunk").cogroup(long.unionByName(others).groupBy("chunk")).applyInArrow(tidy(mark), MARKS)
    return by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(tidy(last), schema)


def _cut(table: pa.Table, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Bytes, removed bytes, removed runs and kept bytes of each document."""
    buf, offsets = text_buffer(table["text"])
    n = table.num_rows
    raw = buf.tobytes()
    gone = np.bincount(owner, stop - start, minlength=n).astype(np.int64)
    spans = np.bincount(owner, minlength=n).astype(np.int64)
    order = np.lexsort((start, owner))
    a, b = start[order].tolist(), stop[order].tolist()
    edge = np.concatenate(([0], np.cumsum(spans))).tolist()
    kept = []
    for d in range(n):
        base, end = int(offsets[d]), int(offsets[d + 1])
        out, at = [], base
        for k in range(edge[d], edge[d + 1]):
            out.append(raw[at : base + a[k]])
            at = base + b[k]
        out.append(raw[at:end])
        kept.append(b"".join(out))
    return np.diff(offsets).astype(np.int64), gone, spans, kept


def dedup(docs: DataFrame, window: int = 200, chunk_bytes: int = 2 << 20, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary), or (digests) its SHA-256 as kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(table, owner, start, stop):
        size, gone, spans, kept = _cut(table, owner, start, stop)
        tail = {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())} if digests else {"kept": pa.array(kept, pa.binary())}
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(size), "n_removed": pa.array(gone), "n_spans": pa.array(spans)} | tail)

    return _finished(docs, window, chunk_bytes, finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digests else 'kept binary'}")


def repeats(docs: DataFrame, window: int = 200, chunk_bytes: int = 2 << 20) -> DataFrame:
    """The maximal removed runs: doc_id, start and stop in bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(table, owner, start, stop):
        return pa.table({"doc_id": table["doc_id"].take(pa.array(owner)), "start": pa.array(start), "stop": pa.array(stop)})

    return _finished(docs, window, chunk_bytes, finish, f"doc_id {kind}, start long, stop long")


def without_repeats(docs: DataFrame, window: int = 200, chunk_bytes: int = 2 << 20) -> DataFrame:
    """docs with all their columns and rows, less the repeats in text; what is cut within a character goes whole; n_chars, where there is one, is counted again."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    schema = StructType([docs.select(row).schema["row"], StructField("text", StringType())])

    def finish(table, owner, start, stop):
        kept = [k.decode("utf-8", "ignore") for k in _cut(table, owner, start, stop)[3]]
        empty = pc.is_null(table["text"]).to_pylist()
        return pa.table({"row": table["row"], "text": pa.array([None if e else k for e, k in zip(empty, kept)], pa.string())})

    out = _finished(docs, window, chunk_bytes, finish, schema, row)
    size = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in others else None
    return out.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

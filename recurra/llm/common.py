"""Shared pieces: checkpoints, chunks of documents, hashes over Arrow text buffers, hash exchanges.

A *chunk* is a set of documents that one task handles as a whole.  Chunks exchange sorted 64-bit
hashes by way of *parts* (ranges of the hash space): a chunk sends each hash once, so a hash that
a third of all rows hold reaches a part at most once for each chunk, and the part answers with
one bit (or count) for each hash it was sent, in the order sent.  A chunk sends no row for a part that has none of its
hashes, so there are never more rows than hashes: the exchange grows with the input.

A task holds a chunk's texts and some arrays of 8 bytes for each byte of them.  A text is not divided: one far above a chunk's
size needs about 40 times its own size in one worker.
"""

import ctypes
import hashlib
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
WORD = r"[^\x20\x09-\x0D]+"


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir; a folder of our own only where none is set and all runs in one process."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="recurra"))
    return df.checkpoint()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_BASE = 0xD1342543DE82EF95


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


def powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n modulo 2**64: multiples of a kept table of half a MB, so that a worker holds on to no more than that."""
    low = _powers(base, (1 << 16) - 1)
    if n < len(low):
        return low[: n + 1]
    high = np.full((n >> 16) + 1, pow(base, 1 << 16, 1 << 64), U)
    high[0] = 1
    return np.multiply.outer(np.cumprod(high, dtype=U), low).ravel()[: n + 1]


class Rolling:
    """Hash of any span of a sequence in constant time: a polynomial modulo 2**64 over random symbol values, then mixed."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.down = powers(pow(_BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(_BASE, n)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), and where each begins, with the end last."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_string())
    a = pc.fill_null(a.cast(pa.large_string()), "")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each document's first word, with the end last."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[buf]


#: Bytes up to which a polynomial modulo 2**64 tells spans apart; from 1,024 symbols on there are patterns on which it fails for certain.
SHORT = 128


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of spans such as words and lines; long ones by a cryptographic hash."""
    out = Rolling(TABLE[buf]).of(starts, ends) + (ends - starts).astype(U)
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def chunk_count(docs: DataFrame, chunk_bytes: int, least: int = 64) -> int:
    """Chunks for about chunk_bytes each, and some for small tables too so that all cores have work."""
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    return max(1, -(-size // chunk_bytes), min(least, rows // 16))


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in byte planes, of which the high ones compress to nothing."""
    d = np.diff(keys, prepend=U(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    d = np.frombuffer(blob, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view("<u8").ravel(), dtype=U)


def part_runs(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted keys fall into, and where each begins, with the end last; the work is that of the keys, however many parts there are."""
    part = ((keys >> U(32)) * U(parts) >> U(32)).astype(np.int64)
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(keys) else np.zeros(0, np.int64)
    return part[head], np.append(head, len(keys))


SENT = "part int, chunk int, keys binary, load binary"


def sent(chunk: int, keys: np.ndarray, parts: int, load: np.ndarray | None = None) -> pa.Table:
    """Rows of SENT for sorted unique keys, none for a part without keys; load: a number or a record for each key."""
    own, e = part_runs(keys, parts)
    return pa.table(
        {
            "part": pa.array(own.astype(np.int32)),
            "chunk": pa.array(np.full(len(own), chunk, np.int32)),
            "keys": pa.array([pack(keys[a:b]) for a, b in zip(e[:-1], e[1:])], pa.binary()),
            "load": pa.array([b"" if load is None else load[a:b].tobytes() for a, b in zip(e[:-1], e[1:])], pa.binary()),
        }
    )


REPLY = "chunk int, part int, phase int, bits binary"


def reply_bits(**phases: int):
    """For each part: a bit for each key sent, by phase: repeated=phase (two chunks or more sent it), earlier=phase (a chunk of lower number sent it)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        keys = [unpack(b.as_py()) for b in table["keys"]]
        e = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        same = s[1:] == s[:-1]
        out = []
        for mode, phase in phases.items():
            hit = np.zeros(len(s), bool)
            hit[1:] = same
            if mode == "repeated":
                hit[:-1] |= same
            bits = np.zeros(len(s), bool)
            bits[order] = hit
            packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(e[:-1], e[1:])]
            out.append(pa.table({"chunk": table["chunk"], "part": table["part"], "phase": pa.array(np.full(len(keys), phase, np.int32)), "bits": pa.array(packed, pa.binary())}))
        return pa.concat_tables(out)

    return run


def answers(replies: pa.Table, phase: int, keys: np.ndarray, parts: int, column: str = "bits"):
    """(from, to, answer) of each part that replied, for sorted unique keys, as the same keys were sent."""
    own, e = part_runs(keys, parts)
    for p, ph, b in zip(replies["part"].to_pylist(), replies["phase"].to_pylist(), replies[column]):
        if ph == phase:
            i = int(np.searchsorted(own, p))
            yield int(e[i]), int(e[i + 1]), b.as_py()


def read_bits(replies: pa.Table, phase: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """The bits answered for sorted unique keys."""
    out = np.zeros(len(keys), bool)
    for a, b, bits in answers(replies, phase, keys, parts):
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def with_order(docs: DataFrame) -> DataFrame:
    """docs with `order`: the rank of doc_id, a whole number itself, or else its place among the distinct ones; null: the least."""
    kind = docs.schema["doc_id"].dataType
    least = F.lit(-(1 << 63)).cast("long")
    if isinstance(kind, IntegralType):
        return docs.withColumn("order", F.coalesce(F.col("doc_id").cast("long"), least))
    ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    ranks = checkpointed(ids.withColumn("order", F.monotonically_increasing_id()))
    return docs.join(ranks, F.col("doc_id") == F.col("id"), "left").drop("id").withColumn("order", F.coalesce("order", least))


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f):
    """f, a function of one or two tables, that gives its memory back; Spark counts its arguments."""

    def one(table):
        try:
            return f(table)
        finally:
            give_back()

    def two(table, other):
        try:
            return f(table, other)
        finally:
            give_back()

    return one if f.__code__.co_argcount == 1 else two

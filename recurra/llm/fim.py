"""Fill-in-the-middle transformation with ropes.

A text is a rope: a balanced tree whose leaves hold pieces of about LEAF bytes and cache how many units and how many code points
they have.  A unit is a word with the white space before it, or the white space at the text's end.  The tree is split at two ranks
of units; prefix, middle and suffix are trees again, which are joined in another order with sentinels between them.  The inverse
builds the rope of the output, in which each sentinel is a leaf of its own, splits it at the sentinels' ranks of code points and
joins the three trees.

Where a text is cut and in which form it comes follows from its doc_id, the key and the number of its units only, so a lost task
gives the same rows again.  Null texts count as empty; empty texts, and texts that hold a sentinel, stay as they are (form plain).
A null doc_id counts as an empty one.  Rows that repeat come out alike; other columns, of any names, are not carried; an empty
table gives an empty result.  A text is handled whole, by one task, in about ten times its size.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import SPACE, give_back, text_buffer

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LEAF = 2048


class Rope:
    """A leaf with data, or a node with two sides; both know their units and code points."""

    __slots__ = ("chars", "data", "left", "right", "units")

    def __init__(self, units: int, chars: int, data: bytes | None = None, left: "Rope | None" = None, right: "Rope | None" = None):
        self.units, self.chars, self.data, self.left, self.right = units, chars, data, left, right


def joined(a: Rope | None, b: Rope | None) -> Rope | None:
    if a is None or b is None:
        return a or b
    return Rope(a.units + b.units, a.chars + b.chars, None, a, b)


def balanced(leaves: list[Rope]) -> Rope | None:
    while len(leaves) > 1:
        leaves = [joined(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def _unit_ends(data: bytes) -> np.ndarray:
    """Where units end within a piece, but for one that ends with it."""
    solid = ~SPACE[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(solid[:-1] & ~solid[1:]) + 1


def _char_starts(data: bytes) -> np.ndarray:
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def split(rope: Rope | None, rank: int, by: str) -> tuple[Rope | None, Rope | None]:
    """The tree up to the end of as many units or chars, and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank > getattr(rope, by):
        return rope, None
    if rope.data is None:
        before = getattr(rope.left, by)
        if rank <= before:
            a, b = split(rope.left, rank, by)
            return a, joined(b, rope.right)
        a, b = split(rope.right, rank - before, by)
        return joined(rope.left, a), b
    if by == "units":
        ends = _unit_ends(rope.data)
        at = int(ends[rank - 1]) if rank <= len(ends) else len(rope.data)
    else:
        starts = _char_starts(rope.data)
        at = int(starts[rank]) if rank < len(starts) else len(rope.data)
    if at == len(rope.data):
        return rope, None
    head, tail = rope.data[:at], rope.data[at:]
    units = rank if by == "units" else len(_unit_ends(head)) + int(not SPACE[head[-1]] and SPACE[tail[0]])
    chars = rank if by == "chars" else len(_char_starts(head))
    return Rope(units, chars, head), Rope(rope.units - units, rope.chars - chars, tail)


def pieces(rope: Rope | None) -> list[bytes]:
    """The leaves' data from left to right."""
    out, todo = [], [rope] if rope else []
    while todo:
        r = todo.pop()
        if r.data is None:
            todo += [r.right, r.left]
        else:
            out.append(r.data)
    return out


def sentinels(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where sentinels begin."""
    if len(buf) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((buf[:-2] == 60) & (buf[2:] == 62))
    at = at[np.isin(buf[at + 1], (77, 80, 83))]
    return at[np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + 2, side="right")]


def leaves(buf: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> list[list[Rope]]:
    """The leaves of each text, cut every LEAF bytes before a code point, and around the sentinels; counts are taken for all texts at once."""
    n = len(buf)
    out: list[list[Rope]] = [[] for _ in range(len(offsets) - 1)]
    if not n:
        return out
    each = -(-np.diff(offsets) // LEAF)
    at = np.repeat(offsets[:-1] - np.append(0, np.cumsum(each)[:-1]) * LEAF, each) + np.arange(each.sum()) * LEAF
    first = (buf & 0xC0) != 0x80
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    for _ in range(3):
        at = at - ~first[at]
    if len(marks):
        at = np.concatenate((at[~np.isin(at, np.concatenate((marks + 1, marks + 2)))], marks, marks[marks + 3 < n] + 3))
    at = np.unique(at)
    solid = ~SPACE[buf]
    ends = np.append(solid[:-1] & ~solid[1:], True)
    ends[offsets[(offsets > 0)] - 1] = True
    units, chars = np.add.reduceat(ends, at, dtype=np.int64).tolist(), np.add.reduceat(first, at, dtype=np.int64).tolist()
    data, to = buf.tobytes(), np.append(at[1:], n).tolist()
    of = (np.searchsorted(offsets, at, side="right") - 1).tolist()
    for k, (a, b) in enumerate(zip(at.tolist(), to)):
        out[of[k]].append(Rope(units[k], chars[k], data[a:b]))
    return out


def draws(doc_id, key: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 of a document."""
    h = hashlib.sha256(f"{key}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def _mark(sentinel: bytes) -> Rope:
    return Rope(1, len(sentinel), sentinel)


def rearranged(rope: Rope | None, doc_id, key: int, rate: int, spm: int) -> tuple[str, int | None, int | None, list[bytes]]:
    """Form, code points of prefix and middle, and the output's pieces."""
    n = rope.units if rope else 0
    a, b, often, which = draws(doc_id, key)
    if not n or often % 100 >= rate:
        return "plain", None, None, pieces(rope)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    head, suffix = split(rope, high, "units")
    prefix, middle = split(head, low, "units")
    form = "spm" if which % 100 < spm else "psm"
    order = [_mark(SUFFIX), suffix, _mark(PREFIX), prefix] if form == "spm" else [_mark(PREFIX), prefix, _mark(SUFFIX), suffix]
    whole = None
    for part in [*order, _mark(MIDDLE), middle]:
        whole = joined(whole, part)
    return form, prefix.chars if prefix else 0, middle.chars if middle else 0, pieces(whole)


def rebuilt(own: list[Rope], form: str) -> list[bytes]:
    """The text's pieces from the leaves of an output, in which sentinels are leaves."""
    rope = balanced(own)
    if form == "plain":
        return pieces(rope)
    ranks, at = {}, 0
    for leaf in own:
        if leaf.data in (PREFIX, SUFFIX, MIDDLE):
            ranks[leaf.data] = at
        at += leaf.chars
    parts = {}
    for mark in sorted(ranks, key=ranks.get, reverse=True):
        rope, part = split(rope, ranks[mark], "chars")
        parts[mark] = split(part, len(mark), "chars")[1]
    return pieces(joined(joined(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def _slices(batch: pa.RecordBatch, column: int, size: int):
    """Runs of rows of about `size` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _texts(parts: list[list[bytes]]) -> pa.Array:
    whole = [b"".join(p) for p in parts]
    offsets = np.append(0, np.cumsum([len(w) for w in whole])).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(offsets), pa.py_buffer(b"".join(whole))).cast(pa.string())


def transform(docs: DataFrame, key: int = 42, rate: int = 50, spm: int = 80, size: int = 4 << 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every whole text.

    rate: how many in a hundred texts are rearranged; spm: how many in a hundred of those begin with the suffix; size: bytes of text
    that are handled at once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in _slices(whole, 1, size):
                buf, offsets = text_buffer(b.column(1))
                marks, rows = sentinels(buf, offsets), []
                marked = {*(np.searchsorted(offsets, marks, side="right") - 1).tolist()}
                for k, (own, doc_id) in enumerate(zip(leaves(buf, offsets, marks), b.column(0).to_pylist())):
                    rope = balanced(own)
                    rows.append((rope.units if rope else 0, *rearranged(rope, doc_id, key, 0 if k in marked else rate, spm)))
                n, form, prefix, middle, out = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _texts(out)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, size: int = 4 << 20) -> DataFrame:
    """rows, which have output and form, with `restored`: the exact text, rebuilt from those two.  A null output counts as an empty one."""

    def run(batches):
        for whole in batches:
            at = whole.schema.get_field_index("output")
            for b in _slices(whole, at, size):
                buf, offsets = text_buffer(b.column(at))
                out = [rebuilt(own, form or "plain") for own, form in zip(leaves(buf, offsets, sentinels(buf, offsets)), b.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, _texts(out)], [*b.schema.names, "restored"])
        give_back()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("restored", StringType())]))

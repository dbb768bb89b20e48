"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is cut into reference blocks (chunks of whole documents), all of which are indexed: first by names of NAME words at
the positions of a difference cover modulo PERIOD, so that any two equal windows share a name at the same place, and windows
none of whose names has a second place are left out; then every window that is left by its first place in the corpus.

Each document is parsed greedily from left to right.  Where the window at hand has an earlier place, a factor begins there and
goes on for as long as the next windows' first places go on in the same reference text; the next factor begins where it ends,
or at the next word whose window has an earlier place.  Words between factors are literals.  At each border between factors
the windows that straddle it are looked up as well and give border factors, so that no duplicate is missed.  Words in a
factor are duplicates.

Rows are in the order of doc_id (a null one comes first), those of the same doc_id by a hash of the text, equal rows one
after the other.  A window of n words is a duplicate if its words also start in a row before, or earlier in the same
text.  Windows are compared by 64-bit hashes: among 10**9 distinct windows an error is expected with a chance of 3 %.  Null
texts count as empty; texts of fewer words than a window keep all; a doc_id may be of any type that can be sorted; an empty
table gives an empty result; other columns, of any names, are not carried.  A text is parsed by one task, whatever its length.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REPLY, SENT, answers, chunk_count, mix, read_bits, reply_bits, sent, text_buffer, tidy, unpack, word_hashes, word_spans, with_order, Rolling

#: A perfect difference set: every difference modulo 13 occurs among these.
COVER, PERIOD = (0, 1, 3, 9), 13
SOURCES = REPLY + ", source binary"
#: A place in the corpus: the row's order and tie, and the word in its text.
PLACE = np.dtype([("order", "<i8"), ("tie", "<i8"), ("word", "<i4")])


class Block:
    """A chunk's documents in order, their words' hashes and what the index answers."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.sort_by([("order", "ascending"), ("tie", "ascending")])
        self.window, self.name = window, window - PERIOD + 1
        self.buf, self.offsets = text_buffer(self.table["text"])
        self.starts, self.ends, self.first = word_spans(self.buf, self.offsets)
        self.rolling = Rolling(mix(word_hashes(self.buf, self.starts, self.ends)))
        n = len(self.starts)
        sizes = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.doc_end = self.first[1:][self.doc]
        self.word = np.arange(n) - self.first[:-1][self.doc]
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        self.samples = np.flatnonzero(cover[self.word % PERIOD] & (np.arange(n) + self.name <= self.doc_end))
        self.names, self.name_of, counts = np.unique(self.rolling.of(self.samples, self.samples + self.name), return_inverse=True, return_counts=True)
        self.many = counts > 1

    def candidates(self, replies: pa.Table, parts: int) -> None:
        """Windows with a name that has a second place; keys: their hashes, heads: each key's first window."""
        shared = read_bits(replies, 0, self.names, parts) | self.many
        n = len(self.word)
        named = np.zeros(n + PERIOD + 1, np.int32)
        named[self.samples[shared[self.name_of]] + 1] = 1
        named = np.cumsum(named)
        i = np.arange(n)
        self.at = i[(i + self.window <= self.doc_end) & (named[i + PERIOD] > named[:n])]
        self.keys, self.heads, self.key_of = np.unique(self.rolling.of(self.at, self.at + self.window), return_index=True, return_inverse=True)
        place = np.zeros(len(self.keys), PLACE)
        head = self.at[self.heads]
        place["order"], place["tie"], place["word"] = self.table["order"].to_numpy()[self.doc[head]], self.table["tie"].to_numpy()[self.doc[head]], self.word[head]
        self.places = place

    def matches(self, replies: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows that have an earlier place, and the first such place of each."""
        earlier = read_bits(replies, 1, self.keys, parts)
        first = self.places.copy()
        for a, b, found in answers(replies, 1, self.keys, parts, "source"):
            first[a:b][earlier[a:b]] = np.frombuffer(found, PLACE)
        again = np.ones(len(self.at), bool)
        again[self.heads] = False
        hit = earlier[self.key_of] | again
        return self.at[hit], first[self.key_of[hit]]

    def factors(self, at: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The greedy parse: first word (in the block), length, source place, and whether it is a border factor."""
        head = np.ones(len(at), bool)
        head[1:] = (np.diff(at) != 1) | (self.doc[at[1:]] != self.doc[at[:-1]])
        for field, step in (("order", 0), ("tie", 0), ("word", 1)):
            head[1:] |= np.diff(source[field]) != step
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        begin, length, of, border = [], [], [], []
        end, doc = 0, -1
        docs = self.doc[at[first]].tolist()
        for k, (p, q, d) in enumerate(zip(at[first].tolist(), at[last].tolist(), docs)):
            if d != doc:
                end, doc = p, d
            if p < end:  # the windows from here to the border straddle it
                stop = min(q, end - 1)
                begin.append(p), length.append(stop - p + self.window), of.append(first[k]), border.append(True)
            start = max(p, end)
            if start <= q:
                begin.append(start), length.append(q - start + self.window), of.append(first[k] + start - p), border.append(False)
                end = q + self.window
        return np.array(begin, np.int64), np.array(length, np.int64), source[np.array(of, np.int64)], np.array(border, bool)


def _name_bits(table: pa.Table) -> pa.Table:
    out = reply_bits(repeated=0)(table)
    return out.append_column("source", pa.array([b""] * out.num_rows, pa.binary()))


def _first_places(table: pa.Table) -> pa.Table:
    """For each key sent: whether another chunk has it at an earlier place, and the first of all places."""
    table = table.sort_by("chunk")
    keys = [unpack(b.as_py()) for b in table["keys"]]
    sizes = [len(k) for k in keys]
    flat = np.concatenate(keys)
    places = np.concatenate([np.frombuffer(b.as_py(), PLACE) for b in table["load"]])
    order = np.lexsort((places["word"], places["tie"], places["order"], flat))
    head = np.append(True, flat[order][1:] != flat[order][:-1])
    first = np.empty(len(flat), np.int64)
    first[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    bits = first != np.arange(len(flat))
    e = np.concatenate(([0], np.cumsum(sizes)))
    spans = [slice(a, b) for a, b in zip(e[:-1], e[1:])]
    return pa.table(
        {
            "chunk": table["chunk"],
            "part": table["part"],
            "phase": pa.array(np.ones(len(sizes), np.int32)),
            "bits": pa.array([np.packbits(bits[s]).tobytes() for s in spans], pa.binary()),
            "source": pa.array([places[first[s][bits[s]]].tobytes() for s in spans], pa.binary()),
        }
    )


def _parsed(docs: DataFrame, window: int, chunk_bytes: int, finish, schema: str) -> DataFrame:
    """finish(block, first word, length, source and border of its factors): the rows of a block."""
    if window < PERIOD + 1:
        raise ValueError(f"a window has more than {PERIOD} words")
    parts = chunks = chunk_count(docs, chunk_bytes)
    row = F.xxhash64("doc_id", F.col("text").cast("string"))
    text = with_order(docs.select("doc_id", F.col("text").cast("string").alias("text"), row.alias("tie"), F.pmod(row, F.lit(chunks)).cast("int").alias("chunk")))

    def index(table: pa.Table) -> pa.Table:
        return sent(table["chunk"][0].as_py(), Block(table, window).names, parts)

    def look_up(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(table, window)
        block.candidates(replies, parts)
        return sent(table["chunk"][0].as_py(), block.keys, parts, block.places)

    def parse(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(table, window)
        block.candidates(replies, parts)
        return finish(block, *block.factors(*block.matches(replies, parts)))

    by_chunk = text.groupBy("chunk")
    names = by_chunk.applyInArrow(tidy(index), SENT).groupBy("part").applyInArrow(tidy(_name_bits), SOURCES)
    places = by_chunk.cogroup(names.groupBy("chunk")).applyInArrow(tidy(look_up), SENT).groupBy("part").applyInArrow(tidy(_first_places), SOURCES)
    return by_chunk.cogroup(names.unionByName(places).groupBy("chunk")).applyInArrow(tidy(parse), schema)


def covered(n: int, at: np.ndarray, length) -> np.ndarray:
    """Which of n places lie in a span that begins at one of at; length: of all spans, or of each."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[:n] > 0


def _kept(block: Block, gone: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Removed words and the kept text of each document."""
    sums = np.concatenate(([0], np.cumsum(gone)))
    removed = sums[block.first[1:]] - sums[block.first[:-1]]
    texts = []
    raw = block.buf.tobytes()
    for d in range(len(block.first) - 1):
        a, b = block.first[d], block.first[d + 1]
        if removed[d] == 0:
            texts.append(b" ".join(raw[block.offsets[d] : block.offsets[d + 1]].split()))
        elif removed[d] == b - a:
            texts.append(b"")
        else:
            k = a + np.flatnonzero(~gone[a:b])
            texts.append(b" ".join([raw[s:e] for s, e in zip(block.starts[k].tolist(), block.ends[k].tolist())]))
    return removed.astype(np.int64), texts


def dedup(docs: DataFrame, window: int = 20, chunk_bytes: int = 4 << 20, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (words joined by one blank), or (digests) its SHA-256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "kept_sha256" if digests else "kept_text"

    def finish(block: Block, begin: np.ndarray, length: np.ndarray, source: np.ndarray, border: np.ndarray) -> pa.Table:
        removed, texts = _kept(block, covered(len(block.word), begin, length))
        out = [hashlib.sha256(t).hexdigest() for t in texts] if digests else [t.decode() for t in texts]
        return pa.table({"doc_id": block.table["doc_id"], "n_words": pa.array(np.diff(block.first).astype(np.int64)), "n_removed": pa.array(removed), last: pa.array(out, pa.string())})

    return _parsed(docs, window, chunk_bytes, finish, f"doc_id {kind}, n_words long, n_removed long, {last} string")


def factors(docs: DataFrame, window: int = 20, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The factors of every document: doc_id, start and length in words, the reference's place (source_order: its doc_id, or the
    rank of that where it is no whole number; source_start: its word) and border (whether it only bridges two others).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(block: Block, begin: np.ndarray, length: np.ndarray, source: np.ndarray, border: np.ndarray) -> pa.Table:
        doc = block.doc[begin]
        return pa.table(
            {
                "doc_id": block.table["doc_id"].take(pa.array(doc)),
                "start": pa.array(block.word[begin]),
                "length": pa.array(length),
                "source_order": pa.array(source["order"].copy()),
                "source_start": pa.array(source["word"].astype(np.int64)),
                "border": pa.array(border),
            }
        )

    return _parsed(docs, window, chunk_bytes, finish, f"doc_id {kind}, start long, length long, source_order long, source_start long, border boolean")

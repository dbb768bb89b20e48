"""Audit of how far the sources of a language diverge, by tiles of group blocks.

A group is a language and a source; its vector counts the language's kept terms, those in at least `least` of its documents.
Terms fall into vocabulary chunks by a hash, and are numbered within each.  Groups of a language form blocks; the packed vectors of
a block are replicated to the tasks of all its pairs of blocks, and each task goes through successive chunks, of each of which it
holds two blocks of vectors, and adds up its part of the pairs' divergences.  A task has a bounded run of chunks (a slab); the sums
of the slabs are added.  All arithmetic is in whole numbers, so results do not depend on the order.

Null texts, languages and sources count as empty strings.  Every group that occurs is reported, also without terms; a language of
one group has no pairs.  Rows that repeat count as often as they occur; other columns, of any names, are not carried; an empty table
gives an empty result.  A text is tokenised whole, by one task, with some 40 bytes for each of its characters.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, chunk_count, give_back, pack, text_buffer, unpack

#: A share of one in whole numbers, and what each term's count is raised by.
ONE, RAISE = 10**9, 2

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(texts) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of some texts, and how many each text has."""
    buf, offsets = text_buffer(texts)
    solid = _LETTER[buf]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    start[inner] = solid[inner]
    letters = _LOWER[buf[solid]]
    ends = np.append(np.flatnonzero(start[solid]), len(letters)).astype(np.int64)
    before = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(start, out=before[1:])
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode(), np.diff(before[offsets])


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n and docs; and a row with an empty term for each group."""
    words, each = terms_of(batch.column(2))
    lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
    wide = len(source.dictionary)
    groups, g = np.unique(lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy(), return_inverse=True)
    bits, own = len(each).bit_length(), len(words.dictionary).bit_length()
    doc = np.repeat(np.arange(len(each)), each)
    keys = np.sort((g[doc] << (own + bits)) | (words.indices.to_numpy().astype(np.int64) << bits) | doc)
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    pair = keys >> bits
    head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(keys) else np.zeros(0, np.int64)
    n, docs = np.diff(np.append(head, len(keys))), np.add.reduceat(new, head, dtype=np.int64) if len(head) else head
    of, none = groups[np.append(pair[head] >> own, np.arange(len(groups)))], np.zeros(len(groups), np.int64)
    terms = pa.concat_arrays([words.dictionary.take(pa.array(pair[head] & ((1 << own) - 1))), pa.array([""] * len(groups), pa.large_string())])
    columns = [lang.dictionary.take(pa.array(of // wide)), source.dictionary.take(pa.array(of % wide)), terms.cast(pa.string()), pa.array(np.append(n, none)), pa.array(np.append(docs, none))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, size: int = 4 << 20) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of all texts; and a row with an empty term for each group.

    size: bytes of text that are counted at once.
    """

    def run(batches):
        for whole in batches:
            ends, at = np.cumsum(whole.column(3).to_numpy()), 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
                yield _counted(whole.slice(at, to - at))
                at = to
        give_back()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*named).withColumn("size", F.octet_length("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


VECTORS = "lang string, chunk int, source string, size long, total long, vector binary, terms array<string>"


def vectors(counts: DataFrame, chunks: int, least: int) -> DataFrame:
    """VECTORS: for each language and chunk a row without source that has the kept terms, their number and the language's counts, and a row for each source that occurs there."""

    def run(rows: pa.Table) -> pa.Table:
        term, source = (pa.concat_arrays(rows[c].chunks).dictionary_encode() for c in ("term", "source"))
        n, own, of = rows["n"].to_numpy(), term.indices.to_numpy(), source.indices.to_numpy()
        docs = np.zeros(len(term.dictionary), np.int64)
        np.add.at(docs, own, rows["docs"].to_numpy())
        names = term.dictionary.to_pylist()
        kept = [k for k in np.flatnonzero(docs >= least).tolist() if names[k]]
        number = np.full(len(names), -1, np.int64)
        number[kept] = np.arange(len(kept))
        at = number[own]
        whole = np.zeros(len(kept), np.int64)
        np.add.at(whole, at[at >= 0], n[at >= 0])
        order = np.lexsort((at, of))
        order = order[at[order] >= 0]
        cut = np.searchsorted(of[order], np.arange(len(source.dictionary) + 1))
        runs = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
        packed = [_packed(np.arange(len(kept)), whole), *[_packed(at[r], n[r]) for r in runs]]
        k = len(packed)
        lang, chunk = rows["lang"][0].as_py(), rows["chunk"][0].as_py()
        totals = [int(whole.sum()), *[int(n[r].sum()) for r in runs]]
        terms = [[names[i] for i in kept], *[None] * (k - 1)]
        columns = [[lang] * k, [chunk] * k, [None, *source.dictionary.to_pylist()], [len(kept), *[None] * (k - 1)], totals, packed, terms]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string())))], [c.split()[0] for c in VECTORS.split(", ")])

    chunk = F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")
    return counts.withColumn("chunk", chunk).groupBy("lang", "chunk").applyInArrow(run, VECTORS)


def _packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places and their counts."""
    return pack(at.astype(np.uint64)) + pack(np.cumsum(n).astype(np.uint64))


def _unpacked(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not vector:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = len(vector) // 2
    return unpack(vector[:half]).astype(np.int64), np.diff(unpack(vector[half:]).astype(np.int64), prepend=0)


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + RAISE) / (total + RAISE * terms)), by long division in three steps, so that nothing overflows below 9 * 10**15 occurrences."""
    of = np.int64(total + RAISE * terms)
    out, rest = divmod((count + RAISE) * 1000, of)
    for _ in range(2):
        more, rest = divmod(rest * 1000, of)
        out = out * 1000 + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tile(rows: list[dict], lo: int, hi: int) -> dict[tuple[str, str], int]:
    """Sums, over the chunks in rows, of the divergences of each source of block lo and each of block hi."""
    sums: dict[tuple[str, str], int] = {}
    for chunk in sorted({r["chunk"] for r in rows}):
        own = [r for r in rows if r["chunk"] == chunk]
        size, terms = own[0]["size"] or 0, own[0]["terms"]
        sparse = [_unpacked(r["vector"]) for r in own]
        used = np.unique(np.concatenate([at for at, _ in sparse]))
        p = np.zeros((len(own), len(used) + 1), np.int64)  # the last column is a term that none of them has
        for k, (at, n) in enumerate(sparse):
            p[k, np.searchsorted(used, at)] = n
            if size:
                p[k] = shares(p[k], own[k]["total"], terms)
        right = [k for k, r in enumerate(own) if r["block"] == hi]
        for i, r in enumerate(own):
            if r["block"] == lo:
                f = divergence(p[i], p[right]) if size else np.zeros((len(right), 1), np.int64)
                values = f[:, :-1].sum(axis=1) + f[:, -1] * (size - len(used) if size else 0)
                for k, v in zip(right, values.tolist()):
                    key = r["source"], own[k]["source"]
                    sums[key] = sums.get(key, 0) + v
    return sums


def audit(docs: DataFrame, least: int = 10, top: int = 10, block: int = 16, slab: int = 8, chunk_bytes: int = 32 << 20) -> DataFrame:
    """lang, source, part, item, value and rank: `pair` for the other sources of the language, all ranks; `term` for the terms more frequent in the group than in the language, to rank `top`.

    least: documents of a language in which a kept term occurs; block: groups in a block; slab: chunks of the vocabulary that one task
    goes through; chunk_bytes: bytes of text for each chunk of the vocabulary.
    """
    chunks = chunk_count(docs, chunk_bytes, 12)
    rows = checkpointed(vectors(term_counts(docs), chunks, least))
    own = rows.where("source is not null")
    langs = rows.where("source is null").groupBy("lang").agg(F.sum("size").alias("terms"), F.sum("total").alias("whole"))
    by_lang = Window.partitionBy("lang")
    groups = own.groupBy("lang", "source").agg(F.sum("total").alias("total")).join(langs, "lang")
    groups = groups.withColumn("block", F.expr(f"cast((row_number() over (partition by lang order by source) - 1) div {block} as int)")).withColumn("blocks", F.max("block").over(by_lang) + 1)
    groups = checkpointed(groups)

    # every group meets every chunk of its language that has terms, and chunk 0, so that there are pairs without terms too
    sizes = rows.where("source is null").select("lang", "chunk", "size")
    grid = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(sizes, ["lang", "chunk"], "left").where("size > 0 or chunk = 0")
    grid = grid.join(own.select("lang", "chunk", "source", "vector"), ["lang", "chunk", "source"], "left")
    sent = grid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.expr(f"chunk div {slab}").alias("slab"), "chunk", "source", "block", "size", "total", "terms", "vector"
    )

    def tiled(table: pa.Table) -> pa.Table:
        lang, lo, hi = (table[c][0].as_py() for c in ("lang", "lo", "hi"))
        sums = {(a, b): v for (a, b), v in tile(table.select(["chunk", "source", "block", "size", "total", "terms", "vector"]).to_pylist(), lo, hi).items() if a != b}
        if lo != hi:
            sums |= {(b, a): v for (a, b), v in sums.items()}
        give_back()
        return pa.table({"lang": pa.array([lang] * len(sums), pa.string()), "source": pa.array([a for a, _ in sums], pa.string()), "item": pa.array([b for _, b in sums], pa.string()), "value": pa.array([*sums.values()], pa.int64())})

    pairs = sent.groupBy("lang", "lo", "hi", "slab").applyInArrow(tiled, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def best(table: pa.Table) -> pa.Table:
        lang, out = table["lang"][0].as_py(), []
        own = table.to_pylist()
        chunk = next((r for r in own if r["source"] is None), {"terms": [], "vector": None})
        names, whole = np.array(chunk["terms"], object), _unpacked(chunk["vector"])[1]
        for r in own if len(names) else []:
            if r["source"] is not None:
                at, n = _unpacked(r["vector"])
                p, q = shares(n, r["total"], r["kept"]), shares(whole[at], r["whole"], r["kept"])
                more = p > q
                f, found = divergence(p[more], q[more]), names[at[more]]
                edge = -np.partition(-f, top - 1)[top - 1] if len(f) > top else 0
                some = np.flatnonzero(f >= edge)
                out += sorted(((r["source"], found[k], int(f[k])) for k in some), key=lambda x: (-x[2], x[1].encode()))[:top]
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array([x[0] for x in out], pa.string()), "item": pa.array([x[1] for x in out], pa.string()), "value": pa.array([x[2] for x in out], pa.int64())})

    with_totals = own.drop("total", "terms", "size").join(groups.select("lang", "source", "total", F.col("terms").alias("kept"), "whole"), ["lang", "source"])
    tops = rows.where("source is null and size > 0").unionByName(with_totals, allowMissingColumns=True).groupBy("lang", "chunk")
    terms = tops.applyInArrow(best, "lang string, source string, item string, value long")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of = lambda rows, part: rows.withColumn("rank", F.row_number().over(ranked)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return of(pairs, "pair").unionByName(of(terms, "term").where(F.col("rank") <= top))

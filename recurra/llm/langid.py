"""Language identification by hyperdimensional profiles.

Every letter, that is every code point that is one, has a random vector of +1 and -1 of its own, made from its number.  A
trigram's vector binds its letters' vectors, each permuted (rotated) by its place, by their product; a document's vector
bundles (adds) those of its trigrams; a language's prototype bundles its training documents.  The language whose
prototype has the greatest cosine with the document is predicted; ties go to the first name.

Vectors are kept as bits, in which a product is an exclusive or.  Tasks bundle the trigrams they read into whole-number sums by
language, which are exact in any order; languages x dims numbers come to the driver and go to the workers.

Null texts and texts without a letter get `und` and score 0.  Rows with a null lang teach nothing.  With no training rows all
is `und`.  Rows that repeat teach and are judged like any others; other columns, of any names, are not carried; an empty table
gives an empty result.  A text is handled whole, by one task, with some 40 bytes for each of its characters.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, mix

#: Trigrams are three code points of 21 bits; 0 stands for the border of a word.
BITS, MASK = 21, (1 << 21) - 1


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(letters: np.ndarray, dims: int) -> np.ndarray:
    """Bits (place, letter, dims / 8 bytes): each letter's random bits, rotated by place."""
    words = np.arange(dims // 64, dtype=U)
    bits = mix(mix(letters.astype(U) + U(0xA5A5))[:, None] + words * U(0x9E3779B97F4A7C15))
    v = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)
    return np.stack([np.packbits(np.roll(v, 2 - place, axis=1), axis=1) for place in range(3)])


def gram_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of +1 and -1."""
    places = [codes >> (2 * BITS), (codes >> BITS) & MASK, codes & MASK]
    letters = np.unique(np.concatenate(places))
    first, second, third = letter_vectors(letters, dims)
    a, b, c = (np.searchsorted(letters, x) for x in places)
    signs = np.unpackbits(first[a] ^ second[b] ^ third[c], axis=1).astype(np.float32)
    signs *= -2
    signs += 1
    return signs


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram counts: document, index among the distinct codes, count; and those codes.  Runs of other characters count as one border symbol."""
    parts = [(t or "").lower() for t in texts]
    raw = np.frombuffer(("\n\n".join(["", *parts])[1:] + "\n").encode("utf-32-le", "surrogatepass"), "<u4") if parts else np.zeros(0, "<u4")
    s = np.where(_is_letter()[raw], raw, 0).astype(np.int64)
    doc = np.repeat(np.arange(len(parts)), np.array([len(p) + 2 for p in parts], np.int64))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    if len(s) < 3:
        return (np.zeros(0, np.int64),) * 4
    inside = (doc[:-2] == doc[2:]) & (s[1:-1] != 0)
    codes, of = np.unique(((s[:-2] << (2 * BITS)) | (s[1:-1] << BITS) | s[2:])[inside], return_inverse=True)
    keys, counts = np.unique(doc[:-2][inside] * max(1, len(codes)) + of, return_counts=True)
    return keys // max(1, len(codes)), keys % max(1, len(codes)), counts, codes


def bundle(of: np.ndarray, row: np.ndarray, count: np.ndarray, codes: np.ndarray, rows: int, dims: int) -> np.ndarray:
    """For each of `rows` rows the sum of its trigrams' vectors."""
    out = np.zeros((rows, dims), np.float64)
    for at in range(0, len(codes), 4096):
        own = (of >= at) & (of < at + 4096)
        counts = np.zeros((rows, min(4096, len(codes) - at)), np.float32)
        np.add.at(counts, (row[own], of[own] - at), count[own])
        out += counts @ gram_vectors(codes[at : at + 4096], dims)
    return out


def prototype_sums(docs: DataFrame, train: Column, dims: int) -> DataFrame:
    """lang, i and x: each language's bundle over all training documents, a row for each of dims."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            langs = whole.column(0).to_pylist()
            for at in range(0, whole.num_rows, 200):
                own = langs[at : at + 200]
                names = sorted(set(own))
                number = np.array([names.index(x) for x in own])
                d, of, n, codes = grams(whole.column(1).slice(at, 200).to_pylist())
                vectors = np.rint(bundle(of, number[d], n, codes, len(names), dims)).astype(np.int64) if len(codes) else np.zeros((len(names), dims), np.int64)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + vectors[k]
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dims, pa.string()), pa.array(np.arange(dims, dtype=np.int32)), pa.array(total)], ["lang", "i", "x"])

    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x"))


def prototypes(sums: DataFrame, dims: int) -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes from prototype_sums."""
    t = sums.toPandas()
    names = sorted(t["lang"].unique())
    out = np.zeros((len(names), dims))
    out[np.searchsorted(names, t["lang"]) if names else [], t["i"]] = t["x"]
    return names, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def classify(texts: list[str | None], names: list[str], protos: np.ndarray) -> tuple[list[str], np.ndarray]:
    dims = protos.shape[1]
    n = len(texts)
    d, of, count, codes = grams(texts)
    if not len(codes) or not names:
        return ["und"] * n, np.zeros(n)
    vectors = bundle(of, d, count, codes, n, dims)
    cos = (vectors @ protos.T) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    best = cos.argmax(axis=1)
    has = np.bincount(d, minlength=n) > 0
    score = np.where(has, np.clip(cos[np.arange(n), best], 0, 1), 0.0).astype(float)
    return [names[b] if h else "und" for b, h in zip(best, has)], score


def identify(docs: DataFrame, train: Column, dims: int = 512) -> DataFrame:
    """doc_id, held_out (not a training row), lang_pred and score of every row of docs."""
    names, protos = prototypes(prototype_sums(docs, train, dims), dims)
    shared = docs.sparkSession.sparkContext.broadcast((names, protos))  # languages x dims numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names, protos = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                lang, score = classify(b.column(2).to_pylist(), names, protos)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (~train).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

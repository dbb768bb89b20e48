"""Homomorphic multiset fingerprints of documents, in DataFrame and SQL functions only.

A text is a multiset of paragraphs (pieces that end with a line or a sentence).  Each paragraph is hashed to a wide
vector: EXACT lanes of 32 bits and LANES signs.  Every 64 bits of it come from a hash of their own, which reads its salt before the
paragraph, so two paragraphs that collide in one do not collide in the others.  A text's fingerprint is the sum of its
paragraphs' vectors, each lane modulo a power of two (2**32 and 2**16 as written), so the order of paragraphs does not matter, equal
texts have equal fingerprints, and `changed` puts paragraphs in or takes them out by adding or subtracting their vectors.
The cosine of two sums of signs estimates how much of the two multisets is shared (error about 1/16); the likeness is that, at
least 0.

Null texts count as empty and have one empty paragraph; rows that repeat have equal fingerprints; a null doc_id comes after
all others in descending order; doc_id may be of any type that can be sorted; an empty table gives an empty result; other
columns, of any names, are not carried.  A very long text is one row of a sorted window, and its paragraphs are rows of their own.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_count, with_order
from .ranges import chunk_of, cut_points

EXACT, LANES = 16, 256
BREAK = r"(?<=\n)|(?<=[.!?;])(?!\n)"


def pieces(text: Column) -> Column:
    """The paragraphs of a text; an empty text has one, which is empty."""
    cut = F.filter(F.split(text, BREAK), lambda x: x != "")
    return F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit("")))


def lanes(piece: Column) -> Column:
    """Struct of `e` and `s`: the hashes that a paragraph's exact lanes and signs are cut from."""
    salted = lambda k: F.xxhash64(F.lit(k), piece)
    return F.struct(*[salted(k).alias(f"e{k}") for k in range(EXACT // 2)], *[salted(1000 + k).alias(f"s{k}") for k in range(LANES // 64)])


def lane_sums(h: str = "h", sign: Column | None = None) -> list[Column]:
    """Aggregates over `h` (lanes of each paragraph): the number of paragraphs, EXACT sums of 32 bits, and LANES sums of one bit, two to a long; sign (1 or -1): whether it is put in or taken out."""
    each = (lambda x: F.sum(x)) if sign is None else (lambda x: F.sum(x * sign))
    out = [each(F.lit(1).cast("long")).alias("n")]
    for k in range(EXACT // 2):
        e = F.col(f"{h}.e{k}")
        out += [each(e.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"e{2 * k}"), each(F.shiftrightunsigned(e, 32)).alias(f"e{2 * k + 1}")]
    return out + [each(F.shiftrightunsigned(F.col(f"{h}.s{k}"), j).bitwiseAND(F.lit(0x100000001))).alias(f"s{k}_{j}") for k in range(LANES // 64) for j in range(32)]


def vector() -> Column:
    """Struct of `exact` (lanes modulo 2**32) and `signs` (sums of +1 and -1) from lane_sums.

    A pair of sums in one long is low + high * 2**32, also where paragraphs are taken out and both are below 0.
    """
    exact = F.array(*[F.pmod(F.col(f"e{k}"), F.lit(1 << 32)) for k in range(EXACT)])
    out = []
    for k in range(LANES // 64):
        for j in range(32):
            both = F.col(f"s{k}_{j}")
            low = both.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)  # the lower half, with its sign
            out += [low * 2 - F.col("n"), F.shiftright(both - low, 32) * 2 - F.col("n")]
    return F.struct(exact.alias("exact"), F.array(*out).alias("signs"))


def text_of(v: str) -> Column:
    """A fingerprint as hexadecimal digits."""
    return F.expr(f"concat(array_join(transform({v}.exact, x -> lpad(hex(x), 8, '0')), ''), ':', array_join(transform({v}.signs, x -> lpad(hex(pmod(x, 65536)), 4, '0')), ''))")


def likeness(a: str, b: str) -> Column:
    """Cosine of two fingerprints' signs, from 0 to 1; 1 for equal fingerprints."""
    dot = lambda x, y: f"aggregate(zip_with({x}.signs, {y}.signs, (p, q) -> cast(p as double) * q), 0D, (t, x) -> t + x)"
    return F.expr(f"case when {a} = {b} then 1D else greatest(0D, least(1D, coalesce(try_divide({dot(a, b)}, sqrt({dot(a, a)} * {dot(b, b)})), 0D))) end")


def changed(prints: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id and v of prints (doc_id, v) after edits (doc_id, piece, sign: 1 to put a paragraph in, -1 to take one out).

    Only the edited paragraphs are hashed.  Documents without an edit keep their v; edits of other doc_ids are left out.
    """
    h = edits.select("doc_id", F.col("sign").cast("long").alias("sign"), lanes(F.col("piece")).alias("h"))
    moved = h.groupBy("doc_id").agg(*lane_sums(sign=F.col("sign"))).select(F.col("doc_id").alias("id"), vector().alias("d"))
    both = prints.select("doc_id", "v").join(moved, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    exact = F.zip_with("v.exact", "d.exact", lambda x, y: F.pmod(x + y, F.lit(1 << 32)))
    signs = F.zip_with("v.signs", "d.signs", lambda x, y: x + y)
    return both.select("doc_id", F.when(F.col("d").isNull(), F.col("v")).otherwise(F.struct(exact.alias("exact"), signs.alias("signs"))).alias("v"))


def with_next(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """chunk, turn, doc_id, text and after (the next text in descending doc_id; after the last the first) of every row; each chunk ends with an extra row, `extra`, that begins the next."""
    rows = with_order(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    cuts = cut_points(rows, chunk_count(docs, chunk_bytes))
    rows = rows.withColumn("chunk", chunk_of(cuts, F.col("order")))
    heads = rows.groupBy("chunk").agg(F.max("order").alias("head"))  # a row for each chunk
    order = Window.orderBy("chunk")
    up = F.coalesce(F.lead("chunk").over(order), F.min("chunk").over(order))
    heads = heads.select(F.col("chunk").alias("of"), "head", up.alias("goes"))
    extra = rows.join(F.broadcast(heads), F.expr("chunk = of and `order` = head")).groupBy("goes", "doc_id", "order").agg(F.max("text").alias("text"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra.select("doc_id", "text", "order", F.col("goes").alias("chunk"), F.lit(1).alias("extra")))
    w = Window.partitionBy("chunk").orderBy("extra", F.desc("order"), F.desc("text"))
    return both.select("chunk", "extra", "doc_id", "text", F.row_number().over(w).alias("turn"), F.lead("text").over(w).alias("after"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, v (the lanes) and fingerprint of every row; rows of equal doc_id and text share one."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    each = rows.select("doc_id", F.xxhash64("text").alias("row"), F.explode(pieces(F.col("text"))).alias("p")).select("doc_id", "row", lanes(F.col("p")).alias("h"))
    sums = each.groupBy("doc_id", "row").agg(*lane_sums())
    return sums.select("doc_id", vector().alias("v")).select("doc_id", "v", text_of("v").alias("fingerprint"))


def compare(docs: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last half of code points replaced by as many of the next text's first (or all it has).
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(F.col("extra") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("after", F.lit(1), half)))
    rows = with_next(docs, chunk_bytes).select("chunk", "turn", "extra", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["chunk", "turn", "extra", "doc_id", "n_chars", "edited_sha256"]
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    each = rows.select(*keys, F.explode(kinds).alias("x")).where("x.t is not null").select(*keys, "x.kind", F.explode(pieces(F.col("x.t"))).alias("p"))
    sums = each.select(*keys, "kind", lanes(F.col("p")).alias("h")).groupBy(*keys, "kind").agg(*lane_sums()).select(*keys, "kind", vector().alias("v"))
    docs_ = sums.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("v"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("v"))).alias("edit"))
    nxt = F.lead("own").over(Window.partitionBy("chunk").orderBy("turn")).alias("nxt")
    out = docs_.select(*keys, "own", "edit", nxt).where("extra = 0")
    return out.select("doc_id", "n_chars", "edited_sha256", text_of("own").alias("fingerprint"), text_of("edit").alias("edited_fingerprint"), likeness("own", "edit").alias("near_edited"), likeness("own", "nxt").alias("near_next"))

"""N-gram Jaccard join by signature trees.

A document's set holds its distinct shingles.  Documents with equal sets form a class, of which one stands for all.
Classes that share a shingle of their prefixes (any pair that is similar enough must) are brought together; shingles are
ordered from rare to frequent by the number of chunks of documents that hold them, so that a document with enough shingles of
its own is left out and a passage which many share brings nobody together.  Each group so found goes into a signature tree: a leaf holds one set, a node the OR of its leaves' token bitmaps and the range of their sizes.
A dual traversal of the tree with itself drops pairs of nodes that cannot overlap enough and compares the sets of the
rest exactly, so that every link is counted; where only groups are asked for it also drops pairs whose leaves all hang
together already.  Groups above `block` sets are cut into blocks, every pair of which is traversed, and what they link is
joined by connected components.

Sets are compared by 64-bit hashes of shingles, classes by a 64-bit hash of the set: among 10**9 classes an error is
expected with a chance of 3 %.  Null and empty texts have empty sets and link with nothing; a document with fewer
words than a shingle has its whole sequence as its one shingle.  A null doc_id counts as larger than all; rows that
repeat are one class and link with each other; an empty table gives an empty result; other columns are not carried.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import REPLY, SENT, U, Rolling, answers, checkpointed, chunk_count, lowered, mix, pack, part_runs, sent, text_buffer, tidy, unpack, word_hashes, word_spans
from .graph import components

BITS, FANOUT, HOT = 4096, 8, 10_000
NAMED = U(0xFFFFFFFFFFFF0000)  # of a shingle's hash what brings sets together; a chance meeting costs a comparison


def shingle_sets(texts, words: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles."""
    buf, offsets = text_buffer(texts)
    buf = lowered(buf)
    starts, ends, first = word_spans(buf, offsets)
    rolling = Rolling(mix(word_hashes(buf, starts, ends)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            at = np.arange(a, b - words + 1)
            out.append(np.unique(rolling.of(at, at + words)))
        elif b > a:
            out.append(rolling.of(np.array([a]), np.array([b])) + U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def set_key(s: np.ndarray) -> int:
    return int((mix(s + U(len(s))).sum(dtype=U) ^ U(len(s) * 0x9E3779B1)).view(np.int64)) if len(s) else 0


def _signed(x) -> pa.Array:
    return pa.array(np.array(x, np.int64))


class Jaccard:
    """Links of sets a and b with 100 * |a & b| >= percent * |a | b|."""

    def __init__(self, percent: int):
        self.percent = percent

    def needed(self, sizes):
        """The least overlap of two sets whose sizes add up to `sizes`."""
        return -(-self.percent * sizes // (100 + self.percent))

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[at] == small).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)


class Tree:
    """Leaves in order of their least hashes, so that like sets are neighbours; levels of nodes over FANOUT children each."""

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        self.order = np.array(sorted(range(n), key=lambda i: (sets[i][0], len(sets[i]))))
        self.sets = [sets[i] for i in self.order]
        bits = np.zeros((n, BITS // 64), U)
        for i, s in enumerate(self.sets):
            np.bitwise_or.at(bits[i], ((s >> U(6)) % U(BITS // 64)).astype(np.int64), U(1) << (s & U(63)))
        size = np.array([len(s) for s in self.sets])
        over = size - np.bitwise_count(bits).sum(axis=1)  # shingles beyond the first on a bit
        self.levels = [(bits, size, size, over.astype(np.int64))]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, o = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(o, at)))

    def span(self, level: int, node: int) -> tuple[int, int]:
        width = FANOUT**level
        return node * width, min(len(self.sets), (node + 1) * width)

    def below(self, level: int, x: int, y: int, rule: Jaccard) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of two nodes that may hold a link, by the overlap their bitmaps allow and their sizes."""
        bits, lo, hi, over = self.levels[level - 1]
        i = np.arange(x * FANOUT, min(len(bits), (x + 1) * FANOUT))
        j = np.arange(y * FANOUT, min(len(bits), (y + 1) * FANOUT))
        most = np.bitwise_count(bits[i][:, None, :] & bits[j][None, :, :]).sum(axis=2) + np.minimum(over[i][:, None], over[j][None, :])
        ok = (most >= rule.needed(lo[i][:, None] + lo[j][None, :])) & (100 * hi[i][:, None] >= rule.percent * lo[j][None, :]) & (100 * hi[j][None, :] >= rule.percent * lo[i][:, None])
        if x == y:
            ok &= (i[:, None] < j[None, :]) if level == 1 else (i[:, None] <= j[None, :])
        p, q = np.nonzero(ok)
        return i[p], j[q]

    def least(self, label: np.ndarray) -> np.ndarray:
        """For each set, in the order given, the least index of those with its label; label: by leaf."""
        first = np.full(len(label), len(label))
        np.minimum.at(first, label, self.order)
        out = np.empty(len(label), np.int64)
        out[self.order] = first[label]
        return out


def tree_links(sets: list[np.ndarray], rule: Jaccard) -> np.ndarray:
    """For each set the least index of its component."""
    if not sets:
        return np.zeros(0, np.int64)
    tree = Tree(sets)
    n = len(sets)
    label = np.arange(n)
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        (a, b), (c, d) = tree.span(level, x), tree.span(level, y)
        if (x != y or b - a > 1) and (label[a:b] == label[a]).all() and (label[c:d] == label[a]).all():
            continue
        if level == 0:
            if x != y and rule.linked(tree.sets[x], tree.sets[y]):
                low, high = sorted((label[x], label[y]))
                label[label == high] = low
            continue
        pairs = [(level - 1, i, j) for i, j in zip(*map(np.ndarray.tolist, tree.below(level, x, y, rule)))]
        stack.extend(sorted(pairs, key=lambda z: -(z[2] - z[1]) or 0))  # near ones are popped first: they link most
    return tree.least(label)


def tree_counts(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, rule: Jaccard) -> tuple[np.ndarray, np.ndarray]:
    """For each set the least index of its component, and the copies that all sets linked with it have; sets of one side are compared only if all are of one."""
    n = len(sets)
    links, label = np.zeros(n, np.int64), np.arange(n)
    if not n:
        return label, links
    tree = Tree(sets)
    copies, side = copies[tree.order], side[tree.order]
    within = (side == side[0]).all()
    may = np.zeros((n, n), bool)
    stack = [(len(tree.levels) - 1, 0, 0)] if n > 1 else []
    while stack:
        level, x, y = stack.pop()
        i, j = tree.below(level, x, y, rule)
        if level > 1:
            stack.extend((level - 1, p, q) for p, q in zip(i.tolist(), j.tolist()))
        else:
            may[i, j] = within | (side[i] != side[j])
    sizes = np.array([len(t) for t in tree.sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    _, local = np.unique(np.concatenate(tree.sets), return_inverse=True)
    mine = np.zeros(len(local), np.uint8)  # the shingles of the set at hand
    for p in range(n):
        q = np.flatnonzero(may[p])
        if not len(q):
            continue
        own = local[starts[p] : starts[p + 1]]
        mine[own] = 1
        if 4 * len(q) > n - p:
            both = np.add.reduceat(mine[local[starts[p] :]], starts[p:-1] - starts[p], dtype=np.int64)[q - p]
        else:
            both = np.array([mine[local[starts[k] : starts[k + 1]]].sum(dtype=np.int64) for k in q])
        mine[own] = 0
        q = q[100 * both >= rule.percent * (sizes[p] + sizes[q] - both)]
        links[p] += copies[q].sum()
        links[q] += copies[p]
        of = np.unique(label[np.append(q, p)])
        if len(of) > 1:
            label[np.isin(label, of)] = of[0]
    out = np.empty(n, np.int64)
    out[tree.order] = links
    return tree.least(label), out


def _degrees(table: pa.Table) -> pa.Table:
    """For each key sent the logarithm of the number of chunks that sent it, a byte."""
    table = table.sort_by("chunk")
    keys = [unpack(b.as_py()) for b in table["keys"]]
    e = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    _, of, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    rank = np.log2(n).astype(np.uint8)[of]
    return pa.table({"chunk": table["chunk"], "part": table["part"], "phase": pa.array(np.zeros(len(keys), np.int32)), "bits": pa.array([rank[a:b].tobytes() for a, b in zip(e[:-1], e[1:])], pa.binary())})


class Shingled:
    """A chunk's sets, one for each class, and their distinct shingles."""

    def __init__(self, table: pa.Table, words: int):
        self.all = shingle_sets(table["text"], words)
        self.keys = [set_key(s) for s in self.all]
        ids = [(i is None, i or 0) for i in table["doc_id"].to_pylist()]
        self.head: dict[int, int] = {}  # of each class here the row with the least doc_id
        for row in sorted(range(len(self.keys)), key=ids.__getitem__):
            if len(self.all[row]):
                self.head.setdefault(self.keys[row], row)
        sets = [self.all[i] for i in self.head.values()]
        self.names, counts = np.unique(np.concatenate(sets) & NAMED if sets else np.zeros(0, U), return_counts=True)
        self.many = counts > 1

    def ranks(self, replies: pa.Table, parts: int) -> np.ndarray:
        """By name: 0 for what one class alone holds, else the more the more chunks hold it."""
        out = np.zeros(len(self.names), np.uint8)
        for a, b, found in answers(replies, 0, self.names, parts):
            out[a:b] = np.frombuffer(found, np.uint8)
        return np.where(out > 0, out, self.many)

    def prefix(self, s: np.ndarray, rule: Jaccard, ranks: np.ndarray) -> np.ndarray:
        """Of the set's first shingles, from rare to frequent, those that another class may hold: two linked sets share one."""
        rank = ranks[np.searchsorted(self.names, s & NAMED)]
        order = np.argsort(rank, kind="stable")[: rule.prefix(len(s))]
        return np.sort(s[order[rank[order] > 0]])


BLOBS = "part int, tokens binary, keys binary, sizes binary"


def _blobs(tokens: np.ndarray, keys: np.ndarray, sizes: np.ndarray, parts: int) -> pa.RecordBatch:
    order = np.argsort(tokens)
    tokens, keys, sizes = tokens[order] & NAMED, keys[order], sizes[order]
    own, e = part_runs(tokens, parts)
    cut = lambda f: pa.array([f(slice(a, b)) for a, b in zip(e[:-1], e[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), cut(lambda s: pack(tokens[s])), cut(lambda s: keys[s].tobytes()), cut(lambda s: sizes[s].tobytes())], ["part", "tokens", "keys", "sizes"])


def row_hash() -> Column:
    """Of doc_id and text, nulls told apart."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), F.col("text").cast("string"))


def classed(docs: DataFrame, words: int, rule: Jaccard, chunk_bytes: int) -> DataFrame:
    """doc_id, row (hash of doc_id and text), n (size of the set), key (of the set) of every row; of a row for each class and chunk also prefix and tokens, packed, if a link is possible."""
    chunks = chunk_count(docs, chunk_bytes)
    parts = max(1, chunks // 2)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_hash().alias("row"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))

    def names(table: pa.Table) -> pa.Table:
        return sent(table["chunk"][0].as_py(), Shingled(table, words).names, parts)

    def rows(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = Shingled(table, words)
        ranks = own.ranks(replies, parts)
        prefix, tokens = [None] * table.num_rows, [None] * table.num_rows
        for i in own.head.values():
            p = own.prefix(own.all[i], rule, ranks)
            if len(p):
                prefix[i], tokens[i] = pack(p), pack(own.all[i])
        return pa.table({"doc_id": table["doc_id"], "row": table["row"], "n": _signed([len(s) for s in own.all]), "key": _signed(own.keys), "prefix": pa.array(prefix, pa.binary()), "tokens": pa.array(tokens, pa.binary())})

    by_chunk = text.groupBy("chunk")
    replies = by_chunk.applyInArrow(tidy(names), SENT).groupBy("part").applyInArrow(tidy(_degrees), REPLY)
    return by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(tidy(rows), f"doc_id {kind}, row long, n long, key long, prefix binary, tokens binary")


def candidate_edges(rows: DataFrame, rule: Jaccard, parts: int) -> DataFrame:
    """u, v: keys of classes that share a prefix shingle, with sizes that allow a link.  rows: of key and prefix."""

    def send(batches):
        for b in batches:
            tokens = [unpack(p) for p in b.column(1).to_pylist()]
            if tokens:
                held = [len(t) for t in tokens]
                yield _blobs(np.concatenate(tokens), np.repeat(b.column(0).to_numpy(), held), np.repeat(b.column(2).to_numpy().astype(np.int32), held), parts)

    def meet(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([unpack(b.as_py()) for b in table["tokens"]])
        keys = np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table["keys"]])
        sizes = np.concatenate([np.frombuffer(b.as_py(), np.int32) for b in table["sizes"]]).astype(np.int64)
        order = np.lexsort((keys, sizes, tokens))
        t, k, n = tokens[order], keys[order], sizes[order]
        # along a shingle's sets by size, neighbours too far apart part the chain
        near = (t[1:] == t[:-1]) & (100 * n[:-1] >= rule.percent * n[1:]) & (k[1:] != k[:-1])
        pairs = np.unique(np.stack((np.minimum(k[1:], k[:-1]), np.maximum(k[1:], k[:-1])), axis=1)[near], axis=0)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return rows.select("key", "prefix", "n").mapInArrow(send, BLOBS).groupBy("part").applyInArrow(tidy(meet), "u long, v long")


def grouped(docs: DataFrame, words: int, percent: int, block: int, chunk_bytes: int, count: bool = False) -> DataFrame:
    """The rows of classed, each with component_id (the least doc_id of its component) and component (the key of one of its classes), both null if n is 0; with count also links (the other rows it links with)."""
    rule = Jaccard(percent)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = checkpointed(classed(docs, words, rule, chunk_bytes))
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    some = rows.where("prefix is not null")
    parts = max(16, (some.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) >> 22)
    edges = components(candidate_edges(some, rule, parts)).withColumnRenamed("u", "key")
    sizes = edges.groupBy("component").agg(F.count(F.lit(1)).alias("members")).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    group = checkpointed(edges.join(sizes, "component").join(classes, "key").select("key", "component", "blocks", "rep", "copies"))
    # Each class goes to the task of its group, or of every pair of its block with another.
    mine = F.pmod("key", F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sets = some.select("key", "doc_id", "tokens").join(group, "key").where("doc_id <=> rep").select("key", "component", "rep", "blocks", "copies", "tokens")
    tasks = sets.withColumn("mine", mine).withColumn("other", other).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("key", "ascending")])
        keys = table["key"].to_numpy()
        table = table.take(pa.array(np.sort(np.unique(keys, return_index=True)[1])))  # rows of one id may hold one class
        sets = [unpack(t.as_py()) for t in table["tokens"]]
        if count:
            of, links = tree_counts(sets, table["copies"].to_numpy(), table["mine"].to_numpy(), rule)
        else:
            of, links = tree_links(sets, rule), np.zeros(len(sets), np.int64)
        hit = np.flatnonzero((of != np.arange(len(of))) | (links > 0))
        at = pa.array(of[hit])
        return pa.table({"key": table["key"].take(pa.array(hit)), "to": table["key"].take(at), "to_rep": table["rep"].take(at), "blocks": table["blocks"].take(pa.array(hit)), "links": pa.array(links[hit])})

    links = checkpointed(tasks.select("key", "component", "rep", "blocks", "copies", "tokens", "mine", "i", "j").groupBy("component", "i", "j").applyInArrow(tidy(link), f"key long, to long, to_rep {kind}, blocks int, links long"))
    labels = links.where("blocks = 1").select("key", F.col("to_rep").alias("least"), F.col("to").alias("component"), "links")
    wide = links.where("blocks > 1")
    if not wide.isEmpty():
        joined = components(wide.select(F.col("key").alias("u"), F.col("to").alias("v"))).join(group.select(F.col("key").alias("u"), "rep"), "u")
        least = joined.groupBy("component").agg(F.min("rep").alias("least"))
        sums = wide.groupBy(F.col("key").alias("u")).agg(F.sum("links").alias("links"))
        labels = labels.unionByName(joined.join(least, "component").join(sums, "u", "left").select(F.col("u").alias("key"), "least", "component", "links"))
    # without a label the class is a component of its own; where all ids of one are null, so is component_id
    more = [(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")] if count else []
    named = classes.join(labels, "key", "left").select("key", "copies", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "key").alias("component"), *more)
    return with_classes(rows, checkpointed(named))


def with_classes(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with what named says of their key.  A class with more than 1/HOT of all copies, of which there are less than HOT, is dealt to as many tasks as it has such parts; rows without a set (n = 0) go anywhere."""
    share = F.lit(max(1, (named.agg(F.sum("copies")).first()[0] or 0) // HOT))
    parts = named.withColumn("parts", F.ceil(F.col("copies") / share).cast("int"))
    hot = F.broadcast(parts.where("parts > 1").select(F.col("key").alias("hot_key"), "parts"))
    dealt = rows.join(hot, F.expr("n > 0 and key = hot_key"), "left").withColumn("part", F.when(F.col("n") == 0, F.col("row")).otherwise(F.coalesce(F.pmod("row", "parts"), F.lit(0)))).drop("hot_key", "parts")
    names = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts", "copies")
    return dealt.join(names, ["key", "part"], "left").drop("part")


def join(docs: DataFrame, words: int = 4, percent: int = 85, block: int = 4096, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included) and n_links (other rows that it links with, copies among them) of every row."""
    rows = grouped(docs, words, percent, block, chunk_bytes, count=True)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 4096, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id (nulls last), with all its columns; rows without words stay."""
    rows = grouped(docs, words, percent, block, chunk_bytes).where("n > 0")
    ids = rows.groupBy("component", "row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    least = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("empty"), "doc_id", "row")).alias("first"))
    apart = checkpointed(ids.join(least, "component").select("row", "copies", (F.col("row") == F.col("first.row")).alias("stays")).where("not stays or copies > 1"))
    # Documents are carried in one column, so that their names and ours cannot clash.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), row_hash().alias("row"))
    kept = marked.join(apart.select("row"), "row", "left_anti")
    repeated = apart.where("stays").select("row")
    if not repeated.isEmpty():  # rows that agree in doc_id and text: one of them, any where other columns differ; each task sends on one at most
        one = marked.join(repeated, "row", "left_semi").groupBy("row").agg(F.first("whole").alias("whole"))
        kept = kept.unionByName(one.select("whole", "row"))
    return kept.select("whole.*")

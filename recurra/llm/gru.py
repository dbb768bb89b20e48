"""Language-model scoring by a gated recurrent network.

Counts of all training tokens are exact: chunks send the hashes and counts of their words, parts add them up and
answer each chunk.  The network knows the most frequent words, in classes of equal size; classes, and words in each, grow
with the fourth root of the number of distinct training words, so what it knows grows with the input.  All other words are one
symbol.  The softmax is factored: a class given the state, a word given class and state, and for the other words their
smoothed share of the counts.  Output biases begin at the logarithms of the exact shares, so the untrained network is
the unigram model, and truncated backpropagation (windows of WINDOW tokens, state carried across windows) moves it on from there.

All training rows are dealt to shards by a hash of the row, and in a shard they are in the order of that hash; each shard
trains a copy, and after each round the copies are averaged, weighted by their tokens, in whole numbers.  So neither the
partitions of the input nor a task that is run again change a score.

Scoring carries the state through a whole document, in windows, and adds up the log10 probability of its tokens.

Null texts count as empty: one token, the end.  Rows that repeat are counted and scored like any others; a null doc_id is
never held out; an empty table gives an empty result; with no training rows all words are unseen; other columns, of any names,
are not carried.  A very long text is scored in windows, but its words' hashes are held by one task.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import REPLY, SENT, U, answers, checkpointed, chunk_count, lowered, sent, text_buffer, tidy, unpack, word_hashes, word_spans

HIDDEN, WINDOW = 16, 32
LN10 = np.log(10.0)
TINY = 1e-30  # keeps the logarithm of a share that rounds to 0 finite
PRIOR = 20_000  # tokens for which the parameters before a round count, so that a few texts move them little
FINE = 1 << 20  # parameters are averaged in whole numbers of this fraction
#: Tokens in thousands are a copy's weight, so that sums of weighted parameters stay within 63 bits up to 10**13 tokens.
GRAIN = 1000


def classes_for(distinct: int) -> int:
    """Classes, and words in each, for so many distinct training words."""
    return max(8, round(1.2 * distinct**0.25))


def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each document's begin."""
    buf, offsets = text_buffer(texts)
    buf = lowered(buf)
    starts, ends, first = word_spans(buf, offsets)
    return word_hashes(buf, starts, ends), first


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _log_softmax(x):
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _softmax(x):
    """Of the rows of x, in its place; logits beyond 60, which float32 could not sum, count as 60."""
    np.exp(np.clip(x, -60, 60, out=x), out=x)
    x *= 1 / (x @ np.ones((x.shape[1], 1), x.dtype))
    return x


def _log_at(x, k):
    """Logarithm of the softmax of each row at its place k; x is used up."""
    at = np.clip(x, -60, 60, out=x)[np.arange(len(k)), k]
    np.exp(x, out=x)
    return at - np.log(x @ np.ones(x.shape[1], x.dtype))


def _by_number(x: np.ndarray, most: int) -> np.ndarray:
    """The order of small numbers, equal ones as they stand; short integers are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if most < 1 << 16 else x, kind="stable")


class Network:
    """Parameters in one vector `p`, so that copies are averaged by name of place only.

    It knows classes * width words; then come the end, all other words (each a class of its own) and the begin of a text.
    """

    def __init__(self, p: np.ndarray | None, classes: int, width: int):
        self.classes, self.width = classes, width
        self.vocab = classes * width
        self.end, self.other, self.start = self.vocab, self.vocab + 1, self.vocab + 2
        shapes = {"X": (self.vocab + 3, 3 * HIDDEN), "R": (HIDDEN, 2 * HIDDEN), "N": (HIDDEN, HIDDEN), "C": (HIDDEN, classes + 2), "c": (classes + 2,), "W": (classes, HIDDEN, width), "w": (classes, width)}
        sizes = {name: int(np.prod(shape)) for name, shape in shapes.items()}
        self.p = np.zeros(sum(sizes.values()), np.float32) if p is None else p.astype(np.float32)
        at = 0
        for name, shape in shapes.items():
            setattr(self, name, self.p[at : at + sizes[name]].reshape(shape))
            at += sizes[name]

    @classmethod
    def begun(cls, counts: np.ndarray, ends: int, others: int, classes: int, width: int, seed: int = 7) -> "Network":
        """counts: of the known words, most frequent first (0 where there are fewer)."""
        rng = np.random.default_rng(seed)
        net = cls(None, classes, width)
        net.p[:] = rng.normal(0, 0.1, len(net.p))
        by = counts.reshape(classes, width).astype(float)
        shares = np.log(np.concatenate((by.sum(axis=1), [ends, others])) + 0.5)
        net.C[:], net.W[:] = 0, 0
        net.c[:] = shares - np.log(np.exp(shares).sum())
        net.w[:] = _log_softmax(np.log(by + 0.5))
        return net

    def classes_of(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < self.vocab, words // self.width, words - self.vocab + self.classes)

    def states(self, tokens: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each of tokens (time, documents), and what backpropagation needs: update and reset gates, the state that was reset, and candidates."""
        out = np.empty((len(tokens), *h.shape), np.float32)
        cache = [np.empty_like(out) for _ in range(4)] if keep else None
        given = self.X[tokens]
        for t in range(len(tokens)):
            x = given[t]
            g = _sigmoid(x[:, : 2 * HIDDEN] + h @ self.R)
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            rh = r * h
            n = np.tanh(x[:, 2 * HIDDEN :] + rh @ self.N)
            if keep:
                for held, now in zip(cache, (z, r, rh, n)):
                    held[t] = now
            h = h + z * (n - h)
            out[t] = h
        return out, cache

    def logs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """ln P(target | state) of flat states; the others' class as a whole."""
        k = self.classes_of(target)
        order = _by_number(k, self.classes + 2)
        h, target, k = h[order], target[order], k[order]
        logits = h @ self.C
        logits += self.c
        found = _log_at(logits, k)
        e = np.searchsorted(k, np.arange(self.classes + 1))
        for c in range(self.classes):
            a, b = e[c], e[c + 1]
            if b > a:
                logits = h[a:b] @ self.W[c]
                logits += self.w[c]
                found[a:b] += _log_at(logits, target[a:b] - c * self.width)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, inputs: np.ndarray, target: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of the mean loss over a window (time, documents), the state after it, and the loss."""
        g = Network(None, self.classes, self.width)
        out, (z, r, rh, n) = self.states(inputs, h, True)
        steps, docs = inputs.shape
        live = np.flatnonzero(mask.ravel())
        y = target.ravel()[live]
        k = self.classes_of(y)
        order = _by_number(k, self.classes + 2)  # rows of a class side by side
        live, y, k = live[order], y[order], k[order]
        flat, own = out.reshape(-1, HIDDEN)[live], np.arange(len(k))
        q = flat @ self.C
        q += self.c
        q = _softmax(q)
        loss = -np.log(q[own, k] + TINY).sum()
        q[own, k] -= 1
        g.C[:], g.c[:] = flat.T @ q, q.sum(axis=0)
        back = q @ self.C.T
        e = np.searchsorted(k, np.arange(self.classes + 1))
        for c in range(self.classes):
            a, b = e[c], e[c + 1]
            if b > a:
                q = flat[a:b] @ self.W[c]
                q += self.w[c]
                q = _softmax(q)
                at = own[: b - a], y[a:b] - c * self.width
                loss -= np.log(q[at] + TINY).sum()
                q[at] -= 1
                g.W[c], g.w[c] = flat[a:b].T @ q, q.sum(axis=0)
                back[a:b] += q @ self.W[c].T
        dout = np.zeros((steps * docs, HIDDEN), np.float32)
        dout[live] = back
        dout = dout.reshape(steps, docs, HIDDEN)
        was = np.concatenate((h[None], out[:-1]))
        stay = 1 - z
        to_n, to_z, to_r = z * (1 - n * n), (n - was) * z * stay, was * r * (1 - r)
        moved = np.empty((steps, docs, 3 * HIDDEN), np.float32)  # gradients of what a token's row of X adds
        back_n, back_r = self.N.T.copy(), self.R.T.copy()
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            d, m = dh + dout[t], moved[t]
            m[:, 2 * HIDDEN :] = dn = d * to_n[t]
            drh = dn @ back_n
            m[:, :HIDDEN] = d * to_z[t]
            m[:, HIDDEN : 2 * HIDDEN] = drh * to_r[t]
            dh = d * stay[t] + drh * r[t] + m[:, : 2 * HIDDEN] @ back_r
        flat = moved.reshape(-1, 3 * HIDDEN)
        g.N[:] = rh.reshape(-1, HIDDEN).T @ flat[:, 2 * HIDDEN :]
        g.R[:] = was.reshape(-1, HIDDEN).T @ flat[:, : 2 * HIDDEN]
        order = _by_number(inputs.ravel(), self.vocab + 3)
        x = inputs.ravel()[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        g.X[x[first]] = np.add.reduceat(flat[order], first, axis=0)
        return g.p / max(1, len(live)), out[-1], float(loss)


class Trainer:
    """Adam over windows of `side` documents side by side; documents of like length share a group."""

    def __init__(self, net: Network, rate: float = 0.01, side: int = 512):
        self.net, self.rate, self.side = net, rate, side
        self.m, self.v, self.steps, self.tokens, self.loss = np.zeros_like(net.p), np.zeros_like(net.p), 0, 0, 0.0

    def learn(self, ids: np.ndarray, first: np.ndarray) -> None:
        """ids: of all documents' words without the ends; first: where each document's begin, with the end last."""
        net = self.net
        sizes = np.diff(first) + 1
        order = np.argsort(-sizes, kind="stable")
        flat = np.append(ids, net.end)
        for at in range(0, len(order), self.side):
            own = order[at : at + self.side]
            h = np.zeros((len(own), HIDDEN), np.float32)
            for t in range(0, int(sizes[own[0]]), WINDOW):
                own = own[sizes[own] > t]
                place = np.arange(t, min(t + WINDOW, int(sizes[own[0]])))[:, None]
                word = first[own] + place
                last = sizes[own] - 1
                mask = place <= last
                y = np.where(place < last, flat[np.minimum(word, len(flat) - 1)], net.end)
                x = np.where(mask & (place > 0), flat[np.clip(word - 1, 0, len(flat) - 1)], net.start)
                grad, h, loss = net.gradient(x, y, mask, h[: len(own)])
                self.loss += loss
                self.tokens += int(mask.sum())
                self.step(grad)

    def step(self, grad: np.ndarray) -> None:
        self.steps += 1
        rate = self.rate * min(1.0, self.steps / 30) * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * grad
        self.v *= np.float32(0.99)
        grad *= grad
        grad *= np.float32(0.01)
        self.v += grad
        np.sqrt(self.v, out=grad)
        grad += np.float32(1e-6)
        np.divide(self.m, grad, out=grad)
        grad *= np.float32(rate)
        self.net.p -= grad


def score(net: Network, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """ln probability of each document: ids without the ends, `first` where each document's begin; states go on across windows."""
    sizes = np.diff(first) + 1
    order = np.argsort(-sizes, kind="stable")
    n = len(sizes)
    total = np.zeros(n)
    h = np.zeros((n, HIDDEN), np.float32)
    flat = np.append(ids, net.end)
    t, longest = 0, int(sizes.max(initial=0))
    while t < longest:
        own = order[sizes[order] > t]
        place = np.arange(t, min(t + max(WINDOW, 8192 // len(own)), int(sizes[own[0]])))  # few documents, long windows
        t = int(place[-1]) + 1
        at = first[own][None, :] + place[:, None]
        last = sizes[own] - 1
        y = np.where(place[:, None] < last[None, :], flat[np.minimum(at, len(flat) - 1)], net.end)
        x = np.where(place[:, None] > 0, flat[np.clip(at - 1, 0, len(flat) - 1)], net.start)
        mask = place[:, None] <= last[None, :]
        x[~mask] = net.start
        out, _ = net.states(x, h[: len(own)])
        h = out[-1]
        live = np.flatnonzero(mask.ravel())
        p = net.logs(out.reshape(-1, HIDDEN)[live], y.ravel()[live])
        np.add.at(total, np.broadcast_to(own, mask.shape).ravel()[live], p)
    return total


def _adder(table: pa.Table) -> pa.Table:
    """For each part: the sums of all chunks, sent back in the order each chunk sent its keys; and in a row of chunk -1 the part's number of distinct words seen in training, of all such words, and its most frequent ones."""
    table = table.sort_by("chunk")
    keys = [unpack(b.as_py()) for b in table["keys"]]
    e = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    words, of = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(of, np.concatenate([np.frombuffer(b.as_py(), "<i4") for b in table["load"]])).astype(np.int64)
    back = [sums[of[a:b]].astype("<i8").tobytes() for a, b in zip(e[:-1], e[1:])]
    n = len(keys)
    stats = _tops(words, sums, int((sums > 0).sum()), int(sums.sum()))
    return pa.table(
        {
            "chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int32()),
            "part": pa.array([*table["part"].to_pylist(), table["part"][0].as_py()], pa.int32()),
            "phase": pa.array([0] * n + [1], pa.int32()),
            "bits": pa.array([*back, stats], pa.binary()),
        }
    )


def _tops(words: np.ndarray, sums: np.ndarray, distinct: int, total: int) -> bytes:
    """Numbers, then the words and counts of the most frequent: as many as the network would know of a thousand times as many distinct words.  Words are dealt to parts by hash, so of more parts than a thousand each holds far fewer of the known words than that."""
    top = np.lexsort((words, -sums))[: classes_for(1000 * max(distinct, 1000)) ** 2]
    top = top[sums[top] > 0]
    return np.concatenate(([distinct, total], words[top].view(np.int64), sums[top])).astype("<i8").tobytes()


def _read_tops(blob: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    x = np.frombuffer(blob, "<i8")
    n = (len(x) - 2) // 2
    return int(x[0]), int(x[1]), x[2 : 2 + n].view(U), x[2 + n :]


def _ids(hashes: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray], other: int) -> np.ndarray:
    """Token ids of words: vocabulary has sorted hashes and their ids; other: the id of all others."""
    keys, ids = vocabulary
    if not len(keys):
        return np.full(len(hashes), other)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, ids[at], other)


def train(docs: DataFrame, wanted: Column, net: Network, vocabulary, rounds: int, shard_bytes: int = 16 << 20) -> Network:
    """Rounds of training in all shards and averaging; what comes to the driver has the size of the network."""
    sc = docs.sparkSession.sparkContext
    row = F.xxhash64("doc_id", F.col("text").cast("string")).alias("row")
    texts = docs.where(wanted).select(F.col("text").cast("string").alias("text"), row)
    known = sc.broadcast(vocabulary)
    short = "<u2" if net.vocab + 3 < 1 << 16 else "<u4"

    def ids(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                own = whole.slice(at, 1024)
                hashes, first = words_of(own.column(0))
                found = _ids(hashes, known.value, net.other).astype(short)
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array([found[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["row", "ids"])

    # token ids take a fraction of the texts' bytes; shards have a size of their own up to 4096 of them, and grow beyond: each is read as a stream
    shards = min(4096, chunk_count(texts, shard_bytes, 24))
    rows = texts.mapInArrow(ids, "row long, ids binary").repartition(shards, "row").sortWithinPartitions("row").select("ids")
    classes, width = net.classes, net.width
    for _ in range(rounds):
        given = sc.broadcast(net.p)

        def run(batches):
            p = given.value
            trainer = Trainer(Network(p.copy(), classes, width))
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    docs = [np.frombuffer(b, short) for b in whole.column(0).slice(at, 4096).to_pylist()]
                    trainer.learn(np.concatenate(docs).astype(np.int64), np.concatenate(([0], np.cumsum([len(d) for d in docs]))))
            if trainer.tokens:
                weight = max(1, trainer.tokens // GRAIN)
                x = np.rint(trainer.net.p.astype(float) * FINE).astype(np.int64) * weight
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p), dtype=np.int32)), pa.array(x), pa.array(np.full(len(p), weight, np.int64))], ["i", "x", "n"])

        got = rows.mapInArrow(run, "i int, x long, n long").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
        given.unpersist()
        if got.num_rows:
            i, x, n = (got[c].to_numpy() for c in ("i", "x", "n"))
            p = np.zeros(len(net.p))
            p[i] = (x / FINE + PRIOR / GRAIN * net.p[i]) / (n + PRIOR / GRAIN)
            net = Network(p, classes, width)
    return net


def counted(rows: DataFrame, parts: int) -> DataFrame:
    """The rows of _adder over rows of doc_id, text, train, row and chunk."""

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        hashes, first = words_of(table["text"])
        keys, of = np.unique(hashes, return_inverse=True)
        seen = np.repeat(table["train"].to_numpy(), np.diff(first))
        return sent(table["chunk"][0].as_py(), keys, parts, np.bincount(of, seen, minlength=len(keys)).astype("<i4"))

    return checkpointed(rows.groupBy("chunk").applyInArrow(tidy(count), SENT).groupBy("part").applyInArrow(tidy(_adder), REPLY))


def vocabulary_of(counts: DataFrame, parts: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Distinct words and all words seen in training, and the most frequent words with their counts; parts meet in groups, so that the driver hears from about the square root of their number."""

    def meet(table: pa.Table) -> pa.Table:
        each = [_read_tops(b.as_py()) for b in table["bits"]]
        words, sums = (np.concatenate([x[k] for x in each]) for k in (2, 3))
        return pa.table({"bits": pa.array([_tops(words, sums, sum(x[0] for x in each), sum(x[1] for x in each))], pa.binary())})

    some = counts.where("chunk = -1").withColumn("meet", F.col("part") % max(1, math.isqrt(parts)))
    each = [_read_tops(r[0]) for r in some.groupBy("meet").applyInArrow(meet, "bits binary").collect()]
    distinct, total = sum(x[0] for x in each), sum(x[1] for x in each)
    words = np.concatenate([x[2] for x in each] or [np.zeros(0, U)])
    sums = np.concatenate([x[3] for x in each] or [np.zeros(0, np.int64)])
    top = np.lexsort((words, -sums))[: classes_for(distinct) ** 2]
    return distinct, total, words[top], sums[top]


def scored(docs: DataFrame, wanted: Column, rounds: int = 1, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    wanted: the training rows, all of which are counted and all of which the network trains on in each round.
    """
    chunks = chunk_count(docs, chunk_bytes)
    parts = max(1, chunks // 2)
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = F.xxhash64("doc_id", F.col("text").cast("string"))
    wanted = F.coalesce(wanted, F.lit(True))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), wanted.alias("train"), row.alias("row"), F.pmod(row, F.lit(chunks)).cast("int").alias("chunk"))
    counts = counted(rows, parts)
    ends = docs.where(wanted).count()
    distinct, words_seen, words, sums = vocabulary_of(counts, parts)
    side = classes_for(distinct)
    total, kinds = words_seen + ends, distinct - len(words)  # kinds: distinct words beyond the vocabulary
    distinct += ends > 0
    order = np.argsort(words)
    vocabulary = words[order], order
    frequent = np.zeros(side * side, np.int64)
    frequent[: len(sums)] = sums
    others = words_seen - int(frequent.sum())
    net = Network.begun(frequent, ends, others, side, side)
    net = train(docs, wanted, net, vocabulary, rounds) if ends else net
    given = docs.sparkSession.sparkContext.broadcast((net.p, vocabulary))  # grows with the square root of the distinct words

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        p, vocab = given.value
        net = Network(p, side, side)
        table = table.sort_by("row")
        hashes, first = words_of(table["text"])
        keys, of = np.unique(hashes, return_inverse=True)
        c = np.zeros(len(keys), np.int64)
        for a, b, found in answers(replies, 0, keys, parts):
            c[a:b] = np.frombuffer(found, "<i8")
        each = c[of]
        per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
        base_of = np.log10((each + 1) / (total + 1 * (distinct + 1)))
        base = per(base_of) + np.log10((ends + 1) / (total + 1 * (distinct + 1)))
        ids = _ids(hashes, vocab, net.other)
        within = np.where(ids == net.other, np.log((each + 1) / (others + kinds + 1)), 0.0)
        ln = score(net, ids, first) + per(within)
        n = np.diff(first)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "held_out": pa.array(~table["train"].to_numpy()),
                "n_tokens": pa.array((n + 1).astype(np.int64)),
                "n_known": pa.array((per(each > 0) + (1 if ends else 0)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(n), total, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(ln / LN10),
            }
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(counts.where("chunk >= 0").groupBy("chunk")).applyInArrow(tidy(finish), schema)

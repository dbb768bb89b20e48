"""Each operator against brute force on small tables with nulls, empty texts, ties, repeats and extra columns."""

import collections
import hashlib
import math

import numpy as np
import pytest

from recurra.llm import binpack, bpe, difference_cover, gru, langid, mixing, multiset_hash, quality, relative_lz, signature_tree
from recurra.llm.queries import tokenizer_path

pyspark = pytest.importorskip("pyspark")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, size string"
BLANK = bytes([32, *range(9, 14)])


def low(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdeéßTH"), rng.integers(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    passage, texts = say(60), [None, "", " \n\t", "one", "Ünï cödé 中文 😀 don't"]
    for k in range(60):
        t = say(int(rng.integers(5, 150)))
        texts += [t] + [t + " " + say(3)] * (k % 9 == 0) + [t] * (k % 7 == 0) + [say(8) + "\n" + passage + "\n" + say(9)] * (k % 11 == 0)
    texts += ["ab ab ab " * 400, "THE END!! " * 30, "x | y | z | # $ " * 20, "aaaa" * 200]
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return out + [out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_binpack(docs, none, rows):
    got = binpack.shard(docs, 4).toPandas()
    assert len(got) == len(rows) and sum(got["size"]) == sum(len((r[1] or "").encode()) + 16 for r in rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.05 * sizes.mean()
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1
    assert binpack.shard(none, 4).count() == 0


def test_every_group_is_placed_by_its_dot_product(spark):
    """Shards of many small, some large and one huge group differ by little in bytes, tokens and rows; groups below a share stay whole."""
    rng = np.random.default_rng(2)
    texts = ["w " * int(n) for n in rng.integers(1, 400, 3000)] + ["x" * int(n) for n in rng.integers(1, 3000, 500)] + ["same " * 300] * 2000 + [None] * 300
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = binpack.shard(d, 8).toPandas()
    sums = got.groupby("shard")[["size", "tokens", "doc_id"]].agg({"size": "sum", "tokens": "sum", "doc_id": "count"})
    spread = (sums.max() - sums.min()) / sums.mean()
    assert spread["size"] < 0.02 and spread["tokens"] < 0.1 and spread["doc_id"] < 0.4
    shards_of = got.groupby("text_crc32")["shard"].nunique()
    assert (shards_of > 1).sum() == 1


def test_place_follows_the_dot_product():
    """Against the rule in plain Python."""
    rng = np.random.default_rng(4)
    v, shards = rng.integers(1, 50, (60, 3)).astype(float), 4
    cap = np.tile(v.sum(axis=0) / shards, (shards, 1))
    got, left = binpack.place(v, cap)
    w = [2.0, 1.0, 1.0]
    rel = [[v[i][d] / cap[0][d] * w[d] for d in range(3)] for i in range(60)]
    res = [list(w) for _ in range(shards)]
    for i in sorted(range(60), key=lambda i: -max(rel[i])):
        fits = [k for k in range(shards) if res[k][0] >= rel[i][0]] or list(range(shards))
        best = max(fits, key=lambda k: (round(sum(a * b for a, b in zip(res[k], rel[i])), 9), -k))
        assert got[i] == best
        res[best] = [a - b for a, b in zip(res[best], rel[i])]
    assert np.allclose(left.sum(axis=0), 0)


def test_names_that_clash(spark, docs, rows):
    """Columns of any names pass through the operators that carry them."""
    from pyspark.sql import functions as F

    names = ["_gone", "_c", "_n", "_k", "_s", "_b", "_m", "_block", "_before", "_oc", "_row", "row", "whole", "part", "order", "copy", "k", "c", "of", "position", "pattern", "q", "a.b"]
    wide = docs.select("*", *[F.lit(x).alias(x) for x in names])
    for f in (mixing.in_order, signature_tree.keep_one, difference_cover.without_repeats, quality.filter_quality):
        got, plain = f(wide), f(docs)
        assert got.columns == wide.columns and got.where(" and ".join(f"`{x}` = '{x}'" for x in names)).count() == plain.count() > 0
    assert mixing.mix_sources(wide).columns == wide.columns + ["_mix"]


def test_null_and_repeated_ids(spark):
    """Null doc_ids in every operator: no row is lost."""
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(None, text, None, None), (None, text, "en", "s"), (None, None, "en", "s"), (4, text + " x", "en", "s"), (4, "", None, "s")], "doc_id long, text string, lang string, source string")
    for f in (lambda d: binpack.shard(d, 2), mixing.mix_sources, quality.judged, relative_lz.dedup, lambda d: bpe.encode(d, tokenizer_path()), signature_tree.join, lambda d: langid.identify(d, F.lit(True)), lambda d: gru.scored(d, F.col("doc_id") % 7 != 2), multiset_hash.compare, difference_cover.dedup):
        assert f(d).count() == 5
    assert {r.doc_id: r.held_out for r in gru.scored(d, F.col("doc_id") % 7 != 4).collect()} == {None: False, 4: True}


def test_mixing(docs, none, rows):
    got = [r["_mix"].asDict() | {"source": r["source"]} for r in mixing.mix_sources(docs, block_rows=4, slots=60).collect()]
    assert sorted(g["position"] for g in got) == list(range(len(rows)))
    assert all(g["release"] <= g["slot"] < g["deadline"] for g in got)
    turns = {g["turn"]: g["source"] for g in got}
    left = collections.Counter(turns.values())
    share = {s: {g["deadline"] - g["release"] for g in got if g["source"] == s} for s in left}
    assert sorted(turns) == list(range(sum(left.values()))) and len(share) == 4
    assert mixing.in_order(docs, block_rows=4, slots=60).columns == docs.columns
    assert mixing.mix_sources(none).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 1 / 3, "b": 2 / 3, "c": 0.0}, {"a": 1.0}])
def test_mixing_keeps_exact_weights(spark, weights):
    from fractions import Fraction

    n = {"a": 1500, "b": 2600, "c": 40} | ({f"d{i}": 3 for i in range(30)} if weights is None else {})
    d = spark.createDataFrame([(f"{s}{i}", s) for s, k in n.items() for i in range(k)], "doc_id string, source string")
    got = [r["_mix"].asDict() | {"source": r["source"]} for r in mixing.mix_sources(d, block_rows=1, slots=20, weights=weights).collect()]
    assert sorted(g["position"] for g in got) == sorted(g["turn"] for g in got) == list(range(sum(n.values())))
    w = {s: Fraction(math.isqrt(k * 1_000_000)) if weights is None else Fraction(weights.get(s, 0)).limit_denominator(10) for s, k in n.items()}
    total = sum(w.values())
    for g in got:
        k, share = g["block"], w[g["source"]] / total
        if share:
            assert (g["release"], g["deadline"]) == (math.floor(k / share), math.ceil((k + 1) / share)) and g["release"] <= g["slot"] < g["deadline"]
        else:
            assert g["slot"] is None and g["turn"] >= sum(k for s, k in n.items() if w[s])
    slots = [g["slot"] for g in got if g["slot"] is not None]
    assert len(set(slots)) == len(slots)
    assert [g["slot"] for g in sorted(got, key=lambda g: g["turn"]) if g["slot"] is not None] == sorted(slots)


def brute_quality(t):
    t = t or ""
    w = t.encode().split()
    g = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    m = [0] * len(w)
    for i in range(len(w) - 4):
        if g[tuple(w[i : i + 5])] > 1:
            m[i : i + 5] = [1] * 5
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(m)


def test_quality(docs, none, rows):
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for r in rows:
        o = got[r[0]]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == brute_quality(r[1])
        assert o.base_failed == (o.n_words < 10 or 100 * o.n_repeat_words > 20 * o.n_words) and not (o.kept and o.base_failed)
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, o in got.items() if o.kept}
    assert quality.judged(none).count() == 0 and quality.filter_quality(none).count() == 0


def test_relative_lz(docs, none, rows):
    seen, want = set(), collections.Counter()
    for r in sorted(rows, key=lambda r: r[0]):
        w = (r[1] or "").encode().split()
        m = [0] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                m[i : i + 20] = [1] * 20
            seen.add(k)
        want[r[0], len(w), sum(m), b" ".join(x for x, y in zip(w, m) if not y).decode()] += 1
    assert collections.Counter(map(tuple, relative_lz.dedup(docs, chunk_bytes=3000).collect())) == want
    assert relative_lz.factors(docs, chunk_bytes=3000).where("length < 20").count() == 0
    assert relative_lz.dedup(none).count() == 0


def test_bpe(docs, none, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.no_padding(), t.no_truncation()
    got = {r.doc_id: r for r in bpe.encode(docs, tokenizer_path()).collect()}
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]].ids == ids and got[r[0]].decoded == t.decode(ids, skip_special_tokens=False) and got[r[0]].n_tokens == len(ids)
    assert bpe.decode(bpe.encode(docs, tokenizer_path()).select("doc_id", "ids"), tokenizer_path()).count() == len(rows)
    assert bpe.encode(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_signature_tree(docs, none, rows, block):
    def shingles(t):
        w = low(t).split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links, times = collections.Counter(), collections.Counter(r[0] for r in rows)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
                links[a] += times[b] - (a == b)
    got = signature_tree.join(docs, block=block).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == {(i, len(s), top(i), links[i]) for i, s in sets.items()}
    assert signature_tree.join(none).count() == 0


@pytest.mark.parametrize("n, apart", [(1, 1), (90, 1), (300, 3), (300, 300)])
def test_tree_counts_every_link(n, apart):
    """Against all pairs, in one block and across two, on sets in groups of near copies that differ by more and less than the bound."""
    rng = np.random.default_rng(n)
    rule = signature_tree.Jaccard(85)
    base = [rng.integers(0, 2**63, 40).astype(np.uint64) for _ in range(apart)]
    sets = [np.unique(np.append(base[i % apart][: 40 - int(rng.integers(0, 8))], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64))) for i in range(n)]
    copies, sides = rng.integers(1, 5, n), rng.integers(0, 2, n)
    for side in (np.zeros(n, int), sides):
        label, links = list(range(n)), [0] * n
        for a in range(n):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if (side[a] != side[b] or not side.any()) and 100 * len(x & y) >= 85 * len(x | y):
                    links[a] += copies[b]
                    links[b] += copies[a]
                    low, high = sorted((label[a], label[b]))
                    label = [low if v == high else v for v in label]
        of, got = signature_tree.tree_counts(sets, copies, side, rule)
        assert of.tolist() == label and got.tolist() == links
        if not side.any():
            assert signature_tree.tree_links(sets, rule).tolist() == label


def test_keep_one_leaves_one_of_each_group(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    one, two, three, four = map(say, range(4))
    near = one + " end"
    rows = [(5, one), (5, one), (3, near), (None, one), (7, two), (7, two), (7, two), (None, three), (None, three), (9, four), (9, say(9)), (None, say(8)), (11, " "), (11, " ")]
    d = spark.createDataFrame([(i, t, None, "s", len(t), 1, "x") for i, t in rows], SCHEMA).repartition(3)
    got = signature_tree.keep_one(d)
    want = [(3, near), (7, two), (None, three), (9, four), (9, say(9)), (None, say(8)), (11, " "), (11, " ")]
    assert got.columns == d.columns and collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(want)


def test_langid(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    got = langid.identify(d, F.col("doc_id") % 4 != 2).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()
    greek, cyrillic = ["αβγδ εζηθ ικλμ νξοπ " * 9], ["абвг дежз иклм нопр " * 9]
    few = spark.createDataFrame([(1, greek[0], "el"), (2, cyrillic[0], "ru"), (6, greek[0][7:], None), (10, cyrillic[0][7:], None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(few, F.col("doc_id") < 3).collect()} == {1: "el", 2: "ru", 6: "el", 10: "ru"}
    assert langid.classify([None, "123", "ab"], [], np.zeros((0, 8), np.float32))[0] == ["und"] * 3
    assert langid.identify(none, F.lit(True)).count() == 0


def test_gru(docs, none, rows):
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in gru.scored(docs, F.col("doc_id") % 3 != 1).collect()}
    words = {r[0]: low(r[1]).split() + [None] for r in rows}
    c = collections.Counter(w for r in rows if r[0] % 3 != 1 for w in words[r[0]])
    n, v = sum(c.values()), len(c)
    for i, o in got.items():
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words[i])
        assert abs(o.base_score - base) < 1e-6 * abs(base) and o.train_tokens == n and o.n_known == sum(c[w] > 0 for w in words[i])
    assert sum(o.score for o in got.values()) > sum(o.base_score for o in got.values()) - 50
    assert gru.scored(none, F.lit(True)).count() == 0


def test_gru_trains_on_all_training_rows(docs, rows, monkeypatch):
    from pyspark.sql import functions as F

    given, train = [], gru.train
    monkeypatch.setattr(gru, "train", lambda d, wanted, *a: given.extend(r.doc_id for r in d.where(wanted).collect()) or train(d, wanted, *a))
    gru.scored(docs, F.col("doc_id") % 3 != 1).count()
    assert sorted(given) == sorted(r[0] for r in rows if r[0] % 3 != 1)


def test_gru_scores_do_not_depend_on_partitions(docs):
    from pyspark.sql import functions as F

    one, many = ({(r.doc_id, r.n_tokens): r.score for r in gru.scored(docs.repartition(n), F.col("doc_id") % 3 != 1, chunk_bytes=4000).collect()} for n in (1, 8))
    assert one == many


def test_gru_gains_on_held_out_texts(spark):
    from recurra.llm.queries import crc_of_id

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = gru.scored(d, crc_of_id(7) != 2, rounds=3).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > 0.99 * got.b


def test_gru_gradient():
    rng = np.random.default_rng(1)
    classes, width = 6, 5
    net = gru.Network.begun(rng.integers(1, 50, classes * width), 5, 100, classes, width)
    net.p[:] += rng.normal(0, 0.1, len(net.p)).astype(np.float32)
    x, y = rng.integers(0, net.vocab, (4, 3)), rng.integers(0, net.vocab + 2, (4, 3))
    run = lambda p: gru.Network(p, classes, width).gradient(x, y, np.ones((4, 3), bool), np.zeros((3, gru.HIDDEN), np.float32))
    g = run(net.p)[0]
    for i in np.argsort(-np.abs(g))[[0, 20, 200]]:
        a, b = net.p.copy(), net.p.copy()
        a[i] += 3e-2
        b[i] -= 3e-2
        assert abs((run(a)[2] - run(b)[2]) / 12 / 6e-2 - g[i]) < 1e-3


def test_multiset_hash(docs, none, rows):
    got = collections.defaultdict(list)
    for r in multiset_hash.compare(docs).collect():
        got[r.doc_id].append(r)
    order = sorted(rows, key=lambda r: -r[0])
    want = collections.Counter()
    for i, r in enumerate(order):
        t, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        want[r[0], hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    assert collections.Counter((o.doc_id, o.edited_sha256) for v in got.values() for o in v) == want
    prints = {r[1] or "": got[r[0]][0].fingerprint for r in rows}
    assert all(got[r[0]][0].fingerprint == prints[r[1] or ""] for r in rows)
    assert multiset_hash.compare(none).count() == 0


def test_multiset_hash_puts_in_and_takes_out(spark):
    """Paragraphs put in or taken out give the fingerprint of the text with or without them, in any order."""
    say = lambda k: f"paragraph {k} of some length.\n"
    before = {1: [0, 1, 2], 2: [3, 3, 4], 3: [5], None: [6, 7]}
    after = {1: [2, 8, 0, 8], 2: [3], 3: [5], None: [7, 9]}
    make = lambda d: multiset_hash.fingerprints(spark.createDataFrame([(i, "".join(map(say, ks))) for i, ks in d.items()], "doc_id long, text string"))
    edits = [(i, say(k), sign) for i in before for ks, sign in ((after[i], 1), (before[i], -1)) for k in ks if i != 3]
    got = multiset_hash.changed(make(before), spark.createDataFrame(edits, "doc_id long, piece string, sign int"))
    assert {(r.doc_id, tuple(r.v.exact), tuple(r.v.signs)) for r in got.collect()} == {(r.doc_id, tuple(r.v.exact), tuple(r.v.signs)) for r in make(after).collect()}


def test_multiset_likeness_follows_what_is_shared(spark):
    rng = np.random.default_rng(3)
    texts = [[f"line {k} {rng.integers(1e9)}\n" for _ in range(200)] for k in range(2)]
    mixed = ["".join(texts[0][:k] + texts[1][k:]) for k in (200, 150, 100, 50, 0)]
    prints = multiset_hash.fingerprints(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")).select("doc_id", "v")
    both = prints.join(prints.where("doc_id = 0").selectExpr("v as w"))
    got = {r.doc_id: r.x for r in both.select("doc_id", multiset_hash.likeness("v", "w").alias("x")).collect()}
    assert got[0] == 1 and all(abs(got[i] - (1 - i / 4)) < 0.2 for i in got)


def test_string_ids(spark, docs, rows):
    """doc_ids that are strings, null ones too, give what the numbers in the same order give."""
    from pyspark.sql import functions as F

    named = docs.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    same = lambda f: sorted((f"d{r[0]:05d}", *r[1:]) for r in f(docs).collect()) == sorted(tuple(r) for r in f(named).collect())
    assert same(lambda d: relative_lz.dedup(d, chunk_bytes=3000))
    assert same(lambda d: multiset_hash.compare(d, chunk_bytes=3000).select("doc_id", "n_chars", "edited_sha256", "fingerprint"))


def test_difference_cover(docs, none, rows):
    assert len({(a - b) % 133 for a in difference_cover.COVER for b in difference_cover.COVER}) == 133
    c = collections.Counter(x[i : i + 200] for r in rows for x in [(r[1] or "").encode()] for i in range(len(x) - 199))
    want = collections.Counter()
    for r in rows:
        x = (r[1] or "").encode()
        m = bytearray(len(x))
        for i in range(len(x) - 199):
            if c[x[i : i + 200]] > 1:
                m[i : i + 200] = b"\1" * 200
        want[r[0], len(x), sum(m), len([s for s in bytes(m).split(b"\0") if s]), bytes(a for a, y in zip(x, m) if not y)] += 1
    got = difference_cover.dedup(docs, chunk_bytes=3000).collect()
    assert collections.Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == want
    assert difference_cover.without_repeats(docs).columns == docs.columns
    assert difference_cover.dedup(none).count() == 0


def test_pipeline_stages_row_by_row(spark):
    """Every stage, and run() as a whole, against plain Python: what the rules keep, one of each group at five words and 0.8, no string of 200 bytes twice, all rows in the mix, the tokenizers library's ids."""
    cp = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(vocab, n)) + "."
    passage, texts = say(60), []
    for k in range(40):
        t = say(int(rng.integers(30, 120)))
        texts += [t] + [t] * (k % 8 == 0) + [t + " " + say(2)] * (k % 10 == 1) + [say(20) + " " + passage + " " + say(20)] * (k % 13 == 0)
    texts += [None, "", "too few words", "ab ab ab " * 300, "# $ % | " * 80]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert {i for i, t in enumerate(texts) if t and len(t.split()) >= 25 and len(set(t.split())) > 10} == kept  # all prose stays, all junk goes
    first = cp.STAGES[0][1](spark, docs, None)
    assert {r.doc_id: r.text for r in first.collect()} == {i: texts[i] for i in kept}

    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in kept for w in [low(texts[i]).split()]}
    up = {i: i for i in kept}
    top = lambda i: i if up[i] == i else top(up[i])
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    one = {i for i in kept if top(i) == i}
    second = cp.STAGES[1][1](spark, first, None)
    assert {r.doc_id for r in second.collect()} == one and second.count() == len(one) < len(kept)

    raw = {i: texts[i].encode() for i in one}
    seen = collections.Counter(x[k : k + 200] for x in raw.values() for k in range(len(x) - 199))
    left = {}
    for i, x in raw.items():
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        left[i] = bytes(c for c, g in zip(x, gone) if not g).decode("utf-8", "ignore")
    third = cp.STAGES[2][1](spark, second, None)
    assert {r.doc_id: (r.text, r.n_chars) for r in third.collect()} == {i: (t, len(t)) for i, t in left.items()} and any(left[i] != texts[i] for i in one)

    fourth = cp.STAGES[3][1](spark, third, None)
    assert sorted(map(tuple, fourth.collect())) == sorted(map(tuple, third.collect()))
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.no_padding(), t.no_truncation()
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in left.items()}
    want = {i: (len(n), hashlib.sha256(" ".join(map(str, n)).encode()).hexdigest(), hashlib.sha256(t.decode(n, skip_special_tokens=False).encode()).hexdigest()) for i, n in ids.items()}
    got = fourth
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.STAGES[4][1](spark, got, None).collect()} == want
    cp_docs, cp.documents = cp.documents, lambda s, d: docs
    try:
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, "").collect()} == want
    finally:
        cp.documents = cp_docs


def test_pipeline(spark):
    cp = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = d.columns
    for name, stage in cp.STAGES[:-1]:
        before, d = d.count(), stage(spark, d, None).cache()
        assert d.columns == names and 0 < d.count() <= before
    assert cp.STAGES[-1][1](spark, d, None).count() == d.count()

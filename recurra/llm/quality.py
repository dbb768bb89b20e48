"""Quality rules by weak supervision.

Eleven rules vote good (+1), bad (-1) or abstain (0) on each document.  Expectation-maximisation
over the counts of vote patterns (at most 3**11, whatever the number of documents) estimates how
often each rule votes what for good and for bad documents, and a document is kept when its
posterior probability of being good reaches the threshold.

Null texts count as empty; an empty text has no words and fails the base rule.  Rows that repeat
are judged alike; an empty table gives an empty result; other columns pass through filter_quality.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, give_back, mix, text_buffer, U, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bangs", "n_stops", "n_distinct", "n_marked", "n_bare"]


def _flags(chars) -> np.ndarray:
    t = np.zeros(256, np.int8)
    t[list(chars)] = 1
    return t


_SYMBOL, _UPPER, _BANG, _STOP = _flags(SYMBOLS), _flags(range(65, 91)), _flags(b"!"), _flags(b".")
_LETTER = _flags([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)])  # a letter beyond ASCII counts by its first byte
_WORDY = _LETTER | _flags(range(48, 58))
_SOLID = (~SPACE & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int8)  # first bytes of code points in words


def _sums(values: np.ndarray) -> np.ndarray:
    s = np.zeros(len(values) + 1, np.int32)
    np.cumsum(values, out=s[1:])
    return s


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    s = _sums(values)
    return (s[offsets[1:]] - s[offsets[:-1]]).astype(np.int64)


def _first_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it is one too many of its equals (all but one of them are), and whether it has an equal at all."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    before, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return before, shared


def features(texts, step: int = 1 << 20) -> dict[str, np.ndarray]:
    """FEATURES of each whole text, by runs of documents of about `step` bytes, which keep within the processor's caches."""
    buf, offsets = text_buffer(texts)
    cuts = np.searchsorted(offsets, np.arange(0, len(buf), step), side="right") - 1 if len(buf) else np.zeros(1, int)
    cuts = np.unique(np.concatenate(([0], cuts, [len(offsets) - 1])))
    runs = [_features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in zip(cuts[:-1], cuts[1:])]
    return {c: np.concatenate([r[c] for r in runs]) if runs else np.zeros(0, np.int64) for c in FEATURES}


def _features(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, first = word_spans(buf, offsets)
    wh = word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(n, dtype=U), np.diff(first))
    salt = mix(doc + U(1))
    before, _ = _first_of_equal(wh ^ salt)
    repeat = np.zeros(len(wh), bool)
    if len(wh) >= 5:
        grams = np.zeros(len(wh) - 4, U)
        for j in range(5):
            grams = grams * U(0x9E3779B97F4A7C15) + mix(wh[j : len(wh) - 4 + j])
        inside = np.flatnonzero(doc[4:] == doc[:-4])
        _, shared = _first_of_equal(mix(grams[inside]) ^ salt[inside])
        at = inside[shared]
        for j in range(5):
            repeat[at + j] = True
    lines, line_doc, dup = np.zeros(n, np.int64), None, np.zeros(n, np.int64)
    if len(buf):
        cut = np.flatnonzero(buf == 10)
        ls = np.sort(np.concatenate((offsets[:-1], cut + 1)), kind="stable")
        line_doc = np.sort(np.concatenate((np.arange(n), np.searchsorted(offsets, cut, side="right") - 1)), kind="stable")
        # a line ends before its \n, or at its document's end
        nxt = np.append(ls[1:], len(buf))
        last = np.append(line_doc[1:] != line_doc[:-1], True)
        le = np.where(last, offsets[line_doc + 1], nxt - 1)
        worded = np.searchsorted(starts, ls) < np.searchsorted(starts, le)
        ls, le, line_doc = ls[worded], le[worded], line_doc[worded]
        lh = word_hashes(buf, ls, le)
        again, _ = _first_of_equal(lh ^ mix(line_doc.astype(U) + U(1)))
        lines, dup = np.bincount(line_doc, minlength=n), np.bincount(line_doc, again, minlength=n).astype(np.int64)
    count = lambda flags: _per_doc(flags[buf], offsets)
    symbols, letters = _sums(_SYMBOL[buf]), _sums(_WORDY[buf])
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": count(_SOLID),
        "n_symbols": count(_SYMBOL),
        "n_dup_lines": dup,
        "n_repeat_words": _per_doc(repeat, first),
        "n_lines": lines.astype(np.int64),
        "n_letters": count(_LETTER),
        "n_upper": count(_UPPER),
        "n_bangs": count(_BANG),
        "n_stops": count(_STOP),
        "n_distinct": _per_doc(~before, first),
        "n_marked": _per_doc(symbols[ends] > symbols[starts], first),
        "n_bare": _per_doc(letters[ends] == letters[starts], first),
    }


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v) for v in features(b.column(1)).values())], ["doc_id", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in FEATURES)]))


def votes(c=F.col) -> dict[str, tuple[Column, Column]]:
    """For each rule: when it votes bad, and when it votes good; else it abstains.  c: gives a feature's column."""
    per_word = lambda x, k: c(x) * 100 > k * c("n_words")
    return {
        "length": (c("n_words") < 10, c("n_words") >= 25),
        "word_length": ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")), (c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 10 * c("n_words"))),
        "marked_words": (per_word("n_marked", 15), ~per_word("n_marked", 5)),
        "bare_words": (per_word("n_bare", 15), ~per_word("n_bare", 5)),
        "symbols": (per_word("n_symbols", 10), ~per_word("n_symbols", 2)),
        "dup_lines": (c("n_dup_lines") * 10 > 3 * c("n_lines"), c("n_dup_lines") * 10 <= c("n_lines")),
        "repeats": (per_word("n_repeat_words", 20), ~per_word("n_repeat_words", 5)),
        "capitals": (c("n_upper") * 10 > 4 * c("n_letters"), c("n_upper") * 10 <= 2 * c("n_letters")),
        "bangs": (per_word("n_bangs", 20), ~per_word("n_bangs", 4)),
        "stops": ((c("n_stops") == 0) & (c("n_words") >= 40), c("n_stops") * 80 >= c("n_words")),
        "variety": ((c("n_distinct") * 100 < 12 * c("n_words")) & (c("n_words") >= 20), c("n_distinct") * 10 >= 3 * c("n_words")),
    }


def pattern_code(c=F.col) -> Column:
    """The votes as digits of base 3: 0 bad, 1 abstains, 2 good."""
    code = F.lit(0)
    for bad, good in votes(c).values():
        code = code * 3 + F.when(bad, 0).when(good, 2).otherwise(1)
    return code.cast("int")


def fit(counts: dict[int, int], rules: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for two classes over vote patterns: P(vote | class) by class, rule and vote; each pattern's posterior of being good; the share of good.

    Pseudo-counts (a fiftieth of the documents, 10 at least) hold to what a rule is for: good documents are rarely voted bad.
    """
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in codes.tolist()], float)
    digits = (codes[:, None] // 3 ** np.arange(rules - 1, -1, -1)) % 3
    hot = np.eye(3)[digits]  # pattern, rule, vote
    strength = max(10.0, n.sum() / 50)
    prior = np.array([[0.25, 0.10, 0.65], [0.002, 0.098, 0.90]])[:, None, :] * strength  # class bad, good
    theta = np.repeat(prior / strength, rules, axis=1)
    share = 0.8
    good = np.zeros(len(codes))
    for _ in range(rounds):
        logs = np.einsum("prv,crv->pc", hot, np.log(theta)) + np.log([1 - share, share])
        was, good = good, 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        weight = np.stack((n * (1 - good), n * good))
        theta = np.einsum("cp,prv->crv", weight, hot) + prior
        theta /= theta.sum(axis=2, keepdims=True)
        share = float((weight[1].sum() + 8) / (n.sum() + 10))
        if np.abs(good - was).max(initial=0) < 1e-9:
            break
    return theta, good, share


def base_failed(c=F.col) -> Column:
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def pattern_probabilities(rows: DataFrame) -> dict[int, float]:
    """P(good) of each vote pattern in rows that have a column pattern; at most 3**11 of them come to the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy("pattern").count().collect()}
    return dict(zip(sorted(counts), fit(counts, len(votes()))[1].tolist())) if counts else {}


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, FEATURES, pattern, p_good, base_failed and kept of every document (those with a null doc_id too)."""
    rows = checkpointed(feature_rows(docs).withColumn("pattern", pattern_code()))
    table = docs.sparkSession.createDataFrame(list(pattern_probabilities(rows).items()), "pattern int, p_good double")
    return rows.join(F.broadcast(table), "pattern").withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & (F.col("p_good") >= threshold))


def filter_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that are kept.

    Features are computed again beside the whole rows, which costs less than a shuffle of the texts.
    """
    names = docs.columns
    table = [k for k, p in pattern_probabilities(feature_rows(docs).select(pattern_code().alias("pattern"))).items() if p >= threshold]

    @F.arrow_udf(f"struct<{', '.join(f'{c}:bigint' for c in FEATURES)}>")
    def measured(texts: pa.Array) -> pa.Array:
        out = pa.StructArray.from_arrays([pa.array(v) for v in features(texts).values()], FEATURES)
        give_back()
        return out

    # Only texts go to Python; undeterministic, so that the filter is not pushed below and measures twice.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), measured.asNondeterministic()(F.col("text").cast("string")).alias("q"))
    of = lambda name: F.col("q." + name)
    good = docs.sparkSession.createDataFrame([(k,) for k in table], "pattern int")
    return rows.where(~base_failed(of)).withColumn("pattern", pattern_code(of)).join(F.broadcast(good), "pattern", "left_semi").select("row.*")

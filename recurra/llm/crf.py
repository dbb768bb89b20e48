"""A linear-chain conditional random field over word shapes, trained and decoded in numpy.

Words are told apart by their class only: a cue word, a shape (runs of letters, runs of digits with their length, marks), or plain.
A word's score for each label is the sum of the weights of the features of the classes of the five words around it; neighbouring
labels add a transition's weight.  Labels are O, and B and I of each kind.  Texts begin and end beside words of class edge, labelled O.

Viterbi runs over whole texts.  Among plain words the lead of O grows with each word, while what transitions could win for another
path is bounded, so plain words far enough from all others are O in the best path whatever stands around them (Model.depth says how
far), and the path falls apart there without loss; the runs between are decoded together, those of like length side by side.
"""

import re
from dataclasses import dataclass, field

import numpy as np

from .common import U, word_spans

WINDOW = (-2, -1, 0, 1, 2)
#: Words of at most eight letters that may tell a kind, in a few languages.
CUES = (
    *("at", "dot", "punkt", "punto", "point", "arroba", "chez", "email", "mail", "correo", "write", "contact", "kontakt"),
    *("phone", "tel", "telefon", "call", "fax", "mobile", "cell", "ring", "text", "dial", "ext", "rufen", "appelez", "llame"),
    *("card", "visa", "carte", "tarjeta", "karte", "credit", "pay", "ip", "host", "server", "address", "ping", "adresse", "node"),
    *("version", "section", "page", "order", "invoice", "isbn", "date"),
)
EDGE, PLAIN = 0, 1
PARTS = 48
_MARK = np.zeros(256, bool)
_MARK[[*b"0123456789@+()[]{}"]] = True
_JOIN = np.zeros(256, bool)
_JOIN[[*b"._:/-"]] = True
_SHAPE = re.compile(rb"[0-9]+|[A-Za-z\x80-\xff]+|[-@.+()\[\]{}:/_=]|[^-0-9A-Za-z\x80-\xff@.+()\[\]{}:/_=]+")
_LONG = {**{n: str(n) for n in range(1, 8)}, 8: "8", 9: "8", 10: "A", 11: "A", 12: "A", 13: "D", **{n: "N" for n in range(14, 20)}}


def shape(word: bytes) -> str:
    """x for letters, 9 and a length for digits, most marks as they are, other marks left out; closing marks at the end do not count.

    Shapes of more than PARTS parts are all one, as no kind has such words.
    """
    out, parts = [], _SHAPE.findall(word.rstrip(b".,;:!?\"'"))
    for part in parts if len(parts) <= PARTS else []:
        if 48 <= part[0] <= 57:
            out.append("9" + _LONG.get(len(part), "H"))
        elif part[0] >= 128 or part.isalpha():
            out.append("x")
        elif len(part) == 1 and part in b"-@.+()[]{}:/_=":
            out.append(part.decode())
    return "".join(out) or ("~" if len(parts) > PARTS else word[:1].decode("latin-1"))


def shape_features(s: str) -> list[str]:
    coarse = re.sub("9.", "9", s)
    digits = len(re.findall("9.", s))
    return [f"s={s}", f"c={coarse}", f"k={re.sub('[-./_:]', '.', coarse)}", f"n={min(digits, 5)}", *[f"m={m}" for m in "@+()[].-/" if m in s], "digits" if digits else "none"]


def _packed_cues() -> np.ndarray:
    return np.array([int.from_bytes(c.encode().ljust(8, b"\0"), "little") for c in CUES], U)


_CUE = _packed_cues()
_CUE_ORDER = np.argsort(_CUE)
_LOW = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)


@dataclass
class Words:
    """Words of some texts, one after the other: where each begins and ends, the text's first word with the end last, and the words' classes."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    classes: np.ndarray


@dataclass
class Classes:
    """Numbers of classes; shapes get theirs as they come."""

    shapes: dict[str, int] = field(default_factory=dict)
    words: dict[bytes, int] = field(default_factory=dict)

    def names(self) -> list[list[str]]:
        """The features of each class."""
        return [["edge"], ["plain"], *[[f"w={c}", "cue"] for c in CUES], *map(shape_features, self.shapes)]

    def of_word(self, word: bytes) -> int:
        k = self.words.get(word)
        if k is None:
            k = self.shapes.setdefault(shape(word), 2 + len(CUES) + len(self.shapes))
            if len(word) <= 64:
                if len(self.words) > 50_000:
                    self.words.clear()
                self.words[word] = k
        return k

    def words_of(self, buf: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends, first = word_spans(buf, offsets)
        classes = np.full(len(starts), PLAIN, np.int64)
        if not len(starts):
            return Words(starts, ends, first, classes)
        # cue words, without the marks around them
        a, b = starts.copy(), ends.copy()
        odd = ~_is_letter[buf]
        a += odd[a] & (a + 1 < b)
        for _ in range(2):
            b -= odd[b - 1] & (b - 1 > a)
        short = np.flatnonzero((b - a <= 8) & (b > a))
        size = (b - a)[short]
        eight = np.zeros(len(short), U)
        for j in range(8):
            own = np.flatnonzero(size > j)
            eight[own] |= _LOW[buf[a[short[own]] + j]].astype(U) << U(8 * j)
        at = np.minimum(np.searchsorted(_CUE, eight, sorter=_CUE_ORDER), len(CUES) - 1)
        hit = _CUE[_CUE_ORDER[at]] == eight
        classes[short[hit]] = 2 + _CUE_ORDER[at[hit]]
        # words with digits or telling marks, and letters joined by marks
        mark = _MARK[buf]
        mark[1:-1] |= _JOIN[buf[1:-1]] & _is_word[buf[:-2]] & _is_word[buf[2:]]
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(mark, out=sums[1:])
        telling = sums[ends] > sums[starts]
        telling |= (ends - starts == 1) & _JOIN[buf[starts]]
        data = buf.tobytes()
        some = np.flatnonzero(telling)
        classes[some] = [self.of_word(data[x:y]) for x, y in zip(starts[some].tolist(), ends[some].tolist())]
        return Words(starts, ends, first, classes)


_is_letter = np.zeros(256, bool)
_is_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_is_word = _is_letter.copy()
_is_word[48:58] = True


class Model:
    """Weights of features at each place of the window, and of transitions."""

    def __init__(self, labels: list[str], features: list[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.features, self.weights, self.moves = labels, {f: i for i, f in enumerate(features)}, weights, moves
        self.classes, self.table = Classes(), np.zeros((0, len(WINDOW), len(labels)))
        self.depth = self._depth()

    def _depth(self) -> int | None:
        """How many words, all in plain neighbourhoods, must lie between a word and others to make it O for certain; None: no number is enough.

        A run of k words that are not O loses k times O's lead, and wins what the moves within it, into it and out of it win at most.
        """
        o = self.labels.index("O")
        rest = [i for i in range(len(self.labels)) if i != o]
        even = self.scores()[PLAIN].sum(axis=0)
        lead = even[o] - even[rest].max()
        stay = self.moves[o, o]
        inner = max(0.0, self.moves[np.ix_(rest, rest)].max() - stay)
        alone = self.moves[o, rest].max() - stay + self.moves[rest, o].max() - stay
        into = (self.moves[:, rest] - self.moves[:, [o]]).max() + (self.moves[rest] - self.moves[[o]]).max()
        if lead <= inner or lead <= alone:
            return None
        return max(0, int(np.floor((into - inner) / (lead - inner))))

    def __getstate__(self):
        return self.labels, [*self.features], self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def scores(self) -> np.ndarray:
        """(class, place in the window, label)."""
        names = self.classes.names()
        if len(names) > len(self.table):
            new = np.zeros((len(names) - len(self.table), len(WINDOW), len(self.labels)))
            for k, own in enumerate(names[len(self.table) :]):
                known = [self.features[f] for f in own if f in self.features]
                new[k] = self.weights[:, known].sum(axis=1)
            self.table = np.concatenate((self.table, new))
        return self.table

    def label(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        """The words of some texts and the best path's label of each."""
        if len(self.classes.shapes) > 100_000:  # begin anew, so that a worker's memory stays bounded
            self.classes, self.table = Classes(), self.table[:0]
        w = self.classes.words_of(buf, offsets)
        o = self.labels.index("O")
        out = np.full(len(w.classes), o, np.int64)
        if not len(out):
            return w, out
        table = self.scores()
        # two words of class edge stand before, between and after the texts
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        at = np.arange(len(out)) + 2 * (doc + 1)
        wide = np.full(len(out) + 2 * len(w.first), EDGE, np.int64)
        wide[at] = w.classes
        even = wide == PLAIN
        if self.depth is None:
            even[:] = False
        else:  # plain words all around, as far as the window reaches and then as many words as it takes
            reach = max(WINDOW) + self.depth
            odd = np.cumsum(np.concatenate((np.zeros(reach + 1, np.int32), ~even, np.zeros(reach, np.int32))))
            even = odd[2 * reach + 1 :] == odd[: len(wide)]
        todo = np.flatnonzero(~even & (wide != EDGE))
        unary = sum(table[wide[todo + d], k] for k, d in enumerate(WINDOW)) if len(todo) else np.zeros((0, len(self.labels)))
        back = np.full(len(wide), o, np.int64)
        back[todo] = viterbi(todo, unary, self.moves, o)
        return w, back[at]


def viterbi(at: np.ndarray, unary: np.ndarray, moves: np.ndarray, o: int) -> np.ndarray:
    """Best labels of words at ascending places; runs of places one after the other are chains, with O on both sides."""
    out = np.zeros(len(at), np.int64)
    if not len(at):
        return out
    head = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    size = np.diff(np.append(head, len(at)))
    order = np.argsort(size, kind="stable")
    start = 0
    while start < len(order):
        longest = size[order[start]] + max(2, size[order[start]] // 4)
        end = min(start + 4096, int(np.searchsorted(size[order], longest, side="right")))
        own, n = head[order[start:end]], size[order[start:end]]
        best, steps, long = moves[o][None, :] + unary[own], [], int(n.max())
        for t in range(1, long):
            path = best[:, :, None] + moves[None]
            frm = path.argmax(axis=1)
            live = t < n
            to = np.take_along_axis(path, frm[:, None, :], axis=1)[:, 0] + unary[np.minimum(own + t, len(at) - 1)]
            best = np.where(live[:, None], to, best)
            steps.append(np.where(live[:, None], frm, np.arange(len(moves))[None]))
        label = (best + moves[:, o][None]).argmax(axis=1)
        for t in range(long - 1, -1, -1):
            live = t < n
            out[own[live] + t] = label[live]
            if t:
                label = steps[t - 1][np.arange(len(own)), label]
        start = end
    return out


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], kinds: list[str], rounds: int = 120, rate: float = 0.15, decay: float = 0.02) -> Model:
    """Maximum likelihood with a quadratic penalty over labelled rows: a text and its spans (kind, start and end in code points).

    All rows are one batch, so the table should be small; the result depends on nothing else.
    """
    from .common import text_buffer

    import pyarrow as pa

    labels = ["O", *[f"{p}-{k}" for k in kinds for p in "BI"]]
    buf, offsets = text_buffer(pa.array([r[0] for r in rows]))
    classes = Classes()
    w = classes.words_of(buf, offsets)
    names = classes.names()
    features = sorted({f for own in names for f in own})
    number = {f: i for i, f in enumerate(features)}
    has = np.zeros((len(names), len(features)))
    for k, own in enumerate(names):
        has[k, [number[f] for f in own]] = 1
    n = np.diff(w.first)
    long = int(n.max())
    cls, gold, live = np.full((len(rows), long + 4), EDGE), np.zeros((len(rows), long), np.int64), np.arange(long)[None] < n[:, None]
    for i, (text, spans) in enumerate(rows):
        own = slice(w.first[i], w.first[i + 1])
        cls[i, 2 : 2 + n[i]] = w.classes[own]
        for kind, a, b in spans:
            x, y = offsets[i] + len(text[:a].encode()), offsets[i] + len(text[:b].encode())
            at = np.flatnonzero((w.starts[own] < y) & (w.ends[own] > x))
            gold[i, at] = labels.index(f"I-{kind}")
            gold[i, at[0]] = labels.index(f"B-{kind}")
    L = len(labels)
    weights, moves = np.zeros((len(WINDOW), len(features), L)), np.zeros((L, L))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    ends = np.concatenate((np.zeros((len(rows), 1), np.int64), np.where(live, gold, 0), np.zeros((len(rows), 1), np.int64)), axis=1)
    true_moves = np.zeros((L, L))
    each = np.arange(long + 1)[None] <= n[:, None]
    np.add.at(true_moves, (ends[:, :-1][each], ends[:, 1:][each]), 1)
    windows = [cls[:, 2 + d : 2 + d + long] for d in WINDOW]
    sorts = [np.argsort(x[live], kind="stable") for x in windows]
    heads = [np.flatnonzero(np.append(True, np.diff(x[live][order]) > 0)) for x, order in zip(windows, sorts)]
    hot = np.eye(L)[gold] * live[..., None]
    for step in range(1, rounds + 1):
        per_class = np.einsum("cf,ofl->ocl", has, weights)
        u = sum(per_class[k][windows[k]] for k in range(len(WINDOW)))
        u = np.exp(u - u.max(axis=2, keepdims=True))
        move = np.exp(moves)
        # forward and backward, each scaled as it goes
        ahead, behind = np.zeros((long, len(rows), L)), np.zeros((long, len(rows), L))
        ahead[0] = move[0] * u[:, 0]
        for t in range(1, long):
            x = (ahead[t - 1] @ move) * u[:, t]
            ahead[t] = np.where(live[:, t, None], x / x.sum(axis=1, keepdims=True), ahead[t - 1])
        behind[-1] = move[:, 0]
        for t in range(long - 2, -1, -1):
            x = (u[:, t + 1] * behind[t + 1]) @ move.T
            behind[t] = np.where(live[:, t + 1, None], x / x.sum(axis=1, keepdims=True), move[:, 0])
        prob = ahead * behind
        prob = (prob / prob.sum(axis=2, keepdims=True)).transpose(1, 0, 2) * live[..., None]
        expected = np.zeros((L, L))
        expected[0] += prob[:, 0].sum(axis=0)
        for t in range(1, long):
            to, some = u[:, t] * behind[t], live[:, t]
            whole = ((ahead[t - 1] @ move) * to).sum(axis=1, keepdims=True)
            expected += move * ((ahead[t - 1] / whole)[some].T @ to[some])
        expected[:, 0] += prob[np.arange(len(rows)), np.maximum(n - 1, 0)].sum(axis=0)
        off = (hot - prob)[live]
        grad_w = np.zeros_like(weights)
        for k, (order, head) in enumerate(zip(sorts, heads)):
            per = np.zeros((len(names), L))
            per[windows[k][live][order][head]] = np.add.reduceat(off[order], head, axis=0)
            grad_w[k] = has.T @ per
        for x, grad, (m, v) in zip((weights, moves), (grad_w - decay * weights, true_moves - expected - decay * moves), state):
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return Model(labels, features, weights, moves)

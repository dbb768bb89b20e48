"""BPE encoding and decoding by traversal of a prefix-sharing trie.

The distinct new words of a batch go through a trie in depth-first order (sorted words visit it so).  At
each prefix only the last token of its encoding is kept: it is the one token t that ends the prefix and may
follow the last token of what stands before t, so a word's encoding is read back through those last tokens
and shared prefixes are encoded once.  Two tokens may stand side by side if no merge across their border
would have come before the merges that made them.

Special tokens in a text become their ids.  Null texts count as empty: no ids, an empty decoded text.  Rows
that repeat are encoded alike; any other columns are left out, of any name.
"""

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be printed, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Vocabulary:
    """A word-level BPE with an end-of-word mark."""

    def __init__(self, path: str, remember: int = 1_000_000):
        """remember: words kept in a worker; beyond that it starts anew."""
        self.keep = remember
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.made: dict[tuple[int, int], tuple[int, int]] = {}  # pair: rank, token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.made[x, y] = rank, z
            self.parts.setdefault(z, (rank, x, y))
        self.letters = _byte_letters()
        self.spans = {i: len(t.removesuffix(self.end) if t.endswith(self.end) else t) for t, i in self.ids.items()}
        self.beside: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.usable = {t: i for t, i in self.ids.items() if self.whole(i)}
        # how far back a token that ends in three given letters may begin: no other is looked up
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t in self.usable:
            final = self.end and t.endswith(self.end)
            t = t.removesuffix(self.end) if final else t
            reach = self.final if final else self.inner
            if len(t) > reach.get(t[-3:], 2):
                reach[t[-3:]] = len(t)
        if not self.end:
            self.final = self.inner

    def may_follow(self, left: int, right: int) -> bool:
        """Whether [left, right] stays as it is: undo the latest merge beside the border, again and again, and see that none across it came earlier."""
        if (seen := self.beside.get((left, right))) is not None:
            return seen
        x, y, limit, ok = left, right, len(self.made) + 1, True
        while True:
            if (m := self.made.get((x, y))) and m[0] < limit:
                ok = False
                break
            rx, ry = self.parts.get(x, (-1,))[0], self.parts.get(y, (-1,))[0]
            if rx < 0 and ry < 0:
                break
            if rx > ry:  # of equal merges the left one comes first, so that of y is undone first
                limit, x = rx, self.parts[x][2]
            else:
                limit, y = ry + 1, self.parts[y][1]
        if len(self.beside) > 4 * self.keep:
            self.beside.clear()
        self.beside[left, right] = ok
        return ok

    def encode_pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of each piece (letters that stand for bytes), through the trie."""
        out: dict[str, list[int]] = {}
        last: list[int] = [-1]  # by prefix length, of the branch being visited
        before = ""
        ids, spans, inner, final, follow = self.usable, self.spans, self.inner.get, self.final.get, self.may_follow
        for piece in sorted(pieces):
            n = len(piece)
            shared = 0
            top = min(len(before), n - 1, len(last) - 1)
            while shared < top and before[shared] == piece[shared]:
                shared += 1
            del last[shared + 1 :]
            for k in range(shared + 1, n):
                for j in range(max(0, k - inner(piece[max(0, k - 3) : k], 2)), k):
                    t = ids.get(piece[j:k])
                    if t is not None and (j == 0 or follow(last[j], t)):
                        last.append(t)
                        break
            tail: list[int] = []
            for j in range(max(0, n - final(piece[max(0, n - 3) : n], 2)), n):
                t = ids.get(piece[j:n] + self.end)
                if t is not None and (j == 0 or follow(last[j], t)):
                    tail = [t]
                    k = j
                    break
            while k:
                t = last[k]
                tail.append(t)
                k -= spans[t]
            out[piece] = tail[::-1]
            before = piece
        return out

    @lru_cache(None)  # noqa: B019  one vocabulary lives as long as its worker
    def whole(self, token: int) -> bool:
        """Whether the token is what its own symbols encode to."""
        p = self.parts.get(token)
        return p is None or self.made.get((p[1], p[2]), (0, -1))[1] == token and self.whole(p[1]) and self.whole(p[2]) and self.may_follow_below(p)

    def may_follow_below(self, p: tuple[int, int, int]) -> bool:
        """Whether the two halves of a merge come to stand side by side: no merge across their border of an earlier rank."""
        x, y, limit = p[1], p[2], p[0]
        while True:
            rx, ry = self.parts.get(x, (-1,))[0], self.parts.get(y, (-1,))[0]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                limit, x = rx, self.parts[x][2]
            else:
                limit, y = ry + 1, self.parts[y][1]
            if (m := self.made.get((x, y))) and m[0] < limit:
                return False

    def pieces(self, word: str) -> list[str]:
        """What the pattern makes of a word without white space, as letters that stand for bytes."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        word = word.lower() if "Σ" not in word else "".join(c.lower() for c in word)
        return ["".join(map(self.letters.__getitem__, m.encode())) for m in self.pattern.findall(word)]

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.keep:
            self.known.clear()
        cut = {w: self.pieces(w) for w in words}
        ids = self.encode_pieces({p for ps in cut.values() for p in ps})
        for w, ps in cut.items():
            of = [i for p in ps for i in ids[p]]
            self.known[w] = len(of), " ".join(map(str, of)), " ".join(map(self.names.__getitem__, of))

    def segments(self, text: str) -> list[str]:
        """Words of a text, and special tokens as they are."""
        if "<" not in text or self.special_pattern is None or not self.special_pattern.search(text):
            return _words(text)
        out = []
        for i, part in enumerate(self.special_pattern.split(text)):
            out += [part] if i % 2 else _words(part)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, the ids and the decoded text, each joined by blanks."""
        for content, i in self.special.items():
            self.known[content] = 1, str(i), content
        words = [self.segments(t) if t else [] for t in texts]
        out: list = [None] * len(texts)
        late, new = [], set()
        for k, ws in enumerate(words):
            got = list(map(self.known.get, ws))
            if None in got:
                new.update(w for w, g in zip(ws, got) if g is None)
                late.append(k)
            else:
                out[k] = _joined(got)
        if new:
            seen = {w: self.known[w] for k in late for w in words[k] if w in self.known} if len(self.known) + len(new) > self.keep else {}
            self.learn(new)
            self.known.update(seen)
            for content, i in self.special.items():
                self.known[content] = 1, str(i), content
            for k in late:
                out[k] = _joined([self.known[w] for w in words[k]])
        return out


_ODD = regex.compile(r"[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")


def _words(text: str) -> list[str]:
    """Split at the white space that the normaliser knows (str.split() knows four control characters more)."""
    return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()


def _joined(got: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    return sum(map(itemgetter(0), got)), " ".join(map(itemgetter(1), got)), " ".join(map(itemgetter(2), got))


@lru_cache(2)
def vocabulary(path: str, remember: int = 1_000_000) -> Vocabulary:
    return Vocabulary(path, remember)


def encode(docs: DataFrame, path: str, digests: bool = False, rows: int = 200, remember: int = 1_000_000) -> DataFrame:
    """doc_id, n_tokens and either ids and the decoded text, or (digests) their SHA-256, of every whole text.

    path: the vocabulary's file, there on every executor.  remember: words whose encodings a worker keeps, which costs memory and
    saves time but changes no result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches):
        v = vocabulary(path, remember)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                got = v.encode_batch(b.column(1).to_pylist())
                n = pa.array([g[0] for g in got], pa.int64())
                if digests:
                    more = [pa.array([hashlib.sha256(g[k].encode()).hexdigest() for g in got], pa.string()) for k in (1, 2)]
                else:
                    more = [pa.array([[int(i) for i in g[1].split()] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), n, *more], ["doc_id", "n_tokens", *[c.split()[0] for c in tail.split(", ")]])
        give_back()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, {tail}")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of rows of doc_id and ids (null: empty)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names = vocabulary(path).names
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(map(names.__getitem__, x or [])) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")

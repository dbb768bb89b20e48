"""Personal data: e-mail addresses, IP addresses, card and phone numbers.

Fixed patterns give the base spans, which always stay.  A conditional random field over word shapes (crf.py), trained from a small
labelled table, adds what the patterns miss: spelled-out addresses, numbers with other separators, and numbers that stand side by
side and spoil each other's pattern.  An added span must hold what its kind needs (digits, their check sum, a domain) and must not
overlap a base span of its kind or a longer added one.

Null texts count as empty and have no spans.  Rows that repeat, and null doc_ids, are handled like others; other columns, of any
names, are not carried; an empty table gives an empty result.  A text is handled whole, by one task, with some 60 bytes for each of its bytes.
"""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import SPACE, give_back, text_buffer

KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+){3,}")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOCALS = np.zeros(256, bool)
_LOCALS[[*b"._%+-", *range(48, 58), *range(65, 91), *range(97, 123)]] = True


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Kind, start and end in bytes of what the patterns find; texts stand one after the other."""
    if len(buf) < 6:
        return []
    data, found = buf.tobytes(), []
    text = lambda at: np.searchsorted(offsets, at, side="right") - 1
    # around each sign the letters before it that no earlier span has, and a domain behind it
    signs, last = np.flatnonzero(buf == 64), 0
    of = text(signs)
    for sign, low, high in zip(signs.tolist(), offsets[of].tolist(), offsets[of + 1].tolist()):
        begin, low = sign, max(low, last)
        while begin > low and _LOCALS[buf[begin - 1]]:
            begin -= 1
        if begin < sign and (m := _DOMAIN.match(data, sign + 1, high)):
            last = m.end()
            found.append((0, begin, last))
    # numbers joined by dots, four by four
    digit = _DIGIT[buf]
    dots = np.flatnonzero((buf[1:-1] == 46) & digit[:-2] & digit[2:]) + 1
    last = -1
    for dot in dots.tolist():
        if dot < last:
            continue
        begin = dot
        low = int(offsets[text(dot)])
        while begin > max(low, last) and digit[begin - 1]:
            begin -= 1
        high = int(offsets[text(dot) + 1])
        m = _DOTTED.match(data, begin, high)
        if m:
            parts = [(p.start() + begin, p.end() + begin) for p in re.finditer(rb"[0-9]+", m.group())]
            for k in range(0, len(parts) - 3, 4):
                if all(int(data[a:b].lstrip(b"0")[:4] or b"0") <= 255 for a, b in parts[k : k + 4]):
                    found.append((1, parts[k][0], parts[k + 3][1]))
            last = m.end()
    # digits with at most one blank or hyphen between
    places = np.flatnonzero(digit)
    if len(places):
        gap = np.diff(places)
        link = (gap == 1) | ((gap == 2) & np.isin(buf[np.minimum(places[:-1] + 1, len(buf) - 1)], (32, 45)))
        link &= text(places[1:]) == text(places[:-1])
        head = np.flatnonzero(np.append(True, ~link))
        size = np.diff(np.append(head, len(places)))
        for k in np.flatnonzero((size >= 14) & (size <= 19)).tolist():
            own = places[head[k] : head[k] + size[k]]
            if luhn(buf[own].tobytes().decode()):
                found.append((2, int(own[0]), int(own[-1]) + 1))
    plus = np.flatnonzero((buf[:-1] == 43) & digit[1:])
    for at, high in zip(plus.tolist(), offsets[text(plus) + 1].tolist()):
        m = _PHONE.match(data, at, high)
        if m and 10 <= sum(48 <= c <= 57 for c in m.group()) <= 15:
            found.append((3, at, m.end()))
    return sorted(found, key=lambda x: (x[1], x[0]))


# ---- the labelled table

#: Texts in which {a kind and a form} stands for a span and {a word's kind} for words; fixed values.
TEMPLATES = (
    *("{w} {w} {email} {w} {w}", "{w} {w} {w}. {email} {w}", "{email}", "{w} {email}, {w} {w}", "email: {email}", "write to {email} or call {phone}", "contact {email} {w}", "mail {email}", "{w}, {email} {phone} {w}", "{email} {card}", "{email} {ip} {w}", "{email} or {email} {w}", "{w} {email} and {email}", "{w} {email}, {email} {w}", "{w} {w} {email} {w} {email} {w} {w}"),
    *("{w} {w} {ip} {w} {w}", "{w} {w} {w}, {ip} {w}", "{ip}", "ip {ip}", "ip address {ip} {w}", "ping {ip} {w}", "{w} from {ip} to {ip} {w}", "server {ip}, {w}", "host: {ip} {w} {w}", "{ip} {card} {w}", "{ip} {phone} {w}", "{ip} {email} {w}", "{w} {ip} and {ip} {w}", "{w} {ip}, {ip}"),
    *("{w} {w} {card} {w} {w}", "{w} {w} {w}. {card} {w}", "{card}", "card {card}", "card number {card} {w}", "visa {card}, {w}", "pay {w} {card} {w} {w}", "credit card: {card}.", "{card} {ip} {w}", "{w} {card} {phone} {w}", "{w} {card} {card} {w}"),
    *("{w} {w} {phone} {w} {w}", "{w} {w} {w}, {phone} {w}", "{phone}", "tel {phone}", "phone: {phone} {w}", "call {phone} or {phone} {w}", "call {w} {w} {phone}. {w}", "fax {phone}", "mobile {phone}, {w} {w}", "{w} {w} {phone} {card} {w} {w}", "{w} {w} {phone} {card} {w} {w}", "{w} {w} {base_phone} {card} {w} {w}", "{w} {base_phone} {ip} {w}", "{phone} {email} {w}", "{w} {base_phone} {base_phone} {w}", "{w} {base_phone} {base_card}", "{w} {base_phone} {base_ip} {w}"),
    *("{w} {w} {none} {w} {w}", "{w} {w} {w}. {none} {w}", "{none}", "{w} {none}, {w} {none} {w}", "{w} {w} {none} {none} {w}", "{w} {w}, {w} {w}. {w} {w} {w}", "{w} {w} at {w} {w} {w}", "{w} at {w}, {w}. {w}", "{w} dot {w} {w}", "{w} {w} on the dot at {w}", "{w} at {none} {w}", "call {w} {w} at {w}", "{w} from {w} to {w} and {w}"),
    *("{w} mail {w} {w}", "card {w} {w} {none}", "{w} ip {w} {w}", "phone {w} {w}", "tel {w} or {w}", "{w} {w} {w} {w} {w} {w} {w} {w}", "{w} {none} {w} {phone}", "{w} {none} {card} {w}", "{w} {none} {w} {email} {w}", "{ip} {w} {none}", "{w} point {w} at {w}", "{w} {w} is {w} or {w}", "page {none} {w}", "section {none} {w}", "version {none}", "{w} host {w} server {w}", "order {none} on {none}", "invoice {none}"),
)
#: Forms: d a digit, o a number up to 255, h a hexadecimal digit, u a capital, l a word, t the end of a domain, c four digits of a card; other characters stand for themselves; fixed values.
EMAILS = ("l@l.t", "l.dd@ld.l.t", "l_l@l.t", "l @ l.t", "l @ l . t", "l at l dot t", "l at l dot l dot t", "l dot l at l dot t", "l [at] l [dot] t", "l (at) l (dot) t", "l[at]l[dot]t", "l(at)l.t", "l(at)l(dot)t", "l (at) l.t", "l [at] l.t", "l@l dot t", "l@l [dot] t", "l@l[.]t", "l at l.t", "l.dd at ld dot l dot t", "l dd at l dot t", "ldd [at] ld.l.t", "l.dd(at)ld.l.t", "l arroba l punto t", "l at l punkt t", "l arroba l.t", "l AT l DOT t", "l{at}l{dot}t", "l.dd@ld.l .t", "l.dd @ ld.l.t")
IPS = ("o.o.o.o", "o . o . o . o", "o[.]o[.]o[.]o", "o[.]o.o.o", "o.o.o[.]o", "o dot o dot o dot o", "o(.)o(.)o(.)o", "o. o. o. o", "o [.] o [.] o [.] o", "o-o-o-o", "o [dot] o [dot] o [dot] o", "o_o_o_o", "o.o.o .o", "o .o .o .o")
CARDS = ("cccc", "c c c c", "c-c-c-c", "c.c.c.c", "c/c/c/c", "c  c  c  c", "c - c - c - c", "c_c_c_c", "c. c. c. c")
PHONES = ("+d (ddd) ddd-dddd", "+d (ddd) ddd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "(ddd)ddd-dddd", "+dd dd dddd dddd", "d-ddd-ddd-dddd", "+d.ddd.ddd.dddd", "+d/ddd/ddd/dddd", "0dd/ddddddd", "0ddd ddddddd", "0dd dd dd dd dd", "00dd dd ddddddd", "ddd - ddd - dddd", "+d ddd ddd dddd", "(ddd) ddd dddd", "ddd/ddd-dddd", "+dd (0) dd ddd dddd", "ddd ddd-dddd")
BASE = {"base_phone": ("+d (ddd) ddd-dddd", "+d (ddd) ddd-dddd", "+d ddd ddd-dddd", "+dd dd ddddddd"), "base_card": ("cccc",), "base_ip": ("o.o.o.o",)}
NONE = (
    *("dddd-dd-dd", "dd.dd.dddd", "dd/dd/dddd", "d/d/dddd", "dd:dd", "dd:dd:dd", "$dd.dd", "d,ddd,ddd", "d.ddd.ddd", "vd.d.d", "d.d.d", "d.d.", "d.d", "d.", "dd.", "(d)", "(dd)", "(dddd)", "dddd", "ddd", "dd", "d", "ddddd", "dddddd", "ddddddd", "dddddddd", "dd-dd", "dddd-dddd", "d-d", "dd:d", "dd%", "d. d. d.", "dd.ddd.dd", "dd.ddd", "ddd.dd.dd.d", "dd dd dd", "ddd ddd", "d dd ddd dddd"),
    *("uuuuhhhuuhuhhuuhhuhu", "l=hhhhhhhhhhhhhhhhhh", 'l = "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"', "hhhhhhhhhhhhhhhh", "hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh", "hh:hh:hh:hh:hh:hh", "uu-uu", "@l", "l.l", "l.", "#ddd", "l-l", "l/l", "(l)", "[l]", "[dd]", "l d.d.", "ld", "ldd", "l_l", "http://l.t/l", "l.t", "ddd-d-dd-dddddd-d", "dddd-dddddd", "uudd dddd", "l @ l", "l at l", "dd x dd", "d + d = d", "dd.dddd, dd.dddd", "dddddddddddd", "ddddddddddddddddddddd", "l@l", "l (l) l", "dd l dddd", "ddxdd", "d:d", "+d", "+d l", "l+l", "dd+"),
)


def labelled_table(copies: int = 14, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts and their spans (kind, start and end in code points): every template `copies` times, its slots filled by chance."""
    chance = random.Random(seed)
    forms = {"email": EMAILS, "ip": IPS, "card": CARDS, "phone": PHONES, "none": NONE, **BASE}

    def word() -> str:
        w = "".join(chance.choice("abcdefghiklmnoprstuvwzéüñ") for _ in range(chance.choice((2, 3, 4, 5, 6, 8))))
        return w if chance.random() < 0.8 else w.capitalize()

    def letters() -> str:
        return "".join(chance.choice("abcdefghiklmnoprstuvwz") for _ in range(chance.choice((3, 4, 5, 6, 8))))

    def filled(form: str) -> str:
        groups, out = None, ""
        if form.count("c") >= 4 and form.strip("c -./_") == "":
            first = "4" + "".join(chance.choice("0123456789") for _ in range(14))
            number = next(first + x for x in "0123456789" if luhn(first + x))
            groups = iter([number[i : i + 4] for i in (0, 4, 8, 12)])
        for part in re.findall(r"at|dot|arroba|punto|punkt|AT|DOT|http|.", form):
            if part == "c" and groups:
                out += next(groups)
            elif part in ("d", "o", "h", "u", "l", "t"):
                out += {"d": lambda: chance.choice("0123456789"), "o": lambda: str(chance.randrange(256)), "h": lambda: chance.choice("0123456789abcdef"), "u": lambda: chance.choice("ABCDEFGHKLMNPQRSTUVWXYZ"), "l": letters, "t": lambda: chance.choice(("com", "org", "net", "example", "de", "io"))}[part]()
            else:
                out += part
        return out

    rows = []
    for template in TEMPLATES:
        for _ in range(copies):
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", template):
                name = part[1:-1] if part.startswith("{") else None
                if name == "w":
                    text += word()
                elif name:
                    new, kind = filled(chance.choice(forms[name])), name.removeprefix("base_")
                    if kind in KINDS:
                        spans.append((kind, len(text), len(text) + len(new)))
                    text += new
                else:
                    text += part
            rows.append((text, spans))
    return rows


def trained(kinds: list[str] = KINDS) -> crf.Model:
    """The model of the labelled table."""
    return crf.train(labelled_table(), kinds)


# ---- spans that the model adds

_AT = r"(?:\s*(?:@|[\[({]\s*(?:at|@|arroba)\s*[\])}])\s*|\s+(?:at|arroba|chez)\s+|_at_)"
_DOT = r"(?:\s*(?:\.|[\[({]\s*(?:dot|\.|punto|punkt|point)\s*[\])}])\s*|\s+(?:dot|punto|punkt|point)\s+|_dot_)"
_ADDRESS = re.compile(rf"[\w%+-]+(?:(?:{_DOT}|\s+)[\w%+-]+){{0,4}}{_AT}[\w-]+(?:{_DOT}[\w-]+){{1,5}}", re.IGNORECASE)
_NUMBERS = re.compile(r"[0-9]+")
#: No span is longer: the longest e-mail address has 320 letters.
LONGEST = 640


def fits(kind: str, text: str) -> bool:
    """Whether a span has what its kind needs."""
    numbers = _NUMBERS.findall(text)
    digits = "".join(numbers)
    if kind == "email":
        return _ADDRESS.fullmatch(text) is not None
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) and all(len(x) <= 9 for x in _NUMBERS.split(text))
    if re.search(r"[^\W\d_]", text):
        return False
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def _trimmed(kind: str, data: bytes, a: int, b: int) -> tuple[int, int]:
    """A span without the marks around it; numbers begin and end with a digit, or begin with the plus and the bracket before it."""
    word = (lambda c: 48 <= c <= 57) if kind != "email" else (lambda c: c >= 128 or chr(c).isalnum())
    low = a
    while a < b and not word(data[a]):
        a += 1
    while b > a and not word(data[b - 1]):
        b -= 1
    if kind == "phone" and a > low and data[a - 1] == 40 and b"(" not in data[a:b] and b")" in data[a:b]:
        a -= 1
    if kind == "phone" and a > low and data[a - 1] == 43:
        a -= 1
    return a, b


def added_spans(model: crf.Model, buf: np.ndarray, offsets: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Kind, start and end in bytes of the model's spans that fit their kind and overlap no base span and no earlier of these.

    A run of words that does not fit as a whole may be several side by side; phone numbers, which nothing checks, are not looked for so.
    """
    w, labels = model.label(buf, offsets)
    some = np.flatnonzero(labels)
    if not len(some):
        return []
    data, names = buf.tobytes(), model.labels
    docs = np.searchsorted(w.first, some, side="right").tolist()
    runs: list[list[int]] = []  # kind, first word, last word, text
    for k, doc in zip(some.tolist(), docs):
        begins, kind = names[labels[k]][0] == "B", KINDS.index(names[labels[k]][2:])
        if runs and not begins and runs[-1][2] == k - 1 and runs[-1][0] == kind and runs[-1][3] == doc:
            runs[-1][2] = k
        else:
            runs.append([kind, k, k, doc])
    starts, out, last = [x[1] for x in sorted(base, key=lambda x: x[1])], [], 0
    ends = np.maximum.accumulate([x[2] for x in sorted(base, key=lambda x: x[1])]) if base else np.zeros(0, np.int64)

    def span(kind: int, first: int, final: int) -> tuple[int, int] | None:
        """The words' span, if it fits its kind and overlaps no other."""
        a, b = int(w.starts[first]), int(w.ends[final])
        if b - a > LONGEST:
            return None
        a, b = _trimmed(KINDS[kind], data, a, b)
        before = int(np.searchsorted(starts, b, side="left"))
        return (a, b) if a >= last and b > a and (not before or ends[before - 1] <= a) and fits(KINDS[kind], data[a:b].decode()) else None

    for kind, first, final, _ in runs:
        if (found := span(kind, first, final)) is not None:
            out.append((kind, *found))
            last = found[1]
        elif KINDS[kind] != "phone":  # several side by side: from the left, the longest that has the kind's check
            at = first
            while at <= final:
                end = min(final, int(np.searchsorted(w.ends, w.starts[at] + LONGEST, side="right")) - 1)
                while end >= at and (found := span(kind, at, end)) is None:
                    end -= 1
                if end >= at:
                    out.append((kind, *found))
                    last = found[1]
                at = max(end, at) + 1
    return out


def _by_text(spans: list[tuple[int, int, int]], buf: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """The spans of each text, in code points."""
    rows: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    chars, text = None, -1
    for i, (kind, a, b) in zip((np.searchsorted(offsets, [x[1] for x in spans], side="right") - 1).tolist(), spans):
        if i != text:  # code points up to each byte
            chars, text = np.cumsum(np.append(0, (buf[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)), i
        rows[i].append({"kind": KINDS[kind], "start": int(chars[a - offsets[i]]), "end": int(chars[b - offsets[i]])})
    return rows


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, model: crf.Model | None = None, size: int = 4 << 20) -> DataFrame:
    """doc_id, text, base and added of every row: spans (kind, start and end in code points, end exclusive) by start and kind.

    model: of the labelled table if none is given.  size: bytes of text that are handled at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())  # some hundred kB
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for whole in batches:
            lengths = np.cumsum(whole.column(2).to_numpy())
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, side="right")))
                b = whole.slice(at, to - at)
                at = to
                buf, offsets = text_buffer(b.column(1))
                base = base_spans(buf, offsets)
                columns = [b.column(0), b.column(1)]
                for spans in (base, added_spans(shared.value, buf, offsets, base)):
                    columns.append(pa.array(_by_text(spans, buf, offsets), pa.list_(span)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "base", "added"])
        give_back()

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("size", F.octet_length("text")).mapInArrow(run, f"doc_id {kind}, text string, base {SPANS}, added {SPANS}")


def listed(spans: str) -> F.Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def together(base: str = "base", added: str = "added") -> F.Column:
    """All spans, by start and then kind as in KINDS."""
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    order = F.array_sort(F.transform(F.concat(base, added), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.transform(order, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def redact(docs: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """doc_id and the text with [KIND] in place of each span; of spans that overlap, the first."""
    rows = find(docs, model).withColumn("spans", together())
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, x):
        cut = F.concat(state["out"], F.substring("text", state["at"] + 1, x["start"] - state["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] >= state["at"], F.struct(cut.alias("out"), x["end"].alias("at"))).otherwise(state)

    done = F.aggregate("spans", start, step)
    return rows.withColumn("done", done).select("doc_id", F.concat("done.out", F.expr("substring(text, done.at + 1)")).alias("redacted"))

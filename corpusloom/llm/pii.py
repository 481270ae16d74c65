"""Personal data by a linear-chain conditional random field over word shapes.

Text is cut into tokens (runs of letters, runs of digits, single signs). Features are the shapes of a token and its
neighbours and whether white space stands before it. The field is trained by maximum likelihood (forward-backward,
Adam) on a small labelled table that training_table() spells out, and decoded by Viterbi in numpy batches, each line one
sequence of any length. Lines that hold neither a digit nor an at sign nor a word for one before a host with a dot can
have no span of the required make-up and are not decoded.

The base patterns' matches always stay; the field adds what they miss: numbers grouped by other signs, addresses written
out ("name at host dot org"), each checked for its kind's number of digits or parts.

Cases: null and empty texts have no spans; repeated rows give a row each; a null doc_id stays null; other columns are
not looked at. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

# The contract's base patterns (its number pattern for ip starts no match inside a run of digits, which
# the look-behind says at once).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the at signs so that long runs without one cost nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            floor = found.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor if found else at + 1)
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m.groups()))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
#: Tokens' shapes and surroundings' scores that a worker remembers.
REMEMBERED = 100_000
_SHAPES: dict[str, str] = {}
#: Tokens, with padding, that are decoded at once; a longer line is decoded alone.
CELLS = 1 << 17


def shape(token: str) -> str:
    if token.isdecimal():
        return f"9{min(len(token), 6)}"
    if token.isalpha():
        low = token.lower()
        if low in ("at", "dot", "punto", "arroba", "point", "punkt"):
            return low
        if low in ("com", "org", "net", "edu", "de", "fr", "es", "io"):
            return "tld"
        if low in ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "teléfono", "téléphone", "móvil"):
            return "dial"
        if low in ("card", "visa", "mastercard", "karte", "tarjeta", "carte"):
            return "plastic"
        return ("X" if token[0].isupper() else "x") + ("" if len(token) > 1 else "1")
    return token if ord(token[0]) < 128 else "sign"


def features(shapes: list[str], gaps: list[bool], i: int) -> tuple[str, ...]:
    """What the field sees at a token: shapes from two before to two after, with gaps."""
    at = lambda k: shapes[k] if 0 <= k < len(shapes) else "^"
    g = lambda k: "_" if 0 <= k < len(gaps) and gaps[k] else ""
    a, b, c, d, e = at(i - 2), at(i - 1), at(i), at(i + 1), at(i + 2)
    return ("0" + c, "1" + b + g(i) + c, "2" + c + g(i + 1) + d, "3" + a + b + c, "4" + c + d + e, "5" + b + g(i) + c + g(i + 1) + d, "6" + a, "7" + e)


def training_table() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled lines, from templates with slots; a small linear generator fills them the same way every time."""
    state = 12345

    def roll(n: int) -> int:
        nonlocal state
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return (state >> 33) % n

    number = lambda n: "".join(str(roll(10)) for _ in range(n))
    word = lambda: "".join("aeioubcdlmnrst"[roll(14)] for _ in range(2 + roll(6)))
    fill = {
        "email": ["{w}.{2}@{w}{1}.{w}.com", "{w}@{w}.org", "{w}_{w}@{w}-{w}.net", "{w} at {w} dot com", "{w} [at] {w} [dot] org", "{w}{2} (at) {w} (dot) net", "{w}.{w} at {w} dot {w} dot com", "{w} (at) {w}.com", "{w} at {w}.org", "{w} [at] {w}.{w}.net", "{w}.{w} arroba {w}.es"],
        "ip": ["{2}.{2}.{2}.{2}", "1{1}.{2}.{1}.1{2}", "10.{1}.{1}.{2}", "192.168.{1}.{2}"],
        "card": ["{16}", "{4} {4} {4} {4}", "{4}-{4}-{4}-{4}", "{4} {6} {5}", "{4}.{4}.{4}.{4}"],
        "phone": ["+1 ({3}) 555-{4}", "+{2} {3} {3} {4}", "({3}) {3}-{4}", "{3}-{3}-{4}", "{3}.{3}.{4}", "+{2}-{3}-{6}", "1-{3}-{3}-{4}", "00{2} {3} {6}", "({3}) 555-{4}"],
    }
    plain = ["{w}", "{w} {w}", "{w}, {w}", "{1}", "{2}", "{3}", "{4}", "{1}.{1}", "v{1}.{1}.{1}", "20{2}-{2}-{2}", "{1},{3}", "{2}:{2}", "${2}.{2}", "{2}%", "Version 2.0", "CC BY-NC 4.0", "{8}", "{5}", "{2}/{2}/20{2}", "§ {2}", "chapter {1}.{2}.{1}", "@{w}", "{w}{3}{w}{4}", "{w} at {w}", "{1}{w}{2}{w}{6}{w}", "#{4}", "{w}-{1}", "{12}", "{24}", "{3}-{2}", "meet at {2}:{2}", "1.{1}.{1}", "{w} dot {w}"]
    lead = ["{w} {w} ", "{w} ", "phone ", "call {w} ", "tel: ", "card ", "write to ", "{w}, ", "{w}. ", "", "| {w} | ", "{w}: ", "{w} — "]
    tail = [" {w} {w}.", " {w}", ".", ", {w} {w}", "", " | {w} |", "!! {w}", " and {w}", "; {w}"]

    def made(template: str) -> str:
        return re.sub(r"\{(w|\d+)\}", lambda m: word() if m[1] == "w" else number(int(m[1])), template)

    rows = []
    for n in range(900):
        kind = LABELS[n % 5]
        middle = made((plain if kind == "none" else fill[kind])[roll(len(plain) if kind == "none" else len(fill[kind]))])
        a, b = made(lead[roll(len(lead))]), made(tail[roll(len(tail))])
        rows.append((a + middle + b, [] if kind == "none" else [(kind, len(a), len(a) + len(middle))]))
    return rows


def tokenised(text: str, lo: int = 0, hi: int | None = None) -> tuple[list[int], list[int], list[str], list[bool]]:
    starts, ends, shapes, gaps = [], [], [], []
    known = _SHAPES
    for m in TOKEN.finditer(text, lo, len(text) if hi is None else hi):
        gaps.append(bool(ends) and m.start() > ends[-1])
        starts.append(m.start())
        ends.append(m.end())
        token = m.group()
        if token not in known:
            if len(known) > REMEMBERED:
                known.clear()
            known[token] = shape(token)
        shapes.append(known[token])
    return starts, ends, shapes, gaps


class Field:
    """Weights of a linear-chain CRF: emissions by feature and label, transitions between labels."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self.known: dict[tuple, int] = {}
        self.table: list[np.ndarray] = [np.zeros(len(LABELS))]

    def emissions(self, shapes: list[str], gaps: list[bool]) -> np.ndarray:
        """(tokens x labels); tokens in the same surroundings are scored once and remembered."""
        padded, known = ["^", "^", *shapes, "^", "^"], self.known
        keys = list(zip(padded, padded[1:], gaps, padded[2:], [*gaps[1:], False], padded[3:], padded[4:]))
        if len(known) > REMEMBERED:
            known.clear()
            self.table = [np.zeros(len(LABELS))]
        for key in set(keys):
            if key not in known:
                a, b, g, c, h, d, e = key
                some = features([a, b, c, d, e], [False, False, g, h, False], 2)
                known[key] = len(self.table)
                self.table.append(self.emit[[self.index.get(f, len(self.index)) for f in some]].sum(axis=0))
        return np.array([self.table[known[k]] for k in keys]).reshape(-1, len(LABELS))

    def viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence of emissions, all sequences a step at a time."""
        if not rows:
            return []
        lengths = np.array([len(r) for r in rows])
        n, t, k = len(rows), int(lengths.max()), len(LABELS)
        e = np.zeros((t, n, k))
        for s, row in enumerate(rows):
            e[: len(row), s] = row
        best, back = e[0].copy(), np.zeros((t, n, k), np.int8)
        stay = np.arange(k, dtype=np.int8)
        for i in range(1, t):
            paths = best[:, :, None] + self.move[None]
            live = (i < lengths)[:, None]
            back[i] = np.where(live, paths.argmax(axis=1), stay)
            best = np.where(live, paths.max(axis=1) + e[i], best)
        labels = np.zeros((n, t), np.int8)
        at = best.argmax(axis=1)
        for i in range(t - 1, -1, -1):
            labels[:, i] = at
            at = back[i, np.arange(n), at]
        return [labels[s, :m] for s, m in enumerate(lengths)]


@functools.lru_cache(maxsize=1)
def train(steps: int = 90, rate: float = 0.2, ridge: float = 2e-3) -> Field:
    """Maximum likelihood on the labelled table; whole-batch forward-backward and Adam."""
    rows, gold = [], []
    for text, spans in training_table():
        starts, ends, shapes, gaps = tokenised(text)
        rows.append([features(shapes, gaps, i) for i in range(len(shapes))])
        gold.append([next((LABELS.index(k) for k, s, e in spans if s <= a and b <= e), 0) for a, b in zip(starts, ends)])
    index = {f: i for i, f in enumerate(sorted({f for row in rows for fs in row for f in fs}))}
    n, t, k, many = len(rows), max(map(len, rows)), len(LABELS), len(next(fs for row in rows for fs in row))
    lengths = np.array([len(r) for r in rows])
    at = np.full((n, t, many), len(index))
    y = np.zeros((n, t), int)
    for s, row in enumerate(rows):
        at[s, : len(row)] = [[index[f] for f in fs] for fs in row]
        y[s, : len(row)] = gold[s]
    live = np.arange(t)[None] < lengths[:, None]
    hot = np.eye(k)[y] * live[..., None]
    pair = np.einsum("sti,stj->ij", hot[:, :-1], hot[:, 1:])
    emit, move = np.zeros((len(index) + 1, k)), np.zeros((k, k))
    moments = [np.zeros_like(x) for x in (emit, emit, move, move)]
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    flat = at.reshape(-1)
    for step in range(1, steps + 1):
        e = emit[at].sum(axis=2)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            alpha[:, i] = np.where(live[:, i, None], e[:, i] + lse(alpha[:, i - 1, :, None] + move, 1), alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(live[:, i + 1, None], lse(move[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        edges = np.exp(alpha[:, :-1, :, None] + move + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        gap = np.repeat((hot - node).reshape(-1, k), many, axis=0)
        push = np.stack([np.bincount(flat, gap[:, j], minlength=len(index) + 1) for j in range(k)], axis=1) / n - ridge * emit
        push[-1] = 0
        shift = (pair - edges.sum(axis=(0, 1))) / n - ridge * move
        for w, g, a, b in ((emit, push, 0, 1), (move, shift, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            w += rate * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
    return Field(index, emit, move)


_DOT = r"(?:dot|punto|punkt|point)"
#: An address; after a word for the at sign a plain dot joins its words without blanks, as it ends a sentence otherwise.
_HOST = rf"[\w-]+(?:(?:\.|\s*[(\[]?\s*\b{_DOT}\b\s*[)\]]?\s*)[\w-]+)+"
ADDRESS = re.compile(rf"[\w.+-]+\s*[(\[]?\s*(?:@\s*[)\]]?\s*[\w-]+(?:\s*[(\[]?\s*(?:\.|\b{_DOT}\b)\s*[)\]]?\s*[\w-]+)+|\b(?:at|arroba)\b\s*[)\]]?\s*{_HOST})", re.I)
#: What sound() asks of a span at least: a digit, an at sign, or a word for one before a host with a dot.
SEED = re.compile(rf"[0-9@]|\b(?:at|arroba)\b(?=\s*[)\]]?\s*{_HOST})", re.I)


def sound(kind: int, body: str) -> bool:
    """Whether a decoded span has its kind's make-up."""
    d = digits_of(body)
    if kind == 0:
        return ADDRESS.fullmatch(body) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", body)
        return len(parts) == 4 and all(map(small, parts)) and set(body) <= set("0123456789.[]() ")
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9](?:[\x20.\-]?[0-9])+", body) is not None
    return 9 <= len(d) <= 15 and re.fullmatch(r"\+?\(?[0-9](?:[\x20().\-]{0,3}[0-9])+", body) is not None and len(re.findall("[0-9]+", body)) >= 3


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with what the base found as words of the same length."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if e > at:
            out += [text[at : max(s, at)], "x" * (e - max(s, at))]
            at = e
    return "".join([*out, text[at:]])


def lines_of(text: str, every: bool = False) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines that may hold a sound span (or of all)."""
    at = 0
    if not every:
        m = SEED.search(text)
        while m:
            lo, hi = text.rfind("\n", at, m.start()) + 1, text.find("\n", m.end())
            hi = hi if hi >= 0 else len(text)
            yield max(lo, at), hi
            at = hi
            m = SEED.search(text, at)
        return
    for line in text.split("\n"):
        yield at, at + len(line)
        at += len(line) + 1


def added_spans(texts: list[str], based: list[list[tuple[int, int, int]]], field: Field, every: bool = False) -> list[list[tuple[int, int, int]]]:
    """The field's sound spans that touch no base span, for many texts at a time. Each line is one sequence; lines where
    nothing can be sound are left out (unless every line is asked for), which changes no span."""
    where, rows = [], []
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def decode() -> None:
        for (n, starts, ends), labels in zip(where, field.viterbi(rows)):
            edges = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1], [True]))).tolist()
            for a, b in zip(edges, edges[1:]):
                if labels[a]:
                    s, e = starts[a], ends[b - 1]
                    if sound(int(labels[a]) - 1, texts[n][s:e]) and not any(s < y and x < e for _, x, y in based[n]):
                        out[n].append((int(labels[a]) - 1, s, e))
        where.clear()
        rows.clear()

    held = []
    for n, text in enumerate(texts):
        body = masked(text, based[n]) if based[n] else text
        for lo, hi in lines_of(body, every):
            starts, ends, shapes, gaps = tokenised(body, lo, hi)
            if shapes:
                held.append(((n, starts, ends), field.emissions(shapes, gaps)))
    held.sort(key=lambda x: len(x[1]))  # like lengths together, so that padding is small
    for at, row in held:
        if rows and (len(rows) + 1) * len(row) > CELLS:
            decode()
        where.append(at)
        rows.append(row)
    decode()
    return out


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every row, by kind as listed, then start."""
    field = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            every = [sorted(b + m) for b, m in zip(base, added_spans(texts, base, field))]
            put = lambda x: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in d] for d in x], span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), put(base), put(every)], ["doc_id", "base", "spans"])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, base {SPAN}, spans {SPAN}")


def _span_list(col: str):
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def personal_digest(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_personal(docs).select("doc_id", *(count(k) for k in KINDS), F.sha2(_span_list("base").cast("binary"), 256).alias("base_sha256"), _span_list("spans").alias("spans"))

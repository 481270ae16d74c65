"""Secret scans by a battery of randomness tests.

Candidates are long runs of encoding characters. For each one the encoding is inferred from its alphabet (hex, base32,
base62, base64). Three tests ask whether it looks drawn at random from that alphabet: chi-squared uniformity of the
alphabet, a runs test about the alphabet's middle, and the serial correlation of neighbours; Fisher's method joins
them. What passes is weighed against prose: the likelihood ratio of random against text gives a p-value that shrinks
with length (Markov's inequality on the ratio), and Benjamini-Hochberg controls false discoveries over the candidates
of a document.

Cases: null text counts as empty; an empty text has no spans; repeated rows give one result row each; a null doc_id is
kept as null; other columns are not looked at. Spans found by the base patterns always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

# The base patterns of the contract.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # greedy runs, so the same as all runs less those under 16
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:=++(?![A-Za-z0-9+/_-]))?")  # an equals sign is padding at the end, else it parts name and value
#: Characters that a candidate has at least, padding with them.
SHORTEST = 20
#: A run with signs of both base64 alphabets is cut at those of the one and at those of the other.
PARTS = (re.compile(r"[A-Za-z0-9+/]{16,}=*"), re.compile(r"[A-Za-z0-9_-]{16,}=*"))

#: A battery p-value under this rejects "drawn at random".
NOT_RANDOM = 1e-5
#: Share of false discoveries allowed among a document's candidates.
FALSE_DISCOVERIES = 0.01

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
#: How a character of a long run in prose is spread: small letters mostly.
_TEXT = {**dict.fromkeys(_LOWER, 0.90 / 26), **dict.fromkeys(_UPPER, 0.05 / 26), **dict.fromkeys(_DIGITS, 0.03 / 10), **dict.fromkeys("+/-_=", 0.02 / 5)}


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty."""
    return _normal_tail(((max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds every character; None for plain numbers and mixtures."""
    body = set(token.rstrip("="))
    if not body or body <= set(_DIGITS):
        return None
    return next((k for k, letters in _INDEX.items() if body <= letters.keys()), None)


def battery(token: str) -> tuple[str | None, float, float]:
    """(encoding, p of the joined tests under 'random', p under 'prose')."""
    kind = encoding(token)
    body = token.rstrip("=")
    n = len(body)
    if kind is None or n < 16:
        return kind, 0.0, 1.0
    index, m = _INDEX[kind], len(ALPHABETS[kind])
    at = [index[c] for c in body]
    counts = [0] * m
    for i in at:
        counts[i] += 1
    uniform = _chi_tail(sum(c * c for c in counts) * m / n - n, m - 1)
    high = [i >= m / 2 for i in at]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(1e-9, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))))
        wald = math.erfc(abs(runs - mean) / spread / math.sqrt(2))
    else:
        wald = 2.0 ** (1 - n)
    centre = sum(at) / n
    power = sum((i - centre) ** 2 for i in at)
    serial = sum((x - centre) * (y - centre) for x, y in zip(at, at[1:])) / power if power else 1.0
    lag = math.erfc(abs(serial) * math.sqrt(n) / math.sqrt(2))
    joined = _chi_tail(-2 * sum(math.log(max(p, 1e-300)) for p in (uniform, wald, lag)), 6)
    ratio = sum(-math.log(m) - math.log(_TEXT[c]) for c in body)
    return kind, joined, math.exp(-ratio) if ratio > 0 else 1.0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def random_spans(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Candidates that touch no base span, pass the battery and survive the false-discovery control."""
    held = [x for x, free in _outside(text, taken) if free]
    tested = sorted((p, s, e) for s, e in held for _, joined, p in [battery(text[s:e])] if joined >= NOT_RANDOM)
    keep = max((i for i, (p, _, _) in enumerate(tested, 1) if p <= FALSE_DISCOVERIES * i / len(held)), default=0)
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in tested[:keep]):  # the two ways to cut a run may overlap
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return [(s, "random", e) for s, e in out]


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each candidate, by start; mixed runs in parts."""
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < SHORTEST:
            continue
        body = set(m.group())
        if not (body & set("+/") and body & set("-_")):
            yield m.span()
        else:
            yield from sorted({x.span() for part in PARTS for x in part.finditer(text, *m.span()) if x.end() - x.start() >= SHORTEST})


def _outside(text: str, taken: list[tuple[int, str, int]]):
    """The candidates, each with whether it lies outside every span; by bisection for texts with many spans."""
    bounds = sorted((s, e) for s, _, e in taken)
    starts, far = [s for s, _ in bounds], list(itertools.accumulate((e for _, e in bounds), max))
    for start, end in _candidates(text):
        i = bisect.bisect_left(starts, end)
        yield (start, end), not i or far[i - 1] <= start


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    base = base_spans(text)
    more = random_spans(text, base)
    return base, sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[1]), x[2])) if more else base


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def redacted(text: str) -> str:
    """Each stretch covered by spans becomes [SECRET]."""
    out, at = [], 0
    for s, _, e in scan(text)[1]:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = e
    return "".join([*out, text[at:]]) if out else text


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points, end exclusive) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [scan(t) for t in batch.column("text").to_pylist()]
            put = lambda i: pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in x[i]] for x in found], span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), put(0), put(1)], ["doc_id", "base", "spans"])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, base {SPAN}, spans {SPAN}")


def _span_list(col: str):
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets()."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_secrets(docs).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(_span_list("base").cast("binary"), 256).alias("base_sha256"), _span_list("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced and n_chars (where there is one) measured anew; no row is dropped, null stays null."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon (whole words and stems) is learnt from a bounded sample of labelled rows: terms whose document frequency
among toxic rows far exceeds that among the others. Its trie is intersected with Levenshtein automata; the product is
made deterministic as tokens are read, so that a token is one walk of dictionary look-ups, and finds terms misspelled
by one edit. Each hit is weighted by what its kind (term, edits) was worth in the sample, and by its window: within
quotation marks or near a reporting word it counts less. A logistic model on the sums gives the score.

Cases: null and empty texts have no hits and get the model's lowest score; repeated rows are scored alike; a null
doc_id is scored and is in neither fold (held_out null); without usable labels the lexicon is empty and all scores
are equal and under the threshold. No other column is looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, remainder, written

#: Bound of the labelled sample, for each label; chosen by a hash of the id, so that it does not depend on order.
SAMPLE_PER_LABEL = 1500
STEMS = range(4, 9)
#: A term's evidence: e to the minus this bounds the chance that it is toxic so often by luck, among some 10^6 terms.
EVIDENCE = 14.0
#: Terms from this length on may be misspelled by one edit.
FUZZY_FROM = 5
THRESHOLD = 0.7
#: Words on each side of a hit that are read for context.
WINDOW = 6
#: What a hit in a quotation counts.
QUOTED = 0.35
# Words that report somebody else's speech.
REPORTING = frozenset("said says quote quoted quotes wrote writes called calls word term means meaning reported dijo escribió llamó sagte schrieb nannte dit écrit appelé".split())
WORD = re.compile(r"[^\W\d_]+")
#: A digit or mark before a letter.
MARK = re.compile(r"(?:[\d_]|[^\w\s])(?=[^\W\d_])")
OPEN = "\"'“”„«»‘’`"


class Matcher:
    """Trie x Levenshtein automaton, made deterministic on the way. A state is the set of (trie node, edits)."""

    def __init__(self, words: list[str], stems: list[str], fuzzy_from: int = FUZZY_FROM, most_states: int = 50_000):
        self.terms = [(w, False) for w in words] + [(s, True) for s in stems]
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.fuzzy: list[bool] = [False]  # whether a fuzzy term lies below
        for i, (term, _) in enumerate(self.terms):
            at = 0
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.fuzzy.append(False)
                at = self.child[at][c]
            self.ends[at].append(i)
        self.may = [len(t) >= fuzzy_from + stem for t, stem in self.terms]
        for i, (term, _) in enumerate(self.terms):
            if self.may[i]:
                at = 0
                self.fuzzy[0] = True
                for c in term:
                    at = self.child[at][c]
                    self.fuzzy[at] = True
        self.most_states = most_states
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.stem_hit: list[tuple[int, int] | None] = []
        self.word_hit: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo = [p for p in pairs if p[1] == 0]
        for node, _ in todo:  # a letter of the term that the token lacks
            pairs |= {(x, 1) for x in self.child[node].values() if self.fuzzy[x]}
        pairs = frozenset(p for p in pairs if p[1] == 0 or (p[0], 0) not in pairs)
        if pairs not in self.ids:
            self.ids[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.step.append({})
            hits = [(e, i) for node, e in pairs for i in self.ends[node] if e == 0 or self.may[i]]
            stem = min(((e, -len(self.terms[i][0]), i) for e, i in hits if self.terms[i][1]), default=None)
            word = min(((e, -len(self.terms[i][0]), i) for e, i in hits), default=None)
            self.stem_hit.append(stem and (stem[2], stem[0]))
            self.word_hit.append(word and (word[2], word[0]))
        return self.ids[pairs]

    def _next(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            below = self.child[node]
            if c in below and (e == 0 or self.fuzzy[below[c]]):
                out.add((below[c], e))
            if e == 0:
                if self.fuzzy[node]:
                    out.add((node, 1))  # a letter too many
                out |= {(x, 1) for k, x in below.items() if k != c and self.fuzzy[x]}
        new = self._state(out) if out else -1
        self.step[state][c] = new
        return new

    def match(self, token: str) -> tuple[int, int] | None:
        """(term, edits) of the best term: a whole word within one edit, or a stem that the token begins with."""
        if len(self.sets) > self.most_states:
            self._reset()
        at, best = self.start, None
        for c in token:
            to = self.step[at].get(c)
            if to is None:
                to = self._next(at, c)
            if to < 0:
                return best
            at = to
            hit = self.stem_hit[at]
            if hit and (best is None or hit[1] <= best[1]):
                best = hit
        hit = self.word_hit[at]
        return hit if hit and (best is None or hit[1] < best[1]) else best


def joined(text: str) -> Iterator[str]:
    """Two words with one digit or mark between them; it may be the one edit of a term, as in 'st0pid'."""
    for m in MARK.finditer(text):
        at = begin = m.start()
        while begin and text[begin - 1].isalnum() and not text[begin - 1].isdecimal():
            begin -= 1
        if begin < at:
            yield text[begin : WORD.match(text, at + 1).end()]


class Reader:
    """Finds the hits of texts, remembering which tokens hit nothing."""

    def __init__(self, matcher: Matcher, most: int = 100_000):
        self.matcher, self.most = matcher, most
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def read(self, text: str) -> list[tuple[int, int, bool]]:
        """(term, edits, quoted) of each hit, in order."""
        lowered = text.lower()
        tokens = WORD.findall(lowered)
        distinct = {*tokens, *joined(lowered)}
        new = distinct - self.seen
        if new:
            if len(self.seen) > self.most:
                self.seen.clear()
                self.hits.clear()
                new = distinct
            self.seen |= new
            for token in new:
                if hit := self.matcher.match(token):
                    self.hits[token] = hit
        if self.hits.keys().isdisjoint(distinct):
            return []
        out, at = [], 0
        for i, token in enumerate(tokens):
            at = lowered.find(token, at)
            hit, end, past = self.hits.get(token), at + len(token), i + 1
            if not hit and past < len(tokens) and tokens[past] not in self.hits and lowered.startswith(tokens[past], end + 1):
                end, past = end + 1 + len(tokens[past]), past + 1
                hit = self.hits.get(lowered[at:end])
            if hit:
                before, after = lowered[at - 1 : at], lowered[end : end + 1]
                near = tokens[max(0, i - WINDOW) : i] + tokens[past : past + WINDOW]
                marked = (before in OPEN and before != "") or (after in OPEN and after != "") or _inside(lowered, at)
                out.append((*hit, marked or not REPORTING.isdisjoint(near)))
            at += len(token)
        return out


def _inside(text: str, at: int, reach: int = 60) -> bool:
    """Whether a quotation opens before and closes after, within reach, on the same line."""
    left = text[max(0, at - reach) : at].rpartition("\n")[2]
    right = text[at : at + reach].partition("\n")[0]
    return any(left.count(a) % 2 == 1 and b in right if a == b else left.rfind(a) > left.rfind(b) and b in right for a, b in ('""', "“”", "«»", "„“"))


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weight: dict[tuple[int, int], float] = field(default_factory=dict)
    beta: tuple[float, ...] = (-4.0, 0.0, 0.0)

    def features(self, hits: list[tuple[int, int, bool]]) -> tuple[float, float]:
        if not hits:
            return 0.0, 0.0
        return self.summed(Counter(hits))

    def summed(self, counts: dict[tuple[int, int, bool], int]) -> tuple[float, float]:
        """features() of hits that are counted by kind."""
        worth = [(self.weight.get((t, e), 0.0) * (QUOTED if quoted else 1.0), n) for (t, e, quoted), n in sorted(counts.items())]
        return math.log1p(sum(w * n for w, n in worth)), max((w for w, _ in worth), default=0.0)

    def score(self, hits: list[tuple[int, int, bool]]) -> float:
        a, b = self.features(hits)
        z = self.beta[0] + self.beta[1] * a + self.beta[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most SAMPLE_PER_LABEL labelled rows of either label, of the training fold."""
    fold = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1))
    one = fold.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    held = [one.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(SAMPLE_PER_LABEL) for k in (0, 1)]
    return id_and_text(docs).join(F.broadcast(held[0].unionByName(held[1])), "doc_id").select("text", "toxic")


def _contexts(sample: DataFrame, terms: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, int]]:
    """For each term the distinct words that it follows, in toxic rows and in the others. Words that only copies of one
    text share follow few; words of abuse follow many."""
    place = {t: i for i, t in enumerate(terms)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int, int]] = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                before = ""
                for w in WORD.findall(text.lower()):
                    for key in (("w", w), *(("s", w[:n]) for n in STEMS if len(w) > n)):
                        if key in place:
                            seen.add((place[key], toxic, zlib.crc32(before.encode())))
                    before = w
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.int64()) for k in range(3)], ["term", "toxic", "before"])

    rows = sample.mapInArrow(find, "term long, toxic long, before long").distinct().groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    return {terms[r["term"]]: (r["toxic"], r["clean"]) for r in rows.collect()}


def _lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """(words, stems) of EVIDENCE at least that are 20 times as frequent among toxic rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            rows = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
                terms = {("w", w) for w in words} | {("s", w[:n]) for w in words for n in STEMS if len(w) > n}
                seen[toxic].update(terms)
                rows[toxic] += 1
            keys = seen[0].keys() | seen[1].keys()
            data = [("n", "", rows[0], rows[1])] + [(k, t, seen[0][k, t], seen[1][k, t]) for k, t in keys]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*data), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["kind", "term", "clean", "toxic"])

    counts = sample.mapInArrow(count, "kind string, term string, clean long, toxic long").groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts, _ = written(counts, "toxic-terms")
    total = counts.filter("kind = 'n'").first()
    if total is None or not total["toxic"]:
        return [], []
    chance = total["toxic"] / (total["toxic"] + total["clean"])

    def evidence(toxic: int, clean: int) -> float:
        """Chernoff's exponent against "as often toxic as any row"."""
        n = toxic + clean
        p = toxic / n if n else 0.0
        if p <= chance:
            return 0.0
        return n * (p * math.log(p / chance) + ((1 - p) * math.log((1 - p) / (1 - chance)) if p < 1 else 0.0))

    # the first bound is evidence()'s own: it is at most toxic * log(1 / chance), so these terms stand in that many of the
    # sample's rows, which bounds how many there are
    strong = counts.filter((F.col("kind") != "n") & (F.col("clean") * 10 <= F.col("toxic")) & (F.col("toxic") * (-math.log(chance)) >= EVIDENCE)).collect()
    held = {(r["kind"], r["term"]): r for r in strong if evidence(r["toxic"], r["clean"]) >= EVIDENCE}
    contexts = _contexts(sample, list(held))
    share = {k: ((r["clean"] + 0.5) / (total["clean"] + 1), (r["toxic"] + 0.5) / (total["toxic"] + 1)) for k, r in held.items() if evidence(*contexts.get(k, (0, 0))) >= EVIDENCE}
    strong = sorted((k for k, (c, t) in share.items() if t / c >= 20), key=lambda k: (-share[k][1], k))
    stems: list[str] = []
    words: list[str] = []
    for kind, term in strong:
        if any(term.startswith(s) for s in stems):
            continue  # a stem chosen before it covers it
        whole = share.get(("w", term))
        if kind == "s":
            # a stem must bring more rows than any one word under it, else the word alone is the term
            if max((share[k, t][1] for k, t in share if k == "w" and t.startswith(term)), default=0) < 0.9 * share[kind, term][1]:
                stems.append(term)
        elif whole and not any(s.startswith(term) for s in stems):
            words.append(term)
    return sorted(w for w in words if not any(w.startswith(s) for s in stems)), sorted(stems)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns lexicon, weights and score from the bounded sample."""
    sample = _sample(docs, labels)
    words, stems = _lexicon(sample)
    if not words and not stems:
        return Model()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Matcher(words, stems))
        for batch in batches:
            # a text's hits are summed by kind, which the lexicon bounds
            hits = [Counter(reader.read(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([[x for (i, e, quoted), m in d.items() for x in (i, e, int(quoted), m)] for d in hits], pa.list_(pa.int32()))], ["toxic", "hits"])

    rows = sample.mapInArrow(read, "toxic int, hits array<int>").collect()  # bounded: the sample's rows, their kinds of hits
    read_rows = [(r["toxic"], {(i, e, bool(quoted)): m for i, e, quoted, m in zip(*(r["hits"][k::4] for k in range(4)))}) for r in rows]
    n = Counter(t for t, _ in read_rows)
    by = (Counter(), Counter())
    for toxic, hits in read_rows:
        by[toxic].update({h[:2] for h in hits})
    weight = {}
    for key in by[0].keys() | by[1].keys():
        odds = math.log((by[1][key] + 0.25) / (n[1] + 1)) - math.log((by[0][key] + 0.25) / (n[0] + 1))
        if odds > 1 and by[1][key] > by[0][key]:
            weight[key] = min(odds, 6.0)
    for i, may in enumerate(Matcher(words, stems).may):  # an edit not met in the sample
        if (i, 0) in weight and may and not by[0][i, 1]:
            weight.setdefault((i, 1), 0.6 * weight[i, 0])
    model = Model(words, stems, weight)
    x = np.array([[1.0, *model.summed(h)] for _, h in read_rows])
    y = np.array([float(t) for t, _ in read_rows])
    beta = np.zeros(3)
    for _ in range(60):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.05, 0.05])
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    if beta[1] < 0 or beta[2] < 0:  # more evidence never lowers a score
        beta = np.array([beta[0], max(beta[1], 0), max(beta[2], 0)])
    model.beta = tuple(float(b) for b in beta)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and hits (count) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Matcher(model.words, model.stems))
        for batch in batches:
            hits = [reader.read(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(h) for h in hits], pa.float64()), pa.array([len(h) for h in hits], pa.int32())], ["doc_id", "score", "hits"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, hits int")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows scored under THRESHOLD, with all their columns."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(Matcher(model.words, model.stems))
        for texts in parts:
            yield texts.map(lambda t: model.score(reader.read(t or "")))

    return docs.filter(score("text") < THRESHOLD)

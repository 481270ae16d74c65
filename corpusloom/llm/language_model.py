"""LM scoring by an interpolated modified Kneser-Ney model of word pairs.

Spark counts it in three rounds; between them travel blobs (sorted, delta-coded, compressed counts of one bucket of one
map task), not a row for each pair. Round one counts words by the hash of their bytes and writes sorted hash arrays,
whose positions are the word ids; round two counts pairs of ids and writes sorted arrays of pairs and the totals of
contexts; round three counts for each word the contexts it follows. The arrays lie in the shared folder, one set for
each bucket, and workers map them into memory to score. All counts are over every training document; the word hash has
64 bits, so that two of a billion words meet with a chance of some hundredths.

    p(w|u) = max(c(u,w) - D(c), 0) / c(u) + gamma(u) * p(w)
    p(w)   = max(n(w) - D'(n), 0) / n + gamma' / (V + 1),  n(w): how many words w follows

Discounts by Chen and Goodman from the counts of counts; where those leave one undefined, 1/2, 1 and 3/2.

Cases: null and empty texts are the end token alone; repeated rows train and score each; a null doc_id trains nothing
and is scored with held_out null; without training documents every token has probability 1; very long texts are read
in pieces cut at white space; other columns are not looked at. Word ids have 32 bits: 2^32 - 1 distinct words or more
are refused with an error before anything is scored.

The order is 2. A third order would add its counts, the middle order's continuation counts and their arrays to what lies
on disk, some 2 bytes for each byte of text in each of two more rounds.
"""

from __future__ import annotations

import bisect
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, new_folder, remainder

#: Bytes of training text for each bucket, as aimed for.
BUCKET_BYTES = 12_000_000
#: Bytes of text that a worker tokenises at once.
PIECE = 4_000_000
#: Distinct keys that a map task holds before it sends them on.
HELD = 3_000_000
NO_WORD = np.uint32(0xFFFFFFFF)

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse mod 2^64


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


END_HASH = _mix(np.array([0x656E64], np.uint64))[0]
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Hasher:
    """Hashes of all words of a buffer at once: differences of prefix sums of byte values times powers."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        """Tables for buffers of n bytes, with some room up to a piece; made in place, as every task has its own."""
        if len(self.power) < n:
            n = max(n, min(n + n // 8, PIECE + 1))

            def run(base: int) -> np.ndarray:
                out = np.full(n, base, np.uint64)
                out[0] = 1
                return np.cumprod(out, out=out)

            self.power, self.inverse = run(_STEP), run(pow(_STEP, -1, 1 << 64))

    def words(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of every word."""
        if not buffer:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        raw = _LOWER[np.frombuffer(buffer, np.uint8)]
        inside = np.concatenate(([False], ~_SPACE[raw], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        self._powers(len(raw) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[raw] * self.power[: len(raw)])))
        h = (sums[end] - sums[start]) * self.inverse[start]
        return _mix(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), start


def pieces(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(buffer, where documents start in it, whether each ends in it): a text of over PIECE bytes is cut at white space."""
    parts, starts, ends, size = [], [], [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        at = 0
        while True:
            stop = len(data)
            if stop - at > PIECE:
                stop = at + PIECE
                while stop < len(data) and not _SPACE[data[stop]]:
                    stop += 1
            parts.append(data[at:stop])
            starts.append(size)
            ends.append(stop == len(data))
            size += stop - at + 1
            at = stop
            if size >= PIECE:
                yield b"\n".join(parts), np.array(starts), np.array(ends)
                parts, starts, ends, size = [], [], [], 0
            if at == len(data):
                break
    if parts:
        yield b"\n".join(parts), np.array(starts), np.array(ends)


def tokens(hasher: Hasher, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hash, document, whether it opens its document) of all tokens, the end tokens among them."""
    begun, open_ = 0, False  # the document that a piece goes on with
    for buffer, starts, ends in pieces(texts):
        h, at = hasher.words(buffer)
        doc = np.searchsorted(starts, at, "right") - 1
        tail = np.flatnonzero(ends)
        where = np.searchsorted(doc, tail, "right")
        h, doc = np.insert(h, where, END_HASH), np.insert(doc, where, tail)
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        if open_ and len(first):
            first[0] = False
        # documents are numbered over all pieces: a piece that does not end its document shares the number with the next
        number = begun + np.concatenate(([0], np.cumsum(ends)[:-1]))
        yield h, number[doc], first
        begun += int(ends.sum())
        open_ = not ends[-1]


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, counts after them; bytes of one weight stand together for the compressor."""
    diff = np.diff(keys, prepend=np.uint64(0))
    planes = np.concatenate([diff.view(np.uint8).reshape(-1, 8).T.ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=12 * n + 1), np.uint8)
    keys = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(keys, dtype=np.uint64), np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their weights."""
    if not len(keys):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(weights, at)


def merged(blobs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of sorted counts, joined in pairs of like size so that little is held twice."""
    stack: list[tuple[np.ndarray, np.ndarray]] = []
    for blob in blobs:
        stack.append(unpacked(blob))
        while len(stack) > 1 and len(stack[-1][0]) * 2 >= len(stack[-2][0]):
            (a, x), (b, y) = stack.pop(), stack.pop()
            stack.append(counted(np.concatenate([b, a]), np.concatenate([y, x])))
    while len(stack) > 1:
        (a, x), (b, y) = stack.pop(), stack.pop()
        stack.append(counted(np.concatenate([b, a]), np.concatenate([y, x])))
    return stack[0] if stack else (np.empty(0, np.uint64), np.empty(0, np.int64))


class Counter:
    """Sums keys in a map task and gives out blobs by bucket when it holds many."""

    def __init__(self, bucket_of, most: int = HELD) -> None:
        self.bucket_of, self.most, self.held, self.size = bucket_of, most, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = counted(keys)
        self.held.append(part)
        self.size += len(part[0])
        if self.size > 2 * self.most:
            self._sum()
            if self.size > self.most:
                yield from self.flush()

    def _sum(self) -> None:
        self.held = [counted(np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held]))] if self.held else []
        self.size = sum(len(k) for k, _ in self.held)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._sum()
        for keys, counts in self.held:
            yield from by_bucket(keys, counts, self.bucket_of(keys))
        self.held, self.size = [], 0


BLOB = "bucket int, blob binary"


def by_bucket(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blobs of sorted keys whose buckets are ranges of them."""
    for b in np.unique(bucket):
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([packed(keys[lo:hi], counts[lo:hi])], pa.binary())], ["bucket", "blob"])


class Store:
    """Arrays in the shared folder. A folder that the machines mount is written and mapped in place; of any other store
    (read through pyarrow's file systems) workers keep a copy of what they use in their temporary folder."""

    def __init__(self, root: str) -> None:
        self.root = root
        at = urlparse(root)
        self.local = at.path if at.scheme in ("", "file") else None

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def put(self, name: str, array: np.ndarray) -> None:
        """Written aside and renamed, so that a repeated task does no harm."""
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            handle, aside = tempfile.mkstemp(dir=self.local, prefix=".new-")
            with os.fdopen(handle, "wb") as f:
                np.save(f, array)
            os.chmod(aside, 0o644)
            os.replace(aside, f"{self.local}/{name}.npy")
        else:
            system, base = self._remote()
            system.create_dir(base, recursive=True)
            aside = f"{base}/.new-{name}-{os.getpid()}-{os.urandom(4).hex()}"
            with system.open_output_stream(aside) as f:
                np.save(f, array)
            system.move(aside, f"{base}/{name}.npy")

    def get(self, name: str) -> np.ndarray:
        """The array, mapped into memory."""
        if self.local:
            return np.load(f"{self.local}/{name}.npy", mmap_mode="r")
        kept = os.path.join(tempfile.gettempdir(), os.path.basename(self.root.rstrip("/")))
        os.makedirs(kept, exist_ok=True)
        here = f"{kept}/{name}.npy"
        if not os.path.exists(here):
            system, base = self._remote()
            handle, aside = tempfile.mkstemp(dir=kept)
            with os.fdopen(handle, "wb") as f, system.open_input_stream(f"{base}/{name}.npy") as g:
                while part := g.read(1 << 22):
                    f.write(part)
            os.replace(aside, here)
        return np.load(here, mmap_mode="r")


@dataclass
class Vocabulary:
    """Word ids: the position of a hash among the sorted hashes; bucket b holds hashes with the top bits b."""

    root: str
    bits: int
    offsets: list[int]

    def __post_init__(self) -> None:
        self.arrays: dict[int, np.ndarray] = {}

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """uint32 ids; NO_WORD where the word is unknown. Each distinct hash is looked up once, in order."""
        distinct, back = np.unique(h, return_inverse=True)
        out = np.full(len(distinct), NO_WORD, np.uint32)
        bucket = self.bucket(distinct)
        for b in np.unique(bucket).tolist():
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            if self.offsets[b + 1] == self.offsets[b]:
                continue
            if b not in self.arrays:
                self.arrays[b] = Store(self.root).get(f"word-{b}")
            known = self.arrays[b]
            at = np.minimum(np.searchsorted(known, distinct[lo:hi]), len(known) - 1)
            out[lo:hi] = np.where(known[at] == distinct[lo:hi], at + self.offsets[b], NO_WORD)
        return out[back]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """What is taken off a count of 0, 1, 2 and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5)
    return (0.0, *(float(d) if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), raw)))


@dataclass
class Model:
    root: str
    vocabulary: Vocabulary
    words: int  # V
    total: int  # N, training tokens
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    followed: int  # distinct pairs
    kinds: tuple[int, int, int]  # words that follow one, two, or more

    def __post_init__(self) -> None:
        self.width = max(1, -(-(self.words + 1) // (1 << self.vocabulary.bits)))  # ids of a bucket; one more for "begin"
        self.maps: dict[tuple[str, int], np.ndarray] = {}
        self.gamma = sum(d * n for d, n in zip(self.word_discounts[1:], self.kinds)) / max(1, self.followed)

    def map(self, name: str, bucket: int) -> np.ndarray:
        if (name, bucket) not in self.maps:
            self.maps[name, bucket] = Store(self.root).get(f"{name}-{bucket}")
        return self.maps[name, bucket]

    def dense(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of ids (sorted) from arrays indexed by id."""
        out = []
        for b in np.unique(ids // self.width).tolist():
            lo, hi = np.searchsorted(ids, [b * self.width, (b + 1) * self.width])
            out.append(self.map(name, b)[ids[lo:hi] - b * self.width])
        return np.concatenate(out) if out else np.empty(0)

    def score(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, probability) of each token; first marks those that open a document."""
        if not self.total:
            return np.zeros(len(ids), np.int64), np.ones(len(ids))
        begin = np.int64(self.words)
        known = ids != NO_WORD
        distinct, back = np.unique(ids[known], return_inverse=True)
        distinct = distinct.astype(np.int64)
        count, lower = np.zeros(len(ids), np.int64), np.full(len(ids), self.gamma / (self.words + 1))
        follows = self.dense("follows", distinct)
        word_d = np.array(self.word_discounts)
        count[known] = self.dense("count", distinct)[back]
        lower[known] += (np.maximum(follows - word_d[np.minimum(follows, 3)], 0) / max(1, self.followed))[back]
        before = np.concatenate(([begin], ids[:-1].astype(np.int64)))
        before[first] = begin
        usable = before != np.int64(NO_WORD)
        contexts, where = np.unique(before[usable], return_inverse=True)
        shape = np.concatenate([self.map("context", b)[contexts[np.searchsorted(contexts, b * self.width) : np.searchsorted(contexts, (b + 1) * self.width)] - b * self.width] for b in np.unique(contexts // self.width).tolist()]) if len(contexts) else np.empty((0, 4), np.int64)
        total = shape[:, 0].astype(np.float64)
        pair_d = np.array(self.pair_discounts)
        back_off = np.where(total > 0, (shape[:, 1:] @ pair_d[1:]) / np.maximum(total, 1), 1.0)
        p = lower.copy()
        p[usable] *= back_off[where]
        both = usable & known
        keys = before[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64)
        asked, again = np.unique(keys, return_inverse=True)
        seen = np.zeros(len(asked), np.int64)
        bucket = (asked >> np.uint64(32)).astype(np.int64) // self.width
        for b in np.unique(bucket).tolist():
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            pairs = self.map("pair", b)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, asked[lo:hi]), len(pairs) - 1)
                seen[lo:hi] = np.where(pairs[at] == asked[lo:hi], self.map("times", b)[at], 0)
        all_totals = np.zeros(len(ids))
        all_totals[usable] = total[where]
        c = seen[again]
        p[both] += np.maximum(c - pair_d[np.minimum(c, 3)], 0) / np.maximum(all_totals[both], 1)
        return count, p


def _first_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)] + [int((x >= 3).sum())]


STATS = "kind string, bucket int, blob binary, stats array<long>"


def _row(kind: str, bucket: int, blob: bytes | None, stats: list[int] | None) -> pa.Table:
    return pa.table({"kind": [kind], "bucket": pa.array([bucket], pa.int32()), "blob": pa.array([blob], pa.binary()), "stats": pa.array([stats], pa.list_(pa.int64()))})


def fit(docs: DataFrame) -> Model:
    """Counts the model over every row of docs."""
    spark = docs.sparkSession
    rows = id_and_text(docs).select("text")
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(3, (-(-size // BUCKET_BYTES) - 1).bit_length())
    buckets, root = 1 << bits, new_folder(spark, "model")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counter = Hasher(), Counter(lambda h: h >> np.uint64(64 - bits))
        for batch in batches:
            for h, _, _ in tokens(hasher, batch.column("text").to_pylist()):
                yield from counter.add(h)
        yield from counter.flush()

    def write_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        hashes, counts = merged(x.as_py() for x in table.column("blob"))
        Store(root).put(f"word-{b}", hashes)
        Store(root).put(f"seen-{b}", counts)
        return _row("words", b, None, [len(hashes), int(counts.sum())])

    found = rows.mapInArrow(words, BLOB).groupBy("bucket").applyInArrow(write_words, STATS).select("bucket", "stats").collect()
    sizes = {r["bucket"]: r["stats"] for r in found}
    offsets = np.concatenate(([0], np.cumsum([sizes.get(b, [0, 0])[0] for b in range(buckets)]))).tolist()
    vocabulary, total = Vocabulary(root, bits, offsets), sum(s[1] for s in sizes.values())
    many = offsets[-1]
    if not total:
        return Model(root, vocabulary, 0, 0, discounts(0, 0, 0, 0), discounts(0, 0, 0, 0), 0, (0, 0, 0))
    if many >= int(NO_WORD):
        raise ValueError("more distinct words than 32-bit ids")
    width = max(1, -(-(many + 1) // buckets))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counter = Hasher(), Counter(lambda k: (k >> np.uint64(32)) // np.uint64(width))
        for batch in batches:
            last = np.uint64(many)
            for h, _, first in tokens(hasher, batch.column("text").to_pylist()):
                ids = vocabulary.ids(h).astype(np.uint64)
                if not len(ids):
                    continue
                before = np.concatenate(([last], ids[:-1]))
                before[first] = many
                last = ids[-1]
                yield from counter.add(before << np.uint64(32) | ids)
        yield from counter.flush()

    def write_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        keys, counts = merged(x.as_py() for x in table.column("blob"))
        Store(root).put(f"pair-{b}", keys)
        Store(root).put(f"times-{b}", counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts)
        at = (keys >> np.uint64(32)).astype(np.int64) - b * width
        shape = np.stack([np.bincount(at, counts, minlength=width), *(np.bincount(at[pick], minlength=width) for pick in (counts == 1, counts == 2, counts >= 3))], axis=1)
        Store(root).put(f"context-{b}", shape.astype(np.int64))
        after, contexts = counted(keys & np.uint64(0xFFFFFFFF), np.ones(len(keys), np.int64))
        out = [_row("pairs", b, None, _first_counts(counts))]
        for batch in by_bucket(after, contexts, after // np.uint64(width)):
            out.append(_row("follows", batch.column("bucket")[0].as_py(), batch.column("blob")[0].as_py(), None))
        return pa.concat_tables(out)

    def write_follows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() == "pairs":
            return pa.concat_tables([_row("pairs", -1, None, s.as_py()) for s in table.column("stats")])
        b = key[1].as_py()
        ids, contexts = merged(x.as_py() for x in table.column("blob"))
        dense = np.zeros(width, np.int64)
        dense[ids.astype(np.int64) - b * width] = contexts
        Store(root).put(f"follows-{b}", dense)
        # the counts of the bucket's words, from the arrays by hash to one array by id
        lo, hi = b * width, min((b + 1) * width, many)
        own = range(max(0, bisect.bisect_right(offsets, lo) - 1), bisect.bisect_left(offsets, hi, hi=buckets))
        parts = [np.asarray(Store(root).get(f"seen-{w}")[max(lo, offsets[w]) - offsets[w] : min(hi, offsets[w + 1]) - offsets[w]]) for w in own if offsets[w] < hi and offsets[w + 1] > lo]
        Store(root).put(f"count-{b}", np.concatenate([*parts, np.zeros(width - (hi - lo), np.int64)]))
        return _row("follows", b, None, [len(ids), int(contexts.sum()), *_first_counts(contexts)])

    second = rows.mapInArrow(pairs, BLOB).groupBy("bucket").applyInArrow(write_pairs, STATS)
    stats = second.groupBy("kind", "bucket").applyInArrow(write_follows, STATS).select("kind", "stats").collect()  # a row for each bucket
    pair = np.sum([r["stats"] for r in stats if r["kind"] == "pairs"], axis=0)
    word = np.sum([r["stats"] for r in stats if r["kind"] == "follows"], axis=0)
    return Model(root, vocabulary, many, total, discounts(*pair[:4].tolist()), discounts(*word[2:6].tolist()), int(word[1]), (int(word[2]), int(word[3]), int(word[6])))


def score_text(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        spread = np.log10(model.total + 0.5 * (model.words + 1))
        for batch in batches:
            n = batch.num_rows
            sums = [np.zeros(n) for _ in range(4)]
            last = np.array([NO_WORD])
            for h, doc, first in tokens(hasher, batch.column("text").to_pylist()):
                if not len(h):
                    continue
                ids = model.vocabulary.ids(h)
                # a document that goes on from the last piece keeps that piece's last word as context
                joined, opens = np.concatenate([last, ids]).astype(np.uint32), np.concatenate(([True], first))
                count, p = model.score(joined, opens)
                count, p, last = count[1:], p[1:], ids[-1:]
                for s, x in zip(sums, (np.ones(len(doc)), count > 0, np.log10(count + 0.5) - spread, np.log10(p))):
                    s += np.bincount(doc, x, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def lm_digest(docs: DataFrame) -> DataFrame:
    fold = remainder(F.col("doc_id").cast("long"), 5)
    model = fit(docs.filter(fold != 1))
    held = remainder(F.col("doc_id"), 5) == 1
    return score_text(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")

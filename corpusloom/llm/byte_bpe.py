"""Byte-level BPE encoding and decoding.

Texts are cut where the tokenizer's pattern always ends one word and starts the next: before a space that follows no
white space, between ASCII letters, digits and marks of different kinds, and around a single line end between such.
A chunk's ids so do not depend on its neighbours. The distinct chunks of the corpus are gathered (each task sends its own distinct chunks, in groups of
bounded size), split by the pattern, and their words encoded by Spark's higher-order functions: bytes (as hex pairs) are
folded, the adjacent pair of lowest rank first, by a literal rank map. The map is an array of small maps, as Spark
searches a map from end to end. The encodings are written as sorted hash arrays to the shared folder; workers map them
into memory and put the documents together, a window of bounded bytes at a time: its distinct chunks are looked up, all
of a bucket at once, and ids gathered by position. What a hash array gives is decoded and compared with the chunk's own
bytes, and a chunk that does not match (two chunks of one 64-bit hash) is merged on the spot. Decoding joins the tokens'
bytes by Spark functions, from a literal array of them.

The cuts suit patterns like public_tokenizers.PATTERN: words are runs of letters, digits or marks behind one optional
space, or contractions that begin with an apostrophe (which therefore never takes part in a cut of the second kind).

Cases: null and empty texts have no ids; very long texts are like others (a chunk of over LONGEST bytes is merged in the
worker with a heap); repeated rows give a row each; a null doc_id stays null; an empty table gives no rows; other columns
are not looked at. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constant, id_and_text, let, new_folder, written
from .language_model import Store

#: Kinds of ASCII bytes: 1 letters, 2 digits, 3 marks but the apostrophe; all others are 0.
KIND = np.array([0 if c > 126 or c < 33 or c == 39 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
#: Small maps in the rank map.
MAPS = 16_384
#: Bytes of a chunk that the fold takes.
LONGEST = 64
#: Distinct chunks that a map task holds.
HELD = 200_000
#: Bytes of text (or of ids) that a worker handles at once; a longer one is handled alone.
WINDOW = 4 << 20
#: Distinct chunks of a bucket of the hash arrays, as aimed for.
BUCKET = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The literal: an array of maps from hex to rank, placed by crc32. Its size is the vocabulary's."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for token, rank in ranks.items():
        key = token.hex()
        maps[zlib.crc32(key.encode()) % MAPS][key] = rank
    return constant(spark, maps, "array<map<string,int>>")


def encode_word(word: Column, ranks: Column) -> Column:
    """array<int> of a word's ids; word is a string of hex pairs."""
    none = F.lit(1 << 30)
    rank = lambda x: F.coalesce(F.try_element_at(F.get(ranks, (F.crc32(x.cast("binary")) % MAPS).cast("int")), x), none)
    pieces = F.transform(F.sequence(F.lit(0), (F.length(word) / 2).cast("int") - 1), lambda i: F.substring(word, i * 2 + 1, F.lit(2)))
    pair_ranks = lambda p: F.transform(F.arrays_zip(F.slice(p, 1, F.size(p) - 1).alias("a"), F.slice(p, 2, F.size(p) - 1).alias("b")), lambda z: rank(F.concat(z["a"], z["b"])))

    def merged(p: Column, r: Column, j: Column) -> Column:
        """State after joining pieces j and j + 1 (from 1): only the ranks beside the join are looked up anew."""
        joined = F.concat(F.get(p, j - 1), F.get(p, j))
        return let(
            F.concat(F.slice(p, F.lit(1), j - 1), F.array(joined), F.slice(p, j + 2, F.greatest(F.size(p) - j - 1, F.lit(0)))),
            lambda q: F.struct(
                q.alias("p"),
                F.concat(
                    F.slice(r, F.lit(1), F.greatest(j - 2, F.lit(0))),
                    F.when(j > 1, F.array(rank(F.concat(F.get(q, j - 2), F.get(q, j - 1))))).otherwise(F.array().cast("array<int>")),
                    F.when(j < F.size(q), F.array(rank(F.concat(F.get(q, j - 1), F.get(q, j))))).otherwise(F.array().cast("array<int>")),
                    F.slice(r, j + 2, F.greatest(F.size(r) - j - 1, F.lit(0))),
                ).alias("r"),
            ),
        )

    def step(s: Column, _: Column) -> Column:
        return let(F.coalesce(F.array_min(s["r"]), none), lambda m: F.when(m >= none, s).otherwise(let(F.array_position(s["r"], m).cast("int"), lambda j: merged(s["p"], s["r"], j))))

    start = let(pieces, lambda p: F.struct(p.alias("p"), F.when(F.size(p) > 1, pair_ranks(p)).otherwise(F.array().cast("array<int>")).alias("r")))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(word) / 2).cast("int") - 1)), start, step, lambda s: F.transform(s["p"], rank))
    return let(rank(word), lambda whole: F.when(whole < none, F.array(whole)).otherwise(folded))


def encode_chunks(chunks: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """chunk, ids (array<int>) of distinct chunks."""
    # (?U): classes by Unicode's properties, as the pattern means them
    words = F.regexp_extract_all("chunk", F.lit("(?U)(" + pattern + ")"), F.lit(1))
    each = lambda literal: F.flatten(F.transform(words, lambda w: encode_word(F.lower(F.hex(w.cast("binary"))), literal)))
    return chunks.withColumn("_ranks", rank_map(chunks.sparkSession, ranks)).select("chunk", let(F.col("_ranks"), each).alias("ids"))


def merge_here(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ranked merges for one word of any length, by a heap over a linked list."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i]
        if piece[i] is None or j >= n or piece[i] + piece[j] != p:
            continue
        piece[i], piece[j] = p, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (q := piece[a] + piece[b]) in ranks:
                heapq.heappush(heap, (ranks[q], a, q))
    return [ranks[p] for p in piece if p is not None]


def bounds_of(array: pa.Array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4) if len(array) else np.zeros(1, np.int32)


def bytes_of(array: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The bytes that bounds take in."""
    return np.frombuffer(array.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)


def ragged(kind: pa.DataType, bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each of the runs, one run after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def windows(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of WINDOW bytes of the column."""
    bounds = bounds_of(batch.column(column)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + WINDOW, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def white_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character of several bytes that ends before a position is white space (Unicode)."""
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    return (
        ((two == 0xC2) & np.isin(one, (0x85, 0xA0)))
        | ((three == 0xE1) & (two == 0x9A) & (one == 0x80))
        | ((three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | np.isin(one, (0xA8, 0xA9, 0xAF))))
        | ((three == 0xE2) & (two == 0x81) & (one == 0x9F))
        | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    )


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts one after another, and the number of the first chunk of each text, with the end."""
    bounds = bounds_of(texts)
    data = bytes_of(texts, bounds)
    kind = KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    space = np.flatnonzero(data[1:] == 32) + 1
    before = data[space - 1]
    cut[space[(kind[space - 1] > 0) | (before == 39) | ((before >= 0x80) & ~white_before(data, space))]] = True
    line = np.flatnonzero(data[1:-1] == 10) + 1
    line = line[(kind[line - 1] > 0) & (kind[line + 1] > 0)]
    cut[line] = cut[line + 1] = True
    starts = bounds - bounds[0]
    cut[starts] = True
    at = np.flatnonzero(cut)
    return ragged(pa.string(), at, data), np.searchsorted(at, starts)


def hash_of(chunk: bytes) -> int:
    return xxhash.xxh64_intdigest(chunk)


class Tokens:
    """The vocabulary's bytes by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.array = pa.array(tokens, pa.binary())

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts, as bytes, whose ids lie between bounds."""
        parts = self.array.take(pa.array(ids))
        at = bounds_of(parts)
        return ragged(pa.binary(), (at - at[0])[bounds], bytes_of(parts, at))


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple[dict[bytes, int], Tokens]:
    """One for each worker process."""
    ranks = read_ranks(path)
    return ranks, Tokens(ranks)


class Encodings:
    """The hash arrays, mapped into memory."""

    def __init__(self, root: str, bits: int, ranks: dict[bytes, int], tokens: Tokens, pattern: str):
        import regex

        self.store, self.bits, self.ranks, self.tokens, self.pattern = Store(root), bits, ranks, tokens, regex.compile(pattern)
        self.maps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray] | None] = {}

    def _bucket(self, b: int):
        if b not in self.maps:
            try:
                self.maps[b] = tuple(self.store.get(f"{k}-{b}") for k in ("hash", "end", "ids"))
            except FileNotFoundError:  # a bucket without a chunk
                self.maps[b] = None
        return self.maps[b]

    def here(self, chunk: str) -> np.ndarray:
        return np.array([i for w in self.pattern.findall(chunk) for i in merge_here(w.encode("utf-8"), self.ranks)], np.uint32)

    def learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Looks up distinct chunks, all of a bucket at once: ids, and the start and number of those of each chunk."""
        plain = chunks.cast(pa.binary())
        h = np.fromiter(map(hash_of, plain.to_pylist()), np.uint64, len(chunks))
        order = np.argsort(h)
        sorted_h = h[order]
        bucket = (sorted_h >> np.uint64(64 - self.bits)).astype(np.int64)
        counts, values = np.zeros(len(h), np.int64), []
        for b in np.unique(bucket).tolist():
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            found = self._bucket(b)
            if found is None or not len(found[0]):
                continue
            hashes, ends, ids = found
            at = np.minimum(np.searchsorted(hashes, sorted_h[lo:hi]), len(hashes) - 1)
            start = np.where(at > 0, ends[np.maximum(at - 1, 0)], 0)
            n = np.where(hashes[at] == sorted_h[lo:hi], ends[at] - start, 0)
            counts[lo:hi] = n
            values.append(ids[spread(start, n)])
        ids = np.concatenate(values) if values else np.empty(0, np.uint32)
        same = pc.equal(self.tokens.decode(ids, np.concatenate(([0], np.cumsum(counts)))), plain.take(pa.array(order))).to_numpy(zero_copy_only=False)
        if not same.all():
            own = [self.here(x) for x in chunks.take(pa.array(order[~same])).to_pylist()]
            right = counts.copy()
            right[~same] = [len(x) for x in own]
            all_ids, kept = np.empty(right.sum(), np.uint32), np.repeat(same, right)
            all_ids[kept], all_ids[~kept] = ids[np.repeat(same, counts)], np.concatenate(own)
            ids, counts = all_ids, right
        starts, numbers = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        starts[order], numbers[order] = np.cumsum(counts) - counts, counts
        return ids, starts, numbers

    def encode(self, texts: pa.Array) -> pa.Array:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        chunks, first = chunks_of(texts)
        coded = chunks.dictionary_encode()
        ids, starts, numbers = self.learn(coded.dictionary)
        which = coded.indices.to_numpy()
        counts = numbers[which]
        bounds = np.concatenate(([0], np.cumsum(counts)))[first]
        return ragged(pa.binary(), bounds * 4, ids[spread(starts[which], counts)].astype("<u4"))


def distinct_chunks(docs: DataFrame) -> DataFrame:
    """chunk: the distinct chunks of all texts that the fold takes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.array([], pa.string())
        for batch in batches:
            for part in windows(batch, "text"):
                new = pc.unique(chunks_of(part.column("text"))[0])
                held = pc.unique(pa.concat_arrays([held, new.filter(pc.less_equal(pc.binary_length(new), LONGEST))]))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([held], ["chunk"])
                    held = held.slice(0, 0)
        yield pa.RecordBatch.from_arrays([held], ["chunk"])

    return id_and_text(docs).select("text").mapInArrow(gather, "chunk string").distinct()


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and tokens (the same as an array) of every row."""
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    chunks, _ = written(distinct_chunks(docs), "bpe-chunks")
    bits = max(2, (-(-chunks.count() // BUCKET) - 1).bit_length())
    root = new_folder(spark, "bpe")
    # as many tasks as there are buckets at least: the folds are the work here
    tasks = max(1 << bits, spark.sparkContext.defaultParallelism)
    folded = encode_chunks(chunks.repartition(tasks, "chunk"), ranks, pattern)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.fromiter(map(hash_of, batch.column("chunk").cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(h.view(np.int64)), batch.column("ids")], ["bucket", "h", "ids"])

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        table = table.combine_chunks()
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        order = order[np.concatenate(([True], np.diff(h[order]) != 0))] if len(h) else order  # of one hash the first stays; readers check
        ids = table.column("ids").take(pa.array(order)).combine_chunks()
        store = Store(root)
        store.put(f"hash-{b}", h[order])
        store.put(f"end-{b}", np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        store.put(f"ids-{b}", ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint32))
        return pa.table({"bucket": pa.array([b], pa.int32()), "chunks": pa.array([len(order)], pa.int64())})

    folded.mapInArrow(place, "bucket int, h long, ids array<int>").groupBy("bucket").applyInArrow(write, "bucket int, chunks long").collect()  # a row for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Encodings(root, bits, *vocabulary(ranks_path), pattern)
        for batch in batches:
            for part in windows(batch, "text"):
                ids = known.encode(part.column("text"))
                at = bounds_of(ids)
                tokens = pa.ListArray.from_arrays(pa.array((at - at[0]) // 4, pa.int32()), pa.array(bytes_of(ids, at).view("<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, tokens], ["doc_id", "ids", "tokens"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary, tokens array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with the column decoded: the bytes of its tokens, joined by Spark from a literal array of the pieces (as
    hex pairs, which are strings and so join in one pass)."""
    tokens = [b""] * (max(read_ranks(ranks_path).values(), default=-1) + 1)
    for token, rank in read_ranks(ranks_path).items():
        tokens[rank] = token
    rows = encoded.withColumn("_pieces", constant(encoded.sparkSession, [t.hex() for t in tokens], "array<string>"))
    joined = lambda pieces: F.unhex(F.array_join(F.transform("tokens", lambda i: F.get(pieces, i)), ""))
    return rows.withColumn("decoded", let(F.col("_pieces"), joined)).drop("_pieces")


def bpe_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

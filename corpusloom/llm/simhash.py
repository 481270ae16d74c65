"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints: XXH64 (seed 42) of word shingles; a bit is set where over half the hashes have it. Equal fingerprints are
one node from then on, so groups of copies cost one row per task.

Links are pairs of fingerprints at DISTANCE (2) or fewer differing bits. A fingerprint is three segments of 23, 23 and
18 bits. Of two errors at most, by the pigeonhole principle one of the pairs (A,B), (B,C), (C,A) has its first segment
free of errors and its second within one. So a fingerprint is stored under (pair, first segment, index of the Golay
codeword that the second segment decodes to) and asks under the indices that the segment's one-bit variants decode to
(1 to 6 of them, as the [23,12] code is perfect): no pair within the distance is missed.

Verification stays linear in hot buckets: fingerprints of buckets with two different members meet at midpoints. Two
words are within two bits just when the balls of radius one about them share a word, and one word lies in the balls of
65 fingerprints at most; each midpoint links its members to its smallest, and the distance is counted again there.
Components come from alternating large-star and small-star rounds over written edges.

Cases: null texts count as empty; a text without words has fingerprint zero and is linked like any other; repeated rows
give a row each; a null doc_id gets its component but never names one (a component of null ids only is null); an empty
table gives no rows; other columns are not looked at. Rows meet the names of their components by fingerprint: where a
fingerprint holds a large share of all rows that join leans on the splitting of skewed partitions, as the names are one row
for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, id_and_text, written

SEED = 42
DISTANCE = 2
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # (shift, bits)
PAIRS = ((0, 1), (1, 2), (2, 0))
#: Generator polynomial of the [23,12,7] Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text; encode().lower() and split() touch ASCII only."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view, digest = memoryview(whole), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    total = np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(first[at : at + 65_536], last[at : at + 65_536])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


_DECODE: list[np.ndarray] = []


def golay_index() -> np.ndarray:
    """For every 23-bit word the index (12 bits) of the codeword within three bits of it; built once in a worker."""
    if not _DECODE:
        message = np.arange(1 << 12, dtype=np.int64)
        code = np.zeros(1 << 12, np.int64)
        for i in range(12):
            code ^= np.where(message >> i & 1, GOLAY << i, 0)
        table = np.full(1 << 23, -1, np.int16)
        ones = [0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i in range(23) for j in range(i)), *(1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j))]
        for e in ones:
            table[code ^ e] = message
        _DECODE.append(table)
    return _DECODE[0]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the fingerprint, key, whether stored) for unsigned fingerprints; keys are 2 + 23 + 12 bits."""
    table, n = golay_index(), len(fps)
    part = [(fps >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    at, keys, stored = [], [], []
    for p, (i, j) in enumerate(PAIRS):
        head = np.int64(p) << 35 | part[i] << 12
        own = table[part[j]].astype(np.int64)
        asked = np.stack([own, *(table[part[j] ^ (1 << k)].astype(np.int64) for k in range(SEGMENTS[j][1]))])
        asked.sort(axis=0)
        new = np.ones_like(asked, bool)
        new[1:] = asked[1:] != asked[:-1]
        _, where = np.nonzero(new)
        at += [np.arange(n), where]
        keys += [head | own, head[where] | asked[new]]
        stored += [np.ones(n, bool), np.zeros(len(where), bool)]
    return np.concatenate(at), np.concatenate(keys), np.concatenate(stored)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for k in range(0, len(fps), 4096):
                at, keys, stored = golay_keys(fps[k : k + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[k : k + 4096][at]), pa.array(stored)], ["key", "fp", "stored"])

    return nodes.mapInArrow(run, "key long, fp long, stored boolean")


def candidates(nodes: DataFrame) -> DataFrame:
    """The fingerprints that share a bucket with another one: stored by one and asked for by the other."""
    keyed = _keyed(nodes)
    kept = F.when(F.col("stored"), F.col("fp"))
    buckets = keyed.groupBy("key").agg(F.min(kept).alias("least"), F.max(kept).alias("most"), F.min("fp").alias("low"), F.max("fp").alias("high")).filter("least is not null and low <> high")
    buckets, _ = written(buckets.select("key"), "simhash-buckets")
    return keyed.join(buckets, "key", "left_semi").select("fp").distinct()


def _ball(fp):
    """fp and its 64 neighbours at one bit."""
    bits = F.array(*(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)))
    return F.concat(F.array(fp), F.transform(bits, lambda bit: fp.bitwiseXOR(bit)))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a the smaller, that connect all fingerprints within two bits; every edge is within two bits."""
    balls = candidates(nodes).select("fp", F.explode(_ball(F.col("fp"))).alias("middle"))
    # a middle lies in 65 balls at most, so its list is bounded by the geometry
    met = balls.groupBy("middle").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    edges = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b")
    return edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in edges, root the smallest of its component: alternating star rounds.

    Each round joins on nodes' smallest neighbours only; the neighbours of a hub stay spread over its partners."""
    edges, path = written(edges.select("a", "b"), "star")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: every larger neighbour goes to the smallest
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large, large_path = written(large, "star")
        # small star: among the smaller neighbours (and itself) everything goes to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct()
        small, small_path = written(small, "star")
        before = edges
        changed = small.join(before, ["a", "b"], "left_anti").isEmpty() and before.join(small, ["a", "b"], "left_anti").isEmpty()
        drop(edges.sparkSession, path)
        drop(edges.sparkSession, large_path)
        edges, path = small, small_path
        if changed:
            break
    else:
        raise RuntimeError("the components did not settle")
    pairs = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return pairs.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows, _ = written(fingerprints(docs, shingle), "simhash-fp")
    nodes, _ = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels, _ = written(components(links(nodes.select("fp"))), "simhash-roots")
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    name, _ = written(rooted.join(named, "root").select("fp", "component_id"), "simhash-names")
    return rows.join(name, "fp").select("doc_id", "fp", "component_id")


def near_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Near copies by word shingles: SimHash fingerprints linked by Golay keys, verified, and completed exactly.

Two texts are near copies when the Jaccard similarity of their sets of word shingles (five words) is 0.8 or more; the
components of that relation are the groups. Of each group drop_near() lets one document stay.

1.  Every distinct shingle's number of texts is counted over all documents, by sorted blobs as in language_model, and
    the shingles of two texts or more go to sorted arrays in the shared folder.
2.  Prefix law: in any one order of all shingles two sets of similarity s share one of their first
    n - ceil(s * n) + 1. In the order of rising counts most of these stand in one text only and need no row; a text
    without a shared one has no near copy. For the others come the SimHash fingerprint, a parity map, the shared
    prefix; their sets go to files in the shared folder, which workers map into memory.
3.  Fingerprints within two bits are linked by simhash.links(), the Golay keys; besides, each text meets the smallest
    that it shares a prefix shingle with. These pairs are verified on the whole sets, and their components found.
4.  All pairs that share a prefix shingle and are still in different components meet in blocks of bounded size; sizes,
    positions in the prefix and parity maps rule out pairs without loss, and the rest is verified on the whole sets where
    it meets. Only links that join two components leave the task. A family of m unlike texts that share a prefix costs
    m^2 / 2 comparisons of maps, dealt over tasks by block, but no rows.

Golay keys alone cannot do it: at 0.8 about 15 % of the fingerprint's bits differ, so seven tables of 28 keys each found
0.958 of such pairs (less among short texts). Steps 2 and 4 leave nothing out, but for clashes of 64-bit hashes.

Cases: null texts count as empty; texts without words equal one another; texts of fewer words than a shingle are one
shingle; very long texts are whole; repeated rows and equal texts are in one group; rows with a null doc_id take part and
stay only if no row with an id is in their group; groups of null ids only have a null component_id; an empty table gives
no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, id_and_text, new_folder, without, written
from .language_model import BLOB, Counter, Hasher, Store, _mix, merged, pieces
from .simhash import components, links

WIDTH, SIMILARITY = 5, 0.8
#: Against rounding in sums of whole numbers and the similarity.
EPS = 1e-9
#: Bytes of text for each bucket of the counted shingles, as aimed for.
BUCKET_BYTES = 6_000_000
#: Distinct shingles that a counting task holds.
HELD = 400_000
#: Characters of text that a worker handles at once; a longer text is handled alone.
SLICE = 1 << 20
#: Shingles of a file of sets.
FILE = 1 << 20
#: Bytes of the parity map that travels with a prefix shingle.
PARITY = 64
#: Rows of a block: larger buckets are cut into blocks, and every two blocks meet once.
BLOCK = 512

_TIMES = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(64)]


def word_hashes(hasher: Hasher, texts: list[str]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    held: list[np.ndarray] = []
    for buffer, starts, ends in pieces(texts):
        h, at = hasher.words(buffer)
        for part, ended in zip(np.split(h, np.searchsorted(at, starts[1:])), ends):
            held.append(part)
            if ended:
                yield np.concatenate(held)
                held = []


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted; fewer words than a shingle are one shingle, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(width, len(words))
    n = len(words) - k + 1
    total = np.full(n, np.uint64(k))
    for i in range(k):
        total += words[i : i + n] * _TIMES[i]
    return np.unique(_mix(total))


def shingle_sets(hasher: Hasher, texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    return [shingles(w, width) for w in word_hashes(hasher, texts)]


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in parts of about SLICE characters."""
    at, size, texts = 0, 0, []
    for i in range(batch.num_rows):
        texts.append(batch.column("text")[i].as_py())
        size += len(texts[-1])
        if size >= SLICE:
            yield batch.slice(at, i + 1 - at), texts
            at, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(at), texts


class Counts:
    """How many texts hold a shingle, by sorted arrays of those in two or more; a shingle is known by its top bits."""

    def __init__(self, root: str, bits: int, shift: int):
        self.store, self.bits, self.shift = Store(root), bits, shift
        self.maps: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.shift - self.bits)).astype(np.int64)

    def of(self, sets: np.ndarray) -> np.ndarray:
        keys, back = np.unique(sets >> np.uint64(self.shift), return_inverse=True)
        out, bucket = np.ones(len(keys), np.int64), self.bucket_of(keys)
        cuts = np.searchsorted(bucket, np.arange(1 << self.bits, dtype=np.int64)) if self.bits < 12 else None
        for b in np.unique(bucket).tolist():
            lo, hi = (cuts[b], cuts[b + 1] if b + 1 < len(cuts) else len(keys)) if cuts is not None else np.searchsorted(bucket, [b, b + 1])
            if b not in self.maps:
                try:
                    self.maps[b] = (self.store.get(f"key-{b}"), self.store.get(f"many-{b}"))
                except FileNotFoundError:  # a bucket without a shared shingle
                    self.maps[b] = None
            if self.maps[b] is None or not len(self.maps[b][0]):
                continue
            known, many = self.maps[b]
            at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
            out[lo:hi] = np.where(known[at] == keys[lo:hi], many[at], 1)
        return out[back]


def count_shingles(plain: DataFrame, width: int, root: str) -> Counts:
    """Counts over all texts; between the rounds travel compressed blobs, a bucket's of a task."""
    size = plain.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(2, (-(-size // BUCKET_BYTES) - 1).bit_length())
    # shortened hashes pack better; two of n meet with a chance of one in 200 at most and then only count too much
    shift = max(0, 64 - max(40, size.bit_length() + 6))
    counts = Counts(root, bits, shift)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counter = Hasher(), Counter(counts.bucket_of, HELD)
        for batch in batches:
            for _, texts in slices(batch):
                yield from counter.add(np.concatenate(shingle_sets(hasher, texts, width)) >> np.uint64(shift))
        yield from counter.flush()

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        keys, many = merged(x.as_py() for x in table.column("blob"))
        store, more = Store(root), many > 1
        store.put(f"key-{b}", keys[more])
        store.put(f"many-{b}", np.minimum(many[more], 0xFFFFFFFF).astype(np.uint32))
        return pa.table({"bucket": pa.array([b], pa.int32()), "shared": pa.array([int(more.sum())], pa.int64())})

    plain.select("text").mapInArrow(count, BLOB).groupBy("bucket").applyInArrow(write, "bucket int, shared long").write.format("noop").mode("overwrite").save()
    return counts


def prefix(s: np.ndarray, many: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that other texts hold too, their places) among the first of the set by rising count."""
    first = len(s) - math.ceil(similarity * len(s) - EPS) + 1
    alone = int((many == 1).sum())
    if alone >= first:
        return s[:0], np.empty(0, np.int64)
    shared = np.flatnonzero(many > 1)
    order = shared[np.lexsort((s[shared], many[shared]))][: first - alone]
    return s[order], alone + np.arange(len(order))


def parity(s: np.ndarray, size: int) -> np.ndarray:
    """size bytes, each bit the parity of the shingles that fall on it (size is a power of two): two maps differ in at
    most as many bits as the sets differ in shingles, and a map folds to half its size by XOR of its halves."""
    many = np.bincount((s & np.uint64(8 * size - 1)).astype(np.int64), minlength=8 * size)
    return np.packbits((many & 1).astype(bool), bitorder="little")


def map_size(n: int) -> int:
    """Bytes of the parity map beside a set: eight bits for each shingle or more."""
    return max(PARITY, 1 << n.bit_length())


def folded(m: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(m.reshape(-1, size), axis=0)


def simhash_of(s: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if set in over half the shingles; signed."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(s), 65_536):
        total += np.unpackbits(s[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(s), bitorder="little").view(np.int64)[0])


class Writer:
    """Gathers sets, each behind its parity map, into files; a file's name is drawn anew in every attempt of a task."""

    def __init__(self, root: str):
        self.store, self.held, self.size, self.name = Store(root), [], 0, self._new()

    @staticmethod
    def _new() -> int:
        return int.from_bytes(os.urandom(7), "little")

    def add(self, s: np.ndarray) -> tuple[int, int]:
        where = self.name, self.size
        for x in (parity(s, map_size(len(s))).view(np.uint64), s):
            self.held.append(x)
            self.size += len(x)
        if self.size >= FILE:
            self.flush()
        return where

    def flush(self) -> None:
        if self.held:
            self.store.put(f"sets-{self.name}", np.concatenate(self.held))
        self.held, self.size, self.name = [], 0, self._new()


class Sets:
    """The sets, mapped into memory; few files are open at a time."""

    def __init__(self, root: str, most: int = 64):
        self.store, self.most = Store(root), most
        self.open: OrderedDict[int, np.ndarray] = OrderedDict()

    def get(self, name: int, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(parity map, set)"""
        if name not in self.open:
            self.open[name] = self.store.get(f"sets-{name}")
            if len(self.open) > self.most:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        body, words = self.open[name], map_size(n) // 8
        return body[at : at + words], body[at + words : at + words + n]


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float) -> bool:
    (map_a, x), (map_b, y) = sorted((a, b), key=lambda p: len(p[1]))
    n, m = len(x), len(y)
    if n < similarity * m - EPS:
        return False
    apart = int(np.bitwise_count(np.asarray(map_a) ^ folded(np.asarray(map_b), len(map_a))).sum())
    if apart > (1 - similarity) / (1 + similarity) * (n + m) + EPS:
        return False
    same = int((y[np.minimum(np.searchsorted(y, x), m - 1)] == x).sum()) if m else 0
    return same >= similarity * (n + m - same) - EPS


SKETCH = "doc_id long, mark long, node long, n int, file long, at long, fp long, parity binary, keys array<long>, pos array<int>"


def sketches(plain: DataFrame, counts: Counts, width: int, similarity: float, root: str) -> DataFrame:
    """A row for each row of plain (doc_id, text, mark). node is a hash of the set; rows of texts that share no prefix
    shingle have nothing more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, writer = Hasher(), Writer(root)
        for batch in batches:
            for part, texts in slices(batch):
                sets = shingle_sets(hasher, texts, width)
                ends = np.cumsum([len(s) for s in sets])
                many = np.split(counts.of(np.concatenate(sets)), ends[:-1])
                rest: list[tuple] = []
                for s, m in zip(sets, many):
                    keys, pos = prefix(s, m, similarity) if len(s) else (s, None)
                    if len(keys):
                        rest.append((len(s), *writer.add(s), simhash_of(s), parity(s, PARITY).tobytes(), keys.view(np.int64), pos))
                    else:
                        rest.append((len(s), None, None, None, None, None, None))
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                cols = [part.column("doc_id"), part.column("mark"), pa.array(nodes), *(pa.array(list(c), k) for c, k in zip(zip(*rest), kinds))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "node", "n", "file", "at", "fp", "parity", "keys", "pos"])
        writer.flush()

    return plain.mapInArrow(run, SKETCH)


def verified(pairs: DataFrame, nodes: DataFrame, root: str, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike; written."""
    side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("file", "at", "n")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(root)
        for batch in batches:
            rows = zip(*(batch.column(f"{c}_{x}").to_pylist() for x in "ab" for c in ("file", "at", "n")))
            keep = pa.array([alike(sets.get(*r[:3]), sets.get(*r[3:]), similarity) for r in rows], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    near = F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - EPS
    return written(pairs.join(side("a"), "a").join(side("b"), "b").filter(near).mapInArrow(check, "a long, b long"), "near-close")[0]


def first_pairs(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs whose number grows with the rows: fingerprints linked by Golay keys, and each node with the smallest of
    those that it shares a prefix shingle with."""
    rep, _ = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "near-prints")
    linked, _ = written(links(rep.select("fp")), "near-links")
    of = lambda x: rep.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}"))
    golay = linked.join(of("a"), "a").join(of("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    same = nodes.join(rep, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    least = keys.groupBy("key").agg(F.min("node").alias("least"))
    star = keys.join(least, "key").groupBy("node").agg(F.min("least").alias("least")).select(F.col("least").alias("a"), F.col("node").alias("b"))
    return golay.unionByName(same).unionByName(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


class Joined:
    """Which roots one task has found to be one component."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while x in self.up:
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


def met(rows: dict[str, np.ndarray], label: np.ndarray, s: int, e: int, sets: Sets, joined: Joined, similarity: float) -> Iterator[tuple[int, int]]:
    """The links between rows s to e, one block of a bucket, that join two components; label holds their components.
    A block of one part holds its rows once; a block of two parts holds both, and only pairs across are new."""
    node, n, pos, maps = rows["node"], rows["n"], rows["pos"], rows["maps"]
    every = np.arange(s, e)
    alone = rows["lo"][s] == rows["hi"][s]
    part = rows["own"][s:e] == rows["lo"][s]
    right = every if alone else every[~part]
    record = lambda k: sets.get(int(rows["file"][k]), int(rows["at"][k]), int(n[k]))
    for i in (every if alone else every[part]).tolist():
        j = right[right > i] if alone else right
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        both = n[j] + n[i]
        # from the first shingle in common on, what is left of either must hold all that they need in common
        left_over = np.minimum(n[i] - pos[i], n[j] - pos[j])
        j = j[(np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i]) - EPS) & (left_over >= similarity / (1 + similarity) * both - EPS)]
        apart = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1)
        may = apart <= (1 - similarity) / (1 + similarity) * (n[j] + n[i]) + EPS
        for k in j[may][np.argsort(apart[may], kind="stable")].tolist():
            if label[k] != label[i] and alike(record(i), record(k), similarity):
                yield int(node[i]), int(node[k])
                x, y = int(label[i]), int(label[k])
                joined.join(x, y)
                label[label == max(x, y)] = min(x, y)


def rest_links(keys: DataFrame, roots: DataFrame, root: str, similarity: float) -> DataFrame:
    """Links (a, b) that join, together with roots, all nodes that share a prefix shingle and are alike: the pairs of a
    bucket that are in different components meet in blocks and are verified where they meet. What comes out joins two
    components of its task, so that it never has more rows than the keys."""
    own = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = own.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("m")).filter("least <> most")
    mixed, _ = written(mixed.select("key", F.ceil(F.col("m") / BLOCK).alias("blocks")), "near-mixed")
    dealt = own.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root", "n", "pos", "file", "at", "parity")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, joined = Sets(root), Joined()
        held: pa.Table | None = None

        def links_of(table: pa.Table) -> pa.RecordBatch:
            rows = {c: table.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "node", "root", "n", "pos", "file", "at")}
            rows["maps"] = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(-1, PARITY // 8)
            distinct, back = np.unique(rows["root"], return_inverse=True)
            label = np.array([joined.find(x) for x in distinct.tolist()], np.int64)[back]
            new = np.concatenate(([True], (np.diff(rows["key"]) != 0) | (np.diff(rows["lo"]) != 0) | (np.diff(rows["hi"]) != 0)))
            cuts = [*np.flatnonzero(new).tolist(), table.num_rows]
            found = [x for s, e in zip(cuts, cuts[1:]) if e - s > 1 for x in met(rows, label, s, e, sets, joined, similarity)]
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = np.ones(table.num_rows, bool)  # the last block may go on in the next batch
            for c in ("key", "lo", "hi"):
                column = table.column(c).to_numpy()
                last &= column == column[-1]
            cut = int(np.argmax(last))
            if cut:
                yield links_of(table.slice(0, cut))
            held = table.slice(cut).combine_chunks()
        if held is not None:
            yield links_of(held)

    return dealt.mapInArrow(meet, "a long, b long")


def grouped(docs: DataFrame, mark: Column, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, mark and root of every row; rows of one group have the same root."""
    spark = docs.sparkSession
    plain = id_and_text(docs, mark=mark)
    shared, files = new_folder(spark, "shingles"), new_folder(spark, "sets")
    rows, _ = written(sketches(plain, count_shingles(plain, width, shared), width, similarity, files), "near-rows")
    drop(spark, shared)
    held = ("n", "file", "at", "fp", "parity", "keys", "pos")
    nodes, nodes_at = written(rows.filter("keys is not null").groupBy("node").agg(F.min(F.struct(*held)).alias("s")).select("node", "s.*"), "near-nodes")
    keys = nodes.select("node", "n", "file", "at", "parity", F.explode(F.arrays_zip("keys", "pos")).alias("k")).select(F.col("k.keys").alias("key"), F.col("k.pos").alias("pos"), "node", "n", "file", "at", "parity")
    keys, keys_at = written(keys, "near-keys")
    close = verified(first_pairs(nodes, keys), nodes, files, similarity)
    roots, _ = written(components(close), "near-some")
    more, _ = written(rest_links(keys, roots, files, similarity), "near-rest")
    for path in (keys_at, nodes_at, files):
        drop(spark, path)
    # the new edges join components, each of which is one node now
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined, _ = written(components(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()), "near-joined")
    own = rows.select("doc_id", "mark", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    last = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
    return own.join(last, "root", "left").select("doc_id", "mark", F.coalesce("last", "root").alias("root"))


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of every row."""
    rows, _ = written(grouped(docs, F.lit(0).cast("long"), width, similarity).select("doc_id", "root"), "near-groups")
    named, _ = written(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-named")
    return rows.join(named, "root").select("doc_id", "component_id")


def drop_near(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group, the one with the smallest doc_id (of several texts with that id, one);
    all columns kept."""
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows, _ = written(grouped(docs, mark, width, similarity), "near-groups")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    best = rows.groupBy("root").agg(F.min(first).alias("best"), F.count("*").alias("m")).filter("m > 1").select("root", "best")
    best, _ = written(best, "near-best")
    counted = rows.join(best, "root").groupBy(F.col("doc_id").alias("id"), "mark", (first == F.col("best")).alias("kept")).agg(F.count("*").alias("rows"))
    decided, _ = written(counted, "near-decided")
    return without(docs, decided.filter("not kept").select("id", "mark"), decided.filter("kept and rows > 1").select("id", "mark"), mark)

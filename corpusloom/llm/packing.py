"""Packing by sum-of-squares online placement.

Each worker reads its documents in order. A document becomes the ids of the tokenizer and a final id 1; whole windows
are cut off and go out at once, and the rest is placed in the partly filled window of the level that makes the sum of
squared counts of partly filled windows smallest (or opens a window), by a level array. Windows that are still open at
the end of a block keep what the rule has put into them; only the emptiest are given up, and their documents cut to fill
the others. The last remainder is cut at powers of two, which need no padding. A block is one input partition, so nothing is shuffled and memory holds open windows only.

Cases: null and empty texts are the single id 1; very long texts spread over many sequences; repeated rows are packed
each; a null doc_id stays null; an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_and_text

WINDOW = 2048
END = 1
#: Ids of the rank files' "end of text" string when it stands in a text: the tokenizer reads it as a special token.
SPECIAL = {"<|endoftext|>": 50256}
#: Encodings of words that a worker remembers.
REMEMBERED = 100_000
#: A single space between two words is always a boundary of the tokenizer's words.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of byte_bpe_50k.json without added tokens: the same vocabulary's ranks are merged by tiktoken, and the
    encodings of words between single spaces are remembered."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.own.encode(text, allowed_special="all", disallowed_special=()), "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return np.empty(0, "<u4")
        if "<|" in text:
            return np.frombuffer(self._ids(text), "<u4")
        first, *rest = BETWEEN.split(text)
        known, out, plain = self.known, [self._ids(first)], self.own.encode_ordinary
        if len(known) > REMEMBERED:
            known.clear()
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = array("I", plain(" " + word)).tobytes()
                if len(word) < 40:
                    known[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")


@functools.lru_cache(maxsize=1)
def encoder_of(ranks_path: str, pattern: str) -> Encoder:
    """One encoder for each worker process, so that it goes on remembering from task to task."""
    return Encoder(ranks_path, pattern)


class Levels:
    """Partly filled windows by fill level; the sum-of-squares rule."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def choose(self, size: int) -> int:
        """The level to add size to (0: a new window) with the least growth of the sum of squares; ties: the fuller."""
        n, w = self.counts, self.window
        # leaving level h takes 2 n[h] - 1 off, reaching level h + size adds 2 n[h + size] + 1; a full window counts no more
        reach = 2 * n[size : w + 1] + 1
        reach[-1] = 0
        grow = reach.copy()
        grow[1:] += 1 - 2 * n[1 : w - size + 1]
        usable = n[: w - size + 1] > 0
        usable[0] = True
        grow[~usable] = np.iinfo(np.int64).max
        return int(len(grow) - 1 - np.argmin(grow[::-1]))

    def place(self, size: int, item) -> list | None:
        """Puts the item; returns the window if that filled it."""
        h = self.choose(size)
        held = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
        held.append(item)
        if h + size == self.window:
            return held
        self.open[h + size].append(held)
        self.counts[h + size] += 1
        return None

    def rest(self) -> Iterator[list]:
        """The windows still open, the fullest first."""
        for h in range(self.window - 1, 0, -1):
            yield from self.open[h]


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]


class Block:
    """Packs the documents of one block; an item is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, block: int, window: int = WINDOW):
        self.next, self.window, self.levels, self.rows = block << 33, window, Levels(window), []
        self.moved = 0  # ids that finish() has taken from the window where the rule put them

    def emit(self, items: list) -> None:
        at = 0
        for doc, start, ids, total in items:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, ids))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        w, total = self.window, len(ids)
        whole = total - total % w
        for s in range(0, whole, w):
            self.emit([(doc, s, ids[s : s + w], total)])
        if whole < total:
            full = self.levels.place(total - whole, (doc, whole, ids[whole:].copy(), total))
            if full:
                self.emit(full)

    def finish(self) -> None:
        """Closes the windows that are open. They stay as the rule has placed them, the fullest first, and what they lack
        is cut from the documents of the emptiest; the last ids, less than a window, are cut at powers of two."""
        windows = deque(self.levels.rest())
        self.levels = Levels(self.window)
        held: list = []  # documents of windows that were given up, the next one last

        def cut(most: int) -> list:
            """Pieces of `most` ids in all, or of what there is, from windows given up."""
            nonlocal held
            out = []
            while most and (held or windows):
                if not held:
                    held = windows.pop()[::-1]
                doc, start, ids, total = held.pop()
                if len(ids) > most:
                    held.append((doc, start + most, ids[most:], total))
                    ids = ids[:most]
                out.append((doc, start, ids, total))
                most -= len(ids)
                self.moved += len(ids)
            return out

        while windows:
            window = windows.popleft()
            window = window + cut(self.window - sum(len(x[2]) for x in window))
            if sum(len(x[2]) for x in window) == self.window:
                self.emit(window)
            else:
                held = window[::-1]
        size = sum(len(x[2]) for x in held)
        while size:
            part = cut(1 << (size.bit_length() - 1))
            size -= sum(len(x[2]) for x in part)
            self.emit(part)

    def batch(self, ids: bool) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(FIELDS)
        self.rows = []
        use = FIELDS if ids else FIELDS[:-1]
        return pa.RecordBatch.from_arrays([pa.array(list(c) if n != "ids" else [x.tolist() for x in c], t) for c, (n, t) in zip(cols, use)], [n for n, _ in use])


def pack(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = encoder_of(ranks_path, pattern), Block(TaskContext.get().partitionId())
        end = np.array([END], "<u4")
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                block.add(doc, np.concatenate([encoder.encode(text), end]))
            yield block.batch(with_ids)
        block.finish()
        yield block.batch(with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return id_and_text(docs).mapInArrow(run, schema)


def production_pack(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids)

"""Building the corpus: copies, reports, sections, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TARGET, MOST, OVERLAP, LEAST = 900, 1400, 150, 30


def collapse(docs: DataFrame, share: int = 2) -> DataFrame:
    """One row for each text: the first row stands for it; owners, their number, and whether it is shared."""
    groups = docs.groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count_distinct("doc_id").alias("n_docs"), F.sort_array(F.collect_set("source")).alias("owners"))
    return groups.withColumn("scope", F.when(F.col("n_docs") >= share, "shared").otherwise("single"))


def canonical(paths: DataFrame, key: Column) -> DataFrame:
    """Of paths with one key the deepest, then the shortest, then the last by name; only keys with several paths."""
    depth = F.length("path") - F.length(F.translate("path", "/", ""))
    best = F.max_by("path", F.struct(depth, -F.length("path"), F.col("path"))).alias("path")
    return paths.groupBy(key.alias("key")).agg(F.count_distinct("path").alias("paths"), best).filter("paths > 1")


def manifest(docs: DataFrame) -> DataFrame:
    """Rows, tables and status of each source."""
    counts = docs.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("text").contains("|")).alias("tables"), F.sum((F.length("text") >= 1000).cast("long")).alias("pages"))
    ratio = F.col("chunks") / F.col("pages")
    return counts.withColumn("status", F.when(F.col("pages") == 0, "EMPTY").when(ratio < 0.4, "LOW_YIELD").otherwise("OK"))


def running_lines(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """Lines of 4 to 60 characters that open or close at least that share of a source's documents (four or more)."""
    n = docs.groupBy("source").agg(F.count("*").alias("n")).filter("n >= 4")
    lines = docs.withColumn("lines", F.split("text", "\n"))
    ends = F.array_distinct(F.concat(F.slice("lines", 1, 2), F.slice("lines", F.greatest(F.size("lines") - 1, F.lit(1)), F.lit(2))))
    found = lines.select("source", F.explode(ends).alias("line")).withColumn("line", F.trim("line")).filter(F.length("line").between(4, 60)).groupBy("source", "line").agg(F.count("*").alias("seen"))
    return found.join(n, "source").filter(F.col("seen") >= share * F.col("n")).select("source", "line", "seen", "n")


def sections(blocks: DataFrame, heading: Column) -> DataFrame:
    """blocks (doc_id, pos) with the last heading before each; a first block takes its own."""
    before = F.last(heading, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("section", F.coalesce(before, heading))


def cut_points(lengths: np.ndarray, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Where chunks of sentences of these lengths begin and end. A chunk ends behind the sentence with which it reaches
    target, or before that sentence if it would pass most; the next one begins at the longest run of whole sentences
    before that end that overlap holds. The sentences after the last end are a chunk too."""
    n = len(lengths)
    plain = np.concatenate(([0], np.cumsum(lengths)))  # characters before each sentence
    joined = plain + np.arange(n + 1)  # and with a line end after each
    out, first, fresh, kept = [], 0, 0, -1  # kept: a sentence that the last chunk ended before, which now goes in as it is
    while first < n:
        # what stands over from the last chunk counts without line ends
        base = plain[fresh] - plain[first] - joined[fresh]
        reach = int(np.searchsorted(joined, target - base, "left")) - 1
        if reach >= n:
            out.append((first, n))
            break
        full = base + joined[reach] + lengths[reach] > most and reach > first and reach != kept
        end = reach if full else reach + 1
        out.append((first, end))
        kept = reach if full else -1
        first = max(first, int(np.searchsorted(plain, plain[end] - overlap, "left")))
        fresh = end
    return out


def packed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ordinal, text: sentences joined to chunks at cut_points(); chunks under LEAST characters are left out.

    Sentences end at . ! ? 。 before white space and at line ends. A null or blank text has no chunk, repeated rows have
    theirs each, and a null key stays null."""
    clean = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split("text", r"(?U)(?<=[.!?。])\s+|\n"), clean), lambda s: s != "")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, texts = [], [], []
            for k, sentences in zip(batch.column(0), batch.column(1).to_pylist()):
                bodies = ["\n".join(sentences[s:e]) for s, e in cut_points(np.array([len(x) for x in sentences or []], np.int64))]
                held = [x for x in bodies if len(x) >= LEAST]
                keys += [k] * len(held)
                at += range(len(held))
                texts += held
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(at, pa.int32()), pa.array(texts, pa.string())], [key, "ordinal", "text"])

    return docs.select(key, parts.alias("sentences")).mapInArrow(run, f"{key} {kind}, ordinal int, text string")


def chunked(blocks: DataFrame) -> DataFrame:
    """Chunks (doc_id, begin, section, kind, ordinal, text) of blocks (doc_id, pos, section, kind, text): a block of kind
    table is a chunk of its own; text between tables and within a section is packed(). begin is the position of the
    first block of such a run, ordinal counts its chunks."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    table = F.col("kind") == "table"
    starts = table | F.coalesce(F.lag(table).over(order), F.lit(True)) | ~F.col("section").eqNullSafe(F.lag("section").over(order))
    runs = blocks.withColumn("begin", F.max(F.when(starts, F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    whole = runs.filter(table & (F.length(body) >= LEAST)).select("doc_id", "begin", "section", "kind", F.lit(0).alias("ordinal"), body.alias("text"))
    # a run is part of one document
    text = runs.filter(~table).groupBy("doc_id", "begin").agg(F.first("section").alias("section"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    parts = packed(text.select(F.struct("doc_id", "begin", "section").alias("run"), "text"), "run")
    return whole.unionByName(parts.select("run.*", F.lit("text").alias("kind"), "ordinal", "text"))


def headless(lines: DataFrame, running: DataFrame) -> DataFrame:
    """lines (source, doc_id, pos, line) without the running headers and footers (source, line)."""
    own = running.select(F.col("source").alias("_s"), F.col("line").alias("_l")).distinct()
    return lines.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.trim("line") == F.col("_l")), "left_anti")


def restored(shared: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each owner (source) of a shared text, with what names says of it."""
    return shared.filter("scope = 'shared'").select("hash", F.explode("owners").alias("source")).join(names, "source", "left").select("hash", "source", *(c for c in names.columns if c != "source"))

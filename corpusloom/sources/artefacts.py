"""Files that the engine reads: documents by path, JSON lines, manifests, results of other shapes; incremental work."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.documents import clean_grid, heading_line, markdown
from ..functions.names import nfc

# The fields of a chunk as its writer lays it out, and the names of lists and fields in results.
CHUNK = "chunk_id string, doc_id string, doc_type string, fund_code string, fund_name string, kofia_code string, base_date string, page int, section string, content_type string, is_ocr boolean, text string, n_chars int, source_path string"
FINAL = CHUNK + ", doc_ids array<string>, n_docs int, scope string, text_hash string"


def documents(spark: SparkSession, root: str, pattern: str = "*.{pdf,docx}", without: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """path, modificationTime, length, content of the files below root; hidden files, lock files, paths with one of the
    given parts, and files of one of the given names are left out. Names compare in Unicode's composed form, as file
    systems differ in theirs."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    kept = ~F.col("path").rlike(r"/(\.|~\$)[^/]*$")
    for part in without:
        kept = kept & ~F.col("path").contains(part)
    found = found.filter(kept)
    return found.filter(~nfc(F.element_at(F.split("path", "/"), -1)).isin([unicodedata.normalize("NFC", n) for n in names])) if names else found


def in_order(files: DataFrame, most: int | None = None) -> DataFrame:
    """Files by path in its composed form; the first ones only, where a smoke run asks for so many."""
    rows = files.orderBy(nfc(F.col("path")), "path")
    return rows if most is None else rows.limit(most)


def json_lines(spark: SparkSession, path: str, schema: str = FINAL) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, perhaps with a byte order mark before the first name."""
    rows = spark.read.option("header", True).csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def first_given(rows: DataFrame, names: list[str]) -> Column:
    """The first non-null of the columns that are there; null if none is."""
    return F.coalesce(*(F.col(n).cast("string") for n in names if n in rows.columns), F.lit(None).cast("string"))


def results(rows: DataFrame) -> DataFrame:
    """Answers of any of the known shapes as question_id, answer: the rows, or the rows of a list inside one."""
    for name in ("rows", "results", "items", "questions", "records", "outputs"):
        if name in rows.columns:
            rows = rows.select(F.explode(name).alias("_r")).select("_r.*")
            break
    return rows.select(first_given(rows, ["question_id", "id", "qid"]).alias("question_id"), first_given(rows, ["answer", "response", "output", "text"]).alias("answer"))


def outdated(found: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path, modificationTime) without an artefact (path, made) as new as they are."""
    return found.join(done.select("path", "made"), (found["path"] == done["path"]) & (F.col("made") >= F.col("modificationTime")), "left_anti")


def latest(cache: DataFrame, keys: list[str], at: str) -> DataFrame:
    """An upsert's outcome: of rows with the same keys the one written last."""
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in cache.columns if c not in keys)), at).alias("_r")).select(*keys, "_r.*")


def pending(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Questions still to be asked: those without a row of done (question_id, answer, error) that has an answer and no
    error. Run after run only these are asked, so that a stopped run goes on."""
    good = done.filter("answer is not null and answer <> '' and coalesce(error, '') = ''").select("question_id").distinct()
    return questions.join(good, "question_id", "left_anti")


def merged(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """Every gold row with its run's columns; lists and structs as JSON, so that it can be written as CSV."""
    both = gold.join(runs, "question_id", "left")
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in both.schema]
    return both.select(*flat)


def imported(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks under new ids, vectors under them, the ids' map) of a corpus that was cut anew elsewhere: an id is the
    document's, the page and the place on it."""
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("chunk_id")) - 1
    new = F.concat_ws("_", "doc_id", F.concat(F.lit("p"), F.coalesce("page", F.lit(0)).cast("string")), F.lpad(place.cast("string"), 4, "0"))
    known = chunks.withColumn("new_id", new)
    ids = known.select(F.col("chunk_id").alias("old_id"), "new_id")
    named = known.withColumn("chunk_id", F.col("new_id")).drop("new_id")
    return named, vectors.withColumnRenamed("chunk_id", "old_id").join(ids, "old_id").withColumnRenamed("new_id", "chunk_id").drop("old_id"), ids


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes, is_heading) -> list[tuple[str, str, str]]:
    """(kind, section, text) of a Word file: runs of paragraphs under each heading (by style, or by is_heading), then all
    tables, under the last section. A file that is none gives nothing."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out: list[tuple[str, str, str]] = []
    section, held = "", []
    for p in body.findall(f"{_W}p") if body is not None else []:
        text, style = text_of(p).strip(), p.find(f"{_W}pPr/{_W}pStyle")
        if not text:
            continue
        if (style is not None and style.get(f"{_W}val", "").lower().startswith("heading")) or is_heading(text):
            out += [("text", section, "\n".join(held))] if held else []
            section, held = text, []
        held.append(text)
    out += [("text", section, "\n".join(held))] if held else []
    for table in body.findall(f"{_W}tbl") if body is not None else []:
        grid = clean_grid([[text_of(c) for c in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")])
        out += [("table", section, m)] if (m := markdown(grid)) else []
    return out


def word_files(files: DataFrame) -> DataFrame:
    """path, pos, kind, section, text: the blocks of Word files (path, content), a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = docx_blocks(content.as_py() or b"", heading_line)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], ["path", "pos", "kind", "section", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, pos int, kind string, section string, text string")

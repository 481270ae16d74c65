"""Sources and sinks on small files; the stream gives what the batch gives."""

import datetime as dt

from corpusloom.functions import answers
from corpusloom.operators import tables
from corpusloom.sources import artefacts
from corpusloom.streaming import questions


def test_documents(spark, tmp_path):
    for name in ("a.pdf", "sub/b.docx", "sub/~$b.docx", ".c.pdf", "d.txt", "old/e.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    found = artefacts.documents(spark, str(tmp_path), without=("/old/",))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.pdf", "b.docx"]


def test_json_lines_and_manifest(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a_p1_0000", "page": 1, "doc_ids": ["x", "y"]}\n\n{"chunk_id": "b", "extra": 2}\n', "utf-8")
    rows = {r["chunk_id"]: r for r in artefacts.json_lines(spark, str(tmp_path / "c.jsonl")).collect()}
    assert set(rows) == {"a_p1_0000", "b"} and rows["a_p1_0000"]["doc_ids"] == ["x", "y"] and rows["b"]["page"] is None
    (tmp_path / "m.csv").write_text("﻿doc_id,name\n1,가나\n", "utf-8")
    got = artefacts.manifest(spark, str(tmp_path / "m.csv"))
    assert got.columns == ["doc_id", "name"] and got.first()["name"] == "가나"


def test_results(spark):
    flat = spark.createDataFrame([("1", None, "yes"), (None, "2", "no")], "id string, qid string, response string")
    assert {tuple(r) for r in artefacts.results(flat).collect()} == {("1", "yes"), ("2", "no")}
    held = spark.createDataFrame([([(7, "a"), (8, None)],)], "results array<struct<question_id: long, answer: string>>")
    assert {tuple(r) for r in artefacts.results(held).collect()} == {("7", "a"), ("8", None)}


def test_incremental(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    found = spark.createDataFrame([("a", day(1)), ("b", day(3)), ("c", day(1))], "path string, modificationTime timestamp")
    done = spark.createDataFrame([("a", day(2)), ("b", day(2))], "path string, made timestamp")
    assert {r["path"] for r in artefacts.outdated(found, done).collect()} == {"b", "c"}
    cache = spark.createDataFrame([("n", "h", 1, "old"), ("n", "h", 2, "new"), ("m", "h", 1, "own")], "ns string, h string, t int, v string")
    assert {(r["ns"], r["v"]) for r in artefacts.latest(cache, ["ns", "h"], "t").collect()} == {("n", "new"), ("m", "own")}


def test_stream_equals_batch(spark, tmp_path, tiny):
    path = f"{tiny}/conversations.parquet"
    rows = spark.read.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tiny}/conversations.parque[t]")
    args = (["the", "and"], ["ing"])
    out = str(tmp_path / "out")
    questions.start(questions.screened(stream, *args), out, str(tmp_path / "checkpoint")).awaitTermination(120)
    want = questions.screened(rows, *args)
    got = spark.read.schema(want.schema).parquet(out)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_tables_and_citations(spark):
    assert answers.split_table("a\nb\n" + "x\n" * 5) == ["a\nb\n" + "x\n" * 5]
    pieces = answers.split_table("\n".join(["head", "----", *("r" * 90 for _ in range(60))]), 1000)
    assert all(len(p) <= 1010 and p.startswith("head\n----\n") for p in pieces) and sum(p.count("r" * 90) for p in pieces) == 60
    assert answers.without_citations("") == "" and answers.without_citations(") a (") == ") a ("
    empty = spark.createDataFrame([], "a int, b string")
    assert tables.without_blank(empty).columns == []

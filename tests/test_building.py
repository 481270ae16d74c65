"""Chunks, tables, guards and identity on small cases, against rules written out the slow way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import answers, documents
from corpusloom.operators import corpus, retrieval, tables


def slow_cuts(lengths, target, most, overlap):
    """By the rule, every sum taken anew."""
    out, first, fresh, i = [], 0, 0, 0

    def size(upto):
        return sum(lengths[first:fresh]) + sum(x + 1 for x in lengths[fresh:upto])

    def close(end):
        nonlocal first, fresh
        out.append((first, end))
        first = next(t for t in range(first, end + 1) if sum(lengths[t:end]) <= overlap)
        fresh = end

    while i < len(lengths):
        if i > first and size(i) + lengths[i] > most:
            close(i)
        i += 1
        if size(i) >= target:
            close(i)
    return [*out, (first, len(lengths))] if first < len(lengths) else out


def test_cut_points():
    rng = np.random.default_rng(0)
    for _ in range(800):
        lengths = rng.integers(1, rng.choice([5, 40, 200, 900]), rng.integers(0, 30)).tolist()
        rule = [(90, 140, 15), (900, 1400, 150), (50, 60, 45)][rng.integers(3)]
        assert corpus.cut_points(np.array(lengths, np.int64), *rule) == slow_cuts(lengths, *rule)


def test_packed(spark):
    long = " ".join(f"Sentence number {i} of this text is here." for i in range(200))
    rows = [(1, long), (1, long), (2, None), (3, "  \n "), (None, "One sentence of more than thirty characters."), (4, "short. too")]
    got = corpus.packed(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ordinal int")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["ordinal"], r["text"]))
    assert set(by) == {1, None} and by[None] == [(0, rows[4][1])]
    assert len(by[1]) == 2 * len(set(by[1])) and all(900 <= len(t) <= 1400 for i, t in by[1] if i < max(by[1])[0])
    sentences = long.replace(". ", ".\n").split("\n")
    want = ["\n".join(sentences[s:e]) for s, e in slow_cuts([len(x) for x in sentences], 900, 1400, 150)]
    assert sorted(set(by[1])) == list(enumerate(want))


def test_chunked(spark):
    a = "A sentence that is long enough to be kept as a chunk."
    rows = [(1, 0, "x", "text", a), (1, 1, "x", "text", a), (1, 2, "x", "table", "| a | b |\n" * 5), (1, 3, "x", "text", a), (1, 4, "y", "text", a), (2, 0, None, "text", a)]
    got = corpus.chunked(spark.createDataFrame(rows, "doc_id long, pos int, section string, kind string, text string"))
    assert {(r["doc_id"], r["begin"], r["kind"], r["text"]) for r in got.collect()} == {(1, 0, "text", a + "\n" + a), (1, 2, "table", ("| a | b |\n" * 5).strip()), (1, 3, "text", a), (1, 4, "text", a), (2, 0, "text", a)}


def test_headless(spark):
    lines = spark.createDataFrame([("s", 1, 0, " Page of s "), ("s", 1, 1, "text"), ("t", 2, 0, "Page of s")], "source string, doc_id long, pos int, line string")
    running = spark.createDataFrame([("s", "Page of s", 4)], "source string, line string, seen int")
    assert sorted(r["line"] for r in corpus.headless(lines, running).collect()) == ["Page of s", "text"]


@pytest.mark.parametrize("sizes", [[90] * 60, [3000, 5, 5], [1] * 5000, [999, 1, 998, 2, 1000]])
def test_split_table(sizes):
    rows = ["r" * n for n in sizes]
    pieces = answers.split_table("\n".join(["head", "----", *rows]), 1000)
    assert [x for p in pieces for x in p.split("\n")[2:]] == rows
    for p, after in zip(pieces, pieces[1:]):
        body = p.split("\n")[2:]
        used = 8 + sum(len(x) + 1 for x in body)  # head, rows with line ends
        assert used - 1 <= 1000 or len(body) == 1
        assert used + len(after.split("\n")[2]) > 1000  # the next row had no room


def test_guard_keeps_strings():
    assert tables.checked("select '--a' as x from t where y = 1") == "select '--a' as x from t where y = 1 LIMIT 50"
    assert tables.checked("select 'a/*' as x, '*/b' as y from t") == "select 'a/*' as x, '*/b' as y from t LIMIT 50"
    assert tables.checked("select 1 -- drop\nfrom t") == "select 1  \nfrom t LIMIT 50"
    assert tables.checked("So:\n```sql\nselect 'it''s; drop' from t;\n```") == "select 'it''s; drop' from t LIMIT 50"


@pytest.mark.parametrize("word", tables.DENIED)
def test_guard_denies(word):
    with pytest.raises(ValueError, match=word.upper()):
        tables.checked(f"select 1 from t where {word.title()} x")
    assert tables.checked(f"select '{word}' from t").endswith("LIMIT 50")


def test_identity(spark):
    rows = [
        ("a/KR5111111111/투자설명서.pdf", "1. 집합투자기구 명칭 : 가나   펀드\n작성 기준일 : 2024년 3월 7일 금융투자협회 펀드코드\n AB12345"),
        ("약관/b.c.pdf", "이 투자설명서는 다라펀드에 대한 KR7222222222 증권신고서 효력발생일 2023. 11. 05"),
        ("docs_renamed/x y!.pdf", ""), ("z.pdf", None),
    ]
    p, h = F.col("path"), F.col("head")
    got = spark.createDataFrame(rows, "path string, head string").select(documents.fund_code(p, h), documents.fund_name(h), documents.base_date(h), documents.kofia_code(h), documents.doc_kind(p), documents.doc_id(p, h)).collect()
    assert [tuple(r) for r in got] == [
        ("KR5111111111", "가나 펀드", "2024-03-07", "12345", "투자설명서", "KR5111111111"), ("KR7222222222", "다라펀드", "2023-11-05", None, "약관", "KR7222222222"),
        (None, None, None, None, "연금문서", "x_y_"), (None, None, None, None, "기타", "z"),
    ]


def test_clean_grid():
    grid = [["a", None, "b", "c"], ["1", "", "2", "3\n4"], ["", "", "", ""], ["5", "", "6", ""]]
    assert documents.clean_grid(grid) == [["a", "b", "c"], ["1", "2", "3 4"], ["5", "6", ""]]
    assert documents.clean_grid([]) == documents.clean_grid([["a", "b"], ["c", "d"]]) == []
    assert documents.markdown([["a", "b"], ["", "c"]]) == "| a | b |\n|---|---|\n|   | c |" and documents.markdown([["a", "b"]]) is None


def test_retrieval_beyond_the_bounds(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "a b a", "x"), (2, "b c", "y"), (3, None, "x"), (4, "a a a c d", "y"), (5, "", "y")], "chunk_id long, text string, source string")
    asked = spark.createDataFrame([(7, "a c"), (8, "zz"), (9, None)], "qid long, text string")
    for group in (None, "source"):
        got = sorted(tuple(r) for r in retrieval.bm25(asked, chunks, 3, group).collect())
        with monkeypatch.context() as m:
            m.setattr(retrieval, "MOST_ASKED", 0)
            cols = ["qid", "chunk_id", "score", *([group] if group else []), "rank"]
            assert got == sorted(tuple(r) for r in retrieval.bm25(asked, chunks, 3, group).select(cols).collect()) and got
    passages = spark.createDataFrame([(1, "a b"), (2, "b"), (3, ""), (4, None), (5, "b")], "qid long, text string")
    found = sorted(tuple(r) for r in retrieval.holders(chunks, passages).collect())
    monkeypatch.setattr(retrieval, "MOST_PASSAGES", 0)
    assert found == sorted(tuple(r) for r in retrieval.holders(chunks, passages).collect()) == [(1, 1), (2, 1), (2, 2), (5, 1), (5, 2)]
    assert retrieval.bm25(asked, chunks.limit(0)).count() == retrieval.bm25(asked.limit(0), chunks).count() == 0

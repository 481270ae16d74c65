"""Routes, evidence, index and imports on small cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import documents, questions
from corpusloom.operators import evidence, index, retrieval
from corpusloom.sources import artefacts


@pytest.mark.parametrize("text, want", [
    ("퇴직연금 중도인출은?", ("연금문서", False, False, False)), ("펀드 환매는?", ("투자설명서", False, False, False)), ("세액공제?", (None, True, False, False)), ("펀드의 세율?", (None, True, False, False)),
    ("연금저축 중도인출 부득이한 사유?", (None, True, True, False)), ("안녕", (None, False, False, False)), (None, (None, False, False, False)), ("삼성 R-A의 총보수는?", (None, False, False, True)),
    ("KR5123456789와 총보수 평균", (None, False, False, True)), ("C-P는 온라인 전용?", (None, False, False, True)), ("총보수란?", (None, False, False, False)),
])
def test_route(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(questions.route(F.col("t")).alias("r")).first()["r"]
    assert (r["doc_type"], r["hybrid"], r["tax_mix"], r["need_sql"]) == want and r["reason"].startswith("제도 키워드")


def test_requests(spark):
    rows = [("어떤 상품 추천?", "open", None), ("원금 지키는 연금 추천", "narrowed", None), ("가나펀드 추천?", None, None), ("비밀번호 재설정 해 주세요", None, ("action", "personal")), ("우리 회사 적립금 알려 주세요", None, ("lookup", "company")), ("해지란?", None, None), (None, None, None)]
    got = spark.createDataFrame([(t,) for t, _, _ in rows], "t string").select(questions.advice(F.col("t"), F.array(F.lit("가나펀드"))).alias("a"), questions.unable(F.col("t")).alias("u")).collect()
    assert [(r["a"], r["u"] and tuple(r["u"])) for r in got] == [(a, u) for _, a, u in rows]
    said = spark.createDataFrame([("세금 우회, 보장",), ("x",)], "t string").select(questions.refusal(F.col("t"), "B", "T", "G", "E").alias("r")).collect()
    assert [r["r"] for r in said] == ["B\nT\nG", "B\nE"]


def test_evidence(spark):
    ev = [("가펀드", "d1", 3, "절", "2024-01-02", "본문"), (None, "d$2", None, "§ 1", None, "둘"), (None, None, 0, None, None, None)]
    row = spark.createDataFrame([(ev, "[근거 1]과 [근거 02], [근거 3], [근거 4]")], f"e {evidence.EVIDENCE}, a string").select(evidence.formatted(F.col("e")).alias("f"), evidence.expanded(F.col("a"), F.col("e")).alias("x")).first()
    assert row["f"] == "[근거 1] 가펀드 3쪽 · 절 (기준일 2024-01-02)\n본문\n\n[근거 2] d$2 · § 1\n둘\n\n[근거 3] 공통\n"
    assert row["x"] == "(가펀드 3쪽)과 (d$2 · § 1), (공통), [근거 4]"
    runs = spark.createDataFrame([("x (a 3쪽), (b 4쪽) (a 3쪽) y (a 3쪽).",), (None,), ("(a) (a)",)], "t string").select(evidence.without_repeats("t").alias("t")).collect()
    assert [r["t"] for r in runs] == ["x (a 3쪽), (b 4쪽) y (a 3쪽).", None, "(a) (a)"]
    frame = spark.createDataFrame
    notes = evidence.grade_notes(frame([(1, "위험은?"), (2, "수익은?")], "qid long, text string"), frame([(q, f, n, t, i) for q in (1, 2) for i, (f, n, t) in enumerate([("F1", None, "x"), ("F1", "이름", "x"), ("F2", "b", "투자위험등급 3"), (None, "c", "x"), ("F3", None, None)])], "qid long, fund string, fund_name string, text string, rank int"), frame([("F1", "2등급"), ("F2", "1등급"), ("F3", "5등급")], "fund string, grade string"))
    assert {(r["qid"], r["note"]) for r in notes.collect()} == {(1, "[확정] 이름(F1) 투자위험등급: 2등급"), (1, "[확정] F3(F3) 투자위험등급: 5등급")}


def test_notices_and_titles(spark):
    a = spark.createDataFrame([("아니요. 방법은 이렇습니다", "N"), ("처리 불가. 고객센터로", "N"), ("그대로", None)], "a string, n string")
    got = a.select(evidence.noticed(F.col("a"), F.col("n"), ["불가"], F.lit("C"), ["고객센터"]).alias("x"), evidence.disclaimed(F.col("a"), F.col("n").isNotNull(), "면책", "불가").alias("d")).collect()
    assert [r["x"] for r in got] == ["N\n\n방법은 이렇습니다\n\nC", "처리 불가. 고객센터로", "그대로"] and [r["d"] for r in got] == ["아니요. 방법은 이렇습니다\n\n면책", "처리 불가. 고객센터로", "그대로"]
    assert evidence.made_title("■ 퇴직연금 이전 안내 본문이 이어집니다") == "퇴직연금 이전 안내" and evidence.made_title(None) == "" and evidence.made_title("가나다라 마바사 가나다라 뒤") == "가나다라 마바사"
    assert evidence.clean_title("a" * 12 + " " + "b" * 30) == "a" * 12 and evidence.clean_title("c" * 40) == "c" * 30
    assert evidence.report([("g", 0.5, 4)], "T", 4).endswith("| g | 4 | 50.0% | ██ |")


def test_index(spark, tmp_path, tiny):
    chunks = spark.read.parquet(f"{tiny}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = spark.read.parquet(f"{tiny}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    path = str(tmp_path / "index")
    assert index.ensure(chunks, path) and not index.ensure(chunks.orderBy("text"), path)
    cols = ["qid", "chunk_id", "score", "rank"]
    got = {tuple(r) for r in index.search(asked, path).select(cols).collect()}
    want = {tuple(r) for r in retrieval.bm25(asked, chunks).select(cols).collect()}
    assert len(got) == len(want) and len(got ^ want) <= 0.002 * len(want)  # sums of other orders differ in the sixth digit
    assert index.ensure(chunks.filter("chunk_id > 3"), path)


def docx(*parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(parts)}</w:body></w:document>")
    return out.getvalue()


def test_word_files(spark):
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(f'{r}{c}')}</w:tc>" for c in range(3)) + "</w:tr>" for r in "ab") + "</w:tbl>"
    files = [("a", docx(p("intro"), p("Title", "Heading1"), table, p("body"), p("1. 집합투자기구"), p("end"))), ("b", b"none"), ("c", None)]
    rows = artefacts.word_files(spark.createDataFrame(files, "path string, content binary")).orderBy("pos").collect()
    assert [(r["kind"], r["section"], r["text"]) for r in rows] == [("text", "", "intro"), ("text", "Title", "Title\nbody"), ("text", "1. 집합투자기구", "1. 집합투자기구\nend") if documents.heading_line("1. 집합투자기구") else None, ("table", "1. 집합투자기구", "| a0 | a1 | a2 |\n|---|---|---|\n| b0 | b1 | b2 |")]


def test_runs_and_imports(spark):
    frame = spark.createDataFrame
    left = artefacts.pending(frame([("1",), ("2",), ("3",)], "question_id string"), frame([("1", "a", None), ("2", "", None), ("3", "x", "timeout")], "question_id string, answer string, error string"))
    assert sorted(r["question_id"] for r in left.collect()) == ["2", "3"]
    both = artefacts.merged(frame([("1", [1, 2])], "question_id string, pages array<int>"), frame([("2", "x")], "question_id string, answer string"))
    assert [tuple(r) for r in both.collect()] == [("1", "[1,2]", None)]
    named, vectors, ids = artefacts.imported(frame([("x1", "d", 1), ("x2", "d", 1), ("x3", "d", None)], "chunk_id string, doc_id string, page int"), frame([("x2", [1.0])], "chunk_id string, v array<double>"))
    assert sorted(r["chunk_id"] for r in named.collect()) == ["d_p0_0000", "d_p1_0000", "d_p1_0001"] and vectors.first()["chunk_id"] == "d_p1_0001" and ids.count() == 3

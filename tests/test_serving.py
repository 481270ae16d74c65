"""Sinks, the service's parts, audits, prompts and rebuilt statements on small cases."""

import json
import threading
import unicodedata
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as cli
from corpusloom import serving
from corpusloom.operators import audit, evidence
from corpusloom.operators import sql_repair as sr
from corpusloom.sources import artefacts, sinks


def test_files_by_name(spark, tmp_path):
    for name in ("나.pdf", "가.pdf", "다.pdf"):
        (tmp_path / unicodedata.normalize("NFD", name)).write_bytes(b"x")
    found = artefacts.documents(spark, str(tmp_path), names=("다.pdf",))
    names = lambda rows: [unicodedata.normalize("NFC", r["path"].rsplit("/", 1)[1]) for r in rows.collect()]
    assert names(artefacts.in_order(found)) == ["가.pdf", "나.pdf"] and names(artefacts.in_order(found, 1)) == ["가.pdf"]


def test_fee_writer(spark, tmp_path):
    grid = "| 클래스 | 판매 수수료 | 총보수 | 판매보수 |\n|---|---|---|---|\n| 온라인(C-e) | 없음 | {} | 0.1 |"
    rows = [("a", "F", grid.format("0.3")), ("b", "F", grid.format("0.4")), ("c", "G", "| 클래스 | 총보수 |\n없다"), ("d", "G", "x"), ("e", None, None)]
    out = str(tmp_path / "fees")
    chunks = spark.createDataFrame(rows, "chunk_id string, fund_code string, text string")
    assert sinks.write_fees(chunks, out).first().asDict() == {"candidates": 3, "rows": 2, "funds": 1, "skipped": 1, "conflicts": 1}
    assert {r["chunk_id"] for r in spark.read.parquet(f"{out}/skipped").collect()} == {"c"}
    assert sinks.write_fees(chunks.filter("chunk_id = 'd'"), out).first().asDict() == {"candidates": 0, "rows": 0, "funds": 0, "skipped": 0, "conflicts": 0}


def test_final_and_swap(spark, tmp_path):
    final = spark.createDataFrame([("b", "d2", 1, "single", "text", "xy", 1), ("a", "d1", 1, "shared", "text", "x \n y", 3), ("c", "d1", 2, "single", "table", None, 1)], "chunk_id string, doc_id string, page int, scope string, content_type string, text string, n_docs long")
    new, path = str(tmp_path / "new"), str(tmp_path / "final")
    sinks.write_final(final, new)
    report = {r["name"]: r["value"] for r in sinks.final_report(final.unionAll(final), final).collect()}
    assert report == {"rows before": 6, "rows": 3, "chars before": 14, "chars": 7, "rows kept": 0.5, "chars saved": 0.5, "tokens": 3, "scope single": 2, "scope shared": 1, "content_type text": 2, "content_type table": 1}
    empty = {r["name"]: r["value"] for r in sinks.final_report(final.limit(0), final.limit(0)).collect()}
    assert empty["rows kept"] == 0 == empty["tokens"] and len(empty) == 7
    assert [tuple(r) for r in sinks.most_shared(final).collect()] == [("a", 3, "x y")]
    with pytest.raises(ValueError):
        sinks.put_in_place(spark, new, path, F.col("text").isNotNull())
    assert sinks.put_in_place(spark, new, path) is None and spark.read.parquet(path).count() == 3
    sinks.write_final(final.filter("page = 1"), new)
    assert sinks.put_in_place(spark, new, path).endswith(".old") and spark.read.parquet(path).count() == 2 and spark.read.parquet(path + ".old").count() == 3
    stamped = sinks.stamped(final).select("today", "run_at").distinct()
    assert stamped.count() == 1 and stamped.filter("run_at is not null").count() == 1


def test_spans(spark):
    text = "중도\n인출 불가. A b.C 중도인출"
    assert [text[s:e] for s, e in audit.spans("중도 인출", text)] == ["중도\n인출", "중도인출"]
    rows = spark.createDataFrame([("중도 인출", text), ("b. c", text), ("", text), (None, text), ("x", None)], "p string, t string")
    got = [[tuple(s) for s in r[0]] for r in rows.select(audit.audited(F.col("p"), F.col("t"))).collect()]
    assert got == [[(0, 5, True, True), (16, 20, False, False)], [(12, 15, True, False)], [], [], []]


def test_prompts(spark):
    row = spark.createDataFrame([("q",)], "q string")
    of = lambda *a, **k: row.select(evidence.composed(F.col("q"), *a, asks=("A", "B", "C"), **k)).first()[0]
    none = F.lit(None).cast("string")
    assert of(none, F.lit(" "), none, F.lit("note")) is None
    assert of(F.lit("5"), F.lit("r"), F.lit("e"), F.lit("n")) == "5\n\nr\n\ne\n\nn\n\nq\n\nA" and of(none, F.lit("r"), F.lit("e"), none, extra=((F.lit(True), "x"), (F.lit(None).cast("boolean"), "y"))) == "r\n\ne\n\nq\n\nB x"
    assert of(none, none, F.lit("e"), none) == "e\n\nq\n\nC"


def test_source_line(spark):
    kind = "array<struct<fund_name:string,doc_id:string,page:int,text:string,title:string>>"
    pieces = [("가나 성장증권자투자신탁1호", "KR1", 3, "alpha beta gamma delta 10"), ("다라", "KR2", 0, "alpha beta gamma"), (None, "d", None, "alpha")]
    rows = spark.createDataFrame([([(*p, None) for p in pieces], "alphabeta gamma ※ 근거: delta"), ([(*p, None) for p in pieces], "none"), ([], "alpha")], f"e {kind}, a string")
    line = evidence.source_line(F.col("e"), F.col("a"))
    assert [r[0] for r in rows.select(line).collect()] == ["\n\n※ 근거: 가나 성장 투자설명서 3쪽 · 다라 투자설명서", "\n\n※ 근거: 가나 성장 투자설명서 3쪽 · 다라 투자설명서", ""]
    asked = evidence.source_line(F.col("e"), F.col("a"), named=lambda n: n.startswith("다라"))
    assert rows.select(asked).first()[0] == "\n\n※ 근거: 다라 투자설명서"


def test_rebuilt():
    short, codes = {"파워단기채": "파워단기채증권", "단기채": "단기채", "국공채": "국'공채", "채": "채"}, ["C-e", "C", "A", "S-퇴직"]
    assert [f for *_, f in sr.funds_in("국공채와 파워단기채, 단기채", short)] == ["국'공채", "파워단기채증권"]
    sql = sr.rebuilt("파워단기채 C-e, S-퇴직과 국공채 A는?", short, codes)
    assert "(fund_name = '파워단기채증권' AND UPPER(REPLACE(class_code,'-','')) IN ('CE', 'S퇴직')) OR (fund_name = '국''공채' AND UPPER(REPLACE(class_code,'-','')) = 'A')" in sql
    assert sr.rebuilt("파워단기채 C-e", short, codes) is None is sr.rebuilt("C-e, S-퇴직", short, codes) and sr.rebuilt("", {}, []) is None
    assert sr.rebuilt("파워단기채" + "가" * 31 + " C-e, S-퇴직", short, codes) is None


def test_census():
    text, kinds = sr.census(["A", "C-e", "C-없음e", None, *(f"C{i}" for i in range(40))], {"퇴직연금": 3, None: 2, "": 1})
    assert kinds == "'퇴직연금'(3행), NULL(2행)" and "없음" not in text and len(text.split(",")) == 42 and all(len(x) < 66 for x in text.split("\n"))
    assert sr.census([], {}) == ("", "NULL(0행)")


def test_attempted():
    told = []

    def generate(question, before):
        told.append(before)
        return "bad" if not before else "good"

    def run(sql):
        if sql == "bad":
            raise ValueError("no")
        return [1]

    assert sr.attempted("q", generate, run) == ([1], ["attempt 1: ValueError: no"]) and told[1] == (("bad", "ValueError: no"),)
    assert sr.attempted("q", lambda *_: "bad", run) == ([], ["attempt 1: ValueError: no", "attempt 2: ValueError: no"])


def test_faults_and_cache():
    assert serving.may_pass(ConnectionError("x")) and serving.may_pass(RuntimeError("HTTP 503: x")) and not serving.may_pass(RuntimeError("HTTP 401"))
    held, key = serving.Responses(2), serving.Responses.key
    assert key("1", " q ") == key(1, "q") != key("1", "r")
    for q in "ab":
        held.put(key("", q), {"answer": q})
    assert held.get(key("", "a")) and not held.put(key("", "c"), {}) and held.get(key("", "b")) is None and held.get(key("", "a")) == {"answer": "a"}


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = serving.Pace(2, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        pace.wait()
    assert slept == [0.5, 0.5]
    pace.told(False)
    assert pace.gap == pytest.approx(0.7)
    for _ in range(14):
        pace.told(True)
    assert pace.gap == pytest.approx(0.7)
    pace.told(True)
    assert pace.gap == pytest.approx(0.56)
    for _ in range(30):
        pace.told(False)
    assert pace.gap == 5
    for _ in range(15 * 40):
        pace.told(True)
    assert pace.gap == 0.5


def test_profiles_probe_deadline():
    def bad(x):
        raise ValueError("parameter")

    ways = serving.Profiles({"a": bad, "b": lambda x: x + 1}, lambda e: "parameter" in str(e))
    assert ways.call(1) == 2 and ways.first == "b"
    with pytest.raises(RuntimeError):
        serving.Profiles({"a": lambda x: 1 / 0, "b": lambda x: x}, lambda e: False).call(1)
    assert serving.first_working([0, 1, 2], lambda t: [1.0] * (3 // t)) == (1, 3) and serving.first_working([], len) is None
    clock = iter([0, 1, 300]).__next__
    late = serving.within([lambda s: s | {"n": 1}, lambda s: s | {"n": 2}], {}, lambda s: "sorry", clock=clock)
    assert late == {"n": 1, "trace": ["stopped after 240 s"], "answer": "sorry"}
    assert serving.within([lambda s: s | {"n": 1}], {}, lambda s: "sorry") == {"n": 1}


def test_http():
    calls = []

    def ask(question, question_id):
        calls.append(question)
        return {"answer": question.upper()} if question != "bad" else 1 / 0

    served = serving.server(ask, port=0, sorry="sorry", responses=serving.Responses())
    threading.Thread(target=served.serve_forever, daemon=True).start()
    get = lambda path: json.load(urlopen(f"http://127.0.0.1:{served.server_address[1]}{path}", timeout=10))
    try:
        assert get("/health") == {"status": "ok"}
        want = {"question_id": "1", "question": "가 a", "retrieved_context": "", "think_trace": "", "answer": "가 A"}
        path = f"/answer?question={quote('가 a')}&question_id=1"
        assert get(path) == want == get(path) and calls == ["가 a"]
        assert get("/answer?question=bad")["answer"] == "sorry" == get("/answer?question=bad")["answer"] and calls.count("bad") == 2
        for path, status in (("/answer", 422), ("/other", 404)):
            with pytest.raises(HTTPError) as e:
                get(path)
            assert e.value.code == status
    finally:
        served.shutdown()
        served.server_close()


def test_commands(spark, tmp_path, capsys):
    chunks, at = str(tmp_path / "chunks"), str(tmp_path / "index")
    spark.createDataFrame([(1, "pension fee"), (2, "other words"), (3, "x y"), (4, None)], "chunk_id long, text string").write.parquet(chunks)
    for want in ("written", "current"):
        cli.main(["index", chunks, at])
        assert capsys.readouterr().out.strip() == want
    cli.main(["search", at, "a fee", "--json", "--chunks", chunks])
    assert json.loads(capsys.readouterr().out)["chunk_id"] == 1
    asked, out = str(tmp_path / "asked"), str(tmp_path / "out")
    spark.createDataFrame([("1", "abc")], "question_id string, question string").write.parquet(asked)
    cli.main(["ask", asked, "builtins:len", out])
    assert spark.read.parquet(out).first()["answer"] == "3"
    with pytest.raises(SystemExit):
        cli.main(["other"])

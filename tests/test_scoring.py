"""Names and scores on small cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import names
from corpusloom.operators import scoring


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in given.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("number, text, found", [
    (0.33, "10.335", False), (0.33, "a0.33%", True), (0.2, "x 0.20 y", True), (0.2, "0.2", True), (0.2, "10.2", False), (0.2, "0.25", False), (900.0, "900만", True), (900.0, "1,900", False),
    (1900.0, "총 1,900원", True), (1900.0, "21,900", False), (900.0, "900.5", False), (900.0, "900.", True), (12.3456, "12.3456", True), (5.0, "", False),
])
def test_number_in(spark, number, text, found):
    assert value(spark, names.number_in(F.col("v"), names.flat(F.col("t"))), v=number, t=text) is found


def test_names(spark):
    at = lambda f, x: value(spark, f(F.col("t")), t=x)
    assert at(names.family, "가나초단기증권자투자신탁 1호(채권)") == "가나" and at(names.family, None) == ""
    assert at(names.without_echo, "가나 약관  가나 약관") == "가나 약관" and at(names.without_echo, "ab ab") == "ab ab"
    assert at(names.shown_label, "오 프라인-없음개 인연금(C-P)") == "오프라인-개인연금(C-P)"
    assert at(names.file_stem, "a b/ㄱ가.pdf") == "a_b_ㄱ가.pdf"
    assert at(names.nfc, unicodedata.normalize("NFD", "가é")) == "가é" and at(names.nfc, None) == ""
    assert [at(names.chunk_owner, x) for x in ("KR5_p12_0003", "a_b_7", "plain")] == ["KR5", "a_b", "plain"] and at(names.chunk_ordinal, "KR5_p12_0003") == 3
    assert [value(spark, names.percent(F.col("v")), v=x) for x in (0.471, 1.0, 0.0, 0.00012, 12.3456, 9999.0)] == ["0.471%", "1%", "0%", "0.00012%", "12.35%", "9999%"]
    assert value(spark, names.section_of(F.col("h"), F.col("t")), h=["a", "b"], t="x") == "a > b" and value(spark, names.section_of(F.col("h"), F.col("t")), h=[""], t="x") == "x"


def test_aliases(spark):
    got = value(spark, scoring.aliases_in(F.col("q"), F.col("a")), q="가나다라 그리고 나다 및 가나", a=["나다", "가나다라", "가나", "없다", "", "및"])
    assert [tuple(r) for r in got] == [(1, "가나다라"), (13, "및")]


def test_scored(spark):
    req = lambda kind, values, alts, weight=1.0, evidence=True: (kind, values, alts, weight, evidence)
    gold = [
        ("all", [req("number", [0.2], None, 2.0), req("text", None, ["가 나", "zz"])], [("docs/A.pdf", ["별칭"], "p. 12"), ("B.pdf", None, "§ 3. 조항입니다")], ["틀린 말"]),
        ("part", [req("number", [5.0], None, 3.0, False), req("text", None, ["없는"])], None, None), ("contra", [req("text", None, ["참"])], [], ["거짓"]),
        ("infra", [req("text", None, ["x"])], None, None), ("none", [req("text", None, ["x"])], None, None), ("empty", None, None, None), ("bad", [req("text", None, ["x"])], None, None),
    ]
    runs = [("all", "값은 0.20% 이고 가나 입니다 (12쪽)", "0.2", "['A.pdf', '조항']", None, 200), ("part", "5", "", None, None, None), ("contra", "참이고 거 짓", "", None, None, 200), ("infra", scoring.FALLBACK + " x", "", None, None, 200), ("empty", "말", None, None, None, 200), ("bad", "x", "", None, "timeout", 200)]
    got = scoring.scored(spark.createDataFrame(gold, scoring.GOLD), spark.createDataFrame(runs, "question_id string, answer string, retrieved_context string, sources string, error string, http_status int"))
    by = {r["question_id"]: r for r in got.collect()}
    assert {k: r["state"] for k, r in by.items()} == {"all": "AUTO_CORRECT", "part": "PARTIAL_REVIEW", "contra": "CONTRADICTION_REVIEW", "infra": "INFRA_FAIL", "none": "MISSING_FROM_RUN", "empty": "SEMANTIC_REVIEW", "bad": "INFRA_FAIL"}
    a = by["all"]
    assert (a["answer_cov"], a["retrieval_cov"], a["grounding"], a["source_recall"], a["locator_recall"]) == (1.0, pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5, 0.5)
    assert by["part"]["answer_cov"] == 0.75 and by["part"]["retrieval_cov"] == 0.0 and by["part"]["grounding"] is None and by["empty"]["source_recall"] is None
    total = scoring.composite(got).first()
    mean = lambda c, rows: (lambda xs: sum(xs) / len(xs) if xs else 0.0)([r[c] for r in rows if r[c] is not None])
    every, ran = list(by.values()), [r for r in by.values() if r["state"] != "INFRA_FAIL"]
    want = 0.5 * mean("answer_cov", every) + 0.2 * mean("retrieval_cov", every) + 0.15 * (2 * mean("source_recall", every) + mean("locator_recall", every)) / 3 + 0.15 * mean("grounding", ran)
    assert total["rows"] == 7 and total["composite"] == pytest.approx(want)


def test_reports(spark):
    frame = spark.createDataFrame
    recall = scoring.source_recall(frame([("q", "f", 1), ("q", "f", 2), ("q", "g", 3), ("r", "f", 1)], "question_id string, fund string, page int"), frame([("q", "f", 2), ("q", "f", 2), ("q", "h", 3)], "question_id string, fund string, page int"))
    assert {r["question_id"]: (r["pages"], r["funds"]) for r in recall.collect()} == {"q": (pytest.approx(1 / 3), pytest.approx(2 / 3)), "r": (0.0, 0.0)}
    assert {r["question_id"]: r["runs"] for r in scoring.failure_history(frame([("q", "2", True), ("q", "1", True), ("q", "2", True), ("r", "1", False)], "question_id string, run_id string, failed boolean")).collect()} == {"q": ["1", "2"]}
    bad = scoring.problems(frame([("1", "x", None, 3, 200, 300.0), ("1", "x", "y", 3, 500, 1.0)], "question_id string, question string, answer string, retrieved_context int, http_status int, elapsed_sec double"))
    assert [r["problems"] for r in bad.collect()] == [["null answer", "not a string: retrieved_context", "missing trace", "slow"], ["not a string: retrieved_context", "missing trace", "status"]]
    first = scoring.opening_chunks(frame([("d", None, 0, "late"), ("d", 2, 1, "b"), ("d", 2, 0, "a")], "doc_id string, page int, ordinal int, text string"))
    assert first.first()["text"] == "a"
    means = scoring.group_means(frame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double"), "k", "v").collect()
    assert [(r["k"], r["mean"], r["rows"]) for r in means] == [("b", 2.0, 1), ("a", 1.0, 2)]


def test_comparison_and_swaps(spark):
    hits = spark.createDataFrame([(1, f, f"{f}{i}", i) for f in "abc" for i in range(9)] + [(2, "a", "a0", 1)], "qid long, fund string, chunk_id string, rank int")
    got = scoring.compared(hits, spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "qid long, fund string")).orderBy("qid", "rank").collect()
    assert [r["chunk_id"] for r in got] == [f"{f}{i}" for f in "ab" for i in range(6)] and {r["qid"] for r in got} == {1}
    assert scoring.capped(hits.select("qid", "fund", "rank"), "fund", "rank").count() == 13
    ids = spark.createDataFrame([("a0", "n0")], "old_id string, new_id string")
    rows = spark.createDataFrame([("a0", 1), ("a1", 2)], "chunk_id string, v int")
    new = scoring.renamed(rows, ids)
    assert {r["chunk_id"] for r in new.collect()} == {"n0", "a1"}
    assert scoring.swap_report(rows, new, 2) == {"old": 2, "new": 2, "repeated": 0, "only_old": 1, "only_new": 1, "ready": True}
    assert not scoring.swap_report(rows, new.union(new), 4)["ready"]

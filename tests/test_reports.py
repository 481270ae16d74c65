"""Reports on small cases: nulls, empty tables, ties."""

import pytest
from pyspark.sql import functions as F

from corpusloom import serving
from corpusloom.operators import reports, retrieval


def test_neighbours_stay_in_their_document(spark):
    chunks = spark.createDataFrame([("a_p1_0001", "x"), ("a_p1_0002", "x"), ("a_p1_0003", "y" * 301), ("b_p1_0000", "x"), ("b_p1_9999", "x"), ("b_p1_10000", "z"), ("b_p1_0001", None)], "chunk_id string, text string")
    hits = spark.createDataFrame([(1, "a_p1_0002", 1), (1, "b_p1_0000", 2), (2, "b_p1_9999", 1), (3, "plain", 1)], "qid int, chunk_id string, rank int")
    got = [tuple(r) for r in retrieval.neighbours_by_id(hits, chunks).orderBy("qid", "rank").collect()]
    assert got == [(1, "a_p1_0001", 1, 1), (2, "b_p1_10000", 1, 1)]


def test_answer_checks(spark):
    gold = spark.createDataFrame([(1, None, ["a|b", "c"], ["w"]), (2, True, None, ["w"]), (3, False, None, None), (4, True, ["a"], None)], "question_id int, covered boolean, points array<string>, wrong array<string>")
    runs = spark.createDataFrame([(1, "B b, w", None), (2, "x" * 250 + "w", "c"), (3, "확인할 수  없다", ""), (5, "a", "a")], "question_id int, answer string, context string")
    got = {r["question_id"]: tuple(r)[1:] for r in reports.answer_checks(gold, runs).collect()}
    assert got == {1: (False, False, ["w"], None), 2: (True, True, [], None), 3: (None, None, None, True)}


def test_stability_and_spread(spark):
    runs = spark.createDataFrame([(1, 1.0), (1, 0.9995), (2, 0.0), (2, None), (3, 1.0), (3, 0.5)], "question_id int, answer_cov double")
    assert {tuple(r) for r in reports.stability(runs).collect()} == {(1, "good"), (2, "bad"), (3, "flaky")} and reports.stability(runs.limit(0)).count() == 0
    one = reports.spread(spark.createDataFrame([(0.5, 1.0)], "a double, b double"), ["a", "b"]).orderBy("metric").collect()
    assert [tuple(r) for r in one] == [("a", 0.5, 0.0, 0.5, 0.5), ("b", 1.0, 0.0, 1.0, 1.0)]


def test_tokens(spark):
    runs = spark.createDataFrame([("1", "토큰: 입력 1,200 + 출력 300 = 1,500 (HCX 호출 2회)", None), ("2", None, 3.0), ("3", "x", 1.0)], "question_id string, trace string, seconds double")
    used = reports.tokens_of(runs)
    assert [tuple(r) for r in used.collect()] == [("1", 1200, 300, 1500, 2, 0.0)]
    assert reports.token_report(used, {"t": 60}).first().asDict()["minute"] is None and reports.token_report(used.limit(0), {}).first()["questions"] == 0


def test_series(spark):
    names = spark.createDataFrame([("라이프 사이클2030(주)",), ("라이프사이클7090",), ("가나123",), (None,)], "name string")
    said = spark.createDataFrame([("미래라이프사이클 3040, 라이프사이클3040" * 2,), ("라이프사이클3040 라이프사이클2030",), ("라이프사이클6090",), ("라이프사이클30405" * 6,), (None,)], "text string")
    got = {(r["family"], r["number"], r["name"]) for r in reports.series(names, said).collect()}
    assert got == {("라이프사이클", "2030", "라이프 사이클2030(주)"), ("라이프사이클", "7090", "라이프사이클7090"), ("라이프사이클", "3040", "라이프사이클3040")}


def test_trips_and_breaker(spark):
    calls = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, None, True, False, True, True, True])], "who string, at int, f boolean")
    assert [tuple(r) for r in reports.trips(calls, "who", "at", F.col("f")).orderBy("begin").collect()] == [("a", 0, 2), ("a", 5, 3)]
    breaker = serving.Breaker()
    breaker.told(True)
    assert breaker.allows(50) and not breaker.allows(30)
    breaker.told(True)
    assert not breaker.allows(50)
    breaker.told(False)
    assert breaker.allows(40)


@pytest.mark.parametrize("question, want", [("제일 싼 것", [2, 1, 3]), ("최고 보수", [1, 2, 3]), ("보수", [3, 1, 2]), (None, [3, 1, 2])])
def test_superlatives(spark, question, want):
    rows = spark.createDataFrame([(1, question, 0.5, 1), (2, question, 0.1, 2), (3, question, None, 0)], "id int, question string, fee double, at int").withColumn("qid", F.lit(1))
    assert [r["id"] for r in reports.superlatives(rows, "question", "fee", ["at"]).orderBy("place").collect()] == want

"""Labels, cells, amounts, citations and tokens, written out."""

from pyspark.sql import functions as F

from corpusloom.functions import answers, classes, money
from corpusloom.functions import text as tx


def test_labels(spark):
    rows = [
        ("수수료미징구-온라인-퇴직연금(C-P2(퇴직연금))", "C-P2", "퇴직연금", "온라인", False), ("A(수수료선취-오프라인)", "A", None, "오프라인", True), ("투자자(C-Pe)", "C-Pe", "연금저축", "온라인", True),
        ("S-P (S-P)", "S-P", "연금저축", "온라인슈퍼", True), ("※ 주석", None, None, None, False), ("퇴 없음 직연금 (C1)", "C1", "퇴직연금", None, True), (None, None, None, None, False),
    ]
    label, code = F.col("label"), F.col("code")
    df = spark.createDataFrame([r[:1] for r in rows], "label string").withColumn("code", classes.code(label))
    assert [tuple(r) for r in df.select("label", "code", classes.account(label, code), classes.channel(label, code), classes.is_label(label)).collect()] == rows


def test_cells(spark):
    rows = [(" 1.25% ", 1.25), ("-", None), ("약 -0.5", -0.5), ("해당없음", None), ("1,200", 1200.0), ("", None), (None, None)]
    assert [tuple(r) for r in spark.createDataFrame([r[:1] for r in rows], "c string").select("c", classes.rate(F.col("c"))).collect()] == rows


def test_amounts(spark):
    rows = [("평가액 1억 2,000만원이고 3년 차면 얼마까지 되나요", 120_000_000, "1억 2,000만원", 3, True), ("금액이 없다", None, None, None, False), ("5만 1원, 만 60세", 50_001, "5만원 1원", 6, False), ("3억, 40세", 300_000_000, "3억", 0, False)]
    t = F.col("t")
    df = spark.createDataFrame([r[:1] for r in rows], "t string").withColumn("won", money.won(t))
    assert [tuple(r) for r in df.select("t", "won", money.won_text(F.col("won")), money.year(t), money.needs_limit(t)).collect()] == rows


def test_citations():
    for text, want in (("A fee of 0.2% (terms (old) p. 12) holds.", "A fee of 0.2% holds."), ("See (a note) here.", "See (a note) here."), ("An (open p. 3", "An (open p. 3"), ("Both [x (p. 4)], done", "Both, done")):
        assert answers.without_citations(text) == want


def test_tokens(spark):
    rows = [("종류C-P2 판매보수는 Ae1", "종류,c,p2,판매보수는,판매,매보,보수,수는,ae1"), ("A 가나", "a,가나")]
    assert [tuple(r) for r in spark.createDataFrame([r[:1] for r in rows], "t string").select("t", F.array_join(tx.tokens(F.col("t")), ",")).collect()] == rows

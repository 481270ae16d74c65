"""The fee parsers and the SQL repairs on small cases."""

import pytest

from corpusloom.operators import fee_tables as ft
from corpusloom.operators import sql_repair as sr

GRID = """| 클래스 | 판매수수료 | 총 | 판매보수 | 동종유형 총보수 |
|---|---|---|---|---|
| 종류 |  | 보수 |  |  |
| 수수료선취- | 1% 이내 | 0.50 | 0.20 | 0.61 |
| 오프라인(A) |  |  |  |  |
| 투자비용 |  |  |  |  |
| 온라인(A-E) | 없음 | 0.30 | 0.10 | 0.61 |"""
SUMMARY = "수수료미징구- 없음\n0.410 0.150 0.520 0.430 42 85 130 225 500\n온라인(C-E)"


def test_grid():
    rows = list(ft.rows_of(GRID))
    assert [(r["class_code"], r["class_label"], r["fee_total"], r["fee_distribution"], r["fee_peer_avg"], r["channel"], r["front_load_text"]) for r in rows] == [
        ("A", "수수료선취-오프라인(A)", 0.5, 0.2, 0.61, "오프라인", "1% 이내"), ("A-E", "온라인(A-E)", 0.3, 0.1, 0.61, "온라인", "없음"),
    ]


def test_grid_edges():
    plain = "| 종류 | 지급비율 총보수 |\n|--|--|\n| C-P | 0.471 |\n| 지급 | 시기 |\n| S-퇴직 | 0.3 |\n| C9 | 99 |\n a long line that ends the table without any bar"
    # a head ends before a line with two numbers only, so the first row of a table of two columns is part of it
    assert [(r["class_code"], r["account_type"], r["channel"]) for r in ft.rows_of("| 종류 | 총보수 | 비용 |\n| C-P | 0.471 | 1 |\n| 지급 | | |\n| S-퇴직 | 0.3 | 2 |\n| C9 | 99 | 3 |")] == [("C-P", "연금저축", "오프라인"), ("S-퇴직", "퇴직연금", "온라인슈퍼")]
    assert list(ft.rows_of(plain)) == [] or all(r["fee_total"] <= 10 for r in ft.rows_of(plain))
    assert list(ft.rows_of("| 클래스 | 환매수수료 |\n| A(A) | 1.0 | 2.0 |")) == [] == list(ft.rows_of(""))
    assert ft.cells("| a || b |") == ["a", "", "b"] and ft.cells("a|b") == ["a", "b"] and ft.cells("") == [] and ft.cells("|") == []
    assert ft.is_rule("|---|:-:|") and not ft.is_rule("| a-b |") and not ft.is_rule("   ")


def test_summary():
    (row,) = ft.rows_of(SUMMARY)
    assert (row["class_code"], row["fee_total"], row["fee_distribution"], row["fee_peer_avg"], row["fee_total_cost"], row["front_load_text"], row["class_label"]) == ("C-E", 0.41, 0.15, 0.52, 0.43, None, "수수료미징구- 없음 온라인(C-E)")
    assert list(ft.rows_of("x\n1 2 3 4 5\n온라인(C-E)")) == []
    assert list(ft.rows_of("0.410 0.150 0.520 0.430 42 85 130 225 500\n\n온라인(C-E)")) == []  # the code does not follow
    two = list(ft.rows_of(SUMMARY + "\n수수료선취- -\n1.434% 0.700% - 1.5% 1,042 85 130 225 500 \n오프라인(A)"))
    assert [r["class_code"] for r in two] == ["C-E", "A"] and two[1]["fee_total"] == 1.434 and two[1]["fee_peer_avg"] is None


def test_fee_rows(spark):
    df = spark.createDataFrame([(1, "총보수\n" + GRID), (2, None), (3, "no table"), (1, "총 보 수 클래스\n" + SUMMARY)], "chunk_id long, text string")
    assert sorted((r["chunk_id"], r["class_code"]) for r in ft.fee_rows(df).collect()) == [(1, "A"), (1, "A-E"), (1, "C-E")]


def test_split_top():
    assert sr.split_top("(a = 1 OR b = 2) OR c = 3", "or") == ["(a = 1 OR b = 2)", "c = 3"]
    assert sr.split_top("a LIKE '%1호(채%' OR b = 'x OR y'", "OR") == ["a LIKE '%1호(채%'", "b = 'x OR y'"]
    assert sr.split_top("  ", "AND") == []


def test_branches():
    head, parts, tail = sr.branches("SELECT 1 FROM t WHERE (fund_name LIKE '%(A%' OR fund_name = 'b') AND page > 2 ORDER BY page LIMIT 1")
    assert parts == ["(fund_name LIKE '%(A%') AND page > 2", "(fund_name = 'b') AND page > 2"] and tail == "ORDER BY page LIMIT 1" and head.endswith("WHERE")
    assert sr.branches("SELECT 1 FROM t WHERE fund_name = 'a' OR page = 1") is None
    assert sr.branches("SELECT min(fee_total) FROM t WHERE fund_name = 'a' OR fund_name = 'b'") is None and sr.branches("SELECT 1 FROM t") is None


@pytest.mark.parametrize("where, whole", [("fund_name = 'a' OR fund_name = 'b'", False), ("class_code IN ('AE', 'CE')", False), ("class_code IN ('AE')", True), ("fund_name = 'a LIMIT 1'", True)])
def test_limit(where, whole):
    sql = f"SELECT fee_total FROM t WHERE {where} ORDER BY fee_total LIMIT 1"
    assert sr.without_limit(sql) == (sql if whole else f"SELECT fee_total FROM t WHERE {where} ORDER BY fee_total")


def test_predicates():
    sql = "SELECT fee_total FROM t WHERE fund_name = 'x' AND class_code = 'C-P' AND account_type IN ('a', 'b') AND account_type IS NOT NULL"
    assert "class_code" in sr.without_invented_class(sql, "C-P 총보수는?") and "class_code" not in sr.without_invented_class(sql, "총보수는?")
    assert sr.without_account(sql).endswith("AND 1=1 AND account_type IS NOT NULL")
    kinds = {"연금저축": "연금저축", "퇴직연금": "퇴직연금"}
    assert sr.account_in_class("WHERE class_code IN ('연금 저축', 'A')", kinds) == "WHERE (account_type = '연금저축' OR class_code = 'A')"
    assert sr.account_in_class("WHERE class_code = '퇴직연금'", kinds) == "WHERE account_type = '퇴직연금'"
    assert sr.account_in_class("WHERE class_code = 'S-퇴직'", kinds) == "WHERE class_code = 'S-퇴직'"


def test_widened():
    sql = "SELECT fee_total FROM t WHERE fund_name LIKE '%a%' LIMIT 1"
    assert sr.widened(sql, "총보수는?") == "SELECT DISTINCT fund_name, class_code, account_type, channel, fee_total, page FROM t WHERE fund_name LIKE '%a%' ORDER BY channel, account_type, fee_total"
    for question, statement in (("가장 낮은 것은?", sql), ("A 클래스?", sql), ("총보수는?", sql.replace("fee_total", "page")), ("총보수는?", sql.replace("LIMIT", "AND class_code = 'A' LIMIT"))):
        assert sr.widened(statement, question) == statement


def test_concepts_and_tables():
    assert sr.is_concept("SELECT * FROM t WHERE class_code LIKE 'C-%'", "시간이 지나면 바뀌나요?", ("비교", "순위"), 3)
    assert not sr.is_concept("SELECT fund_name FROM t WHERE fund_name = 'a'", "?", (), 3) and not sr.is_concept("SELECT 1 FROM t", "비교", ("비교",), 3) and not sr.is_concept("SELECT 1 FROM t", "x", (), 0)
    assert sr.as_table([{"class_label": "오 프라인-없음개 인연금(C-P)", "fee_total": 0.4710, "n": None}], ["class_label", "fee_total", "n"]) == "class_label | fee_total | n\n오프라인-개인연금(C-P) | 0.471% | "
    assert sr.merged([[{"a": 1}, {"a": 2}], [{"a": 2}, {"a": 3}]], 2) == [{"a": 1}, {"a": 2}]

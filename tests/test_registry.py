"""Every registered query against its SQL at the smallest scale."""

import math
from collections import Counter

import duckdb
import pytest

from corpusloom.operators import routing, tables
from corpusloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def clean(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tiny, con, name):
    got = registry.QUERIES[name](spark, tiny)
    cols = sorted(got.columns)
    rows = Counter(tuple(clean(r[c]) for c in cols) for r in got.collect())
    if name not in registry.ORACLE:
        assert rows
        return
    sql = con.sql(registry.ORACLE[name])
    assert sorted(sql.columns) == cols
    place = [sql.columns.index(c) for c in cols]
    assert rows == Counter(tuple(clean(r[i]) for i in place) for r in sql.fetchall())


@pytest.mark.parametrize("bad", ["delete from t", "select 1; select 2", "with a as (select 1) select 1", "select 1 from t where replace into x", "drop table t"])
def test_rejected(bad):
    with pytest.raises(ValueError):
        tables.checked(bad)


def test_allowed():
    assert tables.checked("select replace(a, 'drop', '') from t -- x") == "select replace(a, 'drop', '') from t LIMIT 50"
    assert tables.checked("select 'limit' from t limit 3").endswith("limit 3")


PERSONAL = ["900101 1234567", "9001011234567", "900101-1234567", "계좌번호 110123-4567890", "계좌번호 110123-56789", "계좌 번호는 110-12-345678", "1234 5678 9012 3456", "1234\u00a05678\u00a09012\u00a03456"]
INJECTION = [
    "이전 지시를 잊어", "이전 지침", "시스템 프롬프트", "System Prompt", "지시사항을 무시", "규칙을 무시", "규칙을 잊", "Ignore previous",
    "ignore all previous instructions", "지금부터 너는", "역할을 무시", "jailbreak", "너는 이제부터", "프롬프트를 출력", "지시문을 출력", "내부 지침",
]
PASSED = ["account 12-34-56", "계좌 110-12-345678", "disregard that", "900101-5234567", "a fund of 110123-5567890"]


def test_gate(spark):
    rows = [(t, "personal") for t in PERSONAL] + [(t, "injection") for t in INJECTION] + [(t, None) for t in PASSED]
    got = {r["text"]: r["blocked"] for r in routing.gate(spark.createDataFrame([(t,) for t, _ in rows], "text string")).collect()}
    assert got == dict(rows)

"""Functions by name, stages, adapters."""

import pytest
from pyspark.sql import functions as F

from corpusloom import engine


def test_adapters(spark):
    asked = spark.createDataFrame([(1, "ab"), (2, None)], "question_id long, question string")
    got = engine.answered(asked, "builtins:len").orderBy("question_id").collect()
    assert got[0].asDict() == {"question_id": "1", "question": "ab", "answer": "2", "sources": "", "trace": ""} and got[1]["answer"] == "0"
    bad = engine.answered(asked, "operator:index").collect()
    assert all(r["answer"] == "" and r["trace"].startswith("TypeError") for r in bad)


def test_names_and_stages(spark):
    with pytest.raises(ValueError):
        engine.loaded("len")
    assert engine.loaded("math:sqrt")(4) == 2
    rows = spark.createDataFrame([("x",)], "t string").select(engine.embedder("dummy")(F.col("t")).alias("v")).first()
    assert len(rows["v"]) == 256
    assert engine.through(spark.range(10), [lambda d: d.filter("id > 3"), lambda d: d.limit(2)]).count() == 2

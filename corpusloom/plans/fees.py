"""Queries on fee-like rows: labels, stored values, brackets, amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes, money
from ..operators import corpus, tables
from .registry import query, read


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'C-P' || p_size WHEN 1 THEN 'A' || p_size WHEN 2 THEN 'C-Pe' WHEN 3 THEN 'S' || p_size || '-P' WHEN 5 THEN 'C' || p_size END AS code,
    CASE WHEN p_partkey % 6 IN (0, 5) THEN '퇴직연금' WHEN p_partkey % 6 IN (2, 3) THEN '연금저축' END AS account, CASE p_partkey % 6 WHEN 0 THEN '온라인' WHEN 1 THEN '오프라인' WHEN 2 THEN '온라인' WHEN 3 THEN '온라인슈퍼' END AS channel, p_partkey % 6 NOT IN (0, 4) AS is_class FROM part""")
def class_labels(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    made = ("수수료미징구-온라인-퇴직연금(C-P{}(퇴직연금))", "A{}(수수료선취-오프라인)", "투자자{}(C-Pe)", "S{0}-P (S{0}-P)", "※ 주석 {}", "퇴 없음 직연금 (C{})")
    label = F.coalesce(*(F.when(k == i, F.replace(F.lit(x.replace("{0}", "{}")), F.lit("{}"), n)) for i, x in enumerate(made)))
    rows = read(spark, d, "part").select("p_partkey", label.alias("label")).withColumn("code", classes.code(F.col("label")))
    label, code = F.col("label"), F.col("code")
    return rows.select("p_partkey", "code", classes.account(label, code).alias("account"), classes.channel(label, code).alias("channel"), classes.is_label(label).alias("is_class"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN l_quantity + 0.25 WHEN 2 THEN -l_quantity - 0.5 WHEN 4 THEN l_quantity + 1000 END AS rate FROM lineitem")
def rate_cells(spark, d):
    k, n = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.col("l_quantity").cast("int").cast("string")
    cell = F.when(k == 0, F.concat(F.lit(" "), n, F.lit(".25% "))).when(k == 1, "-").when(k == 2, F.concat(F.lit("약 -"), n, F.lit(".5"))).when(k == 3, "해당없음").when(k == 4, F.concat(F.lit("1,"), F.lpad(n, 3, "0")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", classes.rate(cell).alias("rate"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey % 9000 + 1 AS n FROM orders)
    SELECT k, CASE k % 4 WHEN 0 THEN n * 100000000 + 20000000 WHEN 2 THEN n + 50000 WHEN 3 THEN n * 100000000 END AS won, CASE k % 4 WHEN 0 THEN n || '억 2,000만원' WHEN 2 THEN '5만원 ' || format('{:,}', n) || '원' WHEN 3 THEN n || '억' END AS shown,
    CASE k % 4 WHEN 0 THEN k % 9 + 1 WHEN 2 THEN 6 WHEN 3 THEN 0 END::INT AS year, k % 4 = 0 AS calc FROM x""")
def money_parse_format(spark, d):
    k, n = F.col("o_orderkey"), (F.col("o_custkey") % 9000 + 1).cast("string")
    t = F.when(k % 4 == 0, F.concat(F.lit("평가액 "), n, F.lit("억 2,000만원이고 "), (k % 9 + 1).cast("string"), F.lit("년 차면 얼마까지 되나요"))).when(k % 4 == 1, "금액이 없다").when(k % 4 == 2, F.concat(F.lit("5만 "), n, F.lit("원, 만 60세"))).otherwise(F.concat(n, F.lit("억, 40세")))
    rows = read(spark, d, "orders").select(k.alias("k"), t.alias("t"), money.won(t).alias("won"))
    return rows.select("k", "won", money.won_text(F.col("won")).alias("shown"), money.year(F.col("t")).alias("year"), money.needs_limit(F.col("t")).alias("calc"))


@query("SELECT c_custkey, (9000000 + least(floor(abs(c_acctbal) * 10000 * 0.1::DOUBLE), 3000000))::BIGINT AS total FROM customer")
def transfer_credit(spark, d):
    return read(spark, d, "customer").select("c_custkey", money.transfer_credit(F.abs("c_acctbal") * 10000, 9_000_000, 0.1, 3_000_000).alias("total"))


@query("SELECT c_custkey, (SELECT max(t) FROM (VALUES (0), (1000), (2500), (5000), (9000)) s(t) WHERE t <= c_acctbal)::BIGINT AS floor FROM customer")
def bracket_asof(spark, d):
    return read(spark, d, "customer").select("c_custkey", tables.threshold(F.col("c_acctbal"), [0, 1000, 2500, 5000, 9000]).alias("floor"))


@query("SELECT want, coalesce(c_mktsegment, want) AS stored FROM (VALUES ('AUTO'), ('BUILDING'), ('FURN'), ('none')) r(want) LEFT JOIN (SELECT DISTINCT c_mktsegment FROM customer) ON starts_with(c_mktsegment, want)")
def channel_normalise(spark, d):
    return tables.stored(spark.createDataFrame([("AUTO",), ("BUILDING",), ("FURN",), ("none",)], "want string"), read(spark, d, "customer").select(F.col("c_mktsegment").alias("value")))


@query("SELECT word, value FROM (VALUES ('cars', 'AUTOMOBILE'), ('homes', 'HOUSEHOLD'), ('boats', 'SHIPYARD')) s(word, value) WHERE value IN (SELECT c_mktsegment FROM customer)")
def account_synonyms(spark, d):
    words = spark.createDataFrame([("cars", "AUTOMOBILE"), ("homes", "HOUSEHOLD"), ("boats", "SHIPYARD")], "word string, value string")
    return words.join(read(spark, d, "customer").select(F.col("c_mktsegment").alias("value")), "value", "left_semi").select("word", "value")


@query("SELECT 0 AS branch, count(*) AS n FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT 1, count(*) FROM part WHERE p_brand = 'Brand#99' UNION ALL SELECT 2, count(*) FROM part WHERE p_size > 20 AND p_type LIKE '%O%'")
def or_group_completion(spark, d):
    return tables.branches(read(spark, d, "part"), [F.col("p_brand") == "Brand#11", F.col("p_brand") == "Brand#99", (F.col("p_size") > 20) & F.col("p_type").like("%O%")])


@query("SELECT p_partkey, p_brand, 0 AS zero FROM part")
def blank_column_pruning(spark, d):
    return tables.without_blank(read(spark, d, "part").select("p_partkey", "p_brand", F.lit(0).alias("zero"), F.lit("  ").alias("blank"), F.lit(None).cast("string").alias("none")))


@query("WITH f AS (SELECT DISTINCT regexp_extract(p_brand, '^([^#]*)#', 1) AS family, regexp_extract(p_brand, '#([0-9]+)$', 1)::BIGINT AS number FROM part), s AS (SELECT family FROM f GROUP BY family HAVING count(*) >= 2) SELECT family, a.number FROM s, (SELECT unnest(range(1, 61)) AS number) a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.family = s.family AND f.number = a.number)")
def missing_variant(spark, d):
    known = read(spark, d, "part").select(F.regexp_extract("p_brand", "^([^#]*)#", 1).alias("family"), F.regexp_extract("p_brand", "#([0-9]+)$", 1).cast("long").alias("number"))
    asked = spark.range(1, 61).select(F.lit("Brand").alias("family"), F.col("id").alias("number"))
    return tables.missing(asked, known)


@query("WITH g AS (SELECT md5(text) AS hash, list(DISTINCT source) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2), m AS (SELECT source, count(*) AS chunks FROM documents GROUP BY source) SELECT hash, source, chunks FROM (SELECT hash, unnest(owners) AS source FROM g) LEFT JOIN m USING (source)")
def fee_identity_restore(spark, d):
    docs = read(spark, d, "documents")
    return corpus.restored(corpus.collapse(docs), docs.groupBy("source").agg(F.count("*").alias("chunks")))

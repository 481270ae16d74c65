"""Queries on reports; runs, traces and names are made of every row so that each rule meets its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import squeezed
from ..operators import reports, retrieval
from .registry import long, query, read


@query("SELECT o_orderkey AS question_id, CASE o_orderkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'error: ' || substr(repeat(o_orderpriority || ' ', 9), 1, 60) WHEN 2 THEN 'HTTP ' || (500 + o_custkey % 4) WHEN 3 THEN 'fallback' END AS reason FROM orders")
def infra_reasons(spark, d):
    k = F.col("o_orderkey") % 6
    answer = F.when(k == 0, "  ").when(k == 3, " 답변 생성에 실패했습니다").otherwise("fine")
    error = F.when(k == 1, F.repeat(F.concat("o_orderpriority", F.lit(" ")), 9)).when(k == 4, "")
    status = F.when(k == 2, 500 + F.col("o_custkey") % 4).when(k == 5, 200)
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), reports.infra_reason(answer, error, status).alias("reason"))


_RUN = "SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % {0} = 0 THEN NULL WHEN o_orderkey % {1} = 0 THEN 1.0::DOUBLE ELSE (o_custkey % 100) / 100.0::DOUBLE END AS answer_cov, o_orderstatus AS state FROM orders WHERE o_orderkey % {2} <> 0"


def _run(spark, d, a, b, c):
    k = F.col("o_orderkey")
    share = F.when(k % a != 0, F.when(k % b == 0, 1.0).otherwise((F.col("o_custkey") % 100) / 100.0))
    return read(spark, d, "orders").filter(k % c != 0).select(k.alias("question_id"), share.alias("answer_cov"), F.col("o_orderstatus").alias("state"))


@query(f"WITH n AS ({_RUN.format(7, 3, 11)}), b AS ({_RUN.format(5, 4, 13)}), x AS (SELECT n.question_id, coalesce(n.answer_cov, 0) - coalesce(b.answer_cov, 0) AS t, b.state AS was, n.state AS now FROM n JOIN b USING (question_id)) SELECT question_id, round(t, 6) AS delta, CASE WHEN t > 0.01::DOUBLE THEN 'up' WHEN t < -0.01::DOUBLE THEN 'down' ELSE 'same' END AS direction, was, now FROM x")
def run_changes(spark, d):
    return reports.changes(_run(spark, d, 7, 3, 11), _run(spark, d, 5, 4, 13)).select("question_id", F.round("delta", 6).alias("delta"), "direction", "was", F.col("is").alias("now"))


@query(f"WITH r AS ({_RUN.format(7, 3, 11)} UNION ALL {_RUN.format(5, 4, 13)} UNION ALL {_RUN.format(5, 3, 17)}) SELECT question_id, CASE WHEN min(coalesce(answer_cov, 0)) >= 0.999::DOUBLE THEN 'good' WHEN max(coalesce(answer_cov, 0)) < 0.001::DOUBLE THEN 'bad' ELSE 'flaky' END AS kind FROM r GROUP BY question_id")
def run_stability(spark, d):
    return reports.stability(_run(spark, d, 7, 3, 11).unionAll(_run(spark, d, 5, 4, 13)).unionAll(_run(spark, d, 5, 3, 17)))


@query("SELECT 'price' AS metric, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part UNION ALL SELECT 'size', round(avg(p_size), 6), round(stddev_samp(p_size), 6), min(p_size)::DOUBLE, max(p_size)::DOUBLE FROM part")
def run_spread(spark, d):
    runs = read(spark, d, "part").select(F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return reports.spread(runs, ["price", "size"]).select("metric", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "low", "high")


def _used(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_custkey") + 1000
    trace = F.concat(F.lit("x | 토큰: 입력 "), F.format_number(n, 0), F.lit(" + 출력 "), (k % 900).cast("string"), F.lit(" = "), F.format_number(n + k % 900, 0), F.lit(" (HCX 호출 "), (1 + k % 3).cast("string"), F.lit("회)"))
    return reports.tokens_of(read(spark, d, "orders").select(k.alias("question_id"), F.when(k % 10 != 0, trace).alias("trace"), F.when(k % 4 != 0, (k % 50).cast("double")).alias("seconds")))


_USED = "u AS (SELECT o_orderkey AS question_id, o_custkey + 1000 AS prompt, o_orderkey % 900 AS completion, 1 + o_orderkey % 3 AS calls, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 50 END::DOUBLE AS seconds FROM orders WHERE o_orderkey % 10 <> 0)"


@query(f"WITH {_USED} SELECT count(*) AS questions, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(prompt + completion)::BIGINT AS total, sum(calls)::BIGINT AS calls, sum(seconds) AS seconds, round(sum(prompt + completion)::DOUBLE / count(*), 4) AS each, round(sum(prompt + completion)::DOUBLE / sum(calls), 4) AS call, round(sum(prompt + completion) * 60.0::DOUBLE / sum(seconds), 4) AS minute, round(sum(prompt + completion) * 60.0::DOUBLE / sum(seconds) / 60000, 4) AS of_test FROM u")
def token_totals(spark, d):
    r = reports.token_report(_used(spark, d), {"test": 60_000})
    return r.select("questions", "prompt", "completion", "total", "calls", "seconds", *(F.round(c, 4).alias(c) for c in ("each", "call", "minute", "of_test")))


@query(f"WITH {_USED} SELECT question_id, prompt + completion AS total FROM u ORDER BY total DESC, question_id LIMIT 5")
def token_heaviest(spark, d):
    return reports.heaviest(_used(spark, d)).select("question_id", "total")


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey % 3 AS c FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT k AS question_id, CASE WHEN k % 5 > 0 THEN c < 2 END AS answer_ok, CASE WHEN k % 5 > 0 THEN c = 0 END AS context_ok, CASE WHEN k % 5 > 0 THEN CASE WHEN c = 2 AND k % 2 = 0 THEN 1 ELSE 0 END END AS warnings, CASE WHEN k % 5 = 0 THEN k % 2 = 1 END AS admits FROM x""")
def answer_points(spark, d):
    k, c, number = F.col("o_orderkey"), F.col("o_custkey") % 3, F.col("o_custkey").cast("string")
    o = read(spark, d, "orders")
    points = F.array(F.concat(F.lit("없다|번호 "), number), F.lit("| |맞다"))
    gold = o.select(k.alias("question_id"), (k % 5 != 0).alias("covered"), points.alias("points"), F.array(F.lit("틀린 말"), F.lit("뒷말")).alias("wrong"))
    said = F.concat(F.when(k % 2 == 0, "틀린  말 ").otherwise("자료에  없습니다 "), F.when(c < 2, F.concat(F.lit("번 호"), number, F.lit(" 맞다"))).otherwise("맞 다"), F.lit(" " * 300 + "뒷말"))
    runs = o.filter(k % 7 != 0).select(k.alias("question_id"), said.alias("answer"), F.when(c == 0, said).when(c == 1, "").alias("context"))
    return reports.answer_checks(gold, runs).withColumn("warnings", F.size("warnings")).withColumn("warnings", F.when(F.col("answer_ok").isNotNull(), F.col("warnings")))


@query("SELECT 'p_type' AS kind, CASE WHEN p_size % 5 > 0 THEN p_type END AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT DISTINCT 'p_brand', p_brand, length(p_brand) FROM part")
def value_census(spark, d):
    rows = read(spark, d, "part").select(F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("p_type"), "p_brand")
    return reports.census(rows, "p_type", "p_brand")


@query("SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, round(avg(p_retailprice), 4) AS mean, round(sum(p_retailprice), 2) AS total, count(p_retailprice) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def fee_aggregates(spark, d):
    p = F.col("p_retailprice")
    return read(spark, d, "part").groupBy("p_brand").agg(F.min(p).alias("low"), F.max(p).alias("high"), F.round(F.avg(p), 4).alias("mean"), F.round(F.sum(p), 2).alias("total"), F.count(p).alias("n"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT l_orderkey AS qid, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_orderkey % 3 WHEN 0 THEN CASE WHEN l_discount > 0 THEN l_discount END WHEN 1 THEN CASE WHEN l_discount > 0 THEN -l_discount END END NULLS LAST, l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM lineitem")
def superlative_order(spark, d):
    k = F.col("l_orderkey") % 3
    asked = F.when(k == 0, "보수가 가장 싼 펀드").when(k == 1, "보수 높은 순으로").otherwise("보수는")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("fee"), asked.alias("question"))
    return reports.superlatives(rows, "question", "fee", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("qid", "l_linenumber", "l_partkey", long("place"))


@query("""WITH n AS (SELECT DISTINCT 'Fund' || p_type AS family, (2000 + p_size)::VARCHAR AS number, 'Fund ' || p_type || (2000 + p_size) || '(x)' AS name FROM part),
    m AS (SELECT 'Fund' || p_type AS family, (3000 + p_size)::VARCHAR AS number FROM part GROUP BY ALL HAVING count(*) >= 5)
    SELECT family, number, name FROM n UNION ALL SELECT family, number, family || number FROM m""")
def series_index(spark, d):
    p, size = read(spark, d, "part"), F.col("p_size")
    names = p.select(F.concat(F.lit("Fund "), "p_type", (2000 + size).cast("string"), F.lit("(x)")).alias("name"))
    said = p.select(F.concat(F.lit("to 1, the Fund-"), "p_type", F.lit(" "), (3000 + size).cast("string"), F.lit(" or Other"), (3000 + size).cast("string"), F.lit(", Fund99999")).alias("text"))
    return reports.series(names, said)


@query("WITH e AS (SELECT user_id, event_id, coalesce(value > 50, false) AS f FROM events), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e) SELECT user_id, min(event_id) AS begin, count(*) AS n FROM g WHERE f GROUP BY user_id, g HAVING count(*) >= 2")
def breaker_trips(spark, d):
    return reports.trips(read(spark, d, "events"), "user_id", "event_id", F.col("value") > 50)


@query("WITH h AS (SELECT user_id AS qid, event_type AS owner, event_id AS rank, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS variant FROM events), o AS (SELECT DISTINCT user_id AS qid, 'purchase' AS owner FROM events) SELECT o.qid, v.variant, min(h.rank) AS rank FROM o CROSS JOIN (SELECT DISTINCT variant FROM h) v LEFT JOIN h ON h.qid = o.qid AND h.owner = o.owner AND h.variant = v.variant GROUP BY ALL")
def owner_rank_by_filter(spark, d):
    e = read(spark, d, "events")
    hits = e.select(F.col("user_id").alias("qid"), F.col("event_type").alias("owner"), F.col("event_id").alias("rank"), F.when(F.col("event_id") % 3 == 0, "a").otherwise("b").alias("variant"))
    return reports.owner_ranks(hits, e.select(F.col("user_id").alias("qid"), F.lit("purchase").alias("owner")).distinct())


_IDS = "'d' || doc_id // 25 || '_p1_' || CASE WHEN doc_id < 10000 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END"


@query(f"""WITH c AS (SELECT {_IDS} AS chunk_id, doc_id // 25 AS owner, doc_id, text FROM documents), h AS (SELECT doc_id // 50 AS qid, chunk_id, owner, doc_id, doc_id % 50 AS rank FROM c WHERE doc_id % 5 = 0),
    s AS (SELECT h.qid, c.chunk_id, min(h.rank * 2 + CASE WHEN c.doc_id > h.doc_id THEN 1 ELSE 0 END) AS step FROM h JOIN c ON c.owner = h.owner AND c.doc_id IN (h.doc_id - 1, h.doc_id + 1) WHERE length(c.text) <= 300 AND NOT EXISTS (SELECT 1 FROM h x WHERE x.qid = h.qid AND x.chunk_id = c.chunk_id) GROUP BY ALL)
    SELECT qid, chunk_id, step // 2 AS from_rank, row_number() OVER (PARTITION BY qid ORDER BY step, chunk_id) AS rank FROM s QUALIFY rank <= 3""")
def short_neighbours_by_id(spark, d):
    i = F.col("doc_id")
    number = F.when(i < 10000, F.lpad(i.cast("string"), 4, "0")).otherwise(i.cast("string"))
    chunks = read(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.floor(i / 25).cast("string"), F.lit("_p1_"), number).alias("chunk_id"), "text")
    hits = chunks.filter(i % 5 == 0).select(F.floor(i / 50).cast("long").alias("qid"), "chunk_id", (i % 50).alias("rank"))
    return retrieval.neighbours_by_id(hits, chunks).select("qid", "chunk_id", "from_rank", long("rank"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text || '  x' || chr(10) || chr(10) || chr(10) || chr(10) || 'y', chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM documents")
def squeezed_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", squeezed(F.concat("text", F.lit("  x\n\n\n\ny"))).alias("text"))

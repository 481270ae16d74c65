"""Queries on parsed fee tables, names, numbers and scores; texts are made of every row so that each rule meets its table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, questions
from ..operators import evidence, fee_tables, scoring
from .registry import long, query, read


@query("SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 3 = 0 THEN 'C' ELSE 'A' END || p_size AS class_code, CASE WHEN p_partkey % 3 = 0 THEN '온라인' ELSE '오프라인' END AS channel, p_size + 0.25::DOUBLE AS fee_total, CASE WHEN p_partkey % 3 = 0 THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END AS fee_distribution, CASE WHEN p_partkey % 3 = 0 THEN '없음' END AS front_load_text FROM part WHERE p_partkey % 3 < 2 AND p_size + 0.25 <= 10")
def fee_table_rows(spark, d):
    size = F.col("p_size").cast("string")
    grid = F.concat(F.lit("| 클래스 | 판매 수수료 | 총 | 판매보수 |\n|---|---|---|---|\n| 종류 | | 보수 | |\n| 수수료선취- | 없음 | "), size, F.lit(".25 | 0.1 |\n| 온라인(C"), size, F.lit(") | | | |\n| 투자비용 | | | |\n총보수는 위와 같다"))
    lines = F.concat(F.lit("총 보수 안내\n수수료미징구-\n"), size, F.lit(".25 0.150 0.520 0.430 42 85 130 225 500\n오프라인(A"), size, F.lit(")"))
    k = F.col("p_partkey") % 3
    chunks = read(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.when(k == 0, grid).when(k == 1, lines).otherwise(F.concat(F.lit("총보수 "), size)).alias("text"))
    return fee_tables.fee_rows(chunks).select("chunk_id", "class_code", "channel", "fee_total", "fee_distribution", "front_load_text")


@query("SELECT o_orderkey::VARCHAR AS question_id, CASE WHEN o_orderkey % 7 = 0 THEN 'MISSING_FROM_RUN' WHEN o_orderkey % 5 = 0 THEN 'INFRA_FAIL' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'CONTRADICTION_REVIEW' WHEN o_orderkey % 3 = 0 THEN 'AUTO_CORRECT' WHEN o_orderkey % 3 = 1 THEN 'PARTIAL_REVIEW' ELSE 'SEMANTIC_REVIEW' END AS state, round(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 1 / 3.0 ELSE 0 END, 6)::DOUBLE AS answer_cov, round(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 / 3.0 END, 6)::DOUBLE AS retrieval_cov FROM orders")
def official_scores(spark, d):
    s = _scores(spark, d)
    return s.select("question_id", "state", F.round("answer_cov", 6).alias("answer_cov"), F.round("retrieval_cov", 6).alias("retrieval_cov"))


def _scores(spark, d):
    k, number, word = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.regexp_replace("o_orderpriority", r"^\d-", "")
    key = k.cast("string").alias("question_id")
    o = read(spark, d, "orders")
    required = F.array(F.struct(F.lit("number").alias("type"), F.array(F.col("o_custkey").cast("double")).alias("values"), F.lit(None).cast("array<string>").alias("alts"), F.lit(2.0).alias("weight"), F.lit(True).alias("evidence")), F.struct(F.lit("text").alias("type"), F.lit(None).cast("array<double>").alias("values"), F.array(F.lit("zz"), F.upper(word)).alias("alts"), F.lit(1.0).alias("weight"), F.lit(True).alias("evidence")))
    gold = o.select(key, required.alias("required"), F.lit(None).cast("array<struct<file:string,aliases:array<string>,locator:string>>").alias("sources"), F.array(F.lit("not so")).alias("contradiction_phrases"))
    answer = F.when(k % 3 == 0, F.concat(F.lit("No "), number, F.lit(", "), F.lower(word), F.when(k % 2 == 0, F.lit(" Not  So")).otherwise(F.lit("")))).when(k % 3 == 1, F.concat(F.lit("No "), number, F.lit("9 "), word)).otherwise(F.lit("nothing"))
    runs = o.filter(k % 7 != 0).select(key, answer.alias("answer"), word.alias("retrieved_context"), F.when(k % 5 == 0, F.lit("timeout")).alias("error"))
    return scoring.scored(gold, runs)


@query("WITH s AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 1 / 3.0::DOUBLE ELSE 0 END AS a, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 / 3.0::DOUBLE END AS b, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1 / 3.0::DOUBLE WHEN o_orderkey % 3 = 1 THEN 1 END AS g, CASE WHEN o_orderkey % 7 = 0 THEN 0 END AS c FROM orders) SELECT count(*) AS rows, round(0.5 * avg(a) + 0.2 * avg(b) + 0.15 * coalesce(avg(c), 0) + 0.15 * avg(g), 6) AS composite FROM s")
def official_composite(spark, d):
    return scoring.composite(_scores(spark, d)).select("rows", F.round("composite", 6).alias("composite"))


@query("SELECT l_orderkey, l_linenumber, format('{:.4g}%', l_discount) AS discount, format('{:.4g}%', l_tax * 123) AS tax FROM lineitem")
def rate_percent(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", names.percent(F.col("l_discount")).alias("discount"), names.percent(F.col("l_tax") * 123).alias("tax"))


@query("SELECT p_partkey, trim(p_name) AS family FROM part")
def fund_family(spark, d):
    name = F.concat("p_name", F.lit("초단기증권자투자신탁 "), F.lit("제"), F.col("p_size").cast("string"), F.lit("호("), "p_type", F.lit(")"))
    return read(spark, d, "part").select("p_partkey", names.family(name).alias("family"))


_GOLD_PAGES = "g AS (SELECT DISTINCT l_orderkey AS q, l_suppkey % 5 AS fund, l_linenumber AS page FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS q, l_suppkey % 5 AS fund, l_linenumber AS page FROM lineitem WHERE l_returnflag = 'N')"


@query(f"WITH {_GOLD_PAGES} SELECT g.q AS question_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.q = g.q AND e.fund = g.fund AND e.page = g.page) THEN 1.0 ELSE 0.0 END), 6) AS pages, round(avg(CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.q = g.q AND e.fund = g.fund) THEN 1.0 ELSE 0.0 END), 6) AS funds FROM g GROUP BY g.q")
def source_page_recall(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), (F.col("l_suppkey") % 5).alias("fund"), F.col("l_linenumber").alias("page"), "l_returnflag")
    got = scoring.source_recall(rows, rows.filter("l_returnflag = 'N'"))
    return got.select("question_id", F.round("pages", 6).alias("pages"), F.round("funds", 6).alias("funds"))


@query("SELECT user_id AS question_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS runs FROM events WHERE value > 50 GROUP BY user_id")
def failed_runs(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("run_id"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("failed"))
    return scoring.failure_history(e).select("question_id", F.array_join("runs", ",").alias("runs"))


@query("SELECT source AS doc_id, arg_min(md5(text), {'n': CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, 'p': n_chars % 7, 'o': doc_id}) AS opening FROM documents GROUP BY source")
def opening_chunk(spark, d):
    c = read(spark, d, "documents").select(F.col("source").alias("doc_id"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") % 7).alias("page"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).otherwise((F.col("n_chars") % 7) * (1 << 40) + F.col("doc_id")).alias("ordinal"), F.md5("text").alias("text"))
    return scoring.opening_chunks(c).select("doc_id", F.col("text").alias("opening"))


@query("SELECT user_id AS qid, event_type AS fund, event_id AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 4")
def evidence_cap(spark, d):
    return scoring.capped(read(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("fund"), F.col("event_id").alias("rank")), "fund", "rank")


@query("WITH e AS (SELECT user_id % 40 AS qid, event_type AS fund, event_id AS chunk_id, event_id AS rank FROM events), n AS (SELECT DISTINCT qid, fund FROM e WHERE (qid + length(fund)) % 3 > 0), c AS (SELECT qid, count(*) AS n FROM n GROUP BY qid HAVING count(*) >= 2), b AS (SELECT e.qid, e.fund, chunk_id, row_number() OVER (PARTITION BY e.qid, e.fund ORDER BY rank) AS i, n FROM e JOIN n USING (qid, fund) JOIN c ON c.qid = e.qid QUALIFY i <= greatest(2, 12 // n)) SELECT qid, chunk_id, fund, row_number() OVER (PARTITION BY qid ORDER BY fund, i) AS rank FROM b")
def comparison_hits(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 40).alias("qid"), F.col("event_type").alias("fund"), F.col("event_id").alias("chunk_id"), F.col("event_id").alias("rank"))
    named = e.filter((F.col("qid") + F.length("fund")) % 3 > 0).select("qid", "fund")
    return scoring.compared(e, named).select("qid", "chunk_id", "fund", long("rank"))


_ASKED = "CASE (conv_id + turn) % 6 WHEN 0 THEN '퇴직연금 중도인출 ' || turn WHEN 1 THEN '펀드 환매, 총보수 평균 ' || turn WHEN 2 THEN '세액공제 ' || turn WHEN 3 THEN '펀드 세율 KR' || (1000000000 + conv_id) WHEN 4 THEN '연금저축 압류 소득세법 ' || turn ELSE text END"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"WITH a AS (SELECT conv_id, turn, {_ASKED} AS t FROM conversations), h AS (SELECT *, len(list_filter({_LIST(questions.INSTITUTIONAL)}, lambda w: contains(lower(t), w))) AS inst, len(list_filter({_LIST(questions.PRODUCT)}, lambda w: contains(lower(t), w))) AS prod, len(list_filter({_LIST(questions.TAX_LAW)}, lambda w: contains(lower(t), w))) > 0 AS law FROM a) SELECT conv_id, turn, inst::BIGINT AS inst, prod::BIGINT AS prod, CASE WHEN inst >= 2 AND prod = 0 AND NOT law THEN '연금문서' WHEN prod >= 2 AND inst = 0 THEN '투자설명서' END AS doc_type, (inst >= 1 AND prod >= 1) OR (inst = 1 AND prod = 0) OR (inst >= 2 AND prod = 0 AND law) AS hybrid, inst >= 2 AND prod = 0 AND law AS tax_mix, CASE WHEN (conv_id + turn) % 6 = 3 THEN 'KR' || (1000000000 + conv_id) END AS fund_code, (conv_id + turn) % 6 = 1 AS need_sql FROM h")
def question_route(spark, d):
    c, k, turn = read(spark, d, "conversations"), (F.col("conv_id") + F.col("turn")) % 6, F.col("turn").cast("string")
    made = (F.concat(F.lit("퇴직연금 중도인출 "), turn), F.concat(F.lit("펀드 환매, 총보수 평균 "), turn), F.concat(F.lit("세액공제 "), turn), F.concat(F.lit("펀드 세율 KR"), (F.col("conv_id") + 1_000_000_000).cast("string")), F.concat(F.lit("연금저축 압류 소득세법 "), turn))
    text = F.col("text")
    for i, x in reversed(list(enumerate(made))):
        text = F.when(k == i, x).otherwise(text)
    r = c.select("conv_id", "turn", questions.route(text).alias("r"))
    return r.select("conv_id", "turn", F.col("r.inst").cast("long").alias("inst"), F.col("r.prod").cast("long").alias("prod"), "r.doc_type", "r.hybrid", "r.tax_mix", "r.fund_code", "r.need_sql")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents QUALIFY i <= 5) SELECT source, string_agg('[근거 ' || i || '] ' || CASE WHEN i % 2 = 0 THEN '공통' ELSE doc_id::VARCHAR END || CASE WHEN n_chars % 3 > 0 THEN ' ' || (n_chars % 3) || '쪽' ELSE '' END || ' · ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS evidence FROM r GROUP BY source")
def evidence_lines(spark, d):
    best = read(spark, d, "documents").withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("i <= 5")  # the pieces of one prompt
    one = F.struct("i", F.struct(F.lit(None).cast("string").alias("fund_name"), F.when(F.col("i") % 2 == 1, F.col("doc_id").cast("string")).alias("doc_id"), (F.col("n_chars") % 3).cast("int").alias("page"), F.col("lang").alias("section"), F.lit(None).cast("string").alias("base_date"), "text").alias("e"))
    held = best.groupBy("source").agg(F.sort_array(F.collect_list(one)).alias("x"))
    return held.select("source", evidence.formatted(F.transform("x", lambda x: x["e"])).alias("evidence"))

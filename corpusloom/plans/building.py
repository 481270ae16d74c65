"""Queries on what is written and said at the end: reports of a corpus and a fee table, labels, source lines, prompts, audits,
rebuilt statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, corpus, evidence, sql_repair
from ..sources import sinks
from .registry import query, read


def _final(spark, d):
    docs = read(spark, d, "documents")
    kept = corpus.collapse(docs).join(docs.select(F.col("doc_id").alias("first_id"), "text"), "first_id")
    return docs, kept.withColumnRenamed("first_id", "chunk_id").withColumn("content_type", F.when(F.col("text").contains("|"), "table").otherwise("text"))


_FINAL = "f AS (SELECT min(doc_id) AS chunk_id, count(DISTINCT doc_id) AS n_docs, text FROM documents GROUP BY text)"


@query(f"""WITH {_FINAL}, o AS (SELECT count(*) AS n, sum(length(text)) AS c FROM documents), m AS (SELECT count(*) AS n, sum(length(text)) AS c FROM f)
    SELECT unnest(['rows before', 'rows', 'chars before', 'chars', 'rows kept', 'chars saved', 'tokens']) AS name, unnest([o.n::DOUBLE, m.n::DOUBLE, o.c::DOUBLE, m.c::DOUBLE, round(m.n::DOUBLE / o.n, 6), round((o.c - m.c)::DOUBLE / o.c, 6), floor(m.c / 2.0)::DOUBLE]) AS value FROM o, m
    UNION ALL SELECT 'scope ' || CASE WHEN n_docs > 1 THEN 'shared' ELSE 'single' END, count(*)::DOUBLE FROM f GROUP BY 1
    UNION ALL SELECT 'content_type ' || CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' ELSE 'text' END, count(*)::DOUBLE FROM f GROUP BY 1""")
def final_corpus_report(spark, d):
    return sinks.final_report(*_final(spark, d)).select("name", F.round("value", 6).alias("value"))


@query(f"WITH {_FINAL} SELECT chunk_id, n_docs FROM f WHERE n_docs > 1 ORDER BY n_docs DESC, chunk_id LIMIT 5")
def most_shared_texts(spark, d):
    return sinks.most_shared(_final(spark, d)[1]).select("chunk_id", "n_docs")


@query("SELECT p_partkey AS chunk_id FROM part WHERE p_partkey % 3 = 1 OR (p_partkey % 3 = 0 AND p_size + 0.25 > 10)")
def fee_quarantine(spark, d):
    size = F.col("p_size").cast("string")
    grid = F.concat(F.lit("| 클래스 | 판매 수수료 | 총보수 | 판매보수 |\n|---|---|---|---|\n| 온라인(C"), size, F.lit(") | 없음 | "), size, F.lit(".25 | 0.1 |"))
    broken = F.concat(F.lit("| 클래스 | 총보수 |\n표는 다음 쪽에 있다 "), size)
    k = F.col("p_partkey") % 3
    chunks = read(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.when(k == 0, grid).when(k == 1, broken).otherwise(F.concat(F.lit("보수 "), size)).alias("text"))
    return sinks.fee_candidates(chunks)[1].select("chunk_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' 투자설명서' WHEN p_partkey % 4 = 1 THEN p_type WHEN p_partkey % 4 = 2 THEN '투자설명서' WHEN p_size % 2 = 0 THEN 'doc' || p_size ELSE '공통 조항' END AS label FROM part")
def document_labels(spark, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    fund = F.when(k == 0, F.concat("p_name", F.lit("증권자투자신탁 제"), size, F.lit("호("), "p_type", F.lit(")"))).otherwise("")
    doc = F.when(k == 2, F.concat(F.lit("KR5153"), F.lpad(size, 6, "0"))).when(F.col("p_size") % 2 == 0, F.concat(F.lit("doc"), size))
    return read(spark, d, "part").select("p_partkey", evidence.label(fund, doc, F.when(k == 1, F.col("p_type"))).alias("label"))


_PIECES = """e AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i,
    'shipment ' || l_partkey || ' 7 ' || CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'no' END || ' ' || l_suppkey AS text,
    CASE WHEN l_suppkey % 2 = 0 THEN 'Title ' || l_suppkey WHEN l_suppkey % 3 = 0 THEN '투자설명서' ELSE 'doc' || l_suppkey END || ' ' || l_linenumber || '쪽' AS label FROM lineitem),
    a AS (SELECT l_orderkey AS q, 'shipmentreturned' || max(l_partkey) || max(l_suppkey) AS answer FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_PIECES}, t AS (SELECT DISTINCT q, i, unnest(regexp_extract_all(text, '[가-힣A-Za-z]{{4,}}|[0-9]+(?:[.][0-9]+)?')) AS w FROM e),
    h AS (SELECT e.q, e.i, e.label, (SELECT count(*) FROM t WHERE t.q = e.q AND t.i = e.i AND length(t.w) > 1 AND contains(a.answer, t.w)) AS n FROM e JOIN a ON a.q = e.q),
    r AS (SELECT *, max(n) OVER (PARTITION BY q) AS best, row_number() OVER (PARTITION BY q ORDER BY n DESC, i) AS place FROM h),
    k AS (SELECT q, label, min(CASE WHEN best >= 3 THEN i ELSE place END) AS first_at FROM r WHERE CASE WHEN best >= 3 THEN n >= 3 AND n >= best * 0.4::DOUBLE ELSE place <= 2 END GROUP BY q, label),
    f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY first_at) AS nth FROM k)
    SELECT q AS question_id, chr(10) || chr(10) || '※ 근거: ' || string_agg(label, ' · ' ORDER BY first_at) AS line FROM f WHERE nth <= 4 GROUP BY q""")
def source_lines(spark, d):
    supp, part = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    state = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted").otherwise("no")
    text = F.concat(F.lit("shipment "), part, F.lit(" 7 "), state, F.lit(" "), supp)
    doc = F.when(F.col("l_suppkey") % 3 == 0, "KR5153450009").otherwise(F.concat(F.lit("doc"), supp))
    title = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Title "), supp))
    piece = F.struct(F.lit(None).cast("string").alias("fund_name"), doc.alias("doc_id"), F.col("l_linenumber").alias("page"), text.alias("text"), title.alias("title"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    held = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), piece.alias("e")))).alias("x"), F.concat(F.lit("shipment returned "), F.max("l_partkey").cast("string"), F.lit(" "), F.max("l_suppkey").cast("string")).alias("answer"))
    return held.select("question_id", evidence.source_line(F.col("x.e"), F.col("answer")).alias("line"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1) THEN NULL ELSE concat_ws(chr(10) || chr(10), CASE WHEN o_orderkey & 2 > 0 THEN 'sum ' || o_custkey END, CASE WHEN o_orderkey & 4 > 0 THEN 'rows' END, CASE WHEN o_orderkey & 1 > 0 THEN 'note' END, o_orderpriority, CASE WHEN o_orderkey & 2 > 0 THEN 'A' ELSE 'B' END || CASE WHEN o_orderstatus = 'F' THEN ' more' ELSE '' END) END AS prompt FROM orders")
def composed_prompts(spark, d):
    k = F.col("o_orderkey")
    bit = lambda n, c: F.when(k.bitwiseAND(n) > 0, c)
    prompt = evidence.composed(F.col("o_orderpriority"), bit(2, F.concat(F.lit("sum "), F.col("o_custkey").cast("string"))), bit(4, F.lit("rows")), F.lit(" "), bit(1, F.lit("note")), ("A", "B", "C"), ((F.col("o_orderstatus") == "F", "more"),))
    return read(spark, d, "orders").select("o_orderkey", prompt.alias("prompt"))


@query("SELECT min(doc_id) AS chunk_id, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY text HAVING bool_or(source = (SELECT min(source) FROM documents))")
def shared_membership(spark, d):
    docs = read(spark, d, "documents")
    code = docs.agg(F.min("source").alias("s")).scalar()
    return corpus.collapse(docs).filter(evidence.of_document(code, F.lit(None).cast("string"), F.col("owners"))).select(F.col("first_id").alias("chunk_id"), "n_docs")


@query(r"WITH m AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), CASE WHEN doc_id % 2 = 0 THEN 't\s*e\s*n' ELSE 'n\s*[.]\s*d' END) AS x FROM documents) SELECT doc_id, len(x)::INT AS n, len(list_filter(x, lambda s: regexp_matches(s, '[.!?\n•]')))::INT AS n_crossing FROM m")
def span_audit(spark, d):
    phrase = F.when(F.col("doc_id") % 2 == 0, "Te n").otherwise("n. D")
    return read(spark, d, "documents").select("doc_id", audit.audited(phrase, F.col("text")).alias("x")).select("doc_id", F.size("x").alias("n"), F.size(F.filter("x", lambda s: s["crosses"])).alias("n_crossing"))


#: Classes that the query's questions may name.
_CODES = ["A", "C", "A-E", "C-PE"]


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'SELECT fund_name, class_code, fee_total, front_load_text, page FROM fund_fees WHERE (fund_name = ''' || p_brand || ' fund'' AND UPPER(REPLACE(class_code,''-'','''')) ' || CASE WHEN p_partkey % 4 = 0 THEN '= ''A'') OR (fund_name = ''Other' ELSE 'IN (''A'', ''AE'')) OR (fund_name = ''Other' END || ' fund'' AND UPPER(REPLACE(class_code,''-'','''')) = ''CPE'') ORDER BY fee_total ASC LIMIT 50' END AS sql FROM part")
def rebuilt_statements(spark, d):
    parts = read(spark, d, "part")
    short = {r[0]: f"{r[0]} fund" for r in parts.select("p_brand").distinct().collect()} | {"Other": "Other fund"}  # 25 brands
    k = F.col("p_partkey")
    asked = F.concat("p_brand", F.lit(" A"), F.when(k % 4 == 0, "").otherwise(", A-E"), F.lit(" or Other C-PE?"))
    one = F.when(k % 2 == 0, asked).otherwise(F.concat(F.col("p_brand"), F.lit(" A-E?")))
    return parts.select("p_partkey", sql_repair.rebuilt_each(one, short, _CODES).alias("sql"))

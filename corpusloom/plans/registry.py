"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import corpus, retrieval, routing, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(name: str):
    return F.col(name).cast("long").alias(name)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


# ---- scans, projections, corpus build

@query("SELECT doc_id, source, lang, coalesce(substr(text, 1, 200), '') AS section, length(text)::BIGINT AS n, ',' || source || ',' AS owners FROM documents")
def scan_project_chunks(spark, d):
    return read(spark, d, "documents").select("doc_id", "source", "lang", F.coalesce(F.substring("text", 1, 200), F.lit("")).alias("section"), F.length("text").cast("long").alias("n"), F.concat(F.lit(","), "source", F.lit(",")).alias("owners"))


@query("SELECT source, count(*) AS chunks, count(*) FILTER (WHERE contains(text, '|')) AS tables, count(*) FILTER (WHERE length(text) >= 1000)::BIGINT AS pages, CASE WHEN count(*) FILTER (WHERE length(text) >= 1000) = 0 THEN 'EMPTY' WHEN count(*) / count(*) FILTER (WHERE length(text) >= 1000) < 0.4 THEN 'LOW_YIELD' ELSE 'OK' END AS status FROM documents GROUP BY source")
def manifest_rollup_status(spark, d):
    return corpus.manifest(read(spark, d, "documents"))


@query("SELECT page_id, url FROM pages WHERE NOT (contains(url, '1') OR contains(url, 'zz'))")
def path_exclude_filter(spark, d):
    return read(spark, d, "pages").filter(~(F.col("url").contains("1") | F.col("url").contains("zz"))).select("page_id", "url")


@query("""WITH p AS (SELECT url AS path, page_id % 20 AS key FROM pages) SELECT key, count(DISTINCT path) AS paths, arg_max(path, {'d': length(path) - length(replace(path, '/', '')), 'n': -length(path), 'p': path}) AS path FROM p GROUP BY key HAVING count(DISTINCT path) > 1""")
def canonical_copy(spark, d):
    return corpus.canonical(read(spark, d, "pages").select(F.col("url").alias("path"), (F.col("page_id") % 20).alias("k")), F.col("k"))


@query("SELECT md5(text) AS hash, min(doc_id) AS first_id, count(DISTINCT doc_id) AS n_docs, array_to_string(list_sort(list(DISTINCT source)), ',') AS owners, CASE WHEN count(DISTINCT doc_id) >= 2 THEN 'shared' ELSE 'single' END AS scope FROM documents GROUP BY 1")
def exact_dedup_collapse(spark, d):
    return corpus.collapse(read(spark, d, "documents")).withColumn("owners", F.array_join("owners", ","))


@query("SELECT count(*) AS total, count(DISTINCT md5(text)) AS kept, round(100.0 * count(DISTINCT md5(text)) / count(*), 3) AS kept_pct, sum(length(text))::BIGINT AS chars, sum(length(text) // 2)::BIGINT AS token_estimate FROM documents")
def dedup_report(spark, d):
    n = F.length("text")
    return read(spark, d, "documents").agg(F.count("*").alias("total"), F.count_distinct(F.md5("text")).alias("kept"), F.round(F.count_distinct(F.md5("text")) * 100.0 / F.count("*"), 3).alias("kept_pct"), F.sum(n).alias("chars"), F.sum(F.floor(n / 2)).alias("token_estimate"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) AS place FROM documents")
def final_corpus_order(spark, d):
    order = Window.partitionBy("source").orderBy(F.when(F.col("lang") == "en", 0).otherwise(1), "doc_id")
    return read(spark, d, "documents").select("doc_id", "source", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def embedding_todo_anti(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def embedding_ready_semi(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT len(embedding)::BIGINT AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dim_guard(spark, d):
    return read(spark, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+'))::BIGINT AS n FROM documents")
def tokenize_count(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n"))


@query("SELECT p_partkey, '종류,c,p' || p_size || ',판매보수는,판매,매보,보수,수는,' || replace(p_name, ' ', ',') AS words FROM part")
def hangul_pairs(spark, d):
    text = F.concat(F.lit("종류C-P"), F.col("p_size").cast("string"), F.lit(" 판매보수는 "), F.upper("p_name"))
    return read(spark, d, "part").select("p_partkey", F.array_join(tx.tokens(text), ",").alias("words"))


TOKENS_SQL = "t AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t), p AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL), r AS (SELECT term, count(*) AS df, ln(any_value(s.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term), i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)"
BM25_SQL = TOKENS_SQL + ", q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+')) AS term FROM benchmark) GROUP BY ALL), sc AS (SELECT qid, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / s.avgdl))), 6) AS score FROM q JOIN i USING (term) JOIN p USING (term), s GROUP BY ALL), bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 60)"


@query(f"WITH {TOKENS_SQL} SELECT n, round(avgdl, 6) AS avgdl FROM s")
def corpus_stats(spark, d):
    return retrieval.statistics(_chunks(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {TOKENS_SQL} SELECT term, df, round(idf, 6) AS idf FROM i")
def idf_table(spark, d):
    c = _chunks(spark, d)
    return retrieval.idf(retrieval.postings(c), retrieval.statistics(c)).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark, d):
    return retrieval.bm25(_questions(spark, d), _chunks(spark, d))


@query(f"WITH {BM25_SQL} SELECT qid, chunk_id, score, rank FROM bm")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("qid", "chunk_id", "score", long("rank"))


VECTOR_SQL = "v AS (SELECT q.vec_id AS qid, b.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0), vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM v QUALIFY rank <= 60)"


@query(f"WITH {VECTOR_SQL} SELECT qid, vec_id, rank FROM vr")
def vector_topk(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))  # the stated query set
    return retrieval.vector_top(q, e).select("qid", "vec_id", long("rank"))


OVERLAP_SQL = "ov AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY both_terms DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, count(*) AS both_terms FROM q JOIN p USING (term) GROUP BY ALL) QUALIFY rank <= 60)"


def _overlap(spark, d):
    return retrieval.shared_words(_questions(spark, d), _chunks(spark, d)).withColumnRenamed("score", "both_terms")


FUSED_SQL = "fu AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS vec_rank, b.rank AS key_rank, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS s FROM ov a FULL JOIN bm b ON a.qid = b.qid AND a.chunk_id = b.chunk_id), fr AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_rank ASC NULLS LAST, key_rank ASC NULLS LAST) AS rank FROM fu)"


@query(f"WITH {BM25_SQL}, {OVERLAP_SQL}, {FUSED_SQL} SELECT qid, chunk_id, rank FROM fr")
def rrf_fusion(spark, d):
    return retrieval.fuse(_overlap(spark, d), _bm25(spark, d)).select("qid", "chunk_id", long("rank"))


@query(f"WITH {BM25_SQL} SELECT qid, chunk_id, rank FROM bm JOIN documents ON doc_id = chunk_id WHERE lang = 'en'")
def post_filter_rank(spark, d):
    en = read(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return _bm25(spark, d).join(en, "chunk_id", "left_semi").select("qid", "chunk_id", long("rank"))


@query(f"WITH {BM25_SQL} SELECT qid, chunk_id, source, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, chunk_id) AS rank FROM sc JOIN documents ON doc_id = chunk_id QUALIFY rank <= 2")
def pre_filter_rank(spark, d):
    chunks = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    return retrieval.bm25(_questions(spark, d), chunks, 2, "source").select("qid", "chunk_id", "source", long("rank"))


@query(f"WITH {BM25_SQL}, {OVERLAP_SQL}, u AS (SELECT qid, chunk_id, rank * 2 AS place FROM ov WHERE rank <= 2 UNION ALL SELECT qid, chunk_id, rank * 2 + 1 FROM bm WHERE rank <= 10 UNION ALL SELECT qid, chunk_id, rank + 1000000 FROM bm), o AS (SELECT qid, chunk_id, min(place) AS place FROM u GROUP BY ALL) SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM o QUALIFY rank <= 12")
def quota_interleave_backfill(spark, d):
    b = _bm25(spark, d)
    return retrieval.interleave(_overlap(spark, d), b, b, (2, 10)).select("qid", "chunk_id", long("rank"))


@query(f"WITH {BM25_SQL}, f AS (SELECT qid, chunk_id, rank FROM bm JOIN documents ON doc_id = chunk_id WHERE lang = 'es'), n AS (SELECT qid FROM f GROUP BY qid HAVING count(*) >= 3) SELECT qid, chunk_id, rank, 'filtered' AS kind FROM f WHERE qid IN (SELECT qid FROM n) UNION ALL SELECT qid, chunk_id, rank, 'all' FROM bm WHERE qid NOT IN (SELECT qid FROM n)")
def narrow_result_fallback(spark, d):
    b = _bm25(spark, d).select("qid", "chunk_id", long("rank"))
    es = read(spark, d, "documents").filter("lang = 'es'").select(F.col("doc_id").alias("chunk_id"))
    held = b.join(es, "chunk_id", "left_semi")
    enough = held.groupBy("qid").agg(F.count("*").alias("n")).filter("n >= 3")
    return held.join(enough, "qid", "left_semi").withColumn("kind", F.lit("filtered")).unionByName(b.join(enough, "qid", "left_anti").withColumn("kind", F.lit("all")))


@query(f"WITH {BM25_SQL}, h AS (SELECT qid, chunk_id, rank FROM bm WHERE rank <= 12), n AS (SELECT qid, c AS chunk_id, min(rank) AS from_rank FROM (SELECT qid, rank, unnest([chunk_id - 1, chunk_id + 1]) AS c FROM h) WHERE c IN (SELECT doc_id FROM documents WHERE length(text) <= 300) GROUP BY ALL) SELECT n.qid, n.chunk_id, from_rank, row_number() OVER (PARTITION BY n.qid ORDER BY from_rank, n.chunk_id) AS rank FROM n ANTI JOIN h ON n.qid = h.qid AND n.chunk_id = h.chunk_id QUALIFY rank <= 3")
def short_neighbours(spark, d):
    return retrieval.neighbours(_bm25(spark, d).filter("rank <= 12"), _chunks(spark, d)).select("qid", "chunk_id", long("from_rank"), long("rank"))


@query(f"WITH {BM25_SQL}, x AS (SELECT qid, chunk_id, rank, sum(length(text)) OVER (PARTITION BY qid ORDER BY rank) AS used FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 12) SELECT qid, chunk_id, rank, used::BIGINT AS used FROM x WHERE used <= 9000")
def context_budget(spark, d):
    return retrieval.within_budget(_bm25(spark, d).filter("rank <= 12").join(_chunks(spark, d), "chunk_id")).select("qid", "chunk_id", long("rank"), "used")


@query(f"WITH {BM25_SQL} SELECT qid, string_agg(substr(text, 1, 300), chr(10) ORDER BY rank) AS answer FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY qid")
def fallback_answer(spark, d):
    best = _bm25(spark, d).filter("rank <= 3").join(_chunks(spark, d), "chunk_id")
    return best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.substring("text", 1, 300).alias("t")))).alias("x")).select("qid", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("answer"))


@query(f"WITH {BM25_SQL}, g AS (SELECT item_id AS qid, doc_id AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT g.qid, min(bm.rank) AS first_hit FROM g LEFT JOIN bm ON bm.qid = g.qid AND bm.chunk_id = g.gold AND bm.rank <= 12 GROUP BY g.qid) SELECT count(*) AS questions, count(first_hit) AS hits, round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 6) AS mrr FROM f")
def eval_retrieval_metrics(spark, d):
    gold = retrieval.holders(_chunks(spark, d), _questions(spark, d)).withColumnRenamed("chunk_id", "gold")
    hits = _bm25(spark, d).filter("rank <= 12").select("qid", F.col("chunk_id").alias("gold"), "rank")
    first = gold.join(hits, ["qid", "gold"], "left").groupBy("qid").agg(F.min("rank").alias("first_hit"))
    return first.agg(F.count("*").alias("questions"), F.count("first_hit").alias("hits"), F.round(F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"))


# ---- sections, headers, chunks

@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 4), l AS (SELECT source, string_split(text, chr(10)) AS a FROM documents), e AS (SELECT source, unnest(list_distinct(list_concat(a[1:2], a[greatest(len(a) - 1, 1):len(a)]))) AS line FROM l), s AS (SELECT source, trim(line, ' ') AS line, count(*) AS seen FROM e WHERE length(trim(line, ' ')) BETWEEN 4 AND 60 GROUP BY ALL) SELECT source, line, seen, n FROM s JOIN n USING (source) WHERE seen >= 0.02 * n")
def running_headers(spark, d):
    return corpus.running_lines(read(spark, d, "documents"), 0.02)


@query("WITH x AS (SELECT conv_id AS doc_id, turn AS pos, CASE WHEN length(text) < 60 THEN text END AS heading FROM conversations) SELECT doc_id, pos, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), heading) AS section FROM x")
def section_assign(spark, d):
    x = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.length("text") < 60, F.col("text")).alias("heading"))
    return corpus.sections(x, F.col("heading")).select("doc_id", "pos", "section")


@query()
def chunk_pack(spark, d):
    return corpus.packed(read(spark, d, "documents").select("doc_id", "text"))


@query("SELECT page_id, length(regexp_extract(html, '<h1[^>]*>([^<]*)', 1))::BIGINT AS heading, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS paragraphs FROM pages")
def html_blocks(spark, d):
    return read(spark, d, "pages").select("page_id", F.length(F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1)).cast("long").alias("heading"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"))


# ---- safety and routing

# written from the rule: a resident number, a card number, or the word for an account number with a dashed number; white
# space and digits are Unicode's, which DuckDB's classes are not
_GAP, _DIGIT = r"[\t-\r\x{85}\p{Z}]", r"\p{Nd}"
PERSONAL_SQL = f"(regexp_matches(text, '{_DIGIT}{{6}}(-|{_GAP})?[1-4]{_DIGIT}{{6}}') OR regexp_matches(text, '({_DIGIT}{{4}}(-|{_GAP})?){{3}}{_DIGIT}{{4}}') OR (regexp_matches(text, '계좌{_GAP}?번호') AND regexp_matches(text, '{_DIGIT}{_DIGIT}-{_DIGIT}{_DIGIT}')))"
MARKERS_SQL = "SELECT unnest(['이전 지시', '이전 지침', '시스템 프롬프트', 'system prompt', '지시사항을 무시', '규칙을 무시', '규칙을 잊', 'ignore previous', 'ignore all previous', '지금부터 너는', '역할을 무시', 'jailbreak', '너는 이제부터', '프롬프트를 출력', '지시문을 출력', '내부 지침']) AS marker"


@query(f"SELECT doc_id, {PERSONAL_SQL} AS personal FROM documents")
def pii_scan(spark, d):
    return read(spark, d, "documents").select("doc_id", routing.personal(F.col("text")).alias("personal"))


@query(f"WITH m AS ({MARKERS_SQL}) SELECT conv_id, turn, CASE WHEN {PERSONAL_SQL} THEN 'personal' WHEN EXISTS (SELECT 1 FROM m WHERE contains(lower(text), marker)) THEN 'injection' END AS blocked FROM conversations")
def injection_scan(spark, d):
    return routing.gate(read(spark, d, "conversations")).select("conv_id", "turn", "blocked")


FIRST, SECOND = ["the", "and", "of"], ["ing", "ed ", "for"]
_COUNT = lambda ws: " + ".join(f"contains(lower(text), '{w}')::BIGINT" for w in ws)


@query(f"WITH c AS (SELECT conv_id, turn, {_COUNT(FIRST)} AS a, {_COUNT(SECOND)} AS b FROM conversations WHERE role = 'user') SELECT conv_id, turn, a AS n_first, b AS n_second, CASE WHEN a >= 2 AND b = 0 THEN 'first' WHEN b >= 2 AND a = 0 THEN 'second' END AS route, (a >= 1 AND b >= 1) OR (a = 1 AND b = 0) AS hybrid FROM c")
def route_keywords(spark, d):
    return routing.routed(read(spark, d, "conversations").filter("role = 'user'"), FIRST, SECOND).select("conv_id", "turn", long("n_first"), long("n_second"), "route", "hybrid")


# ---- the fee-like table

@query("SELECT p_partkey, p_brand, p_retailprice FROM part WHERE upper(replace(p_brand, '#', '')) = 'BRAND11' AND p_type ILIKE '%s%' AND p_retailprice BETWEEN 900 AND 950")
def fee_filter_sort(spark, d):
    return read(spark, d, "part").filter((F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))) == "BRAND11") & F.col("p_type").ilike("%s%") & F.col("p_retailprice").between(900, 950)).select("p_partkey", "p_brand", "p_retailprice")


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean, min(p_retailprice) AS least, max(p_retailprice) AS most, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def fee_group_avg(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1")
def fee_min_per_group(spark, d):
    return tables.first_of(read(spark, d, "part"), ["p_brand"], [F.asc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT p_partkey, CASE WHEN p_size <> 5 THEN p_size END AS size, row_number() OVER (ORDER BY CASE WHEN p_size <> 5 THEN p_size END DESC NULLS LAST, p_partkey) AS place FROM part QUALIFY place <= 50")
def superlative_resort_nulls_last(spark, d):
    s = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") != 5, F.col("p_size")).alias("size")).orderBy(F.desc_nulls_last("size"), "p_partkey").limit(50)  # a top 50
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("size"), "p_partkey")).cast("long"))


@query("SELECT o_orderkey, upper(translate(o_orderpriority, '- ', '')) AS class FROM orders")
def class_normalise(spark, d):
    return read(spark, d, "orders").select("o_orderkey", tx.class_form(F.col("o_orderpriority")).alias("class"))


ROWS_SQL = "r AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS code, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS kind, l_linestatus AS channel, l_discount AS fee FROM lineitem)"


def _fee_rows(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("code"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("kind"), F.col("l_linestatus").alias("channel"), F.col("l_discount").alias("fee"))


@query(f"WITH {ROWS_SQL} SELECT l_orderkey, code, kind, channel, fee FROM r WHERE code IS NOT NULL OR NOT EXISTS (SELECT 1 FROM r s WHERE s.code IS NOT NULL AND s.l_orderkey = r.l_orderkey AND s.kind IS NOT DISTINCT FROM r.kind AND s.channel IS NOT DISTINCT FROM r.channel)")
def codeless_absorb(spark, d):
    return tables.absorbed(_fee_rows(spark, d), "code", ["l_orderkey", "kind", "channel"])


@query(f"WITH {ROWS_SQL} SELECT kind, channel, code, count(DISTINCT fee) AS values, min(fee) AS least, max(fee) AS most FROM r WHERE kind IS NOT NULL AND code IS NOT NULL AND channel IS NOT NULL GROUP BY ALL HAVING count(DISTINCT fee) > 1")
def fee_conflicts(spark, d):
    return tables.conflicts(_fee_rows(spark, d), ["kind", "channel", "code"], "fee")


@query(f"WITH {ROWS_SQL} SELECT kind, code, fee, min(l_orderkey) AS l_orderkey FROM r GROUP BY kind, code, fee")
def fee_dedup(spark, d):
    return tables.first_of(_fee_rows(spark, d), ["kind", "code", "fee"], [F.asc("l_orderkey")]).select("kind", "code", "fee", "l_orderkey")


@query("SELECT o_custkey, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def singleton_attribute(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s")).filter(F.size("s") == 1).select("o_custkey", F.col("s")[0].alias("status"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def census(spark, d):
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


_NAMES = "n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT p_partkey AS qid, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '')) WHEN 2 THEN p_name || ' [x]' ELSE 'none such' END AS want FROM part)"


@query(f"WITH {_NAMES}, m AS (SELECT qid, 0 AS rung, count(*) AS matches FROM a JOIN n ON want = name GROUP BY qid UNION ALL SELECT qid, 1, count(*) FROM a JOIN n ON lower(regexp_replace(want, '\\s', '', 'g')) = lower(regexp_replace(name, '\\s', '', 'g')) GROUP BY qid UNION ALL SELECT qid, 2, count(*) FROM a JOIN n ON lower(regexp_replace(regexp_replace(want, '\\[[^\\]]*\\]', '', 'g'), '\\s', '', 'g')) = lower(regexp_replace(name, '\\s', '', 'g')) GROUP BY qid HAVING count(*) = 1), b AS (SELECT qid, min(rung) AS rung, arg_min(matches, rung) AS matches FROM m GROUP BY qid) SELECT a.qid, coalesce(rung, 9) AS rung, coalesce(matches, 0) AS matches FROM a LEFT JOIN b USING (qid)")
def zero_row_ladder(spark, d):
    p = read(spark, d, "part")
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    want = F.when(k == 0, name).when(k == 1, F.upper(F.replace(name, F.lit(" "), F.lit("")))).when(k == 2, F.concat(name, F.lit(" [x]"))).otherwise("none such")
    return tables.relaxed(p.select(F.col("p_partkey").alias("qid"), want.alias("want")), p.select(name.alias("name")))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size > 3 GROUP BY p_brand ORDER BY p_brand LIMIT 50")
def guarded_sql(spark, d):
    read(spark, d, "part").createOrReplaceTempView("fee_rows")
    return spark.sql(tables.checked("SELECT p_brand, count(*) AS n FROM fee_rows WHERE p_size > 3 GROUP BY p_brand ORDER BY p_brand; -- as written"))


# ---- calculators

BRACKETS = [(-1e9, 0.0, "debt"), (0.0, 3000.0, "low"), (3000.0, 7000.0, "middle"), (7000.0, 1e9, "high")]


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 7000 THEN 'middle' ELSE 'high' END AS label FROM customer")
def bracket_range_join(spark, d):
    return tables.bracket(read(spark, d, "customer"), "c_acctbal", spark.createDataFrame(BRACKETS, "lo double, hi double, label string")).select("c_custkey", "label")


@query("SELECT c_custkey, CASE WHEN c_custkey % 13 BETWEEN 1 AND 10 THEN round(c_acctbal / (11 - c_custkey % 13) * 1.2::DOUBLE, 6) END AS cap FROM customer")
def withdrawal_limit(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.round(tables.withdrawal_limit(F.col("c_acctbal"), F.col("c_custkey") % 13), 6).alias("cap"))


@query("SELECT c_custkey, round(least(least(abs(c_acctbal), 600) + c_custkey % 500, 900) * 0.132::DOUBLE, 6) AS credit FROM customer")
def tax_credit(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.round(tables.tax_credit(F.abs("c_acctbal"), F.col("c_custkey") % 500, F.lit(0.132), 600.0, 900.0), 6).alias("credit"))


# ---- logs and evaluation

@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS spread, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def run_spread(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("spread"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("WITH x AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events) SELECT user_id, min(event_id) AS first_event, count(*) AS errors FROM x WHERE bad GROUP BY user_id, g HAVING count(*) >= 2")
def breaker_islands(spark, d):
    e = read(spark, d, "events").withColumn("bad", F.col("event_type") == "error")
    g = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("ts", "event_id"))
    return e.withColumn("g", g).filter("bad").groupBy("user_id", "g").agg(F.min("event_id").alias("first_event"), F.count("*").alias("errors")).filter("errors >= 2").drop("g")


@query("SELECT sha1(trim(text)) AS key, min(conv_id) AS conv_id, count(*) AS asked FROM conversations GROUP BY 1")
def cache_dedupe(spark, d):
    return read(spark, d, "conversations").groupBy(F.sha1(F.trim("text")).alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("asked"))


@query("SELECT 'only_docs' AS side, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'only_labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def id_set_difference(spark, d):
    a, b = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("only_docs").alias("side"), "n").unionByName(b.join(a, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("only_labels").alias("side"), "n"))


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id + 1000000, 'de' FROM documents WHERE lang = 'de'")
def partition_replace(spark, d):
    x = read(spark, d, "documents").select("doc_id", "lang")
    return x.filter("lang <> 'de'").unionByName(x.filter("lang = 'de'").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "lang"))


@query("SELECT count(*) AS n, count(DISTINCT item_id) AS ids, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS missing FROM benchmark")
def evalset_integrity(spark, d):
    return read(spark, d, "benchmark").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("ids"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("missing"))


from . import answers, building, fees, logs, parsing, reports  # noqa: E402,F401  they register further queries

"""Queries on retrieved evidence, answers and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers as an
from ..functions import documents
from ..functions import text as tx
from ..operators import reports, retrieval
from .registry import BM25_SQL, FUSED_SQL, OVERLAP_SQL, _bm25, _chunks, _overlap, _questions, long, query, read

HITS_SQL = f"{BM25_SQL}, h AS (SELECT qid, chunk_id, rank FROM bm WHERE rank <= 12)"
GOLD_SQL = "g AS (SELECT item_id AS qid, doc_id AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {HITS_SQL}, m AS (SELECT a.doc_id AS bad, b.doc_id AS good FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE length(a.text) <= 300) SELECT h.qid, h.rank, coalesce(x.good, h.chunk_id) AS chunk_id FROM h LEFT JOIN (SELECT h.qid, bad, good FROM h JOIN m ON bad = chunk_id ANTI JOIN h p ON p.qid = h.qid AND p.chunk_id = good) x ON x.qid = h.qid AND x.bad = h.chunk_id")
def damaged_swap(spark, d):
    chunks = _chunks(spark, d)
    mapped = chunks.filter(F.length("text") <= 300).select(F.col("chunk_id").alias("bad"), (F.col("chunk_id") + 1).alias("good")).join(chunks.select(F.col("chunk_id").alias("good")), "good", "left_semi")
    return retrieval.swapped(_bm25(spark, d).filter("rank <= 12"), mapped).select("qid", long("rank"), "chunk_id")


@query(f"WITH {BM25_SQL}, x AS (SELECT bm.qid, bm.chunk_id, bm.rank, row_number() OVER (PARTITION BY bm.qid ORDER BY length(text), bm.chunk_id) AS pos FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 15) SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN pos <= 5 THEN pos ELSE 10000 END, rank) AS rank FROM x")
def rerank_merge(spark, d):
    best = _bm25(spark, d).filter("rank <= 15").join(_chunks(spark, d), "chunk_id")
    # stands for an external scorer, which lists five of them
    listed = retrieval.top(best.select("qid", "chunk_id", F.length("text").alias("n")), "qid", [F.asc("n"), F.asc("chunk_id")], 5).select("qid", "chunk_id", F.col("rank").alias("pos"))
    return retrieval.reranked(best, listed).select("qid", "chunk_id", long("rank"))


@query(f"WITH {BM25_SQL}, n AS (SELECT qid, chunk_id, count(*) AS s FROM q JOIN p USING (term) GROUP BY ALL), e AS (SELECT bm.qid, d.source, bm.rank, n.s FROM bm JOIN documents d ON d.doc_id = bm.chunk_id JOIN n ON n.qid = bm.qid AND n.chunk_id = bm.chunk_id WHERE bm.rank <= 12), f AS (SELECT *, max(s) OVER (PARTITION BY qid) AS top, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS place FROM e), k AS (SELECT *, s >= 3 AND s * 5 >= top * 2 AS strong FROM f), l AS (SELECT qid, source, min(place) AS place FROM (SELECT *, bool_or(strong) OVER (PARTITION BY qid) AS found FROM k) WHERE strong OR (NOT found AND place <= 2) GROUP BY ALL) SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY place) AS place FROM l QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) <= 4")
def source_selection(spark, d):
    q = _questions(spark, d).select("qid", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    shared = q.join(retrieval.postings(_chunks(spark, d)), "term").groupBy("qid", "chunk_id").agg(F.count("*").alias("s"))
    src = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    ev = _bm25(spark, d).filter("rank <= 12").select("qid", "chunk_id", "rank").join(shared, ["qid", "chunk_id"]).join(src, "chunk_id")
    return retrieval.named_sources(ev).select("qid", "source", long("place"))


@query(f"WITH {HITS_SQL}, a AS (SELECT qid, string_agg(substr(text, 1, 300), chr(10) ORDER BY rank) AS answer, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS sources FROM h JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY qid) SELECT item_id::VARCHAR AS question_id, text AS question, coalesce(answer, '') AS answer, coalesce(sources, '') AS sources, CASE WHEN qid IS NULL THEN '[1] no evidence' ELSE '[1] keyword search' || chr(10) || '[2] extract' END AS trace FROM benchmark LEFT JOIN a ON qid = item_id")
def response_five_fields(spark, d):
    return retrieval.responses(_questions(spark, d), _bm25(spark, d).filter("rank <= 3").join(_chunks(spark, d), "chunk_id"))


@query(f"WITH {BM25_SQL}, {OVERLAP_SQL}, {FUSED_SQL}, {GOLD_SQL}, m AS (SELECT 'keyword' AS mode, qid, chunk_id, rank FROM bm UNION ALL SELECT 'overlap', qid, chunk_id, rank FROM ov UNION ALL SELECT 'fused', qid, chunk_id, rank FROM fr) SELECT mode, k::BIGINT AS k, count(DISTINCT m.qid) FILTER (rank <= k) AS hits FROM m JOIN g ON g.qid = m.qid AND gold = chunk_id, (SELECT unnest([5, 10, 20]) AS k) GROUP BY ALL")
def mode_k_grid(spark, d):
    key, over = _bm25(spark, d), _overlap(spark, d)
    gold = retrieval.holders(_chunks(spark, d), _questions(spark, d))
    side = lambda df, name: df.select(F.lit(name).alias("mode"), "qid", "chunk_id", "rank")
    ranked = side(key, "keyword").unionByName(side(over, "overlap")).unionByName(side(retrieval.fuse(over, key), "fused"))
    counts = ranked.join(gold, ["qid", "chunk_id"]).groupBy("mode").agg(*(F.count_distinct(F.when(F.col("rank") <= k, F.col("qid"))).alias(str(k)) for k in (5, 10, 20)))
    return counts.unpivot(["mode"], ["5", "10", "20"], "k", "hits").select("mode", F.col("k").cast("long").alias("k"), "hits")


@query(f"WITH {HITS_SQL}, n AS (SELECT qid, regexp_replace(lower(string_agg(text, ' ' ORDER BY rank)), '[ ,\\n\\t]', '', 'g') AS blob FROM h JOIN documents ON doc_id = chunk_id GROUP BY qid) SELECT count(*) AS questions, count(*) FILTER (WHERE contains(blob, regexp_replace(lower(text), '[ ,\\n\\t]', '', 'g'))) AS with_evidence FROM benchmark LEFT JOIN n ON qid = item_id")
def answer_metrics(spark, d):
    flat = lambda c: F.regexp_replace(F.lower(c), "[ ,\n\t]", "")
    found = _bm25(spark, d).filter("rank <= 12").join(_chunks(spark, d), "chunk_id").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("x")).select("qid", flat(F.array_join("x.text", " ")).alias("blob"))
    return _questions(spark, d).join(found, "qid", "left").agg(F.count("*").alias("questions"), F.count_if(F.col("blob").contains(flat(F.col("text")))).alias("with_evidence"))


@query("""SELECT sha256('[' || string_agg('{"question":' || to_json(text)::VARCHAR || ',"question_id":"' || item_id || '"}', ',' ORDER BY item_id) || ']') AS fingerprint FROM benchmark""")
def questionset_fingerprint(spark, d):
    return reports.fingerprint(read(spark, d, "benchmark").select(F.col("item_id").alias("place"), F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question")))


# a vector's component i (from 0): the first eight hex digits of the hash of (hash of the text, i), as a fraction, to unit length
DUMMY_SQL = "SELECT doc_id, list_transform(range(0, 16), lambda i: ('0x' || substr(sha256(sha256(text) || i::VARCHAR), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1) AS r FROM documents"


@query(f"WITH v AS ({DUMMY_SQL}) SELECT doc_id, list_aggregate(list_transform(r, lambda x: round(x / sqrt(list_inner_product(r, r)) * 100000)::BIGINT), 'string_agg', ',') AS parts FROM v")
def dummy_embedding_parts(spark, d):
    v = read(spark, d, "documents").select("doc_id", retrieval.dummy_embedding(F.col("text"), 16).alias("v"))
    return v.select("doc_id", F.array_join(F.transform("v", lambda x: F.round(x * 100000).cast("long").cast("string")), ",").alias("parts"))


@query("SELECT doc_id, doc_id % 7 <> 3 OR text = '' AS same FROM documents WHERE doc_id % 100 = 0")
def cache_cosine_check(spark, d):
    # every hundredth text is embedded anew; the cache has vectors of other texts for ids that leave 3 by 7
    docs = read(spark, d, "documents").filter("doc_id % 100 = 0").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cached = docs.select("doc_id", retrieval.dummy_embedding(F.when((F.col("doc_id") % 7 == 3) & (F.col("text") != ""), F.concat("text", F.lit("?"))).otherwise(F.col("text"))).alias("held"))
    return retrieval.cache_agrees(docs.select("doc_id", retrieval.dummy_embedding(F.col("text")).alias("made")), cached).select("doc_id", "same")


# lines made of every turn, so that each pattern, each exception and plain text occur
_LINES_SQL = "SELECT conv_id, turn, CASE (conv_id + turn) % 10 WHEN 0 THEN '제 ' || turn || ' 장 ' || role WHEN 1 THEN '<' || role || '>' WHEN 2 THEN turn || '. ' || role WHEN 3 THEN '가. ' || role WHEN 4 THEN ' ( ' || turn || ' )' || role WHEN 5 THEN '③ ' || role WHEN 6 THEN turn || '. 24, 12' WHEN 7 THEN '제 1 조 합니다' WHEN 8 THEN turn || '. ' || role || ' ' || role ELSE text END AS line FROM conversations"


@query(f"WITH l AS ({_LINES_SQL}), b AS (SELECT conv_id, turn, regexp_replace(line, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS x FROM l) SELECT conv_id, turn FROM b WHERE length(x) BETWEEN 2 AND 70 AND NOT (ends_with(x, '다.') OR ends_with(x, '니다')) AND NOT regexp_full_match(x, '[\\'\"]?[0-9.\\s~,\\-\\'\"]+') AND (regexp_matches(x, '^제\\s*[0-9]+\\s*[부장절조]\\s*[.．]?\\s*\\S') OR regexp_full_match(x, '[<＜〈【\\[]\\s*[^>＞〉】\\]]{{2,40}}\\s*[>＞〉】\\]]\\s*') OR regexp_full_match(x, '([0-9]{{1,2}}\\s*[.．]|[가-힣]\\s*[.．]|\\(\\s*[0-9]{{1,2}}\\s*\\)|[①-⑳])\\s*\\S{{2,60}}'))".replace("\\'", "''"))
def heading_lines(spark, d):
    c, k = read(spark, d, "conversations"), (F.col("conv_id") + F.col("turn")) % 10
    turn = F.col("turn").cast("string")
    made = (F.concat(F.lit("제 "), turn, F.lit(" 장 "), "role"), F.concat(F.lit("<"), "role", F.lit(">")), F.concat(turn, F.lit(". "), "role"), F.concat(F.lit("가. "), "role"), F.concat(F.lit(" ( "), turn, F.lit(" )"), "role"), F.concat(F.lit("③ "), "role"), F.concat(turn, F.lit(". 24, 12")), F.lit("제 1 조 합니다"), F.concat(turn, F.lit(". "), "role", F.lit(" "), "role"))
    line = F.col("text")
    for i, x in reversed(list(enumerate(made))):
        line = F.when(k == i, x).otherwise(line)
    return c.filter(documents.is_heading(line)).select("conv_id", "turn")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'KR5' || lpad(page_id::VARCHAR, 9, '0') WHEN page_id % 3 = 1 THEN 'KR7' || lpad(page_id::VARCHAR, 9, '0') END AS code, CASE WHEN page_id % 2 = 0 THEN (2000 + page_id % 25)::VARCHAR || '-' || lpad((1 + page_id % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') END AS base_date, CASE WHEN page_id % 4 = 0 THEN '투자설명서' WHEN page_id % 4 = 1 THEN '약관' ELSE '기타' END AS kind, 'Fund ' || page_id AS name FROM pages")
def document_identity(spark, d):
    i = F.col("page_id")
    path = F.concat(F.when(i % 4 == 0, F.lit("a/투자설명서/")).when(i % 4 == 1, F.lit("b/약관/")).otherwise(F.lit("c/")), F.when(i % 3 == 0, F.concat(F.lit("kr5"), F.lpad(i.cast("string"), 9, "0"))).otherwise(F.lit("x")), F.lit("/file.pdf"))
    head = F.concat(F.lit("1. 집합투자기구 명칭 : Fund  "), i.cast("string"), F.lit("\n"), F.when(i % 3 == 1, F.concat(F.lit("코드 KR7"), F.lpad(i.cast("string"), 9, "0"))).otherwise(F.lit("")), F.when(i % 2 == 0, F.concat(F.lit(" 작성 기준일 : "), (2000 + i % 25).cast("string"), F.lit("년 "), (1 + i % 12).cast("string"), F.lit("월 "), (1 + i % 28).cast("string"), F.lit("일"))).otherwise(F.lit("")))
    p = read(spark, d, "pages").select("page_id", path.alias("path"), head.alias("head"))
    return p.select("page_id", documents.fund_code(F.col("path"), F.col("head")).alias("code"), documents.base_date(F.col("head")).alias("base_date"), documents.doc_kind(F.col("path")).alias("kind"), documents.fund_name(F.col("head")).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'A fee of 0.' || p_size || '% holds.' WHEN 1 THEN 'See (a note) ' || p_name || '.' WHEN 2 THEN p_name || ' (open p. 3' WHEN 3 THEN 'Both, ' || p_name END AS text FROM part")
def citation_strip(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("A fee of 0."), n, F.lit("% (terms (old) p. 12) holds."))).when(k == 1, F.concat(F.lit("See (a note) "), "p_name", F.lit("."))).when(k == 2, F.concat("p_name", F.lit(" (open p. 3"))).when(k == 3, F.concat(F.lit("Both [x (p. "), n, F.lit(")], "), "p_name"))
    return read(spark, d, "part").select("p_partkey", an.strip_citations(text).alias("text"))


# rows of 19 signs with their line ends: 131 fit behind the head
@query("SELECT p_partkey, ceil(p_size * 10 / 131.0)::BIGINT AS pieces, p_size * 10::BIGINT AS rows, 1::BIGINT AS heads FROM part")
def table_split(spark, d):
    lines = F.transform(F.sequence(F.lit(1), F.col("p_size") * 10), lambda i: F.concat(F.lit("row "), F.lpad(i.cast("string"), 5, "0"), F.lit(", of ten|")))
    pieces = read(spark, d, "part").select("p_partkey", F.explode(an.table_pieces(F.concat(F.lit("h|\n-|\n"), F.array_join(lines, "\n")))).alias("p"))
    cut = F.split("p", "\n")
    return pieces.groupBy("p_partkey").agg(F.count("*").alias("pieces"), F.sum(F.size(cut) - 2).alias("rows"), F.count_distinct(F.array_join(F.slice(cut, 1, 2), "\n")).alias("heads"))
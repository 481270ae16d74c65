"""Keyword and vector retrieval for batches of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine, dot, tokens

K1, B, FLOOR = 1.5, 0.75, 0.25
POOL, TOP_K, RRF = 60, 12, 60


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf, dl (tokens of the chunk)."""
    words = chunks.select("chunk_id", tokens(F.col("text")).alias("t"))
    return words.select("chunk_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def statistics(chunks: DataFrame) -> DataFrame:
    """n chunks and their mean tokens, in one row."""
    return chunks.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf; negative values become FLOOR times the mean over all terms."""
    return _idf(posts.select("term"), stats)


def _idf(held: DataFrame, stats: DataFrame) -> DataFrame:
    """The same from one row (term) for each chunk that holds it."""
    n = stats.select("n").scalar()
    raw = held.groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("m")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, mean * FLOOR).otherwise(F.col("raw")).alias("idf"))


#: A question set of at most so many (question, word) pairs goes to every worker; a larger one is joined.
MOST_ASKED = 200_000
#: Cells of a block of scores (questions x chunks) that a worker holds.
CELLS = 1 << 20


def bm25(questions: DataFrame, chunks: DataFrame, pool: int = POOL, group: str | None = None) -> DataFrame:
    """qid, chunk_id, score, rank of the pool's best positive scores; repeated question words count again. With group, a
    column of chunks, the best of each of its values (which comes back too).

    The document frequencies of all words are counted in one aggregation; then each task scores its own chunks against
    all questions, a block at a time, and passes on no more than the pool for each question."""
    words = chunks.select("chunk_id", *([group] if group else []), tokens(F.col("text")).alias("t"))
    asked = questions.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    pairs = asked.limit(MOST_ASKED + 1).collect()
    if len(pairs) > MOST_ASKED:
        return joined_bm25(asked, words, pool, group)
    stats, weights = word_weights(words)
    known = weights.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").collect()  # at most the asked words
    idf_of = {r["term"]: r["idf"] for r in known}
    avg = (stats.first()["avgdl"] or 0.0) if known else 0.0

    def weigh(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + (K1 * (1 - B + B * dl / avg))[:, None])

    return _blocks(words, [(r["qid"], r["term"], r["qtf"] * idf_of[r["term"]]) for r in pairs if r["term"] in idf_of], weigh, questions.schema["qid"].dataType.simpleString(), pool, group)


def shared_words(questions: DataFrame, chunks: DataFrame, pool: int = POOL) -> DataFrame:
    """qid, chunk_id, score (how many distinct words both have), rank of the pool's best."""
    words = chunks.select("chunk_id", tokens(F.col("text")).alias("t"))
    asked = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    pairs = asked.limit(MOST_ASKED + 1).collect()
    if len(pairs) > MOST_ASKED:
        one = words.select("chunk_id", F.explode(F.array_distinct("t")).alias("term"))
        return top(asked.join(one, "term").groupBy("qid", "chunk_id").agg(F.count("*").cast("double").alias("score")), "qid", [F.desc("score"), F.asc("chunk_id")], pool)
    return _blocks(words, [(r["qid"], r["term"], 1.0) for r in pairs], lambda tf, dl: (tf > 0).astype(float), questions.schema["qid"].dataType.simpleString(), pool, None)


def word_weights(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n and avgdl in one row, idf of every word) of words (chunk_id, t)."""
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    return stats, _idf(words.select(F.explode(F.array_distinct("t")).alias("term")), stats)


def _blocks(words: DataFrame, asked: list[tuple], weigh, kind: str, pool: int, group: str | None) -> DataFrame:
    """The pool's best chunks of each question by sums over the question's words of weight * weigh(tf, dl)."""
    qids = sorted({q for q, _, _ in asked})
    terms = sorted({t for _, t, _ in asked})
    of_q, of_t = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(terms)}
    row, col = np.array([of_q[q] for q, _, _ in asked], np.int64), np.array([of_t[t] for _, t, _ in asked], np.int64)
    value = np.array([w for _, _, w in asked], float)
    kinds = f"qid {kind}, chunk_id {words.schema['chunk_id'].dataType.simpleString()}, score double" + (f", {group} {words.schema[group].dataType.simpleString()}" if group else "")

    def keep(held: pa.Table) -> pa.Table:
        """The pool's best of each question (and group)."""
        keys = [("q", "ascending"), *([(group, "ascending")] if group else []), ("score", "descending"), ("chunk_id", "ascending")]
        held = held.sort_by(keys)
        same = held.column("q").to_numpy()
        new = np.concatenate(([True], same[1:] != same[:-1])) if len(same) else np.empty(0, bool)
        if group and len(same):
            code = held.column(group).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        at = np.arange(len(same))
        place = at - np.maximum.accumulate(np.where(new, at, 0)) if len(same) else at
        return held.filter(pa.array(place < pool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((len(qids), len(terms)))
        np.add.at(matrix, (row, col), value)
        vocabulary = pa.array(terms, pa.string())
        step, held = max(1, CELLS // max(1, len(terms), len(qids))), None
        for batch in batches:
            for at in range(0, batch.num_rows if qids else 0, step):
                part = batch.slice(at, step)
                lists = part.column("t")
                dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(float)
                code = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), dl.astype(np.int64))
                tf = np.bincount(doc[code >= 0] * len(terms) + code[code >= 0], minlength=part.num_rows * len(terms)).reshape(part.num_rows, -1).astype(float)
                score = np.round(matrix @ weigh(tf, dl).T, 6)
                q, d = np.nonzero(score > 0)
                cols = {"q": pa.array(q), "chunk_id": part.column("chunk_id").take(pa.array(d)), "score": pa.array(score[q, d])}
                if group:
                    cols[group] = part.column(group).take(pa.array(d))
                new = pa.table(cols)
                held = keep(new if held is None else pa.concat_tables([held, new]))
        if held is not None:
            names = pa.array(qids).take(held.column("q").combine_chunks())
            yield from held.drop_columns(["q"]).add_column(0, "qid", names).combine_chunks().to_batches()

    best = words.mapInArrow(run, kinds)
    order = Window.partitionBy("qid", *([group] if group else [])).orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool)


def joined_bm25(asked: DataFrame, words: DataFrame, pool: int, group: str | None = None) -> DataFrame:
    """bm25() by joins, for question sets of any size."""
    stats, weights = word_weights(words)
    held = [group] if group else []
    posts = words.select("chunk_id", *held, F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("term", "chunk_id", *held).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    tf, avg = F.col("tf"), stats.select("avgdl").scalar()
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avg))
    weights = weights.join(asked.select("term").distinct(), "term", "left_semi")
    scored = asked.join(weights, "term").join(posts, "term").groupBy("qid", "chunk_id", *held).agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")
    order = Window.partitionBy("qid", *held).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool)


def top(scored: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


#: Rows of a stripe of queries and of vectors, as aimed for: a task holds one of either.
QUERY_STRIPE, VECTOR_STRIPE = 4096, 16_384


def vector_top(queries: DataFrame, vectors: DataFrame, k: int = POOL) -> DataFrame:
    """qid, vec_id, score, rank: exact cosine of every query (column qv) against all other vectors of its length, in a
    grid of stripes; a query is repeated for each stripe of vectors and a vector for each stripe of queries. Null, empty
    and zero vectors take no part."""
    n, m = vectors.count(), queries.count()
    stripes, rows = max(1, -(-n // VECTOR_STRIPE)), max(1, -(-m // QUERY_STRIPE))
    deal = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = queries.select(deal("qid", rows).alias("i"), each(stripes).alias("j"), "qid", F.col("qv").cast("array<double>").alias("v"), F.size("qv").alias("dim")).filter("dim > 0")
    right = vectors.select(each(rows).alias("i"), deal("vec_id", stripes).alias("j"), "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim")).filter("dim > 0")
    kinds = queries.schema["qid"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"qid": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            side = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            x, y = side(a), side(b)
            lengths = np.sqrt((y * y).sum(axis=1))
            own, theirs = a.column("qid").to_numpy(), b.column("vec_id").to_numpy()
            for i in range(len(x)):
                size = lengths * np.sqrt(x[i] @ x[i])
                use = np.flatnonzero((theirs != own[i]) & (size > 0))
                score = np.round((y[use] @ x[i]) / size[use], 6)
                best = np.lexsort((theirs[use], -score))[:k]
                out["qid"] += [own[i]] * len(best)
                out["vec_id"] += theirs[use][best].tolist()
                out["score"] += score[best].tolist()
        return pa.table({"qid": pa.array(out["qid"], a.schema.field("qid").type), "vec_id": pa.array(out["vec_id"], b.schema.field("vec_id").type), "score": pa.array(out["score"], pa.float64())})

    tiles = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(tile, f"qid {kinds[0]}, vec_id {kinds[1]}, score double")
    return top(tiles, "qid", [F.desc("score"), F.asc("vec_id")], k)


#: Characters of the passages that go to every worker at most; a larger set is joined.
MOST_PASSAGES = 32 << 20


def holders(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, chunk_id) for every passage (qid, text) that stands in a chunk as it is: one walk of an Aho-Corasick
    automaton over each chunk. Empty and null passages are in none."""
    import ahocorasick

    usable = passages.filter("text is not null and text <> ''")
    if (usable.agg(F.sum(F.length("text"))).first()[0] or 0) > MOST_PASSAGES:
        return chunks.join(usable.withColumnRenamed("text", "passage"), F.contains("text", "passage")).select("qid", "chunk_id")
    named: dict[str, list] = {}
    for r in usable.select("qid", "text").collect():
        named.setdefault(r["text"], []).append(r["qid"])
    kinds = passages.schema["qid"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = ahocorasick.Automaton()
        for text, ids in named.items():
            walk.add_word(text, ids)
        walk.make_automaton()
        for batch in batches:
            found = [(q, c) for c, text in zip(batch.column("chunk_id"), batch.column("text").to_pylist()) if text and named for q in sorted({q for _, ids in walk.iter(text) for q in ids})]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa_kind), pa.array([c for _, c in found], batch.schema.field("chunk_id").type)], ["qid", "chunk_id"])

    pa_kind = {"string": pa.string(), "int": pa.int32()}.get(kinds[0], pa.int64())
    return chunks.select("chunk_id", "text").mapInArrow(run, f"qid {kinds[0]}, chunk_id {kinds[1]}")


def fuse(vec: DataFrame, key: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (qid, chunk_id, rank); ties in the order of the first list."""
    both = vec.select("qid", "chunk_id", F.col("rank").alias("vec_rank")).join(key.select("qid", "chunk_id", F.col("rank").alias("key_rank")), ["qid", "chunk_id"], "full")
    score = F.coalesce(1 / (RRF + F.col("vec_rank")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("key_rank")), F.lit(0.0))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("key_rank"))
    return both.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order))


def interleave(first: DataFrame, second: DataFrame, rest: DataFrame, slots: tuple[int, int], k: int = TOP_K) -> DataFrame:
    """Takes turns between two ranked lists up to their slots, keeps first occurrences, fills up from a third."""
    side = lambda df, i, n: df.filter(F.col("rank") <= n).select("qid", "chunk_id", (F.col("rank") * 2 + i).alias("place"))
    union = side(first, 0, slots[0]).unionByName(side(second, 1, slots[1])).unionByName(rest.select("qid", "chunk_id", (F.col("rank") + 1_000_000).alias("place")))
    once = union.groupBy("qid", "chunk_id").agg(F.min("place").alias("place"))
    return top(once, "qid", [F.asc("place")], k).drop("place")


def neighbours(hits: DataFrame, chunks: DataFrame, longest: int = 300, most: int = 3) -> DataFrame:
    """Short chunks next to hits (qid, chunk_id, rank) in number order that are no hits themselves; at most `most`."""
    near = hits.select("qid", "rank", F.explode(F.array(F.col("chunk_id") - 1, F.col("chunk_id") + 1)).alias("chunk_id"))
    short = chunks.filter(F.length("text") <= longest).select("chunk_id")
    new = near.join(short, "chunk_id").join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").groupBy("qid", "chunk_id").agg(F.min("rank").alias("from_rank"))
    return top(new, "qid", [F.asc("from_rank"), F.asc("chunk_id")], most)


def within_budget(ranked: DataFrame, budget: int = 9000) -> DataFrame:
    """The ranked texts up to the first that would pass the budget of characters."""
    running = F.sum(F.length("text")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", running.cast("long")).filter(F.col("used") <= budget)


def swapped(hits: DataFrame, mapped: DataFrame) -> DataFrame:
    """hits (qid, chunk_id, rank) with damaged chunks replaced by mapped (bad, good), unless the question has the good one."""
    at = hits.select("qid", F.col("chunk_id").alias("bad")).join(mapped, "bad").join(hits.select("qid", F.col("chunk_id").alias("good")), ["qid", "good"], "left_anti")
    return hits.withColumnRenamed("chunk_id", "bad").join(at, ["qid", "bad"], "left").withColumn("chunk_id", F.coalesce("good", "bad")).drop("good", "bad")


def reranked(hits: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed (qid, chunk_id, pos) first in their order, the others after them in theirs."""
    order = Window.partitionBy("qid").orderBy(F.asc_nulls_last("pos"), "rank")
    return hits.join(listed, ["qid", "chunk_id"], "left").withColumn("rank", F.row_number().over(order))


def named_sources(evidence: DataFrame, least: int = 3, most: int = 4) -> DataFrame:
    """qid, source, place: sources of evidence (qid, source, rank, s shared words) with at least `least` words and two
    fifths of the best, or else of the best two; at most `most`."""
    per = Window.partitionBy("qid")
    e = evidence.withColumn("strong", (F.col("s") >= least) & (F.col("s") * 5 >= F.max("s").over(per) * 2)).withColumn("place", F.row_number().over(per.orderBy(F.desc("s"), "rank")))
    e = e.withColumn("some", F.bool_or("strong").over(per)).filter(F.col("strong") | (~F.col("some") & (F.col("place") <= 2)))
    first = e.groupBy("qid", "source").agg(F.min("place").alias("first"))
    return top(first, "qid", [F.asc("first")], most).withColumnRenamed("rank", "place")


def responses(questions: DataFrame, best: DataFrame) -> DataFrame:
    """Five strings for each question (qid, text) from its ranked evidence (qid, chunk_id, rank, text): the extractive answer."""
    held = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.substring("text", 1, 300).alias("t"), "chunk_id"))).alias("x"))
    held = held.select("qid", F.array_join("x.t", "\n").alias("answer"), F.array_join(F.transform("x.chunk_id", lambda c: c.cast("string")), ",").alias("sources"))
    steps = F.when(F.col("answer").isNull(), F.array(F.lit("no evidence"))).otherwise(F.array(F.lit("keyword search"), F.lit("extract")))
    trace = F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s)), "\n")
    return questions.join(held, "qid", "left").select(F.col("qid").cast("string").alias("question_id"), F.col("text").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("sources", F.lit("")).alias("sources"), trace.alias("trace"))


def dummy_embedding(text: Column, dim: int = 256) -> Column:
    """A unit vector that depends on the text alone, for runs without a model."""
    seed = F.sha2(F.coalesce(text, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(F.sha2(F.concat(seed, i.cast("string")), 256), 1, 8), 16, 10).cast("double") / 2**31 - 1)
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(dot(v, v)))
    return F.get(F.transform(F.array(raw), unit), F.lit(0))


def cache_agrees(made: DataFrame, cached: DataFrame, least: float = 0.9999) -> DataFrame:
    """made (doc_id, made) with the cached vector (doc_id, held) and whether both agree: a cosine of at least `least`;
    not if the cache lacks the id or holds another length."""
    both = made.join(cached, "doc_id", "left")
    return both.withColumn("same", F.coalesce((F.size("made") == F.size("held")) & (cosine(F.col("made"), F.col("held")) >= least), F.lit(False)))


def neighbours_by_id(hits: DataFrame, chunks: DataFrame, longest: int = 300, most: int = 3) -> DataFrame:
    """neighbours() for ids like owner_p1_0003: the numbers before and behind, of the same owner and with as many digits,
    so that no step leaves a document. In the order of the hits, the one before first; ids of another form have none."""
    parts = F.regexp_extract("chunk_id", r"^(.*_)(\d+)$", 1), F.regexp_extract("chunk_id", r"^(.*_)(\d+)$", 2)
    numbered = hits.filter(F.regexp_like("chunk_id", F.lit(r"^.*_\d+$"))).select("qid", "rank", parts[0].alias("owner"), parts[1].alias("digits"))
    steps = numbered.select("qid", "owner", "digits", F.posexplode(F.array(F.col("digits").cast("long") - 1, F.col("digits").cast("long") + 1)).alias("side", "n"), "rank").filter("n >= 0")
    digits = F.col("n").cast("string")
    near = steps.select("qid", "rank", "side", F.concat("owner", F.when(F.length(digits) >= F.length("digits"), digits).otherwise(F.lpad(digits, F.length("digits"), F.lit("0")))).alias("chunk_id"))
    short = chunks.filter(F.length("text") <= longest).select("chunk_id")
    new = near.join(short, "chunk_id").join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    once = new.groupBy("qid", "chunk_id").agg(F.min(F.col("rank") * 2 + F.col("side")).alias("step"))
    return top(once, "qid", [F.asc("step"), F.asc("chunk_id")], most).select("qid", "chunk_id", F.floor(F.col("step") / 2).cast("long").alias("from_rank"), "rank")

"""A keyword index that is written once: postings by term, and what BM25 needs, rebuilt when the chunks change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import B, K1, POOL, top, word_weights

#: Folders of postings; a search reads those of its words.
BUCKETS = 64


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def fingerprint(chunks: DataFrame) -> str:
    """The same for the same rows in any order; null texts count as such."""
    h = F.xxhash64("chunk_id", "text")
    row = chunks.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


def build(chunks: DataFrame, path: str) -> None:
    """Writes postings (term, chunk_id, tf, dl; by bucket of the term), terms (term, df, idf) and, last, meta."""
    words = chunks.select("chunk_id", tokens(F.col("text")).alias("t"))
    stats, weights = word_weights(words)
    posts = words.select("chunk_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    posts.withColumn("bucket", _bucket("term")).repartition("bucket", F.xxhash64("term", "chunk_id") % 8).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    weights.withColumn("bucket", _bucket("term")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    stats.withColumn("fingerprint", F.lit(fingerprint(chunks))).write.mode("overwrite").parquet(f"{path}/meta")


def is_current(spark: SparkSession, chunks: DataFrame, path: str) -> bool:
    """Whether the index at path is of these chunks; a half-written one has no meta and is not."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return False
    held = spark.read.parquet(f"{path}/meta").first()
    return held is not None and held["fingerprint"] == fingerprint(chunks)


def ensure(chunks: DataFrame, path: str) -> bool:
    """Builds the index unless it is current; returns whether it did."""
    if is_current(chunks.sparkSession, chunks, path):
        return False
    build(chunks, path)
    return True


def search(questions: DataFrame, path: str, pool: int = POOL) -> DataFrame:
    """qid, chunk_id, score, rank as bm25() gives them, from the index; only folders of asked words are read."""
    spark = questions.sparkSession
    asked = questions.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")).withColumn("bucket", _bucket("term"))
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
    part = lambda name: spark.read.parquet(f"{path}/{name}").filter(F.col("bucket").isin(buckets))
    meta = spark.read.parquet(f"{path}/meta").first()
    avg = (meta["avgdl"] if meta else None) or 1.0
    tf = F.col("tf")
    one = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avg)))
    scored = asked.join(part("terms"), ["bucket", "term"]).join(part("postings"), ["bucket", "term"]).groupBy("qid", "chunk_id").agg(F.round(F.sum(one), 6).alias("score")).filter("score > 0")
    return top(scored, "qid", [F.desc("score"), F.asc("chunk_id")], pool)

"""The registered queries of the ten operators, with production parameters over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, language_model, packing, pii, secrets, sharding, simhash, toxicity, vectors
from .common import table


def op1_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_digest(table(spark, sf_dir, "embeddings"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_digest(table(spark, sf_dir, "documents"))


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_digest(table(spark, sf_dir, "documents"))


def op4_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(table(spark, sf_dir, "documents"))


def op6_refined_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op7_folded_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digest(table(spark, sf_dir, "documents"))


def op8_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.production_pack(table(spark, sf_dir, "documents"))


def op10_random_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_block_neighbours, op2_kneser_ney, op3_golay_simhash, op4_lexicon_toxicity, op5_crf_pii, op6_refined_dedup, op7_folded_bpe, op8_splitter_shards, op9_sum_of_squares, op10_random_battery, pipeline)}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {
    "op1_block_neighbours": vectors.NEAREST_SQL,
    "op6_refined_dedup": f"""
WITH t AS (SELECT doc_id::BIGINT AS doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
""",
}

"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. A cluster runs them one by one, each written as Parquet and read again; run() does the same in
the shared folder.

Cases, the same for all stages but the last: all columns come back as they were, whatever their names; null texts count
as empty and stay null; an empty table gives an empty one; rows with a null doc_id take part. Texts of any length are read
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, near_copies, packing, secrets, toxicity
from corpusloom.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model, learnt from the labels, scores at the threshold or over. Repeated rows share their
    fate, empty texts stay, and without usable labels every document does."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays, of repeated rows one; a row without an id
    stays only where no row with one has its text. All empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are linked by five-word shingles at a similarity of 0.8 or more, the row with the
    smallest doc_id stays. Texts without words are one group; rows of one id are told apart by their texts."""
    return near_copies.drop_near(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become [SECRET] and n_chars is measured anew; no row goes."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece; null and empty texts are the single end id, a null doc_id stays null, and an empty table
    gives no piece."""
    return packing.production_pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Stages learn models and count fingerprints; SQL can't express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

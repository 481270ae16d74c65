"""Exact dedup by progressive refinement, in DataFrame operations only.

Rows are grouped by the length of the normalised text, then by (length, hash of a prefix), and only rows whose group
still has two members have their full content hashed (SHA-256). Each step shuffles narrow rows; counts are combined
before the shuffle, so a length or text that a third of all rows share is one row per task. Normalising lower-cases
A-Z and nothing else, which keeps lengths.

Of equal texts the row with the largest doc_id stays.

Cases: null text counts as empty, and empty texts equal one another; null doc_ids count as smaller than any other;
rows that repeat doc_id and text are copies like others: refine() returns one result row for each, all marked with the
same keep_id, and drop_copies() lets only one of them through, and no row without an id beside one that has one. An empty
table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Filter, ascii_lower, id_and_text, without, written

#: Characters that the second step hashes.
PREFIX = 64


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _keys(text: Column) -> list[Column]:
    return [F.length(text).alias("len"), F.xxhash64(normalised(F.substring(text, 1, PREFIX))).alias("prefix")]


def surviving(docs: DataFrame) -> DataFrame:
    """(len, prefix) of the groups that two rows or more share: steps one and two over narrow rows."""
    narrow = id_and_text(docs).select(*_keys(F.col("text")))
    # one shuffle by (len, prefix); the lengths are then counted from its result, not from the rows again
    by_prefix = narrow.groupBy("len", "prefix").agg(F.count("*").alias("rows"))
    by_length = by_prefix.groupBy("len").agg(F.sum("rows").alias("of_length")).filter("of_length > 1")
    return by_prefix.filter("rows > 1").join(by_length, "len", "left_semi").select("len", "prefix")


def refine(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size and kept of every row; with digest also text_sha256, for which every text is hashed."""
    groups, _ = written(surviving(docs), "dedup-groups")
    same, held = _hashed(docs, groups)
    copies = held.join(same, ["len", "text_sha256"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    # rows of no surviving group stand for themselves; they are told apart by the key, so repeated ids do no harm
    hashed = F.sha2(normalised(F.col("text")).cast("binary"), 256) if digest else F.lit(None).cast("string")
    plain = id_and_text(docs).select("doc_id", *_keys(F.col("text")), hashed.alias("text_sha256"))
    single = plain.join(groups, ["len", "prefix"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    out = copies.unionByName(single).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return out if digest else out.drop("text_sha256")


def _hashed(docs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the groups of equal texts, the rows with their full hash), both written, of rows in the surviving groups."""
    rows = id_and_text(docs).select("doc_id", "text", *_keys(F.col("text")))
    # texts that no group names are sifted out before the join, which may have to shuffle
    may, _ = Filter(groups, F.struct("len", "prefix")).split(rows, F.struct("len", "prefix"))
    held = may.join(groups, ["len", "prefix"], "left_semi").select("doc_id", "len", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    held, _ = written(held, "dedup-held")
    # written, so that the join deals both sides anew and a hot group's rows can be split over tasks
    same, _ = written(held.groupBy("len", "text_sha256").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")), "dedup-same")
    return same, held


def dedup_digest(docs: DataFrame) -> DataFrame:
    return refine(docs, digest=True)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies, all columns kept; of each group of equal texts one row, with the largest doc_id. Rows
    are dropped by id and text, so that a text stays whose id also stands on a copy of another."""
    groups, _ = written(surviving(docs), "dedup-groups")
    same, held = _hashed(docs, groups)
    decided = held.join(same.filter("group_size > 1"), ["len", "text_sha256"]).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("mark"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    counted, _ = written(decided.groupBy("id", "mark", "kept").agg(F.count("*").alias("rows")), "dedup-decided")
    return without(docs, counted.filter("not kept").select("id", "mark"), counted.filter("kept and rows > 1").select("id", "mark"), F.sha2(normalised(F.col("text")).cast("binary"), 256))

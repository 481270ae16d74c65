"""What the engine writes: the final corpus with its report, the fee table with its quarantine, and folders put in place of
others. Writers give their reports as rows; nothing of the data comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fee_tables import fee_rows, may_hold_fees

#: Characters that a token of a model has, about, in the report's estimate.
CHARS_PER_TOKEN = 2


def final_report(before: DataFrame, final: DataFrame, by: tuple[str, ...] = ("scope", "content_type")) -> DataFrame:
    """name, value: rows and characters before and after, what share of each is kept and saved, an estimate of tokens, and
    rows of each value of the columns by. Null texts have no characters; of an empty corpus nothing is kept."""
    size = lambda df: df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))
    old, new = size(before).select(F.struct("*").alias("old")), size(final).select(F.struct("*").alias("new"))
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    values = {
        "rows before": F.col("old.rows"), "rows": F.col("new.rows"), "chars before": F.col("old.chars"), "chars": F.col("new.chars"),
        "rows kept": share(F.col("new.rows"), F.col("old.rows")), "chars saved": share(F.col("old.chars") - F.col("new.chars"), F.col("old.chars")),
        "tokens": F.floor(F.col("new.chars") / CHARS_PER_TOKEN),
    }
    both = old.join(new, F.lit(True))  # a row each
    out = both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in values.items()))).alias("r")).select("r.*")
    kinds = final.select(F.explode(F.array(*(F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in by))).alias("name"))
    return out.unionByName(kinds.groupBy("name").agg(F.count("*").cast("double").alias("value")))


def most_shared(final: DataFrame, most: int = 5, shown: int = 60) -> DataFrame:
    """The texts that most documents share: chunk_id, n_docs, and how they begin."""
    opening = F.substring(F.regexp_replace("text", r"(?U)\s+", " "), 1, shown)
    return final.filter("n_docs > 1").orderBy(F.desc("n_docs"), "chunk_id").limit(most).select("chunk_id", "n_docs", opening.alias("opening"))


def write_final(final: DataFrame, path: str, order: tuple[str, ...] = ("doc_id", "page", "chunk_id")) -> None:
    """The corpus as Parquet, in ranges of its order; chunks of single documents come before shared ones."""
    shared = F.col("scope") != F.lit("single")
    final.repartitionByRange(shared, *order).sortWithinPartitions(shared, *order).write.mode("overwrite").parquet(path)


def fee_candidates(chunks: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(fee rows, quarantine): chunks that look as if they held fees and give no row are the quarantine, with key and text.
    A key may stand on several chunks; it is in quarantine if none of them gives a row."""
    rows = fee_rows(chunks, key)
    held = chunks.filter(may_hold_fees(F.col("text")))
    return rows, held.join(rows.select(key).distinct(), key, "left_anti").select(key, "text")


def write_fees(chunks: DataFrame, path: str, key: str = "chunk_id") -> DataFrame:
    """Writes path/rows (the rows with their chunk's other columns) and path/skipped; returns a row of figures: candidates,
    rows, skipped, funds, and (fund, class) pairs that have more than one total. Chunks may carry fund_code; a new run
    writes new folders over the old. Instead of indexes the rows lie in order of fund and account."""
    spark = chunks.sparkSession
    rows, skipped = fee_candidates(chunks, key)
    carried = [c for c in chunks.columns if c not in (key, "text", *rows.columns)]
    if carried:
        rows = rows.join(chunks.select(key, *carried).dropDuplicates([key]), key)
    fund = "fund_code" if "fund_code" in carried else key
    rows.repartitionByRange(fund, "account_type").sortWithinPartitions(fund, "account_type").write.mode("overwrite").parquet(f"{path}/rows")
    skipped.write.mode("overwrite").parquet(f"{path}/skipped")
    written = spark.read.parquet(f"{path}/rows")
    several = written.groupBy(fund, "class_code").agg(F.count_distinct("fee_total").alias("n")).agg(F.count_if(F.col("n") > 1).alias("conflicts"))
    counts = written.agg(F.count("*").alias("rows"), F.count_distinct(fund).alias("funds"))
    missed = spark.read.parquet(f"{path}/skipped").agg(F.count("*").alias("skipped"))
    looked = chunks.agg(F.count_if(may_hold_fees(F.col("text"))).alias("candidates"))
    return looked.join(counts, F.lit(True)).join(missed, F.lit(True)).join(several, F.lit(True))  # a row each


def put_in_place(spark: SparkSession, fresh: str, path: str, holds: Column | None = None) -> str | None:
    """Moves a written Parquet folder to path; what was there goes to path.old (replacing an older one), which is returned.
    ValueError, with nothing moved, if the fresh one is empty or has a row for which holds is not true. If the second move
    fails the first is undone."""
    rows = spark.read.parquet(fresh)
    found = rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(holds if holds is not None else F.lit(True), F.lit(False))).alias("bad")).first()
    if not found["n"] or found["bad"]:
        raise ValueError(f"{fresh}: {found['n']} rows, {found['bad']} bad")
    paths = spark._jvm.org.apache.hadoop.fs.Path
    new, now, old = paths(fresh), paths(path), paths(f"{path}.old")
    files = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    was = files.exists(now)
    if was:
        files.delete(old, True)
        if not files.rename(now, old):
            raise OSError(f"cannot move {path}")
    if not files.rename(new, now):
        if was:
            files.rename(old, now)
        raise OSError(f"cannot move {fresh}")
    return f"{path}.old" if was else None


def stamped(rows: DataFrame) -> DataFrame:
    """With the day and the moment (UTC) of the run, the same on every row."""
    return rows.withColumn("today", F.current_date()).withColumn("run_at", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))

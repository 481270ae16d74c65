"""What the operators share: tables, the shared folder, written tables."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def id_and_text(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id as a long and the text with null as empty, and more columns; whatever others there are stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *(c.alias(k) for k, c in more.items()))


def remainder(doc_id, n: int):
    """crc32 of the id's decimal digits, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of this process where that is unset, as in tests on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        kept = sc._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return str(kept.get())
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(found)
    # a path without a scheme is one of Spark's default file system, which need not be the local disk
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/corpusloom/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and reads it again: the lineage is cut, any executor may be lost,
    and Catalyst knows the size. Returns the path too, for drop()."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    _remove(spark, path)


def constant(spark: SparkSession, value, kind: str):
    """value as a column, evaluated once for a query: a scalar subquery over its JSON. Give it a name by withColumn() and
    use the name once, in let(): Spark takes no subquery in a higher-order function as written, but merges the two."""
    return spark.range(1).select(F.from_json(F.lit(json.dumps(value)), kind).alias("value")).scalar()


def let(value, use):
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bits of a Filter for each key, as aimed for, and the least and most that it has: at most 64 MB are broadcast.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 29


class Filter:
    """A bitmap of hashed keys that passes every row whose key it holds and few others (all of them, at worst).

    It stands before joins that keep or drop rows by a list that may be too long to broadcast: only what passes is
    shuffled, so that texts that no key names stay where they are. keys is a table that is written already."""

    def __init__(self, keys: DataFrame, key: Column):
        many = keys.count()
        bits = LEAST_BITS
        while bits < min(many * BITS_PER_KEY, MOST_BITS):
            bits *= 2
        self.bits, self.empty = bits, not many
        at = F.pmod(F.xxhash64(key), F.lit(bits))
        self.maps = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))

    def split(self, df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """(rows whose key may be among the keys, rows whose key is not)."""
        if self.empty:
            return df.filter(F.lit(False)), df
        at, bucket, held = (fresh(df, x) for x in ("at", "bucket", "map"))
        maps = F.broadcast(self.maps.select(F.col("bucket").alias(bucket), F.col("map").alias(held)))
        dealt = df.withColumn(at, F.pmod(F.xxhash64(key), F.lit(self.bits)))
        joined = dealt.join(maps, F.bitmap_bucket_number(at) == F.col(bucket), "left")
        place = F.bitmap_bit_position(at).cast("int")
        byte = F.conv(F.hex(F.substring(held, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1, F.lit(False))
        return joined.filter(hit).select(*df.columns), joined.filter(~hit).select(*df.columns)


def without(docs: DataFrame, gone: DataFrame, once: DataFrame, mark: Column) -> DataFrame:
    """docs less the rows of gone, and with one row of those that once names; all columns kept.

    A row is named by (id, mark): its doc_id as a long, and a hash of its text, which mark computes. So rows that share
    an id but not the text are told apart. gone and once are written tables. Only rows whose id one of them may hold
    are hashed and shuffled."""
    key = F.col("doc_id").cast("long")
    named = gone.select("id").unionByName(once.select("id"))
    may, rest = Filter(named, F.col("id")).split(docs, key)
    i, m = fresh(docs, "id"), fresh(docs, "mark")
    other = gone.select(F.col("id").alias("gone_" + i), F.col("mark").alias("gone_" + m))
    may = may.withColumn(i, key).withColumn(m, mark)
    kept = may.join(other, F.col(i).eqNullSafe(F.col("gone_" + i)) & (F.col(m) == F.col("gone_" + m)), "left_anti")
    return rest.unionByName(kept.dropDuplicates([i, m]).select(*docs.columns))

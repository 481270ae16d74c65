"""Sharding by sampled splitters, in DataFrame operations only. Law: bytes (sizes near equal).

Records are ordered by (hash of the text, doc_id, row), so that equal texts are neighbours and a hot group can still be
cut inside. A sample of keys, drawn with a chance in proportion to size (and half of it to rows, as many empty texts have
little size), gives quantile boundaries; records fall into ranges between them; ranges that turn out overfull, by bytes
or by rows, are subdivided by denser samples of their own until none is. Within a range a
running sum gives each record its place in bytes over the whole corpus, and shards are equal stretches of that. A group
of equal texts stays in one shard unless it is larger than GROUP of a shard, when it is cut where the shard ends.

Cases: a null text counts no bytes (size 1); an empty text likewise; a null doc_id sorts first and stays null; repeated
rows each get a slot; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import constant, let, written

#: Rows of a range, as aimed for; the driver holds one boundary and one total for each range. Over 4 billion rows there
#: are MOST_RANGES of them, each larger in proportion: a task sorts n / MOST_RANGES narrow rows then.
ROWS_PER_RANGE = 250_000
LEAST_RANGES, MOST_RANGES = 256, 16_384
#: Keys sampled for each range.
OVERSAMPLE = 24
#: A range with over twice its fair share of bytes or rows is subdivided, until there is none.
OVERFULL = 2.0
#: Ranges of so many rows or fewer are never overfull by rows.
LEAST_ROWS = 64
#: A group of equal texts of at most this share of a shard is not cut.
GROUP = 0.005


def _ranged(rows: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """rows with their range: how many boundaries are at or below the key, by binary search in a constant array."""
    if not bounds:
        return rows.withColumn("range", F.lit(0))
    many, key = len(bounds), F.struct("h", "d", "r")

    def search(array: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            below = F.get(array, mid) <= key
            done = s["lo"] >= s["hi"]
            return F.struct(F.when(~done & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(~done & ~below, mid).otherwise(s["hi"]).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.lit(many).alias("hi"))
        return F.aggregate(F.array_repeat(F.lit(0), many.bit_length()), start, halve, lambda s: s["lo"])

    array = constant(rows.sparkSession, [{"h": h, "d": d, "r": r} for h, d, r in bounds], "array<struct<h:long,d:long,r:long>>")
    return rows.withColumn("_bounds", array).select(*rows.columns, let(F.col("_bounds"), search).alias("range"))


def _totals(rows: DataFrame, bounds: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """(bytes, rows, bytes of the largest row) of each range; one row for each comes to the driver."""
    found = _ranged(rows, bounds).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most"))
    return {x["range"]: (x["bytes"], x["n"], x["most"]) for x in found.collect()}


def _splitters(rows: DataFrame, total: int, n: int, ranges: int, salt: int) -> list[tuple[int, int, int]]:
    """Quantile boundaries of a sample weighted half by size and half by row, as many tiny rows fill a range too; about
    OVERSAMPLE keys a range come to the driver."""
    aim = OVERSAMPLE * ranges / 2
    steps = F.col("size") * F.lit(aim / max(total, 1)) + F.lit(aim / max(n, 1))
    # a uniform number from the row's key, the same in every run and retry
    uniform = (F.xxhash64("h", "d", "r", F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)
    # records of over one sample step each stand for so many steps
    drawn = rows.filter(uniform < F.least(F.lit(1.0), steps)).select("h", "d", "r", F.greatest(F.lit(1.0), steps).alias("w")).collect()
    keys = sorted(((x["h"], x["d"], x["r"]), x["w"]) for x in drawn)
    weight, out, at = sum(w for _, w in keys), [], 0.0
    for key, w in keys:
        before, at = at, at + w
        if weight and int(before / weight * ranges) < int(at / weight * ranges) < ranges and (not out or out[-1] < key):
            out.append(key)
    return out


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.monotonically_increasing_id().alias("r"),
    )
    rows, _ = written(narrow, "shard-keys")  # the row numbers are frozen here
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n, total = whole["n"], whole["bytes"] or 0
    ranges = max(LEAST_RANGES, min(MOST_RANGES, -(-n // ROWS_PER_RANGE)))
    bounds = _splitters(rows, total, n, ranges, 1)
    sizes = _totals(rows, bounds)
    for attempt in itertools.count(2):
        # a range that holds one large row and little else cannot be better
        over = sorted(k for k, (b, m, most) in sizes.items() if m > 1 and (b - most > OVERFULL * total / ranges or m > max(LEAST_ROWS, OVERFULL * n / ranges)))
        if not over:
            break
        # each attempt draws twice as densely, in the end every row, so that this ends
        inside, held, many = _ranged(rows, bounds).filter(F.col("range").isin(over)), sum(sizes[k][0] for k in over), sum(sizes[k][1] for k in over)
        parts = sum(max(-(-sizes[k][0] * ranges // total), -(-sizes[k][1] * ranges // n)) for k in over)
        bounds = sorted({*bounds, *_splitters(inside, held, many, parts << attempt, attempt)})
        sizes = _totals(rows, bounds)
    offsets, b, m = [], 0, 0
    for k in range(len(bounds) + 1):
        offsets.append((k, b, m))
        b, m = b + sizes.get(k, (0, 0, 0))[0], m + sizes.get(k, (0, 0, 0))[1]
    at = F.broadcast(spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long"))  # one row a range: MOST_RANGES bounds it
    placed = _ranged(rows, bounds).join(at, "range")
    order = Window.partitionBy("range").orderBy("h", "d", "r").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("upto", F.col("bytes_before") + F.sum("size").over(order)).withColumn("row", F.col("rows_before") + F.row_number().over(Window.partitionBy("range").orderBy("h", "d", "r")) - 1)
    group = Window.partitionBy("range", "h")
    begun = running.withColumn("first", F.min(F.col("upto") - F.col("size")).over(group)).withColumn("last", F.max("upto").over(group))
    begun, _ = written(begun.select("doc_id", "size", "text_crc32", "h", "upto", "row", "first", "last"), "shard-begun")
    # a group that a boundary cuts lies in several ranges; there is one row for each boundary at most
    edge = spark.createDataFrame(sorted({(x[0],) for x in bounds}), "h long")
    whole_groups = begun.join(F.broadcast(edge), "h").groupBy("h").agg(F.min("first").alias("from"), F.max("last").alias("to"))
    begun = begun.join(F.broadcast(whole_groups), "h", "left").withColumn("first", F.coalesce("from", "first")).withColumn("last", F.coalesce("to", "last"))
    small = (F.col("last") - F.col("first")) * shards <= F.lit(GROUP * total)
    place = F.when(small, F.col("first")).otherwise(F.col("upto") - F.col("size"))
    sharded = begun.withColumn("shard", F.least(F.lit(shards - 1), F.floor(place * F.lit(shards) / F.lit(max(total, 1)))).cast("int")).select("doc_id", "size", "text_crc32", "shard", "row")
    sharded, _ = written(sharded, "shard-rows")
    first = F.broadcast(sharded.groupBy("shard").agg(F.min("row").alias("first")))  # one row a shard
    return sharded.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def shard_digest(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""A stream of questions through the same gate and router as a batch, and counts of a request log by time.

The windows are an addition: the studied system answers one question a call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import routing


def screened(questions: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Adds blocked and the route; works on batches and streams, as no state is kept."""
    return routing.routed(routing.gate(questions), first, second)


def once_each(questions: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """Drops questions asked again within the watermark: the response cache of a stream."""
    keyed = questions.withColumn("key", F.sha1(F.trim("text")))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["key"]) if questions.isStreaming else keyed.dropDuplicates(["key"])


def traffic(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests and errors of each kind in tumbling windows."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), kind, "n")


def start(screen: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now and stops; the checkpoint resumes where it stopped."""
    return screen.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

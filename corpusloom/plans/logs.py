"""Queries on logs and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from ..streaming import questions
from .registry import query, read


@query("SELECT user_id, count(*) AS calls, round(sum(value), 2) AS used FROM events GROUP BY user_id ORDER BY calls DESC, user_id LIMIT 5")
def usage_report(spark, d):
    calls = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("used"))
    return calls.orderBy(F.desc("calls"), "user_id").limit(5)  # a report of the five busiest


@query("WITH x AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM events) SELECT event_id, CASE WHEN event_id - mark <= 100 THEN mark END AS mark FROM x WHERE event_type = 'purchase'")
def nearest_preceding_mention(spark, d):
    return tables.nearest_before(read(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase", 100)


@query("SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_probe(spark, d):
    return read(spark, d, "events").groupBy(F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.key")).cast("long").alias("k")).agg(F.count("*").alias("n"))


# an addition: request counts by hour, the same on a stream
@query("SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n FROM events GROUP BY ALL")
def traffic_by_hour(spark, d):
    return questions.traffic(read(spark, d, "events"), "ts", "event_type")

"""Catalogue, part 4: batch forms of the streaming operators over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import progress as P


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def window_tumbling(spark, d):
    return P.tumbling(_events(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


def window_sliding(spark, d):
    return P.sliding(_events(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def window_session(spark, d):
    return P.sessions(_events(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def ema_rate(spark, d):
    return P.ema(_events(spark, d)).select("user_id", F.round("rate", 6).alias("rate"))


def adaptive_ceiling(spark, d):
    return P.ceiling(_events(spark, d).select("user_id", "ts", "event_id", (F.col("event_id") % 5 != 0).alias("ok")))


def static_join(spark, d):
    """Stream-static join: events with the customer of the same number."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return _events(spark, d).join(c, "user_id").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "window_tumbling": (window_tumbling, "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"),
    "window_sliding": (window_sliding, "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY 1"),
    "window_session": (window_session, "WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l), g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::BIGINT AS events FROM g GROUP BY user_id"),
    "ema_rate": (ema_rate, "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), e AS (SELECT user_id, i, value AS rate FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, 0.3::DOUBLE * o.value + (1 - 0.3::DOUBLE) * e.rate FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1) SELECT user_id, round(arg_max(rate, i), 6) AS rate FROM e GROUP BY user_id"),
    "adaptive_ceiling": (adaptive_ceiling, None),
    "stream_static_join": (static_join, "SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON c_custkey = user_id GROUP BY 1"),
}

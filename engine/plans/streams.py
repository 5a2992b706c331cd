"""Queries of the streaming operators, run over a table as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.sources.tables import table
from engine.streaming import events

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(table(spark, d, "events"))


@query("""
WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events))
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s
""")
def window_session(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(table(spark, d, "events"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    return events.distinct_events(table(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(max(value), 2) AS largest FROM events GROUP BY event_type")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.max("value"), 2).alias("largest"))

"""Queries of streaming jobs over the event log, read as files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.plans.catalogue import query, table
from paragraf.streaming import jobs


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    return jobs.arriving(spark, d, "events.parquet", table(spark, d, "events"))


@query("ST1_stream_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run(jobs.hourly(_arriving(spark, d), "ts"), "complete").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(
    "ST8_stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 2 HOUR AS until, count(*) AS n FROM i GROUP BY user_id, island""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.run(jobs.sessions(_arriving(spark, d), "ts", "user_id"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})


@query("ST2_stream_once", "SELECT DISTINCT event_id FROM events")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries, the second one reading the last week again: each event counts once."""
    events = table(spark, d, "events")
    newest = events.agg(F.max("ts").alias("t")).first().t
    again = events.where(F.col("ts") > F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7)))
    folder = jobs.delivered(spark, [events, again])
    return jobs.run(jobs.once(jobs.arriving(spark, folder, "*.parquet", events, files=1), "event_id", "ts"), "append").select("event_id")


@query("ST2_delivered_again", "SELECT count(*) + count(*) FILTER (ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS delivered, count(DISTINCT event_id) AS kept FROM events")
def delivered_again(spark: SparkSession, d: str) -> DataFrame:
    """How many rows came in both deliveries, and how many were kept."""
    events = table(spark, d, "events")
    newest = events.agg(F.max("ts").alias("t")).first().t
    again = events.where(F.col("ts") > F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7)))
    kept = stream_once(spark, d).agg(F.count("*").alias("kept"))
    return events.select("event_id").unionByName(again.select("event_id")).agg(F.count("*").alias("delivered"), F.lit(1).alias("_one")).join(kept.withColumn("_one", F.lit(1)), "_one").drop("_one")  # a row each

"""Queries of usage, sessions and quotas over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.operators import usage
from paragraf.plans.catalogue import query, table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("A10_last_week", "SELECT user_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) - 7 FROM events) GROUP BY user_id")
def last_week(spark: SparkSession, d: str) -> DataFrame:
    newest = _events(spark, d).agg(F.max(F.to_date("ts"))).first()[0]
    return _events(spark, d).where(F.to_date("ts") > F.date_sub(F.lit(newest), 7)).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "A11_caller_usage",
    "SELECT user_id, count(*) AS total, count(*) FILTER (CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) - 7 FROM events)) AS last_7, count(DISTINCT CAST(ts AS DATE)) AS active_days, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY user_id",
)
def caller_usage(spark: SparkSession, d: str) -> DataFrame:
    newest = _events(spark, d).agg(F.max(F.to_date("ts"))).first()[0]
    day = F.to_date("ts")
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(day > F.date_sub(F.lit(newest), 7)).alias("last_7"), F.count_distinct(day).alias("active_days"), F.max(day).alias("last_day"))


@query(
    "W4_islands",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 2 HOUR AS until, count(*) AS rows FROM i GROUP BY user_id, island""",
)
def islands(spark: SparkSession, d: str) -> DataFrame:
    return usage.islands(_events(spark, d), ["user_id"], "ts", 7200)


@query(
    "A12_latency_p95",
    """WITH h AS (SELECT event_type, count(*) AS n, count(*) FILTER (v <= 250) AS a, count(*) FILTER (v <= 1000) AS b, count(*) FILTER (v <= 3000) AS c, count(*) FILTER (v <= 10000) AS e FROM (SELECT event_type, value * 50 AS v FROM events WHERE value IS NOT NULL) GROUP BY event_type)
SELECT event_type, CASE WHEN a * 100 >= n * 95 THEN 250 WHEN b * 100 >= n * 95 THEN 1000 WHEN c * 100 >= n * 95 THEN 3000 WHEN e * 100 >= n * 95 THEN 10000 END AS p95 FROM h""",
)
def latency(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).where("value is not null").groupBy("event_type").agg(usage.histogram(F.col("value") * 50).alias("h"))
    return rows.select("event_type", usage.p95(F.col("h")).alias("p95"))


@query("ST9_quota", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2")
def quota(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("day", F.to_date("ts"))
    return usage.admitted(rows, ["user_id", "day"], [F.asc("ts"), F.asc("event_id")], 2).select("event_id", "user_id")


@query("ST4_failure_runs", "WITH r AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS failures FROM r WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 3")
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    return usage.failure_runs(_events(spark, d), ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error", 3)


@query("ST11_health", "SELECT user_id, arg_max(event_type <> 'error', (ts, event_id)) AS ok, max(ts) AS seen FROM events GROUP BY user_id")
def health(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("user_id").agg(F.max_by(F.col("event_type") != "error", F.struct("ts", "event_id")).alias("ok"), F.max("ts").alias("seen"))


@query(
    "G20_token_bucket",
    """WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b(user_id, n, event_id, t, admitted, rest) AS (SELECT user_id, n, event_id, t, TRUE, CAST(2 AS DOUBLE) FROM r WHERE n = 1
UNION ALL SELECT user_id, n, event_id, t, rest >= 1, rest - CAST(rest >= 1 AS DOUBLE) FROM (SELECT r.*, least(CAST(3 AS DOUBLE), b.rest + (r.t - b.t) * CAST(1.0 / 3600 AS DOUBLE)) AS rest FROM b JOIN r ON r.user_id = b.user_id AND r.n = b.n + 1))
SELECT event_id AS key, user_id AS user, admitted FROM b""",
)
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return usage.token_bucket(_events(spark, d), "user_id", "ts", "event_id", 3.0, 1 / 3600)


@query("ST7_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def windows(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")

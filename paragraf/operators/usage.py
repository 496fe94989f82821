"""Counters, sessions, latency and quotas over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Upper bounds of the latency buckets; the last bucket is open.
BOUNDS = (250, 1_000, 3_000, 10_000)


def islands(df: DataFrame, by: list[str], at: str, gap_seconds: int = 300) -> DataFrame:
    """(by, since, until, rows) of runs whose neighbours lie at most the gap apart; a run lasts one gap beyond its last row."""
    own = Window.partitionBy(*by).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    rows = df.select(*by, at, seconds.alias("_s")).withColumn("_new", (F.col("_s") - F.lag("_s").over(own) > gap_seconds) | F.lag("_s").over(own).isNull())
    rows = rows.withColumn("_island", F.sum(F.col("_new").cast("int")).over(own))
    tail = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds))
    return rows.groupBy(*by, "_island").agg(F.min(at).alias("since"), (F.max(at) + tail).alias("until"), F.count("*").alias("rows")).drop("_island")


def histogram(value: Column) -> Column:
    """A row of counts, one for each bucket, for summing."""
    low = [0, *BOUNDS]
    return F.array(*[F.sum(F.when((value > lo) & (value <= hi) if lo else value <= hi, 1).otherwise(0)) for lo, hi in zip(low, BOUNDS, strict=False)], F.sum(F.when(value > BOUNDS[-1], 1).otherwise(0)))


def p95(counts: Column) -> Column:
    """The upper bound of the bucket that reaches 95 %; null if nothing was counted or the open bucket does."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    reached = lambda i: F.aggregate(F.slice(counts, 1, i), F.lit(0).cast("long"), lambda a, x: a + x) * 100 >= total * 95
    out = F.lit(None).cast("int")
    for i in range(len(BOUNDS), 0, -1):
        out = F.when(reached(i), F.lit(BOUNDS[i - 1])).otherwise(out)
    return F.when(total > 0, out)


def admitted(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each quota's period."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def failure_runs(df: DataFrame, by: list[str], order: list[Column], failed: Column, least: int) -> DataFrame:
    """(by, run, failures, last order columns) of runs of at least `least` failures in a row."""
    own = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(own)).where(failed)
    return rows.groupBy(*by, F.col("_run").alias("run")).agg(F.count("*").alias("failures")).where(F.col("failures") >= least)


def token_bucket(df: DataFrame, user: str, at: str, key: str, capacity: float, per_second: float) -> DataFrame:
    """(key, user, admitted): a bucket of `capacity` tokens that refills continuously; each row takes one if there is one.

    A pause in which an empty bucket fills up makes what comes after it independent of what came before. Users' rows are
    parted at such pauses, and each part is gone through in order on the JVM."""
    rows = df.select(F.col(user).alias("user"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"), F.col(key).alias("key"))
    own = Window.partitionBy("user").orderBy("at", "key")
    pause = F.col("at") - F.lag("at").over(own)
    rows = rows.withColumn("_new", F.coalesce(pause * per_second >= capacity, F.lit(True)).cast("int")).withColumn("_part", F.sum("_new").over(own))
    kind = df.schema[key].dataType.simpleString()
    start = F.struct(F.lit(float(capacity)).alias("left"), F.lit(None).cast("double").alias("last"), F.array().cast(f"array<struct<key: {kind}, admitted: boolean>>").alias("out"))

    def step(state: Column, r: Column) -> Column:
        left = F.when(state["last"].isNull(), F.lit(float(capacity))).otherwise(F.least(F.lit(float(capacity)), state["left"] + (r["at"] - state["last"]) * per_second))
        return F.struct((left - (left >= 1).cast("double")).alias("left"), r["at"].alias("last"), F.concat(state["out"], F.array(F.struct(r["key"].alias("key"), (left >= 1).alias("admitted")))).alias("out"))

    parts = rows.groupBy("user", "_part").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("r"))
    return parts.select("user", F.explode(F.aggregate("r", start, step, lambda s: s["out"])).alias("o")).select("o.key", "user", "o.admitted")


def retry_queue(df: DataFrame, by: list[str], order: list[Column], at: str, failed: Column, done: Column) -> DataFrame:
    """(by, attempts, last): keys whose last outcome is a failure, with their failures since the last success."""
    own = Window.partitionBy(*by).orderBy(*order)
    rows = df.where(failed | done).withColumn("_since", F.sum(done.cast("int")).over(own))
    last = rows.groupBy(*by).agg(F.max("_since").alias("_since"))
    return rows.join(last, [*by, "_since"]).where(failed).groupBy(*by).agg(F.count("*").alias("attempts"), F.max(at).alias("last"))


def paused(df: DataFrame, by: list[str], order: list[Column], at: str, failed: Column, least: int, minutes: int) -> DataFrame:
    """(by, run, failures, until): runs of `least` failures or more; the source rests from the last of them on."""
    own = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(own)).where(failed)
    runs = rows.groupBy(*by, F.col("_run").alias("run")).agg(F.count("*").alias("failures"), F.max(at).alias("_last")).where(F.col("failures") >= least)
    return runs.select(*by, "run", "failures", (F.col("_last") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).alias("until"))

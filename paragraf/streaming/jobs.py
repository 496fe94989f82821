"""Streaming jobs: files that arrive become counters, sessions and deduplicated rows, once each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from paragraf.session import checkpoint_dir, kept


def arriving(spark: SparkSession, folder: str, pattern: str, like: DataFrame, files: int = 8) -> DataFrame:
    """New Parquet files of a folder, with the columns of `like`; timestamps without zone are taken as UTC."""
    rows = spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in like.dtypes])


def delivered(spark: SparkSession, deliveries: list[DataFrame]) -> str:
    """A folder into which the deliveries were written one after another, as a source would land them."""
    folder = f"{checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"
    for rows in deliveries:
        rows.write.mode("append").parquet(folder)
    kept.append((spark, folder))
    return folder


def hourly(events: DataFrame, at: str, late: str = "14 days") -> DataFrame:
    """(hour, event_type, n); rows later than `late` are no longer counted."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, at: str, user: str, gap: str = "2 hours", late: str = "14 days") -> DataFrame:
    """(user, since, until, n) of each user's sessions: a gap longer than `gap` ends one."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def once(events: DataFrame, key: str, at: str, late: str = "14 days") -> DataFrame:
    """Each key once within the lateness: re-read windows deliver rows again."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Take in all that is there and end. complete: the last result; append: all rows written, each batch once."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{'last' if mode == 'complete' else f'batch={number}'}")

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    job.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{base}/out/last" if mode == "complete" else f"{base}/out")
    return out.select(*stream.columns)

"""Structured Streaming over event files: windows with watermarks, sessions, and the
incremental rebuild of trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veinstone.operators import events as E

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


BUCKETS = 256


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files that land in a folder."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and window; state is dropped behind the watermark."""
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("ts", late) if events.isStreaming else events
    s = g.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def rebuild_stream(events: DataFrame, history: str, out: str, checkpoint: str, project) -> StreamingQuery:
    """2.13.8, 2.13.15: each micro-batch appends its events to ``history`` and folds the
    whole history of the workflows it touches again; late events need nothing special,
    as the fold orders by sequence. ``project`` maps raw events to the audit columns.

    The history lies in ``BUCKETS`` partitions by a hash of the workflow, of which only
    those of the touched workflows are read."""

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = project(batch).withColumn("bucket", F.pmod(F.xxhash64("workflow_id"), F.lit(BUCKETS)))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{history}/epoch={epoch}")  # a repeated epoch replaces itself
        new = spark.read.parquet(f"{history}/epoch={epoch}")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        ids = new.select("workflow_id").distinct()
        past = spark.read.option("basePath", history).parquet(f"{history}/epoch=*").where(F.col("bucket").isin(touched))
        full = past.drop("bucket", "epoch").join(ids, "workflow_id", "left_semi")
        E.trajectories(full).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold).start()


def latest_trajectories(spark: SparkSession, out: str) -> DataFrame:
    """2.13.9: the newest fold of each workflow."""
    return E.keep_latest(spark.read.parquet(out), "workflow_id", [F.desc("epoch")])

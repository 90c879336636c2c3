"""The streaming queries over ``events``: a file stream run to its end, and the batch form
of the same plan as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.plans.registry import query
from veinstone.session import read_table, shared_folder
from veinstone.streaming import events as ST


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ST.tumbling(events(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type FROM events UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ST.sliding(events(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ST.sessions(events(spark, sf)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def streamed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a file stream into a table in the shared folder; complete mode, so
    nothing is late and each batch replaces the table."""
    stream = spark.readStream.schema(ST.SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    folder = f"{shared_folder(spark).rstrip('/')}/streamed-{uuid.uuid4().hex}"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts")

    q = stream.groupBy("event_type").agg(F.count("*").alias("n")).writeStream.outputMode("complete").foreachBatch(put)
    q.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string, n long").parquet(f"{folder}/counts")

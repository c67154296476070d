"""Time windows over events in batch form (extensions), and the streaming form of the presence ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources import sinks
from tidemark.sources.views import table


@query("SELECT event_type, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window_counts(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return df.select("event_type", F.unix_timestamp("w.start").alias("start_s"), "n")


@query("SELECT CAST(floor(epoch(ts) / 3600) * 3600 - i * 3600 AS BIGINT) AS start_s, count(*) AS n FROM events, unnest(range(0, 3)) AS u(i) GROUP BY ALL")
def sliding_window_counts(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return df.select(F.unix_timestamp("w.start").alias("start_s"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, session")
def session_windows(spark, sf_dir):
    """Visits with gaps under twelve hours."""
    df = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return df.select("user_id", F.unix_timestamp("w.start").alias("start_s"), "n")


def stream_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def keep_presence(stream: DataFrame, target: str, checkpoint: str):
    """Runs the ledger over a stream: each micro-batch is merged into the table of first and last sightings (``sinks.read``).

    A batch rewrites the buckets that it touches, and one that is run again after a failure counts nothing twice.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        seen = batch.groupBy("event_type", "user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("seen"))
        sum_up = lambda rows: rows.groupBy("event_type", "user_id").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("seen").alias("seen"))
        sinks.merge(target, seen, batch_id, F.pmod(F.xxhash64("event_type", "user_id"), F.lit(sinks.BUCKETS)).cast("int"), sum_up, ("event_type", "user_id"))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts by type and six hours; rows later than the watermark's delay are left out, and closed windows are final."""
    windows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("event_type", F.window("ts", "6 hours").alias("w"))
    return windows.agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")

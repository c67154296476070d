"""Sinks that write: merges of a batch into a table, by batch id.

A table is Parquet, partitioned by a bucket of its key (or by day). A merge reads the buckets that its batch touches and no others,
combines them with the batch, stages the result in the shared folder and puts it in the place of those buckets by dynamic
partition overwrite. Every row bears the id of the last batch that was merged into its bucket, so a batch that is merged
again finds its own id and changes nothing; if a run ends half-way, the next run of that batch merges what is missing. Batches come
in the order of their ids, as ``foreachBatch`` gives them. The number of buckets is fixed when a table is begun: take as many as
give buckets of some hundred megabytes.

Rows without a key are left out. An empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.shared import kept, shared_folder
from tidemark.sources.views import observed

BUCKETS = 16
_HIDDEN = ("bucket", "batch_id")


def read(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a merged table."""
    return spark.read.parquet(target).drop(*_HIDDEN)


def _written(spark: SparkSession, target: str) -> DataFrame | None:
    """None for a table that isn't begun."""
    try:
        return spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def merge(target: str, batch: DataFrame, batch_id: int, bucket: Column, combine: Callable[[DataFrame], DataFrame], absent: tuple[str, ...]) -> int:
    """Merges ``batch`` and tells how many buckets were rewritten.

    ``combine`` makes one table of old and new rows, which have the same columns and ``is_new``; rows whose ``absent`` columns are all
    null are no rows. It must give the columns of ``batch``.
    """
    spark = batch.sparkSession
    new = kept(batch.where(" OR ".join(f"{c} IS NOT NULL" for c in absent)).withColumn("bucket", bucket), "sink-batch")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets
    old = _written(spark, target)
    if old is not None and touched:
        old = old.where(F.col("bucket").isin(touched))
        done = {r["bucket"] for r in old.groupBy("bucket").agg(F.max("batch_id").alias("last")).where(F.col("last") >= batch_id).collect()}
        touched = [b for b in touched if b not in done]
        old = old.where(F.col("bucket").isin(touched)).drop("batch_id")
    if not touched:
        return 0
    new = new.where(F.col("bucket").isin(touched)).withColumn("is_new", F.lit(True))
    rows = new if old is None else old.withColumn("is_new", F.lit(False)).unionByName(new)
    out = combine(rows).withColumn("bucket", bucket).withColumn("batch_id", F.lit(batch_id).cast("long"))
    # The buckets that are read are the ones to be overwritten, so the result is written elsewhere first.
    kept(out, "sink-merged").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
    return len(touched)


def _bucket(*keys: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_insert_ignored(target: str, batch: DataFrame, batch_id: int, key: str, fill: str, buckets: int = BUCKETS) -> int:
    """Adds rows (key, fill) of unknown keys; of a known key only a null ``fill`` is filled. Of several new rows the least counts."""

    def combine(rows: DataFrame) -> DataFrame:
        known = F.max(F.when(~F.col("is_new"), F.col(fill)))
        return rows.groupBy(key).agg(F.coalesce(known, F.min(F.when(F.col("is_new"), F.col(fill)))).alias(fill))

    return merge(target, batch.select(key, fill), batch_id, _bucket(key, buckets=buckets), combine, (key,))


def merge_upserted(target: str, batch: DataFrame, batch_id: int, buckets: int = BUCKETS) -> int:
    """Merges sightings (key, ts_s, event_id, price, seller): the latest price wins, the first sighting stays, a lost seller (null) never
    takes the place of a known one."""
    new = batch.select("key", F.col("ts_s").alias("first_at"), F.col("ts_s").alias("last_at"), F.lit(1).cast("long").alias("seen"), "price", F.col("event_id").alias("price_id"), "seller", F.when(F.col("seller").isNotNull(), F.col("event_id")).alias("seller_id"))

    def combine(rows: DataFrame) -> DataFrame:
        latest = lambda value, by: F.max_by(value, by).alias(value)
        return rows.groupBy("key").agg(
            F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("seen").alias("seen"), latest("price", "price_id"), F.max("price_id").alias("price_id"), latest("seller", "seller_id"), F.max("seller_id").alias("seller_id")
        )

    return merge(target, new, batch_id, _bucket("key", buckets=buckets), combine, ("key",))


def merge_daily(target: str, batch: DataFrame, batch_id: int) -> int:
    """One row a day and key, the last of the day; only the days of the batch are rewritten."""

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy("day", "key").agg(F.max_by("price", "event_id").alias("price"), F.max("event_id").alias("event_id"))

    return merge(target, batch.where("key IS NOT NULL").select("day", "key", "price", "event_id"), batch_id, F.col("day"), combine, ("day",))


def merge_presence(target: str, scans: DataFrame, batch_id: int, buckets: int = BUCKETS) -> int:
    """Adds the sightings of healthy scans (site, key, ts_s, day, healthy, exit_scope), one row for each listing and day.

    ``presence.presence_of_scans`` of ``sightings(...)`` is the state of all listings: dealt by listing, so that no site is one task.
    """

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy("site", "key", "day").agg(F.min("ts_s").alias("ts_s"), F.max("exit_scope").alias("exit_scope"))

    return merge(target, scans.where("healthy").select("site", "key", "day", "ts_s", "exit_scope"), batch_id, _bucket("site", "key", buckets=buckets), combine, ("key",))


def sightings(spark: SparkSession, target: str) -> DataFrame:
    return read(spark, target).withColumn("healthy", F.lit(True))


# --- Queries: batches are merged, each of them twice, and the table is read back.


def _batches(rows: DataFrame, n: int = 3) -> list[DataFrame]:
    return [rows.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == i) for i in range(n)]


@query("SELECT key, min(ts_s) AS first_at, max(ts_s) AS last_at, count(*) AS seen, arg_max(price, event_id) AS price, arg_max(seller, event_id) FILTER (k > 20) AS seller FROM observed GROUP BY key", "observed")
def sink_upsert(spark, sf_dir):
    target = shared_folder(spark, "sink-upsert")
    for i, rows in enumerate(_batches(observed(spark, sf_dir).withColumn("seller", F.when(F.col("k") > 20, F.col("seller"))))):
        merge_upserted(target, rows, i)
        merge_upserted(target, rows, i)
    return read(spark, target).select("key", "first_at", "last_at", "seen", "price", "seller")


@query("WITH a AS (SELECT key, CASE WHEN min(k) < 10 THEN NULL ELSE min(seller) END AS seller FROM observed WHERE day % 2 = 0 GROUP BY key), b AS (SELECT key, min(seller) AS s FROM observed WHERE day % 2 = 1 GROUP BY key) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN s ELSE coalesce(seller, s) END AS seller FROM a FULL JOIN b ON a.key = b.key", "observed")
def sink_insert_ignore(spark, sf_dir):
    target, df = shared_folder(spark, "sink-insert"), observed(spark, sf_dir)
    first = df.where("day % 2 = 0").groupBy("key").agg(F.when(F.min("k") < 10, None).otherwise(F.min("seller")).alias("seller"))
    for i, rows in enumerate((first, df.where("day % 2 = 1").select("key", "seller"))):
        merge_insert_ignored(target, rows, i, "key", "seller")
        merge_insert_ignored(target, rows, i, "key", "seller")
    return read(spark, target)


@query("SELECT day, key, arg_max(price, event_id) AS price FROM observed GROUP BY day, key", "observed")
def sink_daily_snapshot(spark, sf_dir):
    target = shared_folder(spark, "sink-daily")
    for i, rows in enumerate(_batches(observed(spark, sf_dir))):
        merge_daily(target, rows, i)
        merge_daily(target, rows, i)
    return read(spark, target).select("day", "key", "price")

"""Sinks that merge by batch id: repeated batches, half-finished ones, touched buckets only."""

import os

from pyspark.sql import functions as F

SIGHTINGS = "key string, ts_s long, event_id long, price double, seller long"


def files(target):
    return {f"{d}/{f}" for d, _, fs in os.walk(target) for f in fs if f.endswith(".parquet")}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    from tidemark.sources import sinks

    target = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 5, 1, 1.0, 7), ("b", 6, 2, 2.0, None), (None, 1, 3, 3.0, 1)], SIGHTINGS)
    two = spark.createDataFrame([("a", 3, 4, 9.0, None), ("c", 8, 5, 4.0, 1)], SIGHTINGS)
    assert sinks.merge_upserted(target, one, 0, 8) > 0 and sinks.merge_upserted(target, one, 0, 8) == 0
    before = files(target)
    assert sinks.merge_upserted(target, two, 1, 8) > 0
    after = files(target)
    assert before & after or len(before) == 1  # buckets that the batch doesn't touch keep their files
    assert sinks.merge_upserted(target, two, 1, 8) == 0 and sinks.merge_upserted(target, one, 0, 8) == 0 and files(target) == after
    assert sinks.merge_upserted(target, two.limit(0), 2, 8) == 0
    got = {r["key"]: (r["first_at"], r["last_at"], r["seen"], r["price"], r["seller"]) for r in sinks.read(spark, target).collect()}
    assert got == {"a": (3, 5, 2, 9.0, 7), "b": (6, 6, 1, 2.0, None), "c": (8, 8, 1, 4.0, 1)}


def test_a_half_finished_batch_is_finished_by_the_next_run(spark, tmp_path):
    import shutil

    from tidemark.sources import sinks

    rows = spark.range(200).selectExpr("concat('k', id % 40) AS key", "id AS ts_s", "id AS event_id", "CAST(id AS double) AS price", "id % 3 AS seller")
    whole, half = str(tmp_path / "whole"), str(tmp_path / "half")
    sinks.merge_upserted(whole, rows.where("id % 2 = 0"), 0, 8)
    shutil.copytree(whole, half)
    sinks.merge_upserted(whole, rows.where("id % 2 = 1"), 1, 8)
    # Only some buckets of batch 1 came through.
    for name in [d for d in sorted(os.listdir(whole)) if d.startswith("bucket=")][:3]:
        shutil.rmtree(f"{half}/{name}", ignore_errors=True)
        shutil.copytree(f"{whole}/{name}", f"{half}/{name}")
    assert 0 < sinks.merge_upserted(half, rows.where("id % 2 = 1"), 1, 8) <= 5
    order = lambda t: sorted(map(tuple, sinks.read(spark, t).collect()))
    assert order(half) == order(whole) and len(order(whole)) == 40


def test_insert_ignore_fills_nulls_only(spark, tmp_path):
    from tidemark.sources import sinks

    target = str(tmp_path / "t")
    for i, rows in enumerate(([("a", 1), ("b", None)], [("a", 2), ("b", 3), ("c", None)], [("b", 9), ("c", 4), ("c", 2)])):
        sinks.merge_insert_ignored(target, spark.createDataFrame(rows, "key string, seller long"), i, "key", "seller", 4)
    assert {tuple(r) for r in sinks.read(spark, target).select("key", "seller").collect()} == {("a", 1), ("b", 3), ("c", 2)}


def test_daily_snapshots_rewrite_their_days(spark, tmp_path):
    from tidemark.sources import sinks

    target = str(tmp_path / "t")
    schema = "day long, key string, price double, event_id long"
    sinks.merge_daily(target, spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 2.0, 2), (2, "a", 3.0, 3)], schema), 0)
    old = {f for f in files(target) if "bucket=2" in f}
    assert sinks.merge_daily(target, spark.createDataFrame([(1, "a", 9.0, 7), (1, "b", 8.0, 0)], schema), 1) == 1
    assert old <= files(target)
    assert {tuple(r) for r in sinks.read(spark, target).select("day", "key", "price").collect()} == {(1, "a", 9.0), (1, "b", 2.0), (2, "a", 3.0)}


def test_presence_merged_by_listing_equals_the_batch_form(spark, tmp_path):
    from tests.test_presence import SCHEMA, scans
    from tidemark.sources import sinks
    from tidemark.streaming.presence import presence_of_scans

    rows = spark.createDataFrame(scans(), SCHEMA)
    for i in (0, 1, 2):
        sinks.merge_presence(str(tmp_path / "t"), rows.where(F.col("day") % 3 == i), i, 4)
    got = presence_of_scans(sinks.sightings(spark, str(tmp_path / "t")))
    order = lambda df: sorted(map(tuple, df.select("site", "key", "scans", "status").collect()))
    assert order(got) == order(presence_of_scans(rows))

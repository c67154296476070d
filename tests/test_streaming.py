"""The streaming ledger against the batch form."""

from pyspark.sql import functions as F

from tidemark.sources import sinks
from tidemark.streaming.windows import keep_presence, late_counts, stream_events

SF = "/root/testdata/sf0.001"


def test_presence_over_batches_equals_one_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder, target, state = (str(tmp_path / x) for x in ("in", "ledger", "state"))
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
        keep_presence(stream_events(spark, folder, events.schema), target, state).awaitTermination()
    got = {tuple(r) for r in sinks.read(spark, target).select("event_type", "user_id", "first_at", "last_at", "seen").collect()}
    want = events.groupBy("event_type", "user_id").agg(F.min("ts"), F.max("ts"), F.count("*")).collect()
    assert got == {tuple(r) for r in want}


def test_windowed_counts_run_as_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = late_counts(stream_events(spark, str(tmp_path / "in"), events.schema))
    run = counts.writeStream.format("memory").queryName("late_counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < spark.table("late_counts").agg(F.sum("n")).first()[0] <= events.count()


def test_presence_as_keyed_state(spark, tmp_path):
    from tidemark.streaming.state import presence_stream

    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "in")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    # Three files, three micro-batches, one state.
    presence_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)).writeStream.format("memory").queryName("presence_all").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    last = spark.table("presence_all").groupBy("event_type", "user_id").agg(F.max_by(F.struct("first_at", "last_at", "seen"), "seen").alias("s")).select("event_type", "user_id", "s.*")
    want = events.groupBy("event_type", "user_id").agg(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp"), F.count("*"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}


def test_alerts_as_keyed_state_equal_the_fold(spark, tmp_path):
    import random

    from tidemark.operators.machines import alert_machine_of
    from tidemark.streaming.state import alert_stream

    rng = random.Random(2)
    rows = [(site, day, rng.choice([0, 1, 2, 2])) for site in ("a", "b", "c") for day in range(40)]
    scans = spark.createDataFrame(rows, "site string, day long, severity int")
    folder = str(tmp_path / "scans")
    for part in range(4):
        scans.where(F.col("day").between(10 * part, 10 * part + 9)).coalesce(1).write.mode("append").parquet(folder)
        alert_stream(spark.readStream.schema(scans.schema).parquet(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r["site"]: (r["a"], r["r"]) for r in out.groupBy("site").agg(F.count_if(F.col("notice") == "alert").alias("a"), F.count_if(F.col("notice") == "recovered").alias("r")).collect()}
    assert got == {r["site"]: (r["alerts"], r["recoveries"]) for r in alert_machine_of(scans).collect()}
    assert min(a for a, _ in got.values()) > 1

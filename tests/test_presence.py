"""Keyed presence and expiry over micro-batches against the batch forms."""

import random

from pyspark.sql import functions as F

SCHEMA = "site string, key string, ts_s long, day long, healthy boolean, exit_scope boolean"


def scans(seed=6, days=14):
    rng = random.Random(seed)
    rows = []
    for site in ("a", "b", "only parts"):
        for day in range(days):
            healthy, scope = rng.random() > 0.2, site != "only parts" and rng.random() > 0.3
            for listing in range(30):
                if abs(listing - 2 * day) < 5 and rng.random() > 0.2:
                    rows.append((site, f"{site}{listing}", 86400 * day + rng.randrange(5), day, healthy, scope))
    return rows


def run(df, name, out, state):
    df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def stream(spark, rows, schema, folder, batches):
    """One file, and so one micro-batch, for each part of ``rows``."""
    import os
    import time

    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("seen"):
                os.rename(f"{folder}/{f}", f"{folder}/seen-{i:03d}.parquet")
                os.utime(f"{folder}/seen-{i:03d}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def with_rocks(spark):
    from tidemark.streaming.presence import ROCKS

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def test_presence_over_batches_equals_the_batch_form(spark, tmp_path):
    from tidemark.streaming.presence import presence_changes, presence_of_scans

    with_rocks(spark)
    rows = scans()
    want = {(r["site"], r["key"]): (r["scans"], r["status"]) for r in presence_of_scans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {s for _, s in want.values()} == {"present", "disappeared", "window_exit", "unjudged"}
    # In order of days, and with late days: the last state told of each listing is the same.
    by_day = [[r for r in rows if r[3] == d] for d in range(14)]
    for name, parts in (("ordered", [by_day[i] + by_day[i + 1] for i in range(0, 14, 2)]), ("late", [by_day[i] + by_day[13 - i] for i in (6, 2, 0, 4, 5, 1, 3)])):
        changes = presence_changes(stream(spark, rows, SCHEMA, str(tmp_path / name), parts), keep_days=100)
        got = {}

        def keep(batch, i, got=got):
            got |= {(r["site"], r["key"]): (r["scans"], r["status"]) for r in batch.collect()}

        changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
        assert got == want, name


def test_exited_listings_are_pruned_and_start_anew(spark, tmp_path):
    from tidemark.streaming.presence import presence_changes

    with_rocks(spark)
    show = lambda day, *keys: [("a", k, 86400 * day, day, True, True) for k in keys]
    parts = [show(0, "old", "x"), show(1, "old", "x", "young"), show(2, "old"), show(9, "old", "z"), show(10, "old", "x")]
    told = []
    changes = presence_changes(stream(spark, None, SCHEMA, str(tmp_path / "in"), parts), keep_days=5)
    changes.writeStream.foreachBatch(lambda b, i: told.append({r["key"]: (r["status"], r["scans"]) for r in b.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    told = [t for t in told if t]
    assert told[2] == {"old": ("present", 3), "x": ("window_exit", 2), "young": ("disappeared", 1)}
    assert told[3] == {"old": ("present", 4), "z": ("present", 1), "x": ("pruned", 2), "young": ("pruned", 1)}
    assert told[4] == {"old": ("present", 5), "x": ("present", 1), "z": ("disappeared", 1)}


def test_expiry_by_timers_equals_the_batch_rule(spark, tmp_path):
    import datetime as dt

    from tidemark.streaming.presence import expiring

    with_rocks(spark)
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = sorted(((f"k{rng.randrange(40)}", start + dt.timedelta(hours=rng.randrange(24 * 40))) for _ in range(160)), key=lambda r: r[1])
    rows.append(("end", start + dt.timedelta(days=41)))
    parts = [rows[i : i + 23] for i in range(0, len(rows), 23)] + [[("end", start + dt.timedelta(days=41, hours=1))]]
    got = {}
    events = stream(spark, None, "key string, ts timestamp", str(tmp_path / "in"), parts)
    expiring(events, 10).writeStream.foreachBatch(lambda b, i: got.update({r["key"]: r["state"] for r in b.orderBy(F.col("state") == "expired").collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for k, ts in rows:
        last[k] = max(last.get(k, ts), ts)
    want = {k for k, ts in last.items() if ts < start + dt.timedelta(days=31) - dt.timedelta(hours=1)}
    assert {k for k, s in got.items() if s == "expired"} == want and 5 < len(want) < 40


def test_notices_over_batches_equal_the_fold(spark, tmp_path):
    """Rows come up to twelve hours late; each listing's notices are those of its candidates in order of time."""
    from tidemark.streaming.notices import WEEK, notice_stream, notices_of

    with_rocks(spark)
    rng = random.Random(12)
    schema = "key string, ts_s long, rule string, event_id long"
    rows = [(f"k{rng.randrange(12)}", 1_700_000_000 + 3600 * rng.randrange(24 * 60), rng.choice(["likely", "likely", "urgent"]), i) for i in range(250)]
    rows += [(k, t, "urgent", 1000 + i) for i, (k, t, *_) in enumerate(rows[:30])]  # ties
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(12 * 3600))
    end = max(r[1] for r in rows) + 10 * 86400
    parts = [arrival[i : i + 40] for i in range(0, len(arrival), 40)] + [[("end", end, "likely", 9999)], [("end", end + 1, "likely", 10000)]]
    got = []
    stream_of = notice_stream(stream(spark, None, schema, str(tmp_path / "in"), parts))
    stream_of.writeStream.foreachBatch(lambda b, i: got.extend(map(tuple, b.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want, ledger = [], {}
    for key, t, rule, event_id in sorted(rows, key=lambda r: (r[0], r[1], r[2] != "urgent", r[3])):
        urgent, last = ledger.get(key, (False, t - WEEK))
        if not urgent if rule == "urgent" else t - last >= WEEK:
            want.append((key, t, rule, event_id))
            ledger[key] = (urgent or rule == "urgent", t)
    assert sorted(map(tuple, notices_of(spark.createDataFrame(rows, schema)).collect())) == sorted(want)
    assert sorted(r for r in got if r[0] != "end") == sorted(want) and {r[2] for r in want} == {"urgent", "likely"}

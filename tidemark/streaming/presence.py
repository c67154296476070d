"""Presence with a horizon and retention, as keyed state over streams and in the batch form that it must equal.

Scans are rows (site, key, ts_s, day, healthy, exit_scope): what a scan of a site showed. An unhealthy scan says nothing at all. A
scan that shows only a part of its site (``exit_scope`` false) is evidence that its listings are there, and none against others.
The last full scan of a site sets the horizon: the oldest first sighting among what it showed. A listing that it and later
scans don't show has disappeared if it is newer than the horizon, and may just have left the window if it isn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.register import query
from tidemark.sources.views import observed

KEEP_DAYS = 10
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def presence_of_scans(scans: DataFrame) -> DataFrame:
    """State of each listing after all scans: site, key, scans (days of sightings) and status."""
    seen = scans.where("healthy")
    scope = F.when(F.col("exit_scope"), F.col("day"))
    state = seen.groupBy("site", "key").agg(F.min("ts_s").alias("first_at"), F.max("day").alias("last_day"), F.max(scope).alias("scope_day"), F.count_distinct("day").alias("scans"))
    df = state.join(seen.groupBy("site").agg(F.max(scope).alias("scan_day")), "site")
    horizon = df.where("scope_day = scan_day").groupBy("site").agg(F.min("first_at").alias("horizon"))
    df = df.join(horizon, "site", "left")
    status = F.when(F.col("horizon").isNull(), "unjudged").when(F.col("last_day") >= F.col("scan_day"), "present").when(F.col("first_at") > F.col("horizon"), "disappeared").otherwise("window_exit")
    return df.select("site", "key", "scans", status.alias("status"))


def scans_of(events: DataFrame) -> DataFrame:
    """Observations as scans: those of small payloads come from scans that failed, those of large ones from partial scans."""
    return events.select("site", "key", "ts_s", "day", (F.col("k") >= 5).alias("healthy"), (F.col("k") < 60).alias("exit_scope"))


@query(
    """WITH v AS (SELECT site, key, ts_s, day, k < 60 AS exit_scope FROM observed WHERE k >= 5),
s AS (SELECT site, key, min(ts_s) AS first_at, max(day) AS last_day, max(day) FILTER (exit_scope) AS scope_day, count(DISTINCT day) AS scans FROM v GROUP BY ALL), l AS (SELECT site, max(day) FILTER (exit_scope) AS scan_day FROM v GROUP BY site),
h AS (SELECT site, min(first_at) AS horizon FROM s JOIN l USING (site) WHERE scope_day = scan_day GROUP BY site)
SELECT site, key, scans, CASE WHEN horizon IS NULL THEN 'unjudged' WHEN last_day >= scan_day THEN 'present' WHEN first_at > horizon THEN 'disappeared' ELSE 'window_exit' END AS status FROM s JOIN l USING (site) LEFT JOIN h USING (site)""",
    "observed",
)
def presence_by_scope(spark, sf_dir):
    """Presence when some scans have failed and some show a part of their site only."""
    return presence_of_scans(scans_of(observed(spark, sf_dir)))


class Presence(StatefulProcessor):
    """One state for each site: its listings, the days on which each was seen, and its last full scan.

    The map of listings lives in the state store and is walked, not held; what changes is emitted. Scans may come in any
    order. A listing that isn't present and that no scan of the last ``keep_days`` has shown is dropped with its days and
    emitted as ``pruned``; if it comes back, it is a new one.
    """

    OUTPUT = "site string, key string, scans long, status string"

    def __init__(self, keep_days: int = KEEP_DAYS):
        self.keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.listings = handle.getMapState("listings", "key string", "first_at long, last_day long, scope_day long, scans long, status string, told long")
        self.days = handle.getMapState("days", "key string, day long", "n long")
        self.scan = handle.getValueState("scan", "scan_day long, newest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        scan_day, newest = self.scan.get() if self.scan.exists() else (-1, -1)
        for batch in rows:
            for name, ts, day, scope in batch.loc[batch["healthy"], ["key", "ts_s", "day", "exit_scope"]].itertuples(index=False, name=None):
                ts, day, scope_day = int(ts), int(day), int(day) if scope else -1
                first, last, of_scope, scans, status, told = self.listings.getValue((name,)) if self.listings.containsKey((name,)) else (ts, day, -1, 0, "", 0)
                if not self.days.containsKey((name, day)):
                    self.days.updateValue((name, day), (1,))
                    scans += 1
                self.listings.updateValue((name,), (min(first, ts), max(last, day), max(of_scope, scope_day), scans, status, told))
                scan_day, newest = max(scan_day, scope_day), max(newest, day)
        self.scan.update((scan_day, newest))
        yield from self.judged(key[0], scan_day, newest)

    def judged(self, site: str, scan_day: int, newest: int) -> Iterator[pd.DataFrame]:
        horizon = min((v[0] for _, v in self.listings.iterator() if v[2] == scan_day), default=None) if scan_day >= 0 else None
        changed = []
        for (name,), (first, last, scope_day, scans, before, told) in self.listings.iterator():
            status = "unjudged" if horizon is None else "present" if last >= scan_day else "disappeared" if first > horizon else "window_exit"
            if status in ("disappeared", "window_exit") and last < newest - self.keep_days:
                status = "pruned"
            if (status, scans) != (before, told):
                changed.append((name, first, last, scope_day, scans, status))
        gone = {name for name, *_, status in changed if status == "pruned"}
        for at in [k for k, _ in self.days.iterator() if k[0] in gone] if gone else ():
            self.days.removeKey(at)
        for name, first, last, scope_day, scans, status in changed:
            if name in gone:
                self.listings.removeKey((name,))
            else:
                self.listings.updateValue((name,), (first, last, scope_day, scans, status, scans))
        if changed:
            yield pd.DataFrame([(site, name, scans, status) for name, _, _, _, scans, status in changed], columns=["site", "key", "scans", "status"])

    def close(self) -> None:
        pass


def presence_changes(scans: DataFrame, keep_days: int = KEEP_DAYS) -> DataFrame:
    """The listings whose state a micro-batch of ``scans`` changes. The session needs the RocksDB state store (``ROCKS``).

    A site's scans go to one task, which holds what changes. Sites whose listings are too many for that are merged by
    ``sinks.merge_presence``, which deals them by listing.
    """
    return scans.groupBy("site").transformWithStateInPandas(Presence(keep_days), Presence.OUTPUT, "Update", "None")


class Expiry(StatefulProcessor):
    """One state for each listing: its last sighting, and a timer that ends it ``days`` later in event time."""

    OUTPUT = "key string, last_at timestamp, state string"

    def __init__(self, days: int):
        self.ms = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, n = self.last.get() if self.last.exists() else (-1, 0)
        last = before
        for batch in rows:
            n += len(batch)
            last = max(last, int(batch["ts"].max().timestamp() * 1000))
        if last != before:
            if before >= 0:
                self.handle.deleteTimer(before + self.ms)
            self.handle.registerTimer(last + self.ms)
        self.last.update((last, n))
        yield pd.DataFrame({"key": [key[0]], "last_at": [pd.Timestamp(last, unit="ms")], "state": ["new" if n == 1 else "active"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "last_at": [pd.Timestamp(last, unit="ms")], "state": ["expired"]})

    def close(self) -> None:
        pass


def expiring(events: DataFrame, days: int, delay: str = "1 hour") -> DataFrame:
    """States of listings (key, ts): ``new``, ``active``, and ``expired`` once the watermark is ``days`` past the last sighting.

    Rows older than the watermark are left out; one that comes after the end of its listing starts it anew.
    """
    timed = events.selectExpr("key", "CAST(ts AS timestamp) AS ts").withWatermark("ts", delay)
    return timed.groupBy("key").transformWithStateInPandas(Expiry(days), Expiry.OUTPUT, "Update", "EventTime")

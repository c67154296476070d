"""Notices of two rules without repeats: as a fold over a listing's candidates, and as keyed state over a stream.

``urgent`` is told once in a listing's life. ``likely`` is told unless anything was told of the listing in the week before.
Candidates count in order of time; at one time the urgent one comes first, so it takes precedence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.register import query
from tidemark.sources.views import observed

WEEK = 7 * 86400
URGENT, LIKELY = 95, 60


def candidates(events: DataFrame) -> DataFrame:
    """key, ts_s, rule and event_id of what a rule wants to tell."""
    rule = F.when(F.col("k") >= URGENT, "urgent").when(F.col("k") >= LIKELY, "likely")
    return events.select("key", "ts_s", rule.alias("rule"), "event_id").where("rule IS NOT NULL")


def notices_of(found: DataFrame) -> DataFrame:
    """The candidates (key, ts_s, rule, event_id) that are told. A listing's candidates are folded in order."""
    one = F.struct("ts_s", (F.col("rule") != "urgent").alias("later"), "event_id")
    ordered = found.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("all"))
    zero = F.struct(F.lit(False).alias("urgent"), F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<ts_s:bigint,later:boolean,event_id:bigint>>").alias("told"))
    quiet = lambda s, x: s["last"].isNull() | (x["ts_s"] - s["last"] >= WEEK)
    tell = lambda s, x: F.when(x["later"], quiet(s, x)).otherwise(~s["urgent"])
    step = lambda s, x: F.when(tell(s, x), F.struct((s["urgent"] | ~x["later"]).alias("urgent"), x["ts_s"].alias("last"), F.concat(s["told"], F.array(x)).alias("told"))).otherwise(s)
    told = ordered.select("key", F.explode(F.aggregate("all", zero, step, lambda s: s["told"])).alias("x"))
    return told.select("key", "x.ts_s", F.when(F.col("x.later"), "likely").otherwise("urgent").alias("rule"), "x.event_id")


@query(
    f"""WITH RECURSIVE c AS (SELECT key, ts_s, k < {URGENT} AS later, event_id, row_number() OVER (PARTITION BY key ORDER BY ts_s, k < {URGENT}, event_id) AS i FROM (SELECT concat_ws(':', event_type, user_id) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id FROM events) WHERE k >= {LIKELY}),
w AS (SELECT key, i, ts_s, later, event_id, TRUE AS told, NOT later AS urgent, ts_s AS last FROM c WHERE i = 1 UNION ALL
SELECT key, i, ts_s, later, event_id, told, urgent OR told AND NOT later, CASE WHEN told THEN ts_s ELSE last END FROM (SELECT c.key, c.i, c.ts_s, c.later, c.event_id, w.urgent, w.last, CASE WHEN c.later THEN c.ts_s - w.last >= {WEEK} ELSE NOT w.urgent END AS told FROM w JOIN c ON c.key = w.key AND c.i = w.i + 1))
SELECT key, ts_s, CASE WHEN later THEN 'likely' ELSE 'urgent' END AS rule, event_id FROM w WHERE told"""
)
def notices_without_repeats(spark, sf_dir):
    return notices_of(candidates(observed(spark, sf_dir)))


class Notices(StatefulProcessor):
    """One state for each listing: what was told, and the candidates that wait.

    A candidate waits until the watermark has passed it, so all that come before it in time have come; then the waiting ones are
    told or dropped in order. The ledger of a listing is two numbers, and the list is empty between its candidates.
    """

    OUTPUT = "key string, ts_s long, rule string, event_id long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ledger = handle.getValueState("ledger", "urgent boolean, last long")
        self.waiting = handle.getListState("waiting", "ts_s long, later boolean, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        for batch in rows:
            new = [(int(t), rule != "urgent", int(e)) for t, rule, e in batch[["ts_s", "rule", "event_id"]].itertuples(index=False)]
            self.waiting.appendList(new)
            for t in {t for t, *_ in new}:
                self.handle.registerTimer(t * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        urgent, last = self.ledger.get() if self.ledger.exists() else (False, -WEEK)
        told = []
        for t, later, event_id in (tuple(w) for w in waiting if w[0] <= now):
            if t - last >= WEEK if later else not urgent:
                told.append((key[0], t, "likely" if later else "urgent", event_id))
                urgent, last = urgent or not later, t
        rest = [tuple(w) for w in waiting if w[0] > now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.ledger.update((urgent, last))
        if told:
            yield pd.DataFrame(told, columns=["key", "ts_s", "rule", "event_id"])

    def close(self) -> None:
        pass


def notice_stream(found: DataFrame, delay: str = "1 day") -> DataFrame:
    """Notices of a stream of candidates, told when the watermark passes them; rows later than ``delay`` are left out. The session needs
    the RocksDB state store."""
    timed = found.withColumn("ts", F.timestamp_seconds("ts_s")).withWatermark("ts", delay)
    return timed.groupBy("key").transformWithStateInPandas(Notices(), Notices.OUTPUT, "Append", "EventTime")

"""Keyed state over streams: the presence ledger and the alert machine, one state row for each key.

What a micro-batch brings touches the state of its own keys only. Rows come in no order within a batch, so each key's rows are
sorted there; the engine keeps the state in its checkpoint and restores it after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.machines import IN_A_ROW, WAITS

PRESENCE = "event_type string, user_id long, first_at timestamp, last_at timestamp, seen long"


def presence_stream(events: DataFrame) -> DataFrame:
    """First and last sighting and number of sightings of each key, emitted whenever they change."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, seen = state.get if state.exists else (None, None, 0)
        for batch in batches:
            low, high = batch["ts"].min(), batch["ts"].max()
            first = low if first is None else min(first, low)
            last = high if last is None else max(last, high)
            seen += len(batch)
        state.update((first, last, seen))
        yield pd.DataFrame({"event_type": [key[0]], "user_id": [key[1]], "first_at": [first], "last_at": [last], "seen": [seen]})

    rows = events.selectExpr("event_type", "user_id", "CAST(ts AS timestamp) AS ts")
    return rows.groupBy("event_type", "user_id").applyInPandasWithState(update, PRESENCE, "first_at timestamp, last_at timestamp, seen long", "update", GroupStateTimeout.NoTimeout)


ALERTS = "site string, day long, notice string, worst int"


def alert_stream(scans: DataFrame) -> DataFrame:
    """Notices (``alert`` or ``recovered``) of scans (site, day, severity) by the rule of ``alert_machine_of``; days must arrive in
    order from batch to batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, worst, told, last = state.get if state.exists else (0, 0, 0, -1)
        out = []
        for day, severity in pd.concat(list(batches)).sort_values("day")[["day", "severity"]].itertuples(index=False):
            if severity == 0:
                if told:
                    out.append((key[0], day, "recovered", worst))
                fails, worst, told, last = 0, 0, 0, -1
                continue
            fails, worst = fails + 1, max(worst, int(severity))
            if fails >= IN_A_ROW and (last < 0 or day - last >= WAITS[min(told, 2)]):
                told, last = told + 1, int(day)
                out.append((key[0], day, "alert", worst))
        state.update((fails, worst, told, last))
        yield pd.DataFrame(out, columns=["site", "day", "notice", "worst"])

    return scans.groupBy("site").applyInPandasWithState(update, ALERTS, "fails int, worst int, told int, last long", "append", GroupStateTimeout.NoTimeout)

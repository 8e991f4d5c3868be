"""The log as a stream: what is odd about each event against live state, and activity by hour with late rows dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ON, OFF = "assigned", "unassigned"
OUT = "key long, seq long, verb string, owner string, item string, anomaly string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def odd(last: tuple | None, verb: str, owner: str | None, item: str | None) -> str | None:
    """What does not fit what the key's last event (verb, owner, item) left: the names of eventlog.anomalies()."""
    held = last is not None and last[0] == ON
    if verb == ON:
        return "reassigned" if held else None
    if verb != OFF:
        return None
    return "not assigned" if not held else "other address" if last[1] != owner else "other paper" if last[2] != item else None


class Replay(StatefulProcessor):
    """The last event of each key as state. With expiry, a timer drops what has had no event for so many milliseconds."""

    def __init__(self, expiry: int | None = None) -> None:
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "verb string, owner string, item string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plain = lambda x: None if pd.isna(x) else x
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last, out = self.last.get() if self.last.exists() else None, []
        for seq, verb, owner, item in zip(events["seq"], *(map(plain, events[c]) for c in ("verb", "owner", "item"))):
            out.append((key[0], seq, verb, owner, item, odd(last, verb, owner, item)))
            last = (verb, owner, item)
        self.last.update(tuple(last))
        if self.expiry is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expiry)
        yield pd.DataFrame(out, columns=["key", "seq", "verb", "owner", "item", "anomaly"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame(columns=["key", "seq", "verb", "owner", "item", "anomaly"])

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, *, expiry: int | None = None) -> DataFrame:
    """events (key, seq, verb, owner, item) with anomaly, null where an event fits; those that do not are the rows of
    eventlog.anomalies() over the whole log, as long as a key's events come in batches of rising seq.

    expiry: milliseconds without an event after which a key is forgotten, so that state does not grow with all keys ever
    seen; its next event finds nothing before it. Needs a session whose state store is STORE.
    """
    mode = "None" if expiry is None else "ProcessingTime"
    return events.select("key", "seq", "verb", "owner", "item").groupBy("key").transformWithStateInPandas(Replay(expiry), OUT, "Append", mode)


def activity_stream(events: DataFrame, at: str = "ts", *, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Actions by type and window; rows later than the watermark no longer count."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

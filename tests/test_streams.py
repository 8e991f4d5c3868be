"""The log as a stream gives what the batch gives on the same log; state goes when its time is up."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from weftline.operators import eventlog
from weftline.streaming import replay

SCHEMA = "key long, seq long, verb string, owner string, item string"


@pytest.fixture()
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, replay.STORE)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def log(n: int, seed: int = 4):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(rng.randint(0, n // 8), i, pick("assigned", "unassigned", "unassigned", "viewed"), pick("a", "a", "b", None), pick("p", "p", "q")) for i in range(n)]


def run(spark, rows, tmp_path, batches: int):
    """rows in so many batches, one file each; all rows that come out."""
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    query = None
    for k in range(batches):
        spark.createDataFrame(rows[k * len(rows) // batches : (k + 1) * len(rows) // batches], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = replay.replay_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(sink)
        assert query.awaitTermination(120)
    return spark.read.schema(replay.OUT).parquet(sink)


def test_a_stream_in_batches_equals_the_batch(spark, store, tmp_path):
    rows = log(160)
    got = run(spark, rows, tmp_path, 3)
    want = eventlog.anomalies(spark.createDataFrame(rows, SCHEMA), "key", "seq", "verb", "assigned", "unassigned", "owner", "item")
    key = lambda df: sorted((r.key, r.seq, r.verb, r.owner or "", r.item, r.anomaly) for r in df.collect())
    assert got.count() == len(rows)
    assert key(got.where("anomaly is not null")) == key(want) and len({r.anomaly for r in want.collect()}) == 4


class Handle:
    """State and timers in memory, with the calls that Replay makes."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_state_is_forgotten_when_its_time_is_up():
    """Each event puts the one timer off; when it fires, the key's next event finds nothing before it."""
    processor, handle = replay.Replay(expiry=100), Handle()
    processor.init(handle)
    said = lambda seq, verb, now: [x for f in processor.handleInputRows((1,), iter([pd.DataFrame([(1, seq, verb, "a", "p")], columns=["key", "seq", "verb", "owner", "item"])]), Clock(now)) for x in f["anomaly"]]
    assert said(1, "assigned", 0) == [None] and handle.timers == [100]
    assert said(2, "assigned", 50) == ["reassigned"] and handle.timers == [150]
    assert pd.concat(processor.handleExpiredTimer((1,), Clock(150), None)).empty and handle.value is None
    assert said(3, "unassigned", 160) == ["not assigned"]


def test_odd_names_are_those_of_the_batch():
    held = ("assigned", "a", "p")
    assert [replay.odd(None, "assigned", "a", "p"), replay.odd(held, "assigned", "b", "q"), replay.odd(held, "unassigned", "b", "p"), replay.odd(held, "unassigned", "a", "q"), replay.odd(held, "unassigned", "a", "p"), replay.odd(None, "viewed", "a", "p")] == [None, "reassigned", "other address", "other paper", None, None]

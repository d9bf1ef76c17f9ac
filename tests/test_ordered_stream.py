"""Decisions in event order: streams with disorder give what the batch gives, and calls see few rows."""

import datetime as dt
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ownerscope.operators import monitor as N
from ownerscope.streaming import jobs as J
from ownerscope.streaming import ordered as O

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LIMITS = [("BURST_LIMIT", 3, 1, 10), ("GLOBAL_LIMIT", 8, 60, 60), ("HOURLY_LIMIT", 40, 3600, 300), ("DAILY_LIMIT", 200, 86400, 3600)]
PATTERNS = {"burst": (2, 1), "rapid": (4, 5), "hourly": (38, 3600)}
SCHEMA = "requester string, event_id long, ts timestamp, ok boolean"


@pytest.fixture(scope="module")
def store(spark):
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    O.state_store(spark)
    yield
    for k, v in keep.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


@pytest.fixture(scope="module")
def log(spark, store):
    """One requester sends most requests; files are in event order but for shuffled stretches, and end with a far later row."""
    rng, rows, t = random.Random(3), [], 0.0
    for i in range(500):
        t += rng.choice([0.05, 0.1, 0.5, 2, 2, 30, 400]) if rng.random() < 0.995 else 2 * 86400
        rows.append(("hot" if rng.random() < 0.8 else rng.choice(["a", "b"]), i, START + dt.timedelta(seconds=round(t, 3)), rng.random() < 0.6))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cut = [rows[k:k + 125] for k in range(0, 500, 125)]
    for a, b in zip(cut, cut[1:]):  # rows near a file's end come with the next file
        end = max(r[2] for r in a)
        late = [r for r in a if (end - r[2]).total_seconds() < 1500 and rng.random() < .5]
        a[:] = [r for r in a if r not in late]
        b += late
    for part in cut:
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("end", -1, rows[-1][2] + dt.timedelta(days=30), True)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame(rows, SCHEMA), path


def decided(spark, path, key, rule, name, rename=None):
    events = J.read_stream(spark, path, SCHEMA, 1)
    events = events.withColumnRenamed("requester", rename) if rename else events
    query = (O.decisions(events, key, "event_id", rule, delay="2 hours").writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start())
    query.awaitTermination(170)
    return {(r["event_id"], r["decision"]) for r in spark.table(name).collect()}


def batch(df, column="decision"):
    return {(r["event_id"], r[column]) for r in df.collect()}


def test_admission_in_disorder(spark, log):
    rows, path = log
    got = decided(spark, path, "requester", O.admission(LIMITS, PATTERNS), "o4")
    assert got == batch(N.admission(rows, "requester", "ts", "event_id", LIMITS, PATTERNS)) and len({d for _, d in got}) > 2


def test_limit_ttl_and_health_in_disorder(spark, log):
    rows, path = log
    assert decided(spark, path, "requester", O.sliding_limit(5, 60), "o3") == batch(N.sliding_limit(rows, "requester", "ts", "event_id", 5, 60))
    kept = {i for i, d in decided(spark, path, "requester", O.ttl_dedupe(300), "o6") if d == "kept"}
    assert kept == {r["event_id"] for r in N.ttl_dedupe(rows, "requester", "ts", "event_id", 300).collect()}
    tiers = {"hot": (2, 60), "a": (1, 300)}
    assert decided(spark, path, "source", O.source_health(tiers), "o7", "source") == batch(
        N.source_health(rows.withColumnRenamed("requester", "source"), tiers=tiers), "state")


class Store:
    """A state variable of one key."""

    def __init__(self):
        self.value = None

    def exists(self):
        return bool(self.value)

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def put(self, rows):
        self.value = list(rows)

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):
        return Store()

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_one_key_in_many_batches_sees_few_rows_a_call(spark):
    """20,000 events of one key in 200 batches: what waits and what a call decides stays within the delay, and idle state goes."""
    schema = spark.createDataFrame([], "requester string, event_id long, ts timestamp").schema
    p = O.Decisions(schema, "requester", "event_id", O.sliding_limit(30, 60), 60_000)
    handle = Handle()
    p.init(handle)
    rng, most, out = random.Random(1), 0, []
    for k in range(200):
        at = [k * 100 + rng.random() * 150 for _ in range(100)]
        frame = pd.DataFrame({"requester": "a", "event_id": range(k * 100, k * 100 + 100), "ts": [pd.Timestamp(START.replace(tzinfo=None)) + pd.Timedelta(seconds=x) for x in at]})
        assert not list(p.handleInputRows(("a",), iter([frame[:50], frame[50:]]), None))
        water = int(START.timestamp() * 1000) + (k * 100 - 100) * 1000
        for t in sorted(t for t in handle.timers if t <= water):
            handle.timers.discard(t)
            for frame in p.handleExpiredTimer(("a",), Clock(water), None):
                most = max(most, len(frame))
                out += frame["ts"].tolist()
        assert len(p.waiting.value or []) < 600
    assert most < 600 and len(out) > 19_000 and out == sorted(out)
    end = int(START.timestamp() * 1000) + 10 ** 9
    while handle.timers:
        t = min(handle.timers)
        handle.timers.discard(t)
        list(p.handleExpiredTimer(("a",), Clock(end), None))
    assert not p.waiting.exists() and not p.state.exists()

"""Streaming jobs give what the batch jobs give."""

import tempfile

import pytest
from pyspark.sql import functions as F

from ownerscope.operators import mentions as M
from ownerscope.operators import monitor as N
from ownerscope.plans.workload import view
from ownerscope.plans.monitor_queries import LIMITS, PATTERNS
from ownerscope.streaming import jobs as J


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def land(df, order, files=2):
    """Writes a table as several files in event order."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = df.withColumn("_n", F.ntile(files).over(__import__("pyspark").sql.Window.orderBy(order)))
    rows = rows.cache()
    for i in range(1, files + 1):
        rows.filter(F.col("_n") == i).drop("_n").coalesce(1).write.mode("append").parquet(path)
    return path


def run(stream, mode, name):
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start())
    query.awaitTermination(180)
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def requests(spark, sf):
    df = view(spark, sf, "v_request").withColumn("ts", F.col("ts").cast("timestamp"))
    return df, land(df, "ts")


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_sliding_limit(spark, requests):
    batch, path = requests
    stream = J.stream_sliding_limit(J.read_stream(spark, path, batch.schema, 1), n=3, seconds=21600)
    assert as_set(run(stream, "append", "m3"), "event_id", "decision") == as_set(
        N.sliding_limit(batch, "requester", "ts", "event_id", 3, 21600), "event_id", "decision")


def test_admission(spark, requests):
    batch, path = requests
    stream = J.stream_admission(J.read_stream(spark, path, batch.schema, 1), limits=LIMITS, patterns=PATTERNS)
    got = as_set(run(stream, "append", "m4"), "event_id", "decision")
    assert got == as_set(N.admission(batch, "requester", "ts", "event_id", LIMITS, PATTERNS), "event_id", "decision")
    assert len({d for _, d in got}) > 1


def test_rate_alarm_and_metrics(spark, requests):
    batch, path = requests
    stream = J.read_stream(spark, path, batch.schema, 1)
    alarms = as_set(run(J.stream_rate_alarm(stream, 86400, 5, "1 hour"), "complete", "m5"), "window_start", "detections")
    assert alarms == as_set(N.rate_alarm(batch, "ts", 86400, 5), "window_start", "detections")
    scored = lambda d: d.withColumn("score", F.lit(0.5)).withColumn("source", F.col("action"))
    got = as_set(run(J.stream_metrics(scored(stream)), "complete", "m2"), "source", "detections")
    assert got == as_set(J.stream_metrics(scored(batch)), "source", "detections")


def test_latest_and_ttl(spark, requests):
    batch, path = requests
    stream = J.read_stream(spark, path, batch.schema, 1)
    got = as_set(run(J.stream_latest(stream, "requester", "action"), "complete", "m9"), "requester", "action")
    assert got == as_set(J.stream_latest(batch, "requester", "action"), "requester", "action")
    kept = as_set(run(J.stream_ttl_dedupe(stream, "requester", 43200), "append", "m6"), "event_id")
    assert kept == as_set(N.ttl_dedupe(batch, "requester", "ts", "event_id", 43200), "event_id")


def test_source_health(spark, sf):
    batch = view(spark, sf, "v_fetch").withColumn("ts", F.col("ts").cast("timestamp"))
    path = land(batch, "ts")
    tiers = {"yahoo": (2, 86400), "news": (1, 43200)}
    got = as_set(run(J.stream_source_health(J.read_stream(spark, path, batch.schema, 1), tiers=tiers), "append", "m7"),
                 "event_id", "decision")
    want = as_set(N.source_health(batch, tiers=tiers), "event_id", "state")
    assert got == want and len({d for _, d in got}) > 1


def test_detections(spark, sf):
    docs = view(spark, sf, "v_text").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")))
    path = land(docs, "ts")
    stream = J.read_stream(spark, path, docs.schema, 1)
    got = as_set(run(J.stream_detections(stream), "append", "m1"), "doc_id", "normalized", "position")
    assert got == as_set(M.extract_mentions(docs, ["doc_id"]), "doc_id", "normalized", "position")

"""The split sink: replayed and broken batches change nothing."""

import pytest
from pyspark.sql import functions as F

from ownerscope.streaming import sinks

SCHEMA = "source string, id int, seen int, owners int, failed boolean, action string"


def rows(spark, start, n):
    return spark.createDataFrame([("s" if k % 3 else None, k, k, k, k % 2 == 0, "quarantine" if k % 7 == 0 else "accept") for k in range(start, start + n)], SCHEMA)


@pytest.fixture
def sink(spark):
    return sinks.SplitSink(spark, sinks.new_folder(spark, "test"), spark.createDataFrame([], SCHEMA).schema, ["owners"], order=["seen"], limit=3)


def content(sink, spark):
    return {name: sorted(map(tuple, sink.committed(spark, name).collect()), key=str) for name in sink.TABLES}


def test_replay_changes_nothing(spark, sink):
    assert all(not r for r in content(sink, spark).values())
    for k in range(3):
        sink.write(rows(spark, 10 * k, 10), k)
    once = content(sink, spark)
    for k in (2, 0, 1):
        sink.write(rows(spark, 10 * k, 10), k)
    assert content(sink, spark) == once
    whole = sinks.running_failures(rows(spark, 0, 30), "source", ["seen"], 3)
    clean, held = sinks.split_quarantine(whole, ["owners"])
    assert once["clean"] == sorted([(*r, r["id"] // 10) for r in clean.collect()], key=str)
    assert once["quarantined"] == sorted([(*r, r["id"] // 10) for r in held.collect()], key=str) and len(once["quarantined"]) > 6


def test_a_batch_without_commit_is_not_seen(spark, sink):
    sink.write(rows(spark, 0, 10), 0)
    once = content(sink, spark)
    sink._put("clean", rows(spark, 90, 5).withColumn("failures", F.lit(0).cast("long")), 1)  # broke off after one table
    sink._put("failures", rows(spark, 90, 5).select("source", F.lit(100).cast("long").alias("failures")), 1)
    assert content(sink, spark) == once
    sink.write(rows(spark, 10, 10), 1)
    assert [r["batch"] for r in sink.committed(spark, "clean").groupBy("batch").count().orderBy("batch").collect()] == [0, 1]
    assert sink.committed(spark, "failures").agg(F.sum("failures")).first()[0] == 10


def test_stream_into_the_sink(spark, sink):
    landing = sinks.new_folder(spark, "landing")
    for k in range(2):
        sinks.landed(rows(spark, 10 * k, 10).coalesce(1), landing)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing)
    sink.run(stream)
    once = content(sink, spark)
    sink.run(stream)  # nothing new has landed
    assert content(sink, spark) == once and len(once["clean"]) == 20

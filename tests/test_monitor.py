"""Windows, ordered folds, marts and integrity against direct computation."""

import datetime as dt
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from ownerscope import dictionaries as D
from ownerscope.operators import integrity as I
from ownerscope.operators import marts as R
from ownerscope.operators import monitor as N
from ownerscope.operators import scoring as C
from ownerscope.operators.running import PART, balanced, running

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    """Three requesters; one sends most of the requests, in bursts, with idle days."""
    rng, rows, t = random.Random(3), [], 0.0
    for i in range(900):
        t += rng.choice([0.05, 0.1, 0.5, 2, 2, 30, 400]) if rng.random() < 0.995 else 2 * 86400
        rows.append(("hot" if rng.random() < 0.8 else rng.choice(["a", "b"]), i, START + dt.timedelta(seconds=round(t, 3)),
                     rng.random() < 0.6))
    return rows, spark.createDataFrame(rows, "requester string, event_id int, ts timestamp_ntz, ok boolean")


def by_key(rows):
    out = defaultdict(list)
    for key, i, ts, ok in rows:
        out[key].append((i, (ts - START).total_seconds(), ok))
    return out


def decisions(df, column="decision"):
    return {r["event_id"]: r[column] for r in df.collect()}


def test_admission_equals_unsplit_fold(log):
    """Splitting at idle times and the blacklist override change no decision."""
    rows, df = log
    limits = [("BURST_LIMIT", 3, 1, 10), ("GLOBAL_LIMIT", 8, 60, 60), ("HOURLY_LIMIT", 40, 3600, 300), ("DAILY_LIMIT", 200, 86400, 3600)]
    patterns = {"burst": (2, 1), "rapid": (4, 5), "hourly": (38, 3600)}
    want = {}
    for events in by_key(rows).values():
        state, step = N.AdmissionState(), N.admission_step(limits, patterns)
        for i, now, _ in events:
            state, verdict = step(state, now, {})
            want[i] = verdict.partition("+")[0]
    got = decisions(N.admission(df, "requester", "ts", "event_id", limits, patterns))
    assert got == want and len(set(want.values())) >= 3


def test_sliding_limit_and_ttl(log):
    rows, df = log
    limit, kept = {}, set()
    for events in by_key(rows).values():
        window, last = deque(), None
        for i, now, _ in events:
            window = deque(t for t in window if now - t < 60)
            limit[i] = "admitted" if len(window) < 5 else "rejected"
            if len(window) < 5:
                window.append(now)
            if last is None or now - last >= 300:
                last = now
                kept.add(i)
    assert decisions(N.sliding_limit(df, "requester", "ts", "event_id", 5, 60)) == limit
    assert {r.event_id for r in N.ttl_dedupe(df, "requester", "ts", "event_id", 300).collect()} == kept


def test_source_health_equals_unsplit_fold(log):
    rows, df = log
    tiers = {"hot": (2, 60), "a": (1, 300)}
    want = {}
    for key, events in by_key(rows).items():
        state = (0, 0.0, "CLOSED")
        for i, now, ok in events:
            state, want[i] = N._health_step(now, ok, state, *tiers.get(key, (5, 60)))
    got = decisions(N.source_health(df.withColumnRenamed("requester", "source"), tiers=tiers), "state")
    assert got == want and {"OPEN", "CLOSED"} <= set(want.values())


def test_running_equals_plain_window(spark, log):
    _, df = log
    from pyspark.sql import Window
    w = Window.partitionBy("requester").orderBy("ts", "event_id")
    out = running(df, ["requester"], ["ts", "event_id"], F.date_trunc("day", "ts"), {"s": F.col("event_id")}, {"m": F.col("event_id")}, inclusive=False)
    plain = df.withColumn("s", F.coalesce(F.sum("event_id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "m", F.max("event_id").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    pick = lambda d: {(r.event_id, r.s, r.m) for r in d.select("event_id", "s", "m").collect()}
    assert pick(out) == pick(plain)


def test_timing_of_a_regular_sender(spark):
    df = spark.createDataFrame([("bot", i, START + dt.timedelta(seconds=3600 * 5 * i)) for i in range(14)],
                               "requester string, event_id int, ts timestamp_ntz")
    scores = decisions(N.timing_regularity(df, "requester", "ts", "event_id", history_seconds=30 * 86400), "timing_score")
    assert [scores[i] for i in range(14)] == [0.0] * 10 + [0.95] * 4
    assert set(decisions(N.timing_regularity(df, "requester", "ts", "event_id"), "requests").values()) == {1, 2, 3, 4, 5}  # a day's


def test_timing_of_long_even_gaps(spark):
    """Gaps of 1e6 seconds that differ by milliseconds: squares of doubles would lose the variation."""
    rng, t, rows = random.Random(5), 0, []
    for i in range(60):
        rows.append(("slow", i, START + dt.timedelta(microseconds=t)))
        t += 10 ** 12 + rng.choice([-1000, 1000])
    df = spark.createDataFrame(rows, "requester string, event_id int, ts timestamp_ntz")
    got = decisions(N.timing_regularity(df, "requester", "ts", "event_id", history_seconds=200 * 10 ** 6), "cv")
    us = [round((ts - START).total_seconds() * 1e6) for _, _, ts in rows]
    for i in range(2, 60):
        gaps = [us[j + 1] - us[j] for j in range(i) if us[i] - us[j] < 200 * 10 ** 12]
        mean = sum(gaps) / len(gaps)
        assert abs(got[i] - (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean) < 1e-13


@pytest.mark.parametrize("chunks", [1, 20])
def test_trailing_counts_and_timing_equal_direct_counting(spark, log, chunks):
    """In one chunk, and in so many that the hot requester lies in most of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(chunks))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        counted(log)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def counted(log):
    rows, df = log
    windows = {"s": 1, "m": 60, "d": 86400}
    got = {r["event_id"]: tuple(r[w] for w in windows) for r in N.trailing_counts(df, "requester", "ts", "event_id", windows).collect()}
    history = {r["event_id"]: (r["requests"], r["cv"]) for r in N.timing_regularity(df, "requester", "ts", "event_id").collect()}
    for events in by_key(rows).values():
        us = [round(t * 1e6) for _, t, _ in events]
        for k, (i, _, _) in enumerate(events):
            assert got[i] == tuple(sum(us[k] - u < w * 10 ** 6 for u in us[:k]) for w in windows.values())
            gaps = [us[j + 1] - us[j] for j in range(k) if us[k] - us[j] < 86400 * 10 ** 6]
            assert history[i][0] == len(gaps) + 1
            mean = sum(gaps) / max(len(gaps), 1)
            if mean:
                assert abs(history[i][1] - (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean) < 1e-9


def test_one_key_for_all_rows_is_dealt_over_many_chunks(spark):
    rows = [(1, (i * 7919) % 5000) for i in range(5000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        cut = balanced(spark.createDataFrame(rows, "k int, i int"), ["k"], ["i"])
        sizes = [r["count"] for r in cut.groupBy(PART).count().collect()]
        out = running(cut, ["k"], ["i"], F.col(PART), {"s": F.col("i").cast("long")}, {"m": F.col("i")})
        got = {r["i"]: (r["s"], r["m"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 15 and max(sizes) < 1000
    assert got == {i: (i * (i + 1) // 2, i) for i in range(5000)}


def test_levels_and_weakest_factor(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0), (0.9, 0.7, 0.8, 0.7, 0.6), (0.1, 0.1, 0.1, 0.1, 0.1)], "a double, b double, c double, d double, e double")
    rows = C.score_entities(df, dict(zip(C.FACTORS, [F.col(x) for x in "abcde"]))).collect()
    assert [r.level for r in rows] == ["high", "medium", "reject"]
    assert rows[1].recommendation.endswith("verify context consistency")


def test_owner_rules_and_quarantine(spark):
    rows = [("c1", "Fund A", "7.25%"), ("c1", "Fund A", "7.25%"), ("c1", "Fund B", "7.25%"), ("c1", "Fund C", "7.25%"),
            ("c2", "<script>", "5%"), ("c3", "Test Fund", "5%"), ("c4", "Good Fund", "60%"), ("c4", "Other", "50%")]
    df = spark.createDataFrame(rows, "company_id string, name string, percent string").withColumn("source", F.lit("yahoo")).withColumn(
        "seen_at", F.lit("2024-01-01 03:00:00").cast("timestamp"))
    got = {r.company_id: r for r in I.ownership_checks(df, "company_id").collect()}
    assert got["c1"].action == "quarantine" and abs(got["c1"].anomaly - 1.0) < 1e-9
    assert got["c2"].injection and got["c2"].failed and got["c3"].fake and got["c4"].failed
    clean, held = I.split_quarantine(I.ownership_checks(df, "company_id"), ["owners"])
    assert held.count() == 1 and clean.filter("company_id = 'c1'").first().owners is None


def test_series_trend_edges(spark):
    rows = [("up", "2024-01-01", 1.0), ("up", "2024-02-01", 2.0), ("flat", "2024-01-01", 1000.0), ("flat", "2024-02-01", 1000.1),
            ("one", "2024-01-01", 1.0), ("zero", "2024-01-01", 0.0), ("zero", "2024-02-01", 1.0), ("gap", "2024-01-01", 2.0),
            ("gap", "2024-02-01", None), ("gap", "2024-03-01", 1.0)]
    df = spark.createDataFrame(rows, "series_id string, date string, value double").withColumn("date", F.to_date("date"))
    assert {r.series_id: r.trend for r in R.series_trend(df).collect()} == {
        "up": "RISING", "flat": "STABLE", "one": "INSUFFICIENT_DATA", "zero": "RISING", "gap": "FALLING"}


def test_relevance_addition_order(spark):
    df = spark.createDataFrame([("a stake", "reuters", True), ("board sold 5", "x", True), ("proxy sold 5", "x", False)], "t string, s string, want boolean")
    from ownerscope.functions.text import ownership_relevance
    for r in df.select("want", (ownership_relevance(F.col("t"), F.col("s")) > 0.3).alias("got")).collect():
        assert r.got == r.want


def _with_nulls(spark):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, None), (None, 3, "2024-01-01 00:00:05"), (None, 4, None), (None, 5, "2024-01-01 00:00:06")]
    return spark.createDataFrame(rows, "requester string, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))


def test_rows_without_key_or_time_stay(spark):
    df = _with_nulls(spark)
    ids = lambda out: {r["event_id"] for r in out.collect()}
    every = {1, 2, 3, 4, 5}
    counts = N.trailing_counts(df, "requester", "ts", "event_id", {"m": 60, "h": 3600})
    assert {r["event_id"]: (r["m"], r["h"]) for r in counts.collect()} == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (1, 1)}
    regular = N.timing_regularity(df, "requester", "ts", "event_id")
    assert {r["event_id"]: r["requests"] for r in regular.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}  # no time, no history
    known = df.filter("ts is not null")
    assert ids(N.sliding_limit(known, "requester", "ts", "event_id", 1, 60)) == {1, 3, 5}
    assert {r["event_id"]: r["decision"] for r in N.sliding_limit(known, "requester", "ts", "event_id", 1, 60).collect()}[5] == "rejected"
    assert ids(N.ttl_dedupe(known, "requester", "ts", "event_id", 60)) == {1, 3}
    assert ids(N.admission(known, "requester", "ts", "event_id")) == {1, 3, 5}
    assert ids(N.running_mean(df.withColumn("v", F.lit(1.0)), ["requester"], ["ts", "event_id"], "v")) == every


def test_blacklisting_that_also_meets_a_limit(spark):
    """The mark survives a limit's verdict, in later stretches and in the statistics."""
    times = [f"2024-01-01 00:00:0{i}" for i in range(6)] + ["2024-01-04 00:00:00"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [("b", 100 + i, t) for i, t in enumerate(times[:6])],
                               "requester string, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    limits = [("tight", 5, 60, 30)]
    patterns = {"burst": (100, 1), "rapid": (100, 1), "hourly": (5, 3600)}
    got = N.admission(df, "requester", "ts", "event_id", limits, patterns)
    rows = {r["event_id"]: r for r in got.collect()}
    assert rows[5]["decision"] == "tight" and rows[5]["blacklists"] and rows[5]["restricts"]
    assert rows[6]["decision"] == "blacklisted"
    stats = N.limiter_stats(got, "requester").first()
    assert (stats["blacklisted"], stats["restricted"], stats["requesters"]) == (2, 2, 2)

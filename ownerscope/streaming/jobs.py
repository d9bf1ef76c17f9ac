"""Structured Streaming forms of the detection and monitoring jobs.

Sources are landing folders; every job is a plain DataFrame transformation, so a
caller picks the sink, the trigger and the checkpoint location. Event time is a
timestamp column ``ts``. File sources are bounded per trigger
(``files_per_trigger``), which also bounds the rows of one key in a micro-batch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ownerscope import dictionaries as D
from ownerscope.operators import detect as X
from ownerscope.operators import mentions as M
from ownerscope.operators import monitor as N
from ownerscope.sources.pages import site_of


def read_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int = 64, only: str | None = None) -> DataFrame:
    """Parquet landing folder (of its files, ``only`` those of a name pattern) as a stream; ``ts`` becomes a timestamp for watermarks."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    raw = (reader.option("pathGlobFilter", only) if only else reader).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in raw.columns else raw


def stream_detections(texts: DataFrame, delay: str = "10 minutes", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Mentions of newly landed texts; a text delivered again within the delay is skipped.

    ``texts``: key columns, text and ts. Extraction is stateless; only the keys of
    the watermark interval are kept as state.
    """
    fresh = texts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    return M.explode_mentions(M.mention_arrays(fresh), [*keys, "ts"])


def stream_layered(elements: DataFrame) -> DataFrame:
    """Layered detection on streamed elements (url, text, href, parent_tag)."""
    d = X.detect_layered(F.col("text"), F.col("href"), F.col("parent_tag"))
    return elements.withColumn("site", site_of(F.col("url"))).withColumn("d", d).filter(F.col("d").isNotNull()).select(
        *elements.columns, "site", "d.*")


def stream_metrics(detected: DataFrame, source: str = "source") -> DataFrame:
    """Running detections and mean score per source (complete or update mode)."""
    return detected.groupBy(source).agg(F.count("*").alias("detections"), F.avg("score").alias("mean_score"))


def stream_rate_alarm(events: DataFrame, seconds: int = 1, limit: int = 15, delay: str = "1 minute") -> DataFrame:
    return N.rate_alarm(events.withWatermark("ts", delay), "ts", seconds, limit)


def stream_latest(quotes: DataFrame, key: str, value: str, order: str = "event_id") -> DataFrame:
    """Latest value per key (update mode)."""
    return quotes.groupBy(key).agg(F.max_by(value, F.struct("ts", order)).alias(value), F.max("ts").alias("ts"))


# --- stateful decisions ----------------------------------------------------------
def _in_order(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """Rows of one key in one micro-batch, in event order (bounded by the trigger)."""
    return pd.concat(list(batches), ignore_index=True).sort_values(["ts", order], kind="stable")


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / N.MICRO).tolist()


def _stateful(events: DataFrame, key: str, order: str, state_schema: str, load: Callable, dump: Callable,
              decide: Callable, idle_ms: int, extra: str | None = None, delay: str = "1 hour",
              forever: Callable = lambda state: False) -> DataFrame:
    """Ordered decisions per key; keys idle for ``idle_ms`` of event time drop their state.

    Rows later than ``delay`` behind the newest event are dropped by the watermark.
    """
    columns = [key, order, "ts"]
    out = StructType([events.schema[c] for c in columns]).simpleString()[len("struct<"):-1].replace(":", " ") + ", decision string"

    def update(group, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        current = load(group[0], state.get if state.exists else None)
        pdf = _in_order(batches, order)
        verdicts = []
        for i, now in enumerate(_seconds(pdf["ts"])):
            current, verdict = decide(current, now, {} if extra is None else {extra: pdf[extra].iloc[i]})
            verdicts.append(verdict)
        state.update(dump(current))
        if not forever(current):
            state.setTimeoutTimestamp(max(int(now * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pdf[columns].assign(decision=verdicts)

    return events.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(
        update, out, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def stream_sliding_limit(events: DataFrame, key: str = "requester", order: str = "event_id", n: int = 30,
                         seconds: float = 60) -> DataFrame:
    """At most ``n`` admitted per trailing window; the state is the admitted times."""
    return _stateful(events, key, order, "kept array<double>",
                     load=lambda k, s: deque(s[0]) if s else deque(), dump=lambda s: (list(s),),
                     decide=N._limit_step(n, seconds), idle_ms=int(seconds * 1000) * 10)


def stream_ttl_dedupe(events: DataFrame, key: str, ttl_seconds: float = 300, order: str = "event_id") -> DataFrame:
    """First event of a key and each that comes the TTL or more after the last kept one."""
    decided = _stateful(events, key, order, "kept double", load=lambda k, s: s[0] if s else None, dump=lambda s: (s,),
                        decide=N._ttl_step(ttl_seconds), idle_ms=int(ttl_seconds * 1000))
    return decided.filter(F.col("decision") == "kept").drop("decision")


def _load_admission(key, stored):
    s = N.AdmissionState()
    if stored:
        s.history, s.restricted_until, s.flags, s.blacklisted = deque(stored[0]), stored[1], deque(stored[2]), stored[3]
    return s


def stream_admission(events: DataFrame, key: str = "requester", order: str = "event_id", limits=None,
                     patterns=None) -> DataFrame:
    """Tiered admission control; history is bounded by the widest limit."""
    step = N.admission_step(limits, patterns)

    def decide(s, now, row):
        s, verdict = step(s, now, row)
        return s, verdict.partition("+")[0]

    # as in the batch form: no state is left after the widest window and the longest penalty
    widest = max([max(w, p) for _, _, w, p in (limits or D.REQUEST_LIMITS)] + [600])
    return _stateful(events, key, order, "history array<double>, until double, flags array<double>, black boolean",
                     load=_load_admission,
                     dump=lambda s: (list(s.history), s.restricted_until, list(s.flags), s.blacklisted),
                     decide=decide, idle_ms=int(widest * 1000), forever=lambda s: s.blacklisted)


def stream_source_health(log: DataFrame, order: str = "event_id", tiers: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Circuit state per source after each call; sources are few and keep their state."""
    known = dict(tiers or D.SOURCE_TIERS)

    def decide(state, now, row):
        source, inner = state
        threshold, recovery = known.get(source, (5, 60))
        inner, verdict = N._health_step(now, bool(row["ok"]), inner, threshold, recovery)
        return (source, inner), verdict

    return _stateful(log, "source", order, "failures int, last double, status string",
                     load=lambda k, s: (k, tuple(s) if s else (0, 0.0, "CLOSED")), dump=lambda s: s[1],
                     decide=decide, idle_ms=86_400_000, extra="ok", forever=lambda s: True)

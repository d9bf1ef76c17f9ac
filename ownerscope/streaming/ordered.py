"""Stateful decisions in event order, across micro-batches.

``jobs`` decides events as they arrive. Here an event waits in the list state of its key until the watermark has passed it: by then
every earlier event has arrived or is late and dropped. Event-time timers, one per slot of time, release what has waited; they are
sorted and decided, so events that arrive out of order are decided as a batch over the same log decides them. A key's list holds the
events of one watermark delay, and one call sees at most an Arrow batch or what a passed slot releases, never all rows of a key in
a micro-batch. A last timer drops the state of a key that has been idle for longer than its decisions look back.

Needs the RocksDB state store (``state_store``). Events without a time are never decided; late events are dropped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ownerscope import dictionaries as D
from ownerscope.operators import monitor as N

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@dataclass(frozen=True)
class Rule:
    """A decision that depends on a key's earlier events.

    ``decide(state, seconds, row) -> (state, decision)``; ``load`` and ``dump`` turn the state from and into a row of ``schema``;
    after ``idle_ms`` without events a state for which ``forever`` is false equals a new one.
    """
    schema: str
    load: Callable[[Any, tuple | None], Any]
    dump: Callable[[Any], tuple]
    decide: Callable[[Any, float, dict], tuple[Any, str]]
    idle_ms: int
    extra: str | None = None
    forever: Callable[[Any], bool] = lambda state: False


class Decisions(StatefulProcessor):
    """Waiting events in a list state, the decision state in a value state, timers for both."""

    def __init__(self, schema: StructType, key: str, order: str, rule: Rule, slot_ms: int):
        self.schema, self.key, self.order, self.rule, self.slot_ms = schema, key, order, rule, slot_ms
        self.columns = schema.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.state = handle.getValueState("state", self.rule.schema)
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        slots = set()
        for frame in rows:
            frame = frame[frame["ts"].notna()]
            ms = frame["ts"].astype("datetime64[us]").astype("int64") // 1000
            slots.update(((ms // self.slot_ms + 1) * self.slot_ms).tolist())
            values = [tuple(_plain(v) for v in row) for row in frame[self.columns].itertuples(index=False)]
            if values:
                self.waiting.appendList(values)
        for at in slots:
            self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        at = self.columns.index("ts")
        due = [r for r in held if r[at].timestamp() * 1000 <= now]
        if due:
            rest = [r for r in held if r[at].timestamp() * 1000 > now]
            if rest:
                self.waiting.put([tuple(r) for r in rest])
            else:
                self.waiting.clear()
            yield self._decided(key, due)
        elif not held and self.last.exists() and now - self.last.get()[0] >= self.rule.idle_ms:
            current = self.rule.load(key[0], tuple(self.state.get()) if self.state.exists() else None)
            if not self.rule.forever(current):
                self.state.clear()
                self.last.clear()

    def _decided(self, key: Any, due: list) -> pd.DataFrame:
        frame = pd.DataFrame([tuple(r) for r in due], columns=self.columns).sort_values(["ts", self.order], kind="stable")
        current = self.rule.load(key[0], tuple(self.state.get()) if self.state.exists() else None)
        seconds = frame["ts"].astype("datetime64[us]").astype("int64") / N.MICRO
        verdicts = []
        for i, now in enumerate(seconds.tolist()):
            current, verdict = self.rule.decide(current, now, {} if self.rule.extra is None else {self.rule.extra: frame[self.rule.extra].iloc[i]})
            verdicts.append(verdict)
        self.state.update(self.rule.dump(current))
        last = int(seconds.iloc[-1] * 1000)
        self.last.update((last,))
        self.handle.registerTimer(last + self.rule.idle_ms + 1)
        return frame.assign(decision=verdicts)

    def close(self) -> None:
        pass


def _plain(value: Any) -> Any:
    """A value of a frame as the state store takes it."""
    if isinstance(value, pd.Timestamp):
        return value.floor("us").to_pydatetime()
    return value.item() if hasattr(value, "item") else value


def decisions(events: DataFrame, key: str, order: str, rule: Rule, delay: str = "1 hour", slot_seconds: int = 60) -> DataFrame:
    """The events (key, order, ts and what the rule reads) with their ``decision``, once the watermark has passed them."""
    columns = [key, order, "ts", *([rule.extra] if rule.extra else [])]
    schema = StructType([events.schema[c] for c in columns])
    out = StructType([*schema.fields, StructField("decision", StringType())])
    return events.select(*columns).withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(
        Decisions(schema, key, order, rule, slot_seconds * 1000), out, "Append", "EventTime")


def sliding_limit(n: int = 30, seconds: float = 60) -> Rule:
    """At most ``n`` admitted events within any trailing window."""
    return Rule("kept array<double>", lambda k, s: deque(s[0]) if s else deque(), lambda s: (list(s),), N._limit_step(n, seconds), int(seconds * 1000))


def ttl_dedupe(ttl_seconds: float = 300) -> Rule:
    """The first event of a key and each that comes the TTL or more after the last kept one are ``kept``."""
    return Rule("kept double", lambda k, s: s[0] if s else None, lambda s: (s,), N._ttl_step(ttl_seconds), int(ttl_seconds * 1000))


def admission(limits=None, patterns=None) -> Rule:
    """Tiered admission control; a blacklisted requester is kept for good."""
    step = N.admission_step(limits, patterns)

    def load(key: Any, stored: tuple | None) -> N.AdmissionState:
        s = N.AdmissionState()
        if stored:
            s.history, s.restricted_until, s.flags, s.blacklisted = deque(stored[0]), stored[1], deque(stored[2]), stored[3]
        return s

    def decide(s: N.AdmissionState, now: float, row: dict) -> tuple[N.AdmissionState, str]:
        s, verdict = step(s, now, row)
        return s, verdict.partition("+")[0]

    widest = max([max(w, p) for _, _, w, p in (limits or D.REQUEST_LIMITS)] + [600])
    return Rule("history array<double>, until double, flags array<double>, black boolean", load,
                lambda s: (list(s.history), s.restricted_until, list(s.flags), s.blacklisted), decide, int(widest * 1000),
                forever=lambda s: s.blacklisted)


def source_health(tiers: dict[str, tuple[int, int]] | None = None) -> Rule:
    """Circuit state of a source after each call."""
    known = dict(tiers or D.SOURCE_TIERS)

    def decide(state: tuple, now: float, row: dict) -> tuple[tuple, str]:
        source, inner = state
        inner, verdict = N._health_step(now, bool(row["ok"]), inner, *known.get(source, (5, 60)))
        return (source, inner), verdict

    return Rule("failures int, last double, status string", lambda k, s: (k, tuple(s) if s else (0, 0.0, "CLOSED")), lambda s: s[1], decide,
                86_400_000, extra="ok", forever=lambda s: True)

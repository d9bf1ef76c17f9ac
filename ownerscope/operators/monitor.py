"""Request and source monitoring: windows, limits, admission control, health."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ownerscope import dictionaries as D
from ownerscope.operators.running import PART, balanced, idle_sessions, running
from ownerscope.session import materialize

MICRO = 1_000_000


def trailing_sums(df: DataFrame, key: str, ts: str, order: str, windows: dict[str, int], values: dict[str, Column]) -> DataFrame:
    """Adds ``<window>_<value>``: sums over the key's earlier rows that are strictly younger than each window.

    A sum over a trailing window is the difference of two running sums, the row's and that of the moment the window begins, so
    sums must be exact (integers, decimals). Rows are cut into chunks of bounded size by a range partitioning over (key, time); a
    key that lies within a chunk is answered where it lies, by a search among its times. Only a chunk's first and last key can go
    on in others: for those, at most one for each boundary, ``_across`` orders rows and moments together. Rows that share a
    time count in the order of ``order``. A row without a time has no earlier ones.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    names = [f"{w}_{n}" for w in windows for n in values]
    types = {n: "bigint" if df.select(v).schema[0].dataType.typeName() in ("byte", "short", "integer", "long") else "decimal(38,0)" for n, v in values.items()}
    rows = df.select("*", us.alias("_us"), *[F.coalesce(v, F.lit(0)).cast(types[n]).alias(f"_v_{n}") for n, v in values.items()])
    schema = StructType([*rows.schema.fields, *[StructField(f"{w}_{n}", rows.schema[f"_v_{n}"].dataType) for w in windows for n in values],
                         StructField(PART, IntegerType()), StructField("_edge", BooleanType())])
    fields, widest = list(values), max(windows.values()) * MICRO
    # a value of a key's rows before each, whole numbers of any size
    plain = {n: t == "bigint" for n, t in types.items()}

    def sums(table: pa.Table) -> dict[str, np.ndarray]:
        """Of the rows of whole keys, in order."""
        at = table.column("_us")
        none = at.null_count and at.is_null().to_numpy()
        times = at.fill_null(0).to_numpy()
        keys = table.column(key)
        starts = _starts(keys)
        out = {}
        before = {}
        for n in fields:
            v = table.column(f"_v_{n}")
            v = v.to_numpy() if plain[n] else np.array([int(x) for x in v.to_pylist()], object)
            before[n] = np.concatenate([np.zeros(1, v.dtype), np.cumsum(v)])
        ends = [*starts[1:], len(times)]
        begins = starts if not at.null_count else [a + int(none[a:b].sum()) for a, b in zip(starts, ends)]  # rows without a time come first
        # all keys on one line, further apart than the widest window, where the numbers allow it
        span, line = int(times.max() - times.min()) + widest + 1, None
        if not at.null_count and len(starts) * span < 1 << 62:
            line = np.repeat(np.arange(len(starts)), np.diff([*starts, len(times)])) * span + (times - times.min())
        for w, seconds in windows.items():
            if line is not None:
                first = np.searchsorted(line, line - seconds * MICRO, side="right")
            else:
                first = np.concatenate([np.zeros(0, np.int64), *[
                    np.concatenate([np.arange(a, m), m + np.searchsorted(times[m:b], times[m:b] - seconds * MICRO, side="right")])
                    for a, m, b in zip(starts, begins, ends)]])
            for n in fields:
                out[f"{w}_{n}"] = before[n][:-1] - before[n][first]
        return out

    def answered(table: pa.Table, part: int, edge: bool) -> Iterator[pa.RecordBatch]:
        found = sums(table)
        for w in names:
            n = next(v for v in fields if w.endswith(f"_{v}"))
            column = pa.array(found[w]) if plain[n] else pa.array([Decimal(int(x)) for x in found[w]], pa.decimal128(38, 0))
            table = table.append_column(w, column)
        table = table.append_column(PART, pa.array(np.full(len(table), part, np.int32))).append_column("_edge", pa.array(np.full(len(table), edge)))
        yield from table.combine_chunks().to_batches()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, first = TaskContext.get().partitionId(), [], True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            starts = _starts(pa.chunked_array([x.column(key) for x in held]))
            if len(starts) == 1:
                continue  # one key, perhaps with more rows to come
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = [0, starts[1], starts[-1]] if first else [0, starts[-1]]
            for begin, end in zip(cuts, cuts[1:]):
                if begin < end:
                    yield from answered(table.slice(begin, end - begin).combine_chunks(), part, first)
                first = False
            held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            yield from answered(pa.Table.from_batches(held).combine_chunks(), part, True)

    by = [key, "_us", order]
    placed = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(local, schema))
    across = placed.where("_edge").groupBy(F.col(key).alias("_key")).agg(F.min(PART).alias("_a"), F.max(PART).alias("_b")).where("_a < _b").select("_key")
    inner = placed.select(*df.columns, *names)
    if across.isEmpty():
        return inner
    same = F.col(key).eqNullSafe(F.col("_key"))
    wide = placed.join(across, same, "left_semi")
    more = _across(wide.select(*df.columns, *[f"_v_{n}" for n in values]), key, ts, order, windows, {n: F.col(f"_v_{n}") for n in values})
    return inner.join(across, same, "left_anti").unionByName(more.select(*inner.columns))


def _starts(keys: pa.ChunkedArray) -> list[int]:
    """Where a new key begins in a sorted column; nulls are equal to each other."""
    keys = keys.combine_chunks()
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.chunk(0)
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
    return [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist()]


def _across(df: DataFrame, key: str, ts: str, order: str, windows: dict[str, int], values: dict[str, Column]) -> DataFrame:
    """``trailing_sums`` by one balanced prefix scan over rows and, for each window of a row, a probe at the moment it begins."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    row = F.struct(*[F.col(c) for c in df.columns])
    kinds = list(windows)
    own = F.struct(us.alias("at"), F.lit(0).alias("kind"), F.col(order).alias("ord"), row.alias("row"),
                   F.struct(*[v.alias(n) for n, v in values.items()]).alias("v"))
    types = {f.name: f.dataType for f in df.select(own.alias("e")).schema["e"].dataType.fields}
    null = lambda n: F.lit(None).cast(types[n]).alias(n)
    probes = [F.struct((us - windows[w] * MICRO).alias("at"), F.lit(k + 1).alias("kind"), null("ord"), null("row"), null("v")) for k, w in enumerate(kinds)]
    events = df.withColumn("_id", F.monotonically_increasing_id()).select("_id", F.col(key).alias("_key"), F.explode(F.array(own, *probes)).alias("e"))
    events = events.select("_id", "_key", "e.*")
    by = ["at", "kind", "ord"]
    placed = running(balanced(events, ["_key"], by), ["_key"], by, F.col(PART), inclusive=False,
                     sums={f"_s_{n}": F.coalesce(F.col("v")[n], F.lit(0).cast(types["v"][n].dataType)) for n in values})
    held = lambda k, n: F.max(F.when(F.col("kind") == k, F.col(f"_s_{n}")))
    out = placed.groupBy("_id").agg(F.first("row", ignorenulls=True).alias("row"), F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("_at"), *[
        (held(0, n) - held(k + 1, n)).alias(f"{w}_{n}") for k, w in enumerate(kinds) for n in values])
    return out.select("row.*", *[F.when(F.col("_at").isNull(), F.lit(0).cast(out.schema[f"{w}_{n}"].dataType)).otherwise(F.col(f"{w}_{n}")).alias(f"{w}_{n}")
                                 for w in kinds for n in values])


def trailing_counts(df: DataFrame, key: str, ts: str, order: str, windows: dict[str, int]) -> DataFrame:
    """Earlier requests of the key within each trailing window (strictly younger)."""
    out = trailing_sums(df, key, ts, order, windows, {"n": F.lit(1).cast("long")})
    return out.withColumnsRenamed({f"{w}_n": w for w in windows})


def timing_regularity(df: DataFrame, key: str, ts: str, order: str, min_requests: int = D.TIMING_MIN_REQUESTS,
                      max_cv: float = D.TIMING_MAX_CV, history_seconds: int = D.TIMING_HISTORY) -> DataFrame:
    """Regularity of the gaps in each request's history: 0.95 when suspiciously even.

    The history are the requests of the last ``history_seconds``, the request itself included. Gaps are whole microseconds and
    their sums exact, so the variation of long, almost equal gaps is not lost in the difference of their squares.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = balanced(df.withColumn("_us", us), [key], ["_us", order])
    # the next request's time is the least of what follows: the running maximum of the negated times from the end
    rows = running(rows, [key], [F.desc("_us"), F.desc(order)], -F.col(PART), maxes={"_next": -F.col("_us")}, inclusive=False)
    gap = (-F.col("_next") - F.col("_us")).cast("decimal(18,0)")
    rows = trailing_sums(rows.withColumn("_gap", gap).drop("_us", PART, "_next"), key, ts, order, {"_h": history_seconds}, {
        "n": F.lit(1).cast("long"), "s1": F.col("_gap").cast("decimal(38,0)"), "s2": (F.col("_gap") * F.col("_gap")).cast("decimal(38,0)")})
    n, s1, s2 = F.col("_h_n"), F.col("_h_s1"), F.col("_h_s2")
    spread = (n.cast("decimal(12,0)") * s2).cast("decimal(38,0)") - (s1 * s1).cast("decimal(38,0)")
    rows = rows.withColumn("requests", n + 1).withColumn("cv", F.sqrt(spread.cast("double")) / F.nullif(s1.cast("double"), F.lit(0.0)))
    score = F.when((F.col("requests") > min_requests) & (F.col("cv") < max_cv), 0.95).otherwise(0.0)
    return rows.withColumn("timing_score", score).drop("_gap", "_h_n", "_h_s1", "_h_s2")


def running_mean(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean of everything up to and including the row."""
    out = running(balanced(df, keys, order), keys, order, F.col(PART), sums={"_n": F.lit(1), "_s": F.col(value)})
    return out.withColumn("running_mean", F.col("_s") / F.col("_n")).drop("_n", "_s", PART)


def failure_streaks(log: DataFrame, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Consecutive failures per source after each call, and whether that opens the circuit."""
    part = F.col(PART)
    out = running(balanced(log, ["source"], [ts, order]), ["source"], [ts, order], part, sums={"_f": (~F.col("ok")).cast("bigint")})
    out = running(out, ["source"], [ts, order], part, maxes={"_at": F.when(F.col("ok"), F.col("_f"))})
    out = out.withColumn("streak", F.col("_f") - F.coalesce("_at", F.lit(0)))
    tiers = F.create_map(*[F.lit(x) for s, (n, _) in D.SOURCE_TIERS.items() for x in (s, n)])
    return out.withColumn("open", F.col("streak") >= F.coalesce(F.try_element_at(tiers, F.col("source")), F.lit(5))).drop("_f", "_at", PART)


def rate_alarm(df: DataFrame, ts: str = "ts", seconds: int = 1, limit: int = 15) -> DataFrame:
    """Aligned windows with more than ``limit`` detections."""
    return (df.groupBy(F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds").alias("w"))
            .agg(F.count("*").alias("detections")).filter(F.col("detections") > limit)
            .select(F.col("w.start").alias("window_start"), "detections"))


# --- ordered folds -----------------------------------------------------------
# A decision that depends on earlier decisions of the same key needs the rows in
# order. The rows are split where the state is certainly empty, shuffled by
# (key, stretch), sorted by Spark and streamed in Arrow batches; only the small
# decision state is held in Python, never a whole group.
Decide = Callable[[object, float, dict], tuple[object, str]]


def ordered_fold(df: DataFrame, keys: list[str], segment: str, ts: str, order: str,
                 start: Callable[[tuple], object], decide: Decide, extra: list[str] | None = None) -> DataFrame:
    """Adds ``decision``: ``decide(state, seconds, row) -> (state, decision)`` in order."""
    schema = StructType(df.schema.fields + [StructField("decision", StringType())])
    names = [f.name for f in df.schema.fields]
    extra = extra or []

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            seconds = pdf[ts].astype("datetime64[us]").astype("int64").to_numpy() / MICRO
            group = list(zip(*[pdf[c] for c in [*keys, segment]]))
            values = {c: pdf[c].to_numpy() for c in extra}
            decisions = []
            for i, g in enumerate(group):
                if g != current:
                    current, state = g, start(g)
                state, verdict = decide(state, seconds[i], {c: v[i] for c, v in values.items()})
                decisions.append(verdict)
            yield pdf[names].assign(decision=decisions)

    ordered = df.repartition(*keys, segment).sortWithinPartitions(*keys, segment, ts, order)
    return ordered.mapInPandas(fold, schema)


def _limit_step(n: int, seconds: float):
    def decide(state, now, row):
        while state and now - state[0] >= seconds:
            state.popleft()
        if len(state) >= n:
            return state, "rejected"
        state.append(now)
        return state, "admitted"
    return decide


def sliding_limit(df: DataFrame, key: str, ts: str, order: str, n: int = 30, seconds: float = 60) -> DataFrame:
    """At most ``n`` admitted requests of a key within any trailing window."""
    rows = idle_sessions(df, [key], ts, [ts, order], seconds)
    return ordered_fold(rows, [key], "session", ts, order, lambda g: deque(), _limit_step(n, seconds)).drop("session")


def _ttl_step(ttl: float):
    def decide(state, now, row):
        if state is None or now - state >= ttl:
            return now, "kept"
        return state, "repeat"
    return decide


def ttl_dedupe(df: DataFrame, key: str, ts: str, order: str, ttl_seconds: float = 300) -> DataFrame:
    """First row of a key is kept; repeats within the TTL of the last kept row are dropped."""
    rows = idle_sessions(df, [key], ts, [ts, order], ttl_seconds)
    folded = ordered_fold(rows, [key], "session", ts, order, lambda g: None, _ttl_step(ttl_seconds))
    return folded.filter(F.col("decision") == "kept").drop("session", "decision")


class AdmissionState:
    """What admission control remembers about one requester."""

    __slots__ = ("history", "restricted_until", "flags", "blacklisted", "flagged")

    def __init__(self):
        self.history: deque = deque()
        self.restricted_until = float("-inf")
        self.flags: deque = deque()
        self.blacklisted = False
        self.flagged = False  # by the last decision


def _recent(history: deque, now: float, seconds: float) -> int:
    n = 0
    for t in reversed(history):
        if now - t >= seconds:
            break
        n += 1
    return n


def _even_gaps(history: deque, max_cv: float) -> bool:
    h = list(history)
    gaps = [b - a for a, b in zip(h, h[1:])]
    mean = sum(gaps) / len(gaps)
    var = sum((g - mean) ** 2 for g in gaps) / len(gaps)
    return mean > 0 and (var ** 0.5) / mean < max_cv


#: marks of decisions that found a suspicious pattern, or after which the requester is restricted or blacklisted
FLAGS, RESTRICTS, BLACKLISTS = "+flag", "+restrict", "+blacklist"


def admission_step(limits=None, patterns=None, timing=(D.TIMING_MIN_REQUESTS, D.TIMING_MAX_CV)):
    """Decision function of tiered admission control.

    Order: blacklist, temporary restriction, suspicious patterns, tiered limits.
    Only admitted requests enter the history. A pattern found now restricts the
    following requests; the request itself still meets the limits. A decision that
    leaves the requester restricted or blacklisted carries that as a mark.
    """
    limits = limits or D.REQUEST_LIMITS
    patterns = patterns or D.PATTERN_LIMITS
    day = max(window for _, _, window, _ in limits)

    def decide(s: AdmissionState, now: float, row) -> tuple[AdmissionState, str]:
        s, verdict = judged(s, now)
        if verdict in ("blacklisted", "restricted"):
            return s, verdict
        return s, verdict + (FLAGS if s.flagged else "") + (RESTRICTS if now < s.restricted_until else "") + (BLACKLISTS if s.blacklisted else "")

    def judged(s: AdmissionState, now: float) -> tuple[AdmissionState, str]:
        if s.blacklisted:
            return s, "blacklisted"
        if now < s.restricted_until:
            return s, "restricted"
        s.flagged = False
        while s.history and now - s.history[0] >= day:
            s.history.popleft()
        while s.flags and now - s.flags[0] >= 300:
            s.flags.popleft()

        def flag(penalty: float, needed: int) -> None:
            s.flags.append(now)
            s.flagged = True
            if len(s.flags) >= needed:
                s.restricted_until = now + penalty

        if _recent(s.history, now, patterns["burst"][1]) >= patterns["burst"][0]:
            flag(60, 2)
        if _recent(s.history, now, patterns["rapid"][1]) >= patterns["rapid"][0]:
            flag(300, 1)
        if len(s.history) > timing[0] and _even_gaps(s.history, timing[1]):
            flag(600, 3)
        if _recent(s.history, now, patterns["hourly"][1]) >= patterns["hourly"][0]:
            s.flags.append(now)
            s.flagged = s.blacklisted = True
        for name, requests, window, penalty in limits:
            if _recent(s.history, now, window) >= requests:
                s.restricted_until = now + penalty
                return s, name
        s.history.append(now)
        return s, "admitted"

    return decide


def admission(df: DataFrame, key: str, ts: str, order: str, limits=None, patterns=None) -> DataFrame:
    """Tiered admission control over a request log, one decision per request.

    All state but the blacklist is gone after an idle time longer than the widest
    window and the longest penalty, so requesters split there; a blacklisting
    then overrides every later stretch of the requester. ``flags`` tells whether the
    request showed a suspicious pattern, ``restricts`` and ``blacklists`` whether it
    left the requester in that state.
    """
    limits = limits or D.REQUEST_LIMITS
    idle = max([max(w, p) for _, _, w, p in limits] + [600])
    rows = idle_sessions(df, [key], ts, [ts, order], idle)
    decided = ordered_fold(rows, [key], "session", ts, order, lambda g: AdmissionState(),
                           admission_step(limits, patterns))
    black = F.col("decision").endswith(BLACKLISTS)
    first = decided.groupBy(F.col(key).alias("_key")).agg(F.min(F.when(black, F.col("session"))).alias("_from"))
    later = F.coalesce(F.col("session") > F.col("_from"), F.lit(False))
    out = decided.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.withColumn("flags", ~later & F.col("decision").contains(FLAGS)).withColumn("restricts", ~later & F.col("decision").contains(RESTRICTS)).withColumn("blacklists", ~later & black).withColumn(
        "decision", F.when(later, "blacklisted").otherwise(F.regexp_replace("decision", r"\+.*$", ""))).drop("_from", "_key", "session")


def limiter_stats(decided: DataFrame, key: str) -> DataFrame:
    """Requesters seen, blacklisted, restricted and suspicious at least once (their last request may have done it)."""
    per = decided.groupBy(key).agg(
        F.max((F.col("decision") == "blacklisted") | F.col("blacklists")).alias("b"),
        F.max((F.col("decision") == "restricted") | F.col("restricts")).alias("g"),
        F.max(F.col("decision") == "admitted").alias("a"), F.max("flags").alias("s"))
    return per.agg(F.count_if("s").alias("suspicious"), F.count_if("a").alias("active"), F.count_if("b").alias("blacklisted"),
                   F.count_if("g").alias("restricted"), F.count("*").alias("requesters"))


def _health_step(now: float, ok: bool, state: tuple, threshold: int, recovery: float) -> tuple[tuple, str]:
    failures, last, status = state
    if status == "OPEN":
        if now - last > recovery:
            status = "HALF_OPEN"
        else:
            return (failures, last, status), "OPEN"
    if ok:
        return (0, last, "CLOSED"), "CLOSED"
    failures += 1
    status = "OPEN" if failures >= threshold else status
    return (failures, now, status), status


def source_health(log: DataFrame, ts: str = "ts", order: str = "event_id",
                  tiers: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Circuit state per source after each call (calls while open are not executed).

    A success with no failure in the recovery time before it certainly closes the
    circuit; the log splits after such rows.
    """
    tiers = tiers or D.SOURCE_TIERS
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    part = F.col(PART)
    rows = running(balanced(log, ["source"], [ts, order]), ["source"], [ts, order], part, maxes={"_bad": F.when(~F.col("ok"), us)}, inclusive=False)
    slow = max(r for _, r in tiers.values()) * MICRO
    reset = F.col("ok") & F.coalesce(us - F.col("_bad") > slow, F.lit(True))
    rows = running(rows.withColumn("_reset", reset.cast("bigint")), ["source"], [ts, order], part,
                   sums={"_seg": F.col("_reset")}, inclusive=False)
    known = dict(tiers)

    def start(group: tuple):
        return (group[0], (0, 0.0, "CLOSED"))

    def decide(state, now, row):
        source, inner = state
        threshold, recovery = known.get(source, (5, 60))
        inner, verdict = _health_step(now, bool(row["ok"]), inner, threshold, recovery)
        return (source, inner), verdict

    return ordered_fold(rows.drop("_bad", "_reset", PART), ["source"], "_seg", ts, order, start, decide,
                        extra=["ok"]).drop("_seg").withColumnRenamed("decision", "state")

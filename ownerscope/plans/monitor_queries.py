"""Request-log and source-health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ownerscope.functions.text import requester_key
from ownerscope.operators import monitor as N
from ownerscope import dictionaries as D
from ownerscope.plans import sqlparts as Q
from ownerscope.plans.registry import query
from ownerscope.plans.workload import cte, table, view

# the test log is sparse, so the windows are hours instead of seconds
WINDOWS = {"w_1h": 3600, "w_6h": 21600, "w_1d": 86400, "w_7d": 604800}
LIMITS = [("BURST_LIMIT", 2, 3600, 1800), ("GLOBAL_LIMIT", 3, 21600, 7200), ("HOURLY_LIMIT", 6, 86400, 14400), ("DAILY_LIMIT", 20, 604800, 86400)]
PATTERNS = {"burst": (2, 7200), "rapid": (3, 14400), "hourly": (12, 604800)}


def _trailing(name: str, seconds: int) -> str:
    return (f"cast(count(*) over (partition by requester order by us range between {seconds * 1000000 - 1} preceding and current row) "
            f"- (count(*) over (partition by requester, us) - row_number() over (partition by requester, us order by event_id)) - 1 as bigint) as {name}")


@query("trailing_request_counts", f"""{cte('v_request')}, r as (select *, epoch_us(ts) as us from v_request)
select requester, event_id, {", ".join(_trailing(n, s) for n, s in WINDOWS.items())} from r""")
def trailing_request_counts(spark, sf):
    return N.trailing_counts(view(spark, sf, "v_request"), "requester", "ts", "event_id", WINDOWS).select(
        "requester", "event_id", *WINDOWS)


HISTORY = 30 * 86400


@query("request_timing", f"""{cte('v_request')},
g as (select *, epoch_us(ts) as us, row_number() over o as rn, lead(epoch_us(ts)) over o - epoch_us(ts) as gap from v_request window o as (partition by requester order by ts, event_id)),
w as (select a.requester, a.event_id, count(b.us) + 1 as requests, avg(b.gap) as mean, stddev_pop(b.gap) as sd
  from g a left join g b on b.requester = a.requester and b.rn < a.rn and a.us - b.us < {HISTORY * 1000000} group by all)
select requester, event_id, requests, round(sd / mean, 4) as cv, case when requests > 10 and coalesce(sd / mean < 0.75, false) then 0.95::double else 0e0 end as timing_score from w""")
def request_timing(spark, sf):
    out = N.timing_regularity(view(spark, sf, "v_request"), "requester", "ts", "event_id", max_cv=0.75, history_seconds=HISTORY)
    return out.select("requester", "event_id", "requests", F.round("cv", 4).alias("cv"), "timing_score")


@query("running_value_mean", """select event_type, event_id, round(avg(value) over (partition by event_type order by ts, event_id rows unbounded preceding) + 1e-9, 6) as running_mean from events""")
def running_value_mean(spark, sf):
    out = N.running_mean(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value")
    return out.select("event_type", "event_id", F.round(F.col("running_mean") + 1e-9, 6).alias("running_mean"))


_TIER = "case source " + " ".join(f"when '{k}' then {n}" for k, (n, _) in D.SOURCE_TIERS.items()) + " end"


@query("failure_streaks", f"""{cte('v_fetch')},
f as (select *, sum(case when ok then 1 else 0 end) over (partition by source order by ts, event_id rows unbounded preceding) as grp from v_fetch),
s as (select source, event_id, cast(sum(case when ok then 0 else 1 end) over (partition by source, grp order by ts, event_id rows unbounded preceding) as bigint) as streak from f)
select source, event_id, streak, streak >= {_TIER} as open from s""")
def failure_streaks(spark, sf):
    return N.failure_streaks(view(spark, sf, "v_fetch")).select("source", "event_id", F.col("streak").cast("bigint").alias("streak"), "open")


@query("rate_alarms", """select time_bucket(interval '3600 seconds', ts) as window_start, count(*) as detections from events group by 1 having count(*) > 15""")
def rate_alarms(spark, sf):
    out = N.rate_alarm(table(spark, sf, "events"), seconds=3600, limit=15)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _limit_sql(n: int, seconds: int) -> str:
    """The fold row by row: admitted timestamps travel in a list."""
    return f"""with recursive v_request as (select user_id as requester, event_id, ts from events),
o as (select requester, event_id, epoch_us(ts) as us, row_number() over (partition by requester order by ts, event_id) as rn from v_request),
fold as (select requester, event_id, rn, [us] as kept, true as ok from o where rn = 1
  union all select o.requester, o.event_id, o.rn, case when len(x.l) < {n} then list_append(x.l, o.us) else x.l end, len(x.l) < {n}
  from fold f join o on o.requester = f.requester and o.rn = f.rn + 1,
  lateral (select list_filter(f.kept, lambda t: o.us - t < {seconds * 1000000}) as l) x)
select requester, event_id, case when ok then 'admitted' else 'rejected' end as decision from fold"""


@query("sliding_limit", _limit_sql(3, 21600))
def sliding_limit(spark, sf):
    return N.sliding_limit(view(spark, sf, "v_request"), "requester", "ts", "event_id", 3, 21600).select("requester", "event_id", "decision")


def _admission_ctes() -> str:
    """The decisions request by request: history and flags travel in lists, times in microseconds; ``fold`` has them all."""
    us = lambda seconds: int(seconds * 1_000_000)
    recent = lambda seconds: f"len(list_filter(h, lambda t: us - t < {us(seconds)}))"
    limit = "case " + " ".join(f"when {recent(w)} >= {n} then '{name}'" for name, n, w, _ in LIMITS) + " end"
    penalty = "case verdict " + " ".join(f"when '{name}' then {us(p)}" for name, _, _, p in LIMITS) + " end"
    even = f"list_aggregate(gaps, 'avg') > 0 and list_aggregate(gaps, 'stddev_pop') / list_aggregate(gaps, 'avg') < {D.TIMING_MAX_CV}"
    return f"""with recursive v_request as (select user_id as requester, event_id, ts from events),
o as (select requester, event_id, epoch_us(ts) as us, row_number() over (partition by requester order by ts, event_id) as rn from v_request),
fold as (select distinct requester, cast(null as bigint) as event_id, cast(0 as bigint) as rn, cast([] as bigint[]) as history, cast(0 as bigint) as until, cast([] as bigint[]) as flags,
    false as black, '' as decision, false as flagged, false as restricts, false as blacklists from o
  union all select requester, event_id, rn, case when open and verdict is null then list_append(h, us) when open then h else history end,
    case when open then case when verdict is not null then us + {penalty} when timing and n3 >= 3 then us + {us(600)} when rapid then us + {us(300)} when burst and n1 >= 2 then us + {us(60)} else until end else until end,
    case when open then list_concat(f, list_transform(range(0, n3 + hourly::int - len(f)), lambda i: us)) else flags end,
    black or (open and hourly), case when black then 'blacklisted' when not open then 'restricted' else coalesce(verdict, 'admitted') end,
    open and (burst or rapid or timing or hourly),
    open and us < case when verdict is not null then us + {penalty} when timing and n3 >= 3 then us + {us(600)} when rapid then us + {us(300)} when burst and n1 >= 2 then us + {us(60)} else until end,
    open and hourly
  from (select *, len(f) + burst::int as n1, len(f) + burst::int + rapid::int + timing::int as n3 from
    (select *, {recent(PATTERNS['burst'][1])} >= {PATTERNS['burst'][0]} as burst, {recent(PATTERNS['rapid'][1])} >= {PATTERNS['rapid'][0]} as rapid,
      len(h) > {D.TIMING_MIN_REQUESTS} and coalesce({even}, false) as timing, {recent(PATTERNS['hourly'][1])} >= {PATTERNS['hourly'][0]} as hourly, {limit} as verdict from
      (select *, list_transform(range(1, len(h)), lambda i: h[i + 1] - h[i]) as gaps from
        (select o.requester, o.event_id, o.rn, o.us, history, until, flags, black, not black and o.us >= until as open,
          list_filter(history, lambda t: o.us - t < {us(max(w for _, _, w, _ in LIMITS))}) as h, list_filter(flags, lambda t: o.us - t < {us(300)}) as f
         from fold join o on o.requester = fold.requester and o.rn = fold.rn + 1) a) b) c) d)"""


@query("admission_control", f"{_admission_ctes()} select requester, event_id, decision from fold where rn > 0")
def admission_control(spark, sf):
    """Tiered admission decisions over the whole request log."""
    return N.admission(view(spark, sf, "v_request"), "requester", "ts", "event_id", LIMITS, PATTERNS).select(
        "requester", "event_id", "decision")


@query("limiter_stats", f"""{_admission_ctes()}, per as (select requester, max(decision = 'admitted') as a, max(decision = 'blacklisted' or blacklists) as b,
  max(decision = 'restricted' or restricts) as g, max(flagged) as s from fold where rn > 0 group by requester)
select count_if(s) as suspicious, count_if(a) as active, count_if(b) as blacklisted, count_if(g) as restricted, count(*) as requesters from per""")
def limiter_stats(spark, sf):
    return N.limiter_stats(N.admission(view(spark, sf, "v_request"), "requester", "ts", "event_id", LIMITS, PATTERNS), "requester")


_HEALTH_TIERS = {k: (n, r * 60) for k, (n, r) in D.SOURCE_TIERS.items()}
_THRESHOLD = "case source " + " ".join(f"when '{k}' then {n}" for k, (n, _) in _HEALTH_TIERS.items()) + " else 5 end"
_RECOVERY = "case source " + " ".join(f"when '{k}' then {r * 1_000_000}" for k, (_, r) in _HEALTH_TIERS.items()) + " else 60000000 end"


@query("source_health", f"""{cte('v_fetch').replace('with ', 'with recursive ', 1)},
o as (select source, event_id, ok, epoch_us(ts) as us, row_number() over (partition by source order by ts, event_id) as rn, {_THRESHOLD} as threshold, {_RECOVERY} as recovery from v_fetch),
fold as (select distinct source, cast(null as bigint) as event_id, false as ok, cast(0 as bigint) as rn, 0 as failures, cast(0 as bigint) as last, 'CLOSED' as state from o
  union all select o.source, o.event_id, o.ok, o.rn, case when blocked then failures when o.ok then 0 else failures + 1 end, case when blocked or o.ok then last else us end,
    case when blocked then 'OPEN' when o.ok then 'CLOSED' when failures + 1 >= threshold then 'OPEN' when state = 'OPEN' then 'HALF_OPEN' else state end
  from fold join o on o.source = fold.source and o.rn = fold.rn + 1, lateral (select fold.state = 'OPEN' and o.us - fold.last <= o.recovery as blocked) x)
select source, event_id, ok, state from fold where rn > 0""")
def source_health(spark, sf):
    """Circuit state after each call of the fetch log."""
    return N.source_health(view(spark, sf, "v_fetch"), tiers=_HEALTH_TIERS).select("source", "event_id", "ok", "state")


@query("ttl_deduplicated", """with recursive o as (select user_id as requester, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events),
fold as (select requester, event_id, rn, us as last, true as kept from o where rn = 1
  union all select o.requester, o.event_id, o.rn, case when o.us - f.last >= 43200000000 then o.us else f.last end, o.us - f.last >= 43200000000
  from fold f join o on o.requester = f.requester and o.rn = f.rn + 1)
select requester, event_id from fold where kept""")
def ttl_deduplicated(spark, sf):
    return N.ttl_dedupe(view(spark, sf, "v_request"), "requester", "ts", "event_id", 43200).select("requester", "event_id")


_ORIGIN = "case event_id % 5 when 0 then '' when 1 then 'https://www.forbes.com/x' when 2 then 'http://a.example.org:8080/y?z' when 3 then 'not a url' else null end"


@query("requester_keys", f"""select event_id, concat(cast(user_id as varchar), '_', case when o is null or o = '' then 'unknown' when regexp_matches(o, '^https?://') then regexp_extract(o, '^https?://([^/:]+)', 1) else 'invalid' end) as requester_key
from (select *, {_ORIGIN} as o from events) x""")
def requester_keys(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", requester_key(F.col("user_id"), F.expr(_ORIGIN)).alias("requester_key"))


@query("latest_values", """select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_values(spark, sf):
    """Latest quote per key, as an aggregate rather than a sort."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("q")).select("user_id", "q.*")

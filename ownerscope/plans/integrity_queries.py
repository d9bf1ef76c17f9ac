"""Feed rule checks, anomaly scores, fingerprints and quarantine queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ownerscope import dictionaries as D
from ownerscope.operators import integrity as I
from ownerscope.plans import sqlparts as Q
from ownerscope.plans.registry import query
from ownerscope.plans.workload import cte, table, view

_PCT = "concat(cast(cast(pct as decimal(12,2)) as varchar(20)), '%')"


def _owners(spark, sf):
    return view(spark, sf, "v_owner").select(
        "company_id", "name", F.concat(F.col("pct").cast("decimal(12,2)").cast("string"), F.lit("%")).alias("percent"),
        F.when(F.col("company_id") % 3 == 0, "yahoo").otherwise("registry").alias("source"), "seen_at", "shares")


_OWN = f"""{cte('v_owner')}, own as (select company_id, name, {_PCT} as percent, case when company_id % 3 = 0 then 'yahoo' else 'registry' end as source, seen_at, pct from v_owner)"""
_BAD_NAME = f"not regexp_matches(name, {Q.rx(D.OWNER_NAME_PATTERN)})"
_BAD_PCT = f"not regexp_matches(percent, {Q.rx(D.OWNER_PERCENT_PATTERN)})"


def _violations(checks: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in checks) + "], lambda x: x is not null), '|')"


@query("owner_rule_violations", f"""{_OWN} select v, count(*) as n from (select {_violations([('bad_name', _BAD_NAME), ('bad_percent', _BAD_PCT)])} as v from own) x group by v""")
def owner_rule_violations(spark, sf):
    v = F.array_join(I.owner_violations(F.col("name"), F.col("percent")), "|")
    return _owners(spark, sf).groupBy(v.alias("v")).agg(F.count("*").alias("n"))


@query("entity_rule_violations", f"""{cte('v_entity')} select jurisdiction, {_violations([('bad_jurisdiction', "not regexp_matches(jurisdiction, '^[a-z]{2,3}$')")])} as v,
  lower(jurisdiction) not in {Q.strings(D.ALLOWED_JURISDICTIONS)} as unlisted, lower(jurisdiction) in {Q.strings(D.OFFSHORE_CODES)} as offshore, count(*) as n from v_entity group by all""")
def entity_rule_violations(spark, sf):
    from ownerscope.functions.text import is_offshore
    e = view(spark, sf, "v_entity")
    return e.groupBy("jurisdiction", F.array_join(I.entity_violations(F.col("name"), F.col("jurisdiction")), "|").alias("v"),
                     I.unlisted_jurisdiction(F.col("jurisdiction")).alias("unlisted"),
                     is_offshore(F.col("jurisdiction")).alias("offshore")).agg(F.count("*").alias("n"))


_CID = "case when o_orderkey % 10 = 0 then 'short' when o_orderkey % 10 = 1 then concat('AWD ', cast(o_orderkey as varchar(20)), ' x') else concat('awd_', lpad(cast(o_orderkey as varchar(20)), 8, '0')) end"
_CAM = "case when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then -o_totalprice when o_orderkey % 7 = 2 then o_totalprice * 1e8 else o_totalprice end"


@query("contract_rule_violations", f"""with c as (select {_CID} as award_id, {_CAM} as amount from orders)
select v, count(*) as n from (select {_violations([('missing_amount', 'amount is null'), ('bad_award', f"not regexp_matches(award_id, {Q.rx(D.AWARD_ID_PATTERN, 'i')})"), ('bad_amount', f"coalesce(amount, 0) < 0 or coalesce(amount, 0) > {D.MAX_AWARD_AMOUNT}")])} as v from c) x group by v""")
def contract_rule_violations(spark, sf):
    o = table(spark, sf, "orders").select(F.expr(_CID).alias("award_id"), F.expr(_CAM).cast("decimal(30,2)").alias("amount"))
    v = F.array_join(I.contract_violations(F.col("award_id"), F.lit("x"), F.col("amount")), "|")
    return o.groupBy(v.alias("v")).agg(F.count("*").alias("n"))


_INJ = "case p_partkey % 8 when 0 then '<script>x' when 1 then 'JavaScript:alert' when 2 then 'a OnClick=b' when 3 then 'union  select 1' when 4 then '../etc' when 5 then 'windows' when 6 then 'John Doe' else 'A Sample Fund' end"


@query("injection_and_fake_checks", f"""with t as (select p_partkey, concat({_INJ}, case when p_partkey % 3 = 0 then p_name else '' end) as name from part)
select p_partkey, {" or ".join(f"regexp_matches(lower(name), {Q.rx(p)})" for p in D.INJECTION_PATTERNS)} as injection,
  {Q.contains_any('lower(name)', D.FAKE_NAME_PARTS)} or name in {Q.strings(D.FAKE_NAMES)} as fake from t""")
def injection_and_fake_checks(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.concat(F.expr(_INJ), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise("")).alias("name"))
    return t.select("p_partkey", I.has_injection(F.to_json(F.struct("name"))).alias("injection"), I.is_fake_owner(F.col("name")).alias("fake"))


@query("owner_shapes", """select o_orderkey, o_orderkey % 5 not in (1, 2, 3) as valid from orders""")
def owner_shapes(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    owner = F.struct(F.when(k != 1, F.lit("a")).alias("name"), F.when(k != 2, F.col("o_totalprice")).alias("percent"))
    return o.select("o_orderkey", I.owner_shape(F.when(k != 3, F.lit(1)), F.array(owner)).alias("valid"))


_CHECKED = f"""{_OWN},
agg as (select company_id, source, count(*) as owners, count_if({_BAD_NAME} or {_BAD_PCT}) as bad_owners,
  bool_or({" or ".join(f"regexp_matches(lower(name), {Q.rx(p)})" for p in D.INJECTION_PATTERNS)}) as injection,
  bool_or({Q.contains_any('lower(name)', D.FAKE_NAME_PARTS)}) as fake, sum(pct) as total_percent, var_pop(case when pct > 0 then pct end) as variance,
  count_if(pct > 0) as n, count(distinct lower(name)) as distinct_names, max(seen_at) as seen_at from own group by company_id, source),
sc as (select *, least(1e0, case when n > 0 and variance > 100 then 0.3::double else 0e0 end + case when n > 3 and variance < 0.01 then 0.5::double else 0e0 end
  + case when distinct_names < owners then 0.4::double else 0e0 end + case when extract(hour from seen_at) < 6 or extract(hour from seen_at) > 22 then 0.1::double else 0e0 end) as anomaly,
  owners > 50 or bad_owners > 0 or injection or fake or total_percent > 105 as failed from agg),
chk as (select *, case when failed then 'reject' when anomaly > 0.95 then 'quarantine' when anomaly > 0.8 then 'warn' else 'accept' end as action,
  substr(sha256(concat('{{"ownerCount":', cast(owners as varchar), ',"hasOwnershipData":true,"source":"', source, '"}}')), 1, 16) as fingerprint from sc)"""


def _checked(spark, sf):
    return I.ownership_checks(_owners(spark, sf), "company_id").withColumn(
        "fingerprint", I.ownership_fingerprint(F.col("owners"), F.col("source")))


@query("ownership_integrity", f"""{_CHECKED} select company_id, source, owners, bad_owners, injection, fake, round(total_percent, 4) as total_percent,
  round(variance + 1e-9, 4) as variance, distinct_names, round(anomaly, 9) as anomaly, failed, action, fingerprint from chk""".replace("{{", "{").replace("}}", "}"))
def ownership_integrity(spark, sf):
    return _checked(spark, sf).select(
        "company_id", "source", "owners", "bad_owners", "injection", "fake", F.round("total_percent", 4).alias("total_percent"),
        F.round(F.col("variance") + 1e-9, 4).alias("variance"), "distinct_names", F.round("anomaly", 9).alias("anomaly"), "failed", "action", "fingerprint")


_RUN = f"""{_CHECKED}, run as (select *, cast(sum(case when failed then 1 else 0 end) over (partition by source order by seen_at, company_id rows unbounded preceding) as bigint) as failures from chk),
act as (select * exclude (action), case when failed and failures > 5 then 'quarantine' else action end as action from run)""".replace("{{", "{").replace("}}", "}")


def _escalated(spark, sf):
    return I.running_failures(_checked(spark, sf), "source", ["seen_at", "company_id"])


@query("failure_escalation", f"{_RUN} select company_id, source, failures, action from act")
def failure_escalation(spark, sf):
    return _escalated(spark, sf).select("company_id", "source", "failures", "action")


@query("quarantine_split", f"""{_RUN} select company_id, case when action = 'quarantine' then case when failed then 'Multiple integrity failures detected' else 'Critical anomaly detected' end end as reason,
  case when action <> 'quarantine' then owners end as owners from act""")
def quarantine_split(spark, sf):
    """Clean records with emptied payloads, joined back with the reason of the held ones."""
    clean, held = I.split_quarantine(_escalated(spark, sf), ["owners"])
    return clean.select("company_id", "owners").join(held.select("company_id", "reason"), "company_id", "left")


@query("quarantine_stats", f"""{_RUN} select count_if(action = 'quarantine') as quarantined, count_if(failed) as failures, count(distinct fingerprint) as fingerprints from act""")
def quarantine_stats(spark, sf):
    return I.quarantine_stats(_escalated(spark, sf))


@query("new_fingerprints", f"""{_RUN} select distinct source, fingerprint from act a where seen_at >= timestamp '1998-12-15'
and not exists (select 1 from act b where b.seen_at < timestamp '1998-12-15' and b.source = a.source and b.fingerprint = a.fingerprint)""")
def new_fingerprints(spark, sf):
    c = _checked(spark, sf).select("source", "fingerprint", "seen_at")
    cut = F.lit("1998-12-15").cast("timestamp_ntz")
    return I.new_fingerprints(c.filter(F.col("seen_at") >= cut), c.filter(F.col("seen_at") < cut).select("source", "fingerprint"))


@query("source_baselines", f"""{_CHECKED} select source, count(*) as samples, round(avg(owners), 6) as avg_owners, round(avg(length(fingerprint) + owners), 6) as avg_size from chk where anomaly < 0.3 group by source""".replace("{{", "{").replace("}}", "}"))
def source_baselines(spark, sf):
    b = I.baselines(_checked(spark, sf), F.length("fingerprint") + F.col("owners"))
    return b.withColumn("avg_owners", F.round("avg_owners", 6)).withColumn("avg_size", F.round("avg_size", 6))


@query("symbol_conflicts", """with s as (select user_id as company_id, concat('src', cast(event_id % 3 as varchar)) as source,
  concat('T', cast(case when event_id % 3 = 2 then value else user_id end as integer)) as symbol, event_id as ord from events),
l as (select * from s qualify row_number() over (partition by company_id, source order by ord desc) = 1)
select a.company_id, a.source as source_a, b.source as source_b, a.symbol as symbol_a, b.symbol as symbol_b from l a join l b
on a.company_id = b.company_id and a.source < b.source and a.symbol <> b.symbol""".replace("value else user_id end as integer", "floor(value) else user_id end as integer"))
def symbol_conflicts(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 3
    s = e.select(F.col("user_id").alias("company_id"), F.concat(F.lit("src"), k.cast("string")).alias("source"),
                 F.concat(F.lit("T"), F.when(k == 2, F.floor("value")).otherwise(F.col("user_id")).cast("int").cast("string")).alias("symbol"),
                 F.col("event_id").alias("ord"))
    return I.symbol_conflicts(s)


@query("anomaly_counters", """select source, type, count(*) as flags, count(*) - 1 > 5 as suspicious from (
  select concat('s', cast(user_id % 40 as varchar)) as source, event_type as type from events) x group by source, type""")
def anomaly_counters(spark, sf):
    e = table(spark, sf, "events")
    return I.anomaly_counter(e.select(F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("source"), F.col("event_type").alias("type")))

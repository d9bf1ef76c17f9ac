"""Feed flattening and enrichment-mart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ownerscope import dictionaries as D
from ownerscope.functions.text import (
    agency_weight, headline_sentiment, is_classified, is_offshore, key_indicators, money_scale, registry_match,
)
from ownerscope.operators import marts as R
from ownerscope.plans import sqlparts as Q
from ownerscope.plans.registry import query
from ownerscope.plans.workload import cte, table, view
from ownerscope.sources import feeds as S


# --- landed JSON --------------------------------------------------------------
@query("ownership_feed", """select l_orderkey as order_id, l_linenumber as line, cast(i as integer) as ord, concat('Owner ', cast(l_suppkey + i as varchar)) as name,
  floor(l_discount * 100 * 100 + 0.5::double) / 100 as percent, case when i % 3 = 0 then 0 else cast(l_quantity as bigint) + i end as shares
from (select *, unnest(range(0, 12)) as i from lineitem) x where (l_suppkey + i) % 10 <> 0 and i < 10""")
def ownership_feed(spark, sf):
    """Ownership documents of twelve entries each; entries without a name drop after the first ten are taken."""
    line = table(spark, sf, "lineitem")
    owner = lambda i: F.col("l_suppkey") + i
    listed = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(
        F.when(owner(i) % 10 == 0, "").otherwise(F.concat(F.lit("Owner "), owner(i).cast("string"))).alias("organization"),
        F.struct(F.col("l_discount").alias("raw")).alias("pctHeld"),
        F.when(i % 3 != 0, F.struct((F.col("l_quantity").cast("bigint") + i).alias("raw"))).alias("position")))
    raw = line.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.to_json(F.struct(F.struct(
        F.array(F.struct(F.struct(listed.alias("ownershipList")).alias("institutionOwnership"))).alias("result"))
        .alias("quoteSummary"))).alias("payload"))
    return S.flatten_ownership(raw, ["order_id", "line"], first=10)


@query("registry_feed", f"""{cte('v_entity')}
select entity_id, name, jurisdiction, company_number, status, lower(jurisdiction) in {Q.strings(D.OFFSHORE_CODES)} as is_offshore from v_entity""")
def registry_feed(spark, sf):
    e = view(spark, sf, "v_entity")
    raw = e.select("entity_id", "term", F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(
        "name", F.col("jurisdiction").alias("jurisdiction_code"), "company_number", F.col("status").alias("current_status"))
        .alias("company"))).alias("companies")).alias("results"))).alias("payload"))
    return S.flatten_registry(raw, ["entity_id"], "term").select(
        "entity_id", "name", "jurisdiction", "company_number", "status", "is_offshore")


@query("contract_feed", f"""{cte('v_contract')}
select award_id, recipient_name, amount, agency, description, {Q.contains_any('lower(description)', D.CLASSIFIED_KEYWORDS)} as is_classified,
  case agency {" ".join(f"when {Q.s(k)} then {v}::double" for k, v in D.AGENCY_WEIGHTS.items())} else 1.0::double end as agency_risk from v_contract""")
def contract_feed(spark, sf):
    c = view(spark, sf, "v_contract")
    raw = c.select("recipient_id", F.to_json(F.struct(F.array(F.struct(
        F.col("award_id").alias("Award ID"), F.col("recipient_name").alias("Recipient Name"),
        F.col("amount").cast("string").alias("Award Amount"), F.col("award_type").alias("Award Type"),
        F.col("agency").alias("Awarding Agency"), F.col("description").alias("Description"))).alias("results"))).alias("payload"))
    return S.flatten_contracts(raw, ["recipient_id"]).select(
        "award_id", "recipient_name", "amount", "agency", "description", "is_classified", "agency_risk")


@query("news_feed", f"""{cte('v_article')} select doc_id, title, md5(description) as body, source_id from v_article""")
def news_feed(spark, sf):
    a = view(spark, sf, "v_article")
    raw = a.select("doc_id", F.to_json(F.struct(F.array(F.struct(
        "title", "description", F.struct(F.col("source_id").alias("id")).alias("source"))).alias("articles"))).alias("payload"))
    return S.flatten_news(raw, ["doc_id"]).select("doc_id", "title", F.md5("description").alias("body"), "source_id")


_PERIOD = ("1998-08-01", "2001-08-01")


@query("contract_scan", f"""{cte('v_contract')}
select recipient_id, award_id, amount, agency, cast(row_number() over (partition by recipient_id order by amount desc, award_id) as integer) as rank
from v_contract where award_type in ('A', 'B', 'C', 'D') and start_date between timestamp '{_PERIOD[0]}' and timestamp '{_PERIOD[1]}'
qualify row_number() over (partition by recipient_id order by amount desc, award_id) <= 50""")
def contract_scan(spark, sf):
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in _PERIOD)
    return R.contract_scan(view(spark, sf, "v_contract"), lo, hi).select("recipient_id", "award_id", "amount", "agency", "rank")


_SERIES_SRC = f"""{cte('v_series')}, s as (select series_id, cast(date as date) as date, case when extract(month from date) % 5 = 0 then null else value end as value from v_series),
r as (select *, row_number() over (partition by series_id order by date desc) as rn from s qualify rn <= 12),
k as (select *, row_number() over (partition by series_id order by date desc) as rank from r where value is not null qualify rank <= 6)"""


def _series(spark, sf):
    s = view(spark, sf, "v_series")
    return s.select("series_id", F.col("date").cast("date").alias("date"),
                    F.when(F.month("date") % 5 != 0, F.col("value")).alias("value"))


def _series_landed(spark, sf):
    """The same observations through the JSON form of the feed."""
    rows = _series(spark, sf).select(F.to_json(F.struct("series_id", F.array(F.struct(
        F.col("date").cast("string").alias("date"),
        F.coalesce(F.col("value").cast("string"), F.lit(".")).alias("value"))).alias("observations"))).alias("payload"))
    return S.flatten_series(rows)


@query("series_scan", f"{_SERIES_SRC} select series_id, date, round(value, 2) as value, cast(rank as integer) as rank from k")
def series_scan(spark, sf):
    return R.series_scan(_series_landed(spark, sf)).select("series_id", "date", F.round("value", 2).alias("value"), "rank")


_TREND = f"""{_SERIES_SRC}, two as (select series_id, max(case when rank = 1 then value end) as cur, max(case when rank = 2 then value end) as prev, count(*) as n from k where rank <= 2 group by series_id),
trend as (select series_id, cur, prev, case when n < 2 then 'INSUFFICIENT_DATA' when abs((cur - prev) / prev * 100) < 0.1 then 'STABLE'
  when (cur - prev) / prev > 0 then 'RISING' else 'FALLING' end as trend from two)"""


@query("series_trend", f"{_TREND} select series_id, round(cur, 2) as current, round(prev, 2) as previous, trend from trend")
def series_trend(spark, sf):
    return R.series_trend(_series(spark, sf)).select(
        "series_id", F.round("current", 2).alias("current"), F.round("previous", 2).alias("previous"), "trend")


_SECTOR = "case c_custkey % 6 when 0 then 'Financial' when 1 then 'Technology' when 2 then 'Energy' when 3 then 'Healthcare' when 4 then 'Default' else 'Mining' end"


@query("sector_indicators", f"""with c as (select c_custkey as company_id, {_SECTOR} as sector from customer)
select company_id, sector, unnest(case sector {" ".join(f"when {Q.s(k)} then {Q.list_of(v)}" for k, v in D.SECTOR_SERIES.items())} else {Q.list_of(D.SECTOR_SERIES['Default'])} end) as series_id from c""")
def sector_indicators(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.expr(_SECTOR).alias("sector"))
    return R.sector_series(c).drop("indicator_ord")


def _macro_sql() -> str:
    def t(series):
        return "coalesce(t_FEDFUNDS, t_TB3MS)" if series == "RATES" else f"t_{series}"
    every = sorted({x for v in D.SECTOR_SERIES.values() for x in v})
    cols = ", ".join(f"max(case when series_id = '{x}' then trend end) as t_{x}" for x in every)
    lists = {k: ", ".join(
        f"case when {t(series)} = '{trend}'" + (f" and sector = '{sec}'" if sec else "") + f" then {Q.s(text)} end"
        for kind, sec, series, trend, text in D.MACRO_RULES if kind == k) for k in ("opportunities", "risks", "implications")}
    made = ", ".join(f"list_filter([{v}], lambda x: x is not null) as {k}" for k, v in lists.items())
    return f"""{_TREND}, c as (select c_custkey as company_id, {_SECTOR} as sector from customer),
ind as (select company_id, sector, unnest(case sector {" ".join(f"when {Q.s(k)} then {Q.list_of(v)}" for k, v in D.SECTOR_SERIES.items())} else {Q.list_of(D.SECTOR_SERIES['Default'])} end) as series_id from c),
w as (select company_id, sector, {cols} from ind left join trend using (series_id) group by company_id, sector),
l as (select company_id, sector, {made} from w)
select company_id, sector as sector_used, array_to_string(opportunities, '|') as opportunities, array_to_string(risks, '|') as risks,
  array_to_string(implications, '|') as implications,
  trim(concat('Economic context for ', sector, ' sector: ',
    case when len(opportunities) > 0 then concat('Opportunities include ', lower(opportunities[1]), '. ') else '' end,
    case when len(risks) > 0 then concat('Key risks: ', lower(risks[1]), '. ') else '' end,
    case when len(implications) > 0 then concat('Ownership impact: ', lower(implications[1]), '.') else '' end)) as summary from l"""


@query("macro_context", _macro_sql())
def macro_context(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.expr(_SECTOR).alias("sector"))
    out = R.macro_context(c, R.series_trend(_series(spark, sf)), "company_id")
    for k in ("opportunities", "risks", "implications"):
        out = out.withColumn(k, F.array_join(k, "|"))
    return out


# --- registry ------------------------------------------------------------------
_OFFSHORE = f"""{cte('v_entity')},
j as (select group_id, jurisdiction, count(*) as n, jurisdiction in {Q.strings(D.OFFSHORE_CODES)} as off from v_entity group by group_id, jurisdiction),
g as (select group_id, cast(sum(case when off then n else 0 end) as bigint) as offshore_count, count(*) as jurisdictions,
  string_agg(concat(jurisdiction, '=', cast(n as varchar)), '|' order by jurisdiction) as breakdown,
  bool_or(jurisdiction in {Q.strings(D.SECRECY_CODES)}) as secret from j group by group_id),
p as (select *, list_filter([case when offshore_count > 2 then 'Multiple offshore jurisdictions detected' end,
  case when secret then 'High-secrecy jurisdiction detected' end, case when jurisdictions > 5 then 'Complex multi-jurisdictional structure' end], lambda x: x is not null) as pat from g)"""


@query("offshore_structure", f"""{_OFFSHORE} select group_id, offshore_count, jurisdictions, breakdown, array_to_string(pat, '|') as patterns,
  case when len(pat) >= 2 or offshore_count >= 3 then 'HIGH' when len(pat) >= 1 or offshore_count >= 1 then 'MEDIUM' else 'LOW' end as risk from p""")
def offshore_structure(spark, sf):
    out = R.offshore_structure(view(spark, sf, "v_entity"), "group_id")
    entries = F.transform(F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("breakdown", F.array_join(entries, "|")).withColumn("patterns", F.array_join("patterns", "|"))


_MATCH = """case when a = b then 100 when contains(b, a) then 85 when contains(a, b) then 75 else
  cast(floor(len(list_filter(string_split(a, ' '), lambda w: len(list_filter(string_split(b, ' '), lambda v: contains(v, w) or contains(w, v))) > 0))::double
    / greatest(len(string_split(a, ' ')), len(string_split(b, ' '))) * 60 + 0.5::double) as integer) end"""


@query("registry_top_matches", f"""{cte('v_entity')},
m as (select *, lower(term) as a, lower(replace(name, '#', ' ')) as b, jurisdiction in {Q.strings(D.OFFSHORE_CODES)} as off from v_entity),
s as (select *, {_MATCH} as confidence from m)
select group_id, entity_id, off as is_offshore, cast(confidence as integer) as confidence,
  cast(row_number() over (partition by group_id order by off desc, confidence desc, entity_id) as integer) as rank from s
qualify row_number() over (partition by group_id order by off desc, confidence desc, entity_id) <= 5""")
def registry_top_matches(spark, sf):
    e = view(spark, sf, "v_entity").withColumn("is_offshore", is_offshore(F.col("jurisdiction"))).withColumn(
        "confidence", registry_match(F.col("term"), F.replace("name", F.lit("#"), F.lit(" "))))
    top = R.top_k(e, ["group_id"], [F.desc("is_offshore"), F.desc("confidence"), F.asc("entity_id")], 5)
    return top.select("group_id", "entity_id", "is_offshore", "confidence", "rank")


# --- contracts -----------------------------------------------------------------
_HIGH, _MEDIUM = 5e6, 1e6
_DEPENDENCY = f"""{cte('v_contract')},
c as (select *, {Q.contains_any('lower(description)', D.CLASSIFIED_KEYWORDS)} as cl from v_contract),
a as (select recipient_id, agency, sum(amount) as amount from c group by recipient_id, agency),
ag as (select recipient_id, max(amount) as top, max(case when agency = 'DEPARTMENT OF DEFENSE' then amount end) as dod,
  string_agg(concat(agency, '=', cast(cast(floor(amount) as bigint) as varchar)), '|' order by agency) as agencies from a group by recipient_id),
ty as (select recipient_id, string_agg(concat(award_type, '=', cast(n as varchar)), '|' order by award_type) as types
  from (select recipient_id, award_type, count(*) as n from c group by 1, 2) x group by recipient_id),
tot as (select recipient_id, sum(amount) as total, count_if(cl) as classified from c group by recipient_id),
d as (select *, coalesce(dod > total * 0.3::double, false) as is_dod, total > 0 and top / total > 0.7::double as is_one from tot join ag using (recipient_id) join ty using (recipient_id)),
e as (select *, list_filter([case when total > {_HIGH} then 'High total contract value (>${_HIGH / 1e6:g}M)' when total > {_MEDIUM} then 'Significant contract value (>${_MEDIUM / 1e6:g}M)' end,
  case when is_dod then 'High defense dependency (>30%)' end, case when classified > 0 then 'Classified/sensitive contracts detected' end,
  case when is_one then 'High agency concentration (>70%)' end], lambda x: x is not null) as reasons,
  case when is_dod or classified > 0 or is_one or total > {_HIGH} then 'HIGH' when total > {_MEDIUM} then 'MEDIUM' else 'LOW' end as risk from d)"""


@query("government_dependency", f"""{_DEPENDENCY} select recipient_id, round(total, 2) as total_value, cast(classified as bigint) as classified_count, agencies, types,
  array_to_string(reasons, '|') as reasons, risk from e""")
def government_dependency(spark, sf):
    out = R.gov_dependency(view(spark, sf, "v_contract"), "recipient_id", high=_HIGH, medium=_MEDIUM)
    agencies = F.transform(F.map_entries("agencies"), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"]).cast("string")))
    types = F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("recipient_id", F.round("total_value", 2).alias("total_value"), "classified_count",
                      F.array_join(agencies, "|").alias("agencies"), F.array_join(types, "|").alias("types"),
                      F.array_join("reasons", "|").alias("reasons"), "risk")


@query("dependency_explanations", f"""{_DEPENDENCY} select recipient_id, risk, case risk
  when 'HIGH' then concat('High government dependency detected. Total contracts: ', m, '. Key risks: ', array_to_string(reasons, ', '), '.')
  when 'MEDIUM' then concat('Moderate government exposure. Total contracts: ', m, '. Monitor for revenue concentration.')
  else 'Limited government contracts detected. Low dependency risk.' end as explanation
from (select *, case when total >= 1e6 then concat('$', format('{{:.1f}}', floor(total / 1e6 * 10 + 0.5::double) / 10), 'M')
  else concat('$', format('{{:.1f}}', floor(total / 1e3 * 10 + 0.5::double) / 10), 'K') end as m from e) x""")
def dependency_explanations(spark, sf):
    out = R.gov_dependency(view(spark, sf, "v_contract"), "recipient_id", high=_HIGH, medium=_MEDIUM)
    return R.dependency_text(out).select("recipient_id", "risk", "explanation")


@query("money_scale", """select o_orderkey, case when v >= 1e9 then floor(v / 1e9 * 10 + 0.5::double) / 10 when v >= 1e6 then floor(v / 1e6 * 10 + 0.5::double) / 10
  when v >= 1e3 then floor(v / 1e3 * 10 + 0.5::double) / 10 else v end as amount,
  case when v >= 1e9 then 'B' when v >= 1e6 then 'M' when v >= 1e3 then 'K' else '' end as unit
from (select o_orderkey, o_totalprice * case o_orderkey % 4 when 0 then 0.001::double when 1 then 1::double when 2 then 100::double else 10000::double end as v from orders) x""")
def money_scale_query(spark, sf):
    k = F.col("o_orderkey") % 4
    v = F.col("o_totalprice") * F.when(k == 0, 0.001).when(k == 1, 1.0).when(k == 2, 100.0).otherwise(10000.0)
    o = table(spark, sf, "orders").select("o_orderkey", v.alias("v"))
    return o.select("o_orderkey", money_scale(F.col("v")).alias("m")).select("o_orderkey", "m.*")


@query("largest_contracts", f"""{cte('v_contract')} select recipient_id, award_id, amount,
  cast(row_number() over (partition by recipient_id order by amount desc, award_id) as integer) as rank from v_contract
qualify row_number() over (partition by recipient_id order by amount desc, award_id) <= 10""")
def largest_contracts(spark, sf):
    return R.top_k(view(spark, sf, "v_contract"), ["recipient_id"], [F.desc("amount"), F.asc("award_id")], 10).select(
        "recipient_id", "award_id", "amount", "rank")


# --- news ----------------------------------------------------------------------
_TEXT = "concat(title, ' ', description)"


def _relevance_sql() -> str:
    e = "0e0"
    for w in D.OWNERSHIP_KEYWORDS:
        e = f"({e} + case when contains(low, {Q.s(w)}) then 0.2::double else 0e0 end)"
    e = f"({e} + case when source_id in {Q.strings(D.TIER1_SOURCES)} then 0.1::double else 0e0 end)"
    for p in D.OWNERSHIP_PATTERNS:
        e = f"({e} + case when regexp_matches(low, {Q.rx(p, 'i')}) then 0.15::double else 0e0 end)"
    return f"least(1e0, {e})"


def _count(words) -> str:
    return "(" + " + ".join(f"cast(contains(low, {Q.s(w)}) as integer)" for w in words) + ")"


_ARTICLES = f"""{cte('v_article')}, lo as (select *, lower({_TEXT}) as low from v_article),
art as (select *, {_relevance_sql()} as relevance,
  case when {_count(D.HEADLINE_POSITIVE)} > {_count(D.HEADLINE_NEGATIVE)} then 'POSITIVE'
       when {_count(D.HEADLINE_NEGATIVE)} > {_count(D.HEADLINE_POSITIVE)} then 'NEGATIVE' else 'NEUTRAL' end as sentiment,
  array_to_string(list_concat(list_transform(regexp_extract_all(low, '(\\d+(?:\\.\\d+)?)%', 0), lambda x: concat('Percentage: ', x)),
    list_transform(regexp_extract_all(low, '(?i)\\$(\\d+(?:\\.\\d+)?)\\s*(billion|million|b|m)', 0), lambda x: concat('Amount: ', x)),
    list_transform(list_filter({Q.list_of(D.INVESTOR_TYPES)}, lambda t: contains(low, t)), lambda t: concat('Investor Type: ', t)))[1:3], '|') as indicators from lo)"""


@query("scored_articles", f"{_ARTICLES} select doc_id, company_id, round(relevance, 9) as relevance, relevance > 0.3::double as relevant, sentiment, indicators from art")
def scored_articles(spark, sf):
    a = R.scored_articles(view(spark, sf, "v_article"))
    return a.select("doc_id", "company_id", F.round("relevance", 9).alias("relevance"),
                    (F.col("relevance") > 0.3).alias("relevant"), "sentiment", F.array_join("indicators", "|").alias("indicators"))


@query("news_sentiment", f"""{_ARTICLES}, n as (select company_id, count(*) as n, count_if(sentiment = 'POSITIVE')::double / count(*) as p,
  count_if(sentiment = 'NEGATIVE')::double / count(*) as g, count_if(sentiment = 'NEUTRAL')::double / count(*) as z from art group by company_id)
select company_id, n as articles, case when p > 0.6 then 'POSITIVE' when g > 0.6 then 'NEGATIVE' when p > g then 'SLIGHTLY_POSITIVE'
  when g > p then 'SLIGHTLY_NEGATIVE' else 'NEUTRAL' end as overall,
  case when p > 0.6 then concat(cast(floor(p * 100 + 0.5::double) as integer), '% positive coverage') when g > 0.6 then concat(cast(floor(g * 100 + 0.5::double) as integer), '% negative coverage')
   when p > g then 'Moderately positive sentiment' when g > p then 'Moderately negative sentiment' else 'Mixed sentiment signals' end as reason,
  cast(floor(p * 100 + 0.5::double) as integer) as positive_pct, cast(floor(g * 100 + 0.5::double) as integer) as negative_pct,
  cast(floor(z * 100 + 0.5::double) as integer) as neutral_pct from n""")
def news_sentiment(spark, sf):
    return R.sentiment_summary(R.scored_articles(view(spark, sf, "v_article")), "company_id")


@query("ownership_triggers", f"""{_ARTICLES}, tr as (
  select company_id, doc_id, title, 0 as sub, 'ACTIVIST_ACTIVITY' as type, 0.8::double as confidence from art where relevance > 0.3 and (contains(low, 'activist') or contains(low, 'proxy'))
  union all select company_id, doc_id, title, 1, 'M&A_ACTIVITY', 0.9::double from art where relevance > 0.3 and (contains(low, 'acquisition') or contains(low, 'merger'))
  union all select company_id, doc_id, title, 2, 'STAKE_INCREASE', 0.7::double from art where relevance > 0.3 and contains(low, 'increased') and contains(low, 'stake')
  union all select company_id, doc_id, title, 3, 'POSITION_REDUCTION', 0.6::double from art where relevance > 0.3 and (contains(low, 'sold') or contains(low, 'reduced')))
select company_id, doc_id, title, type, confidence, cast(row_number() over (partition by company_id order by confidence desc, doc_id, sub) as integer) as rank from tr
qualify row_number() over (partition by company_id order by confidence desc, doc_id, sub) <= 5""")
def ownership_triggers(spark, sf):
    a = R.scored_articles(view(spark, sf, "v_article")).filter(F.col("relevance") > 0.3)
    return R.ownership_triggers(a).select("company_id", "doc_id", "title", "type", "confidence", "rank")


@query("news_scan", f"""{_ARTICLES} select company_id, doc_id, cast(row_number() over (partition by company_id order by doc_id) as integer) as rank from art
where source_id in {Q.strings(D.TIER1_SOURCES)} and contains(low, 'stake') and regexp_matches(low, '{"|".join(D.OWNERSHIP_KEYWORDS[:5])}')
qualify row_number() over (partition by company_id order by doc_id) <= 20""")
def news_scan(spark, sf):
    return R.news_scan(view(spark, sf, "v_article"), F.lit("Stake")).select("company_id", "doc_id", "rank")


# --- ownership lookup and merge --------------------------------------------------
_LOOK = "case p_partkey % 9 when 0 then 'Berkshire Hathaway Inc' when 1 then 'JPMorgan Chase' when 2 then 'Bank of Elsewhere' when 3 then 'Tesla Motors' when 4 then 'Apple' when 5 then 'Americas' else p_name end"


@query("ownership_lookup", f"""with n as (select p_partkey, {_LOOK} as name from part),
k as (select *, coalesce(list_filter({Q.list_of(D.OWNERSHIP_TABLE)}, lambda k: contains(lower(name), k) or contains(k, string_split(lower(name), ' ')[1]))[1], 'default') as table_key from n),
o as (select * from (values {", ".join(f"({Q.s(k)}, {i}, {Q.s(n)}, {p}::double, {s if s is not None else 'null'}::bigint)" for k, rows in D.OWNERSHIP_TABLE.items() for i, (n, p, s) in enumerate(rows))}) v(table_key, owner_ord, owner, percent, shares))
select p_partkey, name, table_key, owner_ord, owner, percent, shares from k join o using (table_key)""")
def ownership_lookup(spark, sf):
    n = table(spark, sf, "part").select("p_partkey", F.expr(_LOOK).alias("name"))
    return R.lookup_ownership(n)


def _merge(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"))
    owners = view(spark, sf, "v_owner").select("company_id", F.col("owner_id").alias("ord"), "name", F.col("pct").alias("percent"), "shares")
    entities = view(spark, sf, "v_entity").select(F.col("group_id").alias("company_id"), F.col("entity_id").alias("ord"), "name", "jurisdiction", "status")
    contracts = view(spark, sf, "v_contract").select(F.col("recipient_id").alias("company_id"), F.col("award_id").alias("ord"), "award_id", "amount", "agency")
    articles = R.scored_articles(view(spark, sf, "v_article")).select("company_id", F.col("doc_id").alias("ord"), "title", "sentiment")
    market = table(spark, sf, "events").select(
        F.col("user_id").alias("company_id"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("ord"))
    failed = view(spark, sf, "v_fetch").filter(~F.col("ok")).select(
        (F.col("event_id") % 2000).alias("company_id"), F.concat("source", F.lit(" failed")).alias("reason"))
    filed = spark.sql(_SEC.replace("from supplier", f"from parquet.`{sf}/supplier.parquet`"))
    economy = table(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("field"),
                                                F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ord"))
    symbols = customers.filter("company_id % 3 = 0").select(
        "company_id", F.concat(F.lit("C"), F.col("company_id").cast("string")).alias("symbol"), F.lit(0).alias("ord"))
    answered = view(spark, sf, "v_fetch").filter("ok").select((F.col("event_id") % 2000).alias("company_id"), "source")
    feeds = {"yahoo": owners, "sec": filed, "opencorporates": entities, "usaspending": contracts, "fred": economy, "news": articles}
    return R.merge_sources(customers, feeds, failed, market, symbols, answered)


_SEC = "select s_suppkey % 97 + 1 as company_id, s_suppkey as ord, concat('Filer ', s_name) as name, round(abs(s_acctbal) / 100, 2) as percent, cast(s_nationkey as bigint) as shares from supplier"

_MERGE_SQL = f"""{cte('v_owner', 'v_entity', 'v_contract', 'v_article', 'v_fetch')}, v_filed as ({_SEC}),
c as (select distinct c_custkey as company_id from customer),
ow as (select company_id, 0 as src, owner_id as ord, name, pct from v_owner union all select company_id, 1, ord, name, percent from v_filed),
o as (select company_id, count(*) as n, count_if(src = 0) as n_yahoo, count_if(src = 1) as n_sec,
  string_agg(concat(name, ' ', cast(round(pct, 2) as varchar)), '|' order by src, ord) as owner_names from ow group by 1),
i as (select o_custkey as company_id, string_agg(concat(o_orderpriority, ' ', cast(o_totalprice as varchar)), '|' order by o_orderpriority) as indicators from
  (select * from orders qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey desc) = 1) z group by 1),
an as (select event_id % 2000 as company_id, list(distinct source) as answers from v_fetch where ok group by 1),
e as (select group_id as company_id, count(*) as n, string_agg(concat(name, ' ', jurisdiction), '|' order by entity_id) as entity_names from v_entity group by 1),
g as (select recipient_id as company_id, count(*) as n, string_agg(concat(award_id, ' ', agency), '|' order by award_id) as contract_names from v_contract group by 1),
a as (select company_id, count(*) as n, string_agg(title, '|' order by doc_id) as article_titles from v_article group by 1),
m as (select user_id as company_id, count(distinct event_type) as n from events group by 1),
w as (select event_id % 2000 as company_id, string_agg(distinct concat(source, ' failed'), '|' order by concat(source, ' failed')) as warnings from v_fetch where not ok group by 1),
x as (select c.company_id, coalesce(o.n, 0) as owners, coalesce(n_yahoo, 0) as n_yahoo, coalesce(n_sec, 0) as n_sec, coalesce(indicators, '') as indicators, coalesce(answers, []) as answers,
  case when c.company_id % 3 = 0 then concat('C', cast(c.company_id as varchar)) end as symbol, coalesce(e.n, 0) as entities, coalesce(g.n, 0) as contracts, coalesce(a.n, 0) as articles, coalesce(m.n, 0) as market, coalesce(warnings, '') as warnings,
  coalesce(owner_names, '') as owner_names, coalesce(entity_names, '') as entity_names, coalesce(contract_names, '') as contract_names, coalesce(article_titles, '') as article_titles
  from c left join o using (company_id) left join e using (company_id) left join g using (company_id) left join a using (company_id) left join m using (company_id) left join w using (company_id)
  left join i using (company_id) left join an using (company_id)),
y as (select *, list_filter([case when n_yahoo > 0 or list_contains(answers, 'yahoo') then 'yahoo' end, case when n_sec > 0 or list_contains(answers, 'sec') then 'sec' end,
    case when entities > 0 or list_contains(answers, 'opencorporates') then 'opencorporates' end, case when contracts > 0 or list_contains(answers, 'usaspending') then 'usaspending' end,
    case when indicators <> '' or list_contains(answers, 'fred') then 'fred' end, case when articles > 0 or list_contains(answers, 'news') then 'news' end], lambda z: z is not null) as source_list from x)"""


@query("merged_companies", f"""{_MERGE_SQL} select company_id, cast(owners as integer) as owners, cast(entities as integer) as entities, cast(contracts as integer) as contracts,
  cast(articles as integer) as articles, cast(market as integer) as market_fields, warnings, owner_names, entity_names, contract_names, article_titles,
  symbol, indicators, array_to_string(source_list, '|') as sources,
  cast(least(100, 15 * len(source_list) + case when owners > 0 then 25 else 0 end
    + case when owners > 5 then 15 else 0 end + case when entities > 0 then 20 else 0 end + case when contracts > 0 then 20 else 0 end
    + case when market > 3 then 15 else 0 end) as integer) as quality_score from y""")
def merged_companies(spark, sf):
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "|"), F.lit(""))
    return _merge(spark, sf).select(
        text("owners", lambda x: F.concat(x["name"], F.lit(" "), F.round(x["percent"], 2).cast("string"))).alias("owner_names"),
        text("entities", lambda x: F.concat(x["name"], F.lit(" "), x["jurisdiction"])).alias("entity_names"),
        text("contracts", lambda x: F.concat(x["award_id"], F.lit(" "), x["agency"])).alias("contract_names"),
        text("articles", lambda x: x["title"]).alias("article_titles"),
        F.array_join(F.transform(F.array_sort(F.map_entries("indicators")), lambda x: F.concat(x["key"], F.lit(" "), x["value"].cast("string"))), "|").alias("indicators"),
        "symbol", "company_id", n("owners").alias("owners"), n("entities").alias("entities"), n("contracts").alias("contracts"),
        n("articles").alias("articles"), n("market").alias("market_fields"),
        F.array_join("warnings", "|").alias("warnings"), F.array_join("sources", "|").alias("sources"), "quality_score")


@query("company_summary_cards", f"""{cte('v_owner', 'v_entity', 'v_contract')}, v_filed as ({_SEC}),
ow as (select company_id, 0 as src, owner_id as ord, name from v_owner union all select company_id, 1, ord, name from v_filed),
o as (select company_id, string_agg(name, '|' order by src, ord) as owners from (select * from ow qualify row_number() over (partition by company_id order by src, ord) <= 5) z group by 1),
e as (select group_id as company_id, string_agg(name, '|' order by entity_id) as entities from (select * from v_entity qualify row_number() over (partition by group_id order by entity_id) <= 3) z group by 1),
g as (select recipient_id as company_id, string_agg(award_id, '|' order by award_id) as contracts from (select * from v_contract qualify row_number() over (partition by recipient_id order by award_id) <= 3) z group by 1)
select c_custkey as company_id, coalesce(owners, '') as owners, coalesce(entities, '') as entities, coalesce(contracts, '') as contracts
from customer left join o on o.company_id = c_custkey left join e on e.company_id = c_custkey left join g on g.company_id = c_custkey""")
def company_summary_cards(spark, sf):
    cards = R.summary_card(_merge(spark, sf))
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), "|"), F.lit(""))
    return cards.select("company_id", joined("owners", "name").alias("owners"), joined("entities", "name").alias("entities"),
                        joined("contracts", "award_id").alias("contracts"))


@query("contract_checks", f"""{cte('v_contract')} select agency, {Q.contains_any('lower(description)', D.CLASSIFIED_KEYWORDS)} as classified,
  case agency {" ".join(f"when {Q.s(k)} then {v}::double" for k, v in D.AGENCY_WEIGHTS.items())} else 1.0::double end as weight, count(*) as n from v_contract group by all""")
def contract_checks(spark, sf):
    return view(spark, sf, "v_contract").groupBy(
        "agency", is_classified(F.col("description")).alias("classified"), agency_weight(F.col("agency")).alias("weight")).agg(
        F.count("*").alias("n"))

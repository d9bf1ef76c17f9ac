"""Name normalising, matching and knowledge-base queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ownerscope import dictionaries as D
from ownerscope.functions import similarity as S
from ownerscope.functions.text import (
    company_suffixes, company_type, country_hints, country_table, expand_abbreviations, is_variation, normalize_company,
)
from ownerscope.operators import kb as K
from ownerscope.plans import sqlparts as Q
from ownerscope.plans.registry import query
from ownerscope.plans.workload import cte, view


@query("normalized_names", f"""{cte('v_name')}
select name_id, name, n as normalized from {Q.normalized('v_name', 'name', 'n')} t""")
def normalized_names(spark, sf):
    return view(spark, sf, "v_name").withColumn("normalized", normalize_company(F.col("name")))


@query("normalized_names_strip")
def normalized_names_strip(spark, sf):
    return view(spark, sf, "v_name").withColumn("normalized", normalize_company(F.col("name"), "strip"))


def _case_list(expr: str, table: dict[str, list[str]]) -> str:
    return "case " + expr + " " + " ".join(f"when {Q.s(k)} then {Q.list_of(v)}" for k, v in table.items()) + " else [] end"


_TYPES = {x: [t] for t, names in D.SUFFIX_TYPES.items() for x in names}


@query("name_suffixes", f"""{cte('v_name')},
x as (select name_id, regexp_extract_all(name, {Q.SUFFIX}, 1) as sx from v_name),
e as (select name_id, list_transform(sx, lambda x: lower(x)) as l, sx from x)
select name_id, array_to_string(sx, '|') as suffixes,
  array_to_string(list_sort(list_distinct(flatten(list_transform(l, lambda x: {_case_list('x', _TYPES)})))), '|') as company_type,
  array_to_string(list_sort(list_distinct(flatten(list_transform(l, lambda x: {_case_list('x', country_table())})))), '|') as countries
from e""")
def name_suffixes(spark, sf):
    sx = company_suffixes(F.col("name"))
    return view(spark, sf, "v_name").select(
        "name_id", F.array_join(sx, "|").alias("suffixes"),
        F.array_join(F.array_sort(company_type(sx)), "|").alias("company_type"),
        F.array_join(F.array_sort(country_hints(sx)), "|").alias("countries"))


_ABBR_TEXT = ("concat(case p_partkey % 6 when 0 then 'IBM' when 1 then 'P&G' when 2 then 'ups' when 3 then 'BMW and GM' "
              "when 4 then 'ey' else 'KPMGs' end, ' buys ', p_name)")


def _expanded_sql() -> str:
    e = "t"
    for k, v in D.ABBREVIATIONS.items():
        e = f"regexp_replace({e}, {Q.rx(chr(92) + 'b' + k + chr(92) + 'b', 'i')}, {Q.s(v)}, 'g')"
    return f"select p_partkey, {e} as expanded from (select p_partkey, {_ABBR_TEXT} as t from part) x"


@query("expanded_abbreviations", _expanded_sql())
def expanded_abbreviations(spark, sf):
    t = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.expr(_ABBR_TEXT).alias("t"))
    return t.select("p_partkey", expand_abbreviations(F.col("t")).alias("expanded"))


_VAR_A = "concat(case p_partkey % 6 when 0 then 'Google' when 1 then 'Facebook' when 2 then 'JP Morgan' when 3 then 'Exxon' when 4 then 'Wal-Mart' else p_name end, case when p_partkey % 4 = 0 then ' Inc' else '' end)"
_VAR_B = "case p_partkey % 7 when 0 then 'Alphabet' when 1 then 'Meta Platforms' when 2 then 'Chase' when 3 then 'Mobil' when 4 then 'Walmart' when 5 then p_name else 'Twitter' end"
_GROUPS = "[" + ", ".join(Q.list_of([k, *v]) for k, v in D.VARIATIONS.items()) + "]"


@query("variation_test", f"""with t as (select p_partkey, {_VAR_A} as a, {_VAR_B} as b from part),
n as (select p_partkey, lower(na) as na, lower(nb) as nb from {Q.normalized(Q.normalized('t', 'a', 'na') + ' u', 'b', 'nb')} v)
select p_partkey, na = nb or len(list_filter({_GROUPS}, lambda g: list_contains(g, na) and list_contains(g, nb))) > 0 as variation from n""")
def variation_test(spark, sf):
    t = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.expr(_VAR_A).alias("a"), F.expr(_VAR_B).alias("b"))
    return t.select("p_partkey", is_variation(F.col("a"), F.col("b")).alias("variation"))


_NAME_OF = "case query_id % 10 " + " ".join(f"when {i} then {Q.s(c[1])}" for i, c in enumerate(D.KB_COMPANIES)) + " end"


@query("name_similarity", f"""{cte('v_query')},
src as (select distinct query as a, {_NAME_OF} as b from v_query),
{Q.pair_ctes('src')}
select a, b, round(ratio, 9) as ratio, round(partial, 9) as partial, round(token_sort, 9) as token_sort,
  round(token_set, 9) as token_set, round(name_ratio, 9) as name_ratio,
  round(least(1e0, name_ratio + bonus), 9) as enhanced, {Q.label('round(name_ratio, 9)')} as label,
  round(name_ratio, 9) >= 0.8 as is_match,
  round((r0 * 0.5::double + pr0 * 0.2::double + so0 * 0.3::double + se0 * 0.3::double) / 1.3, 9) as reweighted,
  round(len(list_intersect(string_split_regex(lower(a), '\\s+'), string_split_regex(lower(b), '\\s+')))::double
    / len(list_distinct(list_concat(string_split_regex(lower(a), '\\s+'), string_split_regex(lower(b), '\\s+')))), 9) as word_jaccard
from p5""")
def name_similarity(spark, sf):
    src = view(spark, sf, "v_query").select(F.col("query").alias("a"), F.expr(_NAME_OF).alias("b")).distinct()
    f = S.with_features(S.with_features(src, F.col("a"), "x"), F.col("b"), "y")
    fa, fb = S.feature_columns("x"), S.feature_columns("y")
    parts = S.part_ratios(fa, fb)
    r = lambda c: F.round(c, 9)
    out = f.select(
        "a", "b", r(parts["ratio"]).alias("ratio"), r(parts["partial"]).alias("partial"),
        r(parts["tokenSort"]).alias("token_sort"), r(parts["tokenSet"]).alias("token_set"),
        r(S.name_ratio(fa, fb)).alias("name_ratio"), r(S.enhanced_ratio(fa, fb)).alias("enhanced"),
        r(S.name_ratio(fa, fb, {"ratio": 0.5})).alias("reweighted"),
        r(S.word_jaccard(F.col("a"), F.col("b"))).alias("word_jaccard"))
    return out.withColumn("label", S.score_label(F.col("name_ratio"))).withColumn("is_match", F.col("name_ratio") >= 0.8)


# --- knowledge base ----------------------------------------------------------
_KB_QUERIES = f"{cte('v_query')}, q as (select distinct query, n as qn from {Q.normalized('v_query', 'query', 'n')} z), {Q.candidates_cte()}"


@query("kb_name_lookup", f"""{_KB_QUERIES}
select query, company_id, text as matched_text from q join cand on kind = 'name' and b = qn""")
def kb_name_lookup(spark, sf):
    return K.lookup_exact(view(spark, sf, "v_query"), K.shipped_kb(spark), "name")


@query("kb_ticker_lookup", f"""{_KB_QUERIES}
select query, company_id, text as matched_text from q join cand on kind = 'ticker' and b = upper(query)""")
def kb_ticker_lookup(spark, sf):
    return K.lookup_exact(view(spark, sf, "v_query"), K.shipped_kb(spark), "ticker")


@query("kb_alias_lookup", f"""{_KB_QUERIES}
select distinct query, company_id from q join cand on kind = 'alias' and b = qn""")
def kb_alias_lookup(spark, sf):
    return K.lookup_exact(view(spark, sf, "v_query"), K.shipped_kb(spark), "alias").select("query", "company_id")


@query("kb_exact_search", f"""{_KB_QUERIES},
h as (select query, company_id, 1.0::double as score, 'name' as match_type, text as matched_text from q join cand on kind = 'name' and b = qn
  union all select query, company_id, 0.9::double, 'ticker', text from q join cand on kind = 'ticker' and b = upper(query)
  union all select distinct query, company_id, 0.8::double, 'alias', query from q join cand on kind = 'alias' and b = qn)
select query, company_id, score, match_type, matched_text from h
qualify row_number() over (partition by query, company_id order by score desc) = 1""")
def kb_exact_search(spark, sf):
    return K.exact_search(view(spark, sf, "v_query"), K.shipped_kb(spark))


def _fuzzy_sql(threshold: float, limit: int) -> str:
    return f"""{_KB_QUERIES},
src as (select query, company_id, text, kind, boost, ord, qn as a, b from q cross join cand),
{Q.pair_ctes('src')},
sc as (select query, company_id, text, kind, ord, least(1e0, name_ratio + bonus) * boost as score from p5),
best as (select * from sc where score >= {threshold} qualify row_number() over (partition by query, company_id order by score desc, ord) = 1),
top as (select *, row_number() over (partition by query order by score desc, ord) as rank from best qualify rank <= {limit})"""


@query("kb_fuzzy_search", f"""{_fuzzy_sql(0.7, 5)}
select query, cast(rank as integer) as rank, company_id, round(score, 9) as score, kind as match_type, text as matched_text from top""")
def kb_fuzzy_search(spark, sf):
    hits = K.fuzzy_search(view(spark, sf, "v_query"), K.shipped_kb(spark))
    return hits.withColumn("score", F.round("score", 9))


@query("name_suggestions", f"""{_fuzzy_sql(0.5, 10)}
select query, cast(rank as integer) as rank, c.name as text, c.ticker, round(score, 9) as confidence from top
join (values {", ".join(f"({Q.s(c[0])}, {Q.s(c[1])}, {Q.s(c[3])})" for c in D.KB_COMPANIES)}) c(id, name, ticker) on c.id = company_id""")
def name_suggestions(spark, sf):
    return K.suggestions(view(spark, sf, "v_query"), K.shipped_kb(spark)).withColumn("confidence", F.round("confidence", 9))


@query("resolved_names", f"""{_fuzzy_sql(0.7, 1)}
select q.query, company_id, round(score, 9) as score from q left join top on q.query = top.query""")
def resolved_names(spark, sf):
    return K.resolve_names(view(spark, sf, "v_query"), K.shipped_kb(spark)).withColumn("score", F.round("score", 9))


_PAIR_B = "case query_id % 4 when 0 then 'Apple Computer' when 1 then 'Microsoft Corp' when 2 then query else 'Google' end"


@query("same_company_test", f"""{cte('v_query')},
pr as (select distinct query as xa, {_PAIR_B} as xb from v_query),
names as (select xa as query from pr union select xb from pr),
q as (select query, n as qn from {Q.normalized('names', 'query', 'n')} z), {Q.candidates_cte()},
src as (select query, company_id, boost, ord, qn as a, b from q cross join cand),
{Q.pair_ctes('src')},
top as (select query, company_id from p5 where least(1e0, name_ratio + bonus) * boost >= 0.6
  qualify row_number() over (partition by query order by least(1e0, name_ratio + bonus) * boost desc, ord) = 1),
direct as (select xa as a, xb as b from pr),
{Q.pair_ctes('direct', 'd')}
select d5.a, d5.b, coalesce(ta.company_id = tb.company_id, name_ratio >= 0.8) as same
from d5 left join top ta on ta.query = d5.a left join top tb on tb.query = d5.b""")
def same_company_test(spark, sf):
    pairs = view(spark, sf, "v_query").select(F.col("query").alias("a"), F.expr(_PAIR_B).alias("b")).distinct()
    return K.same_company(pairs, K.shipped_kb(spark)).select("a", "b", "same")


@query("best_choices", f"""{cte('v_query')},
ch as (select * from (values {", ".join(f"({i}, {Q.s(c[1])})" for i, c in enumerate(D.KB_COMPANIES))}) v(ord, b)),
src as (select query as a, ord, b from (select distinct query from v_query) x cross join ch),
{Q.pair_ctes('src')}
select a as query, cast(row_number() over (partition by a order by name_ratio desc, ord) as integer) as rank, b as match,
  round(name_ratio, 9) as score, {Q.label('name_ratio')} as confidence from p5
qualify row_number() over (partition by a order by name_ratio desc, ord) <= 3""")
def best_choices(spark, sf):
    best = K.extract_best(view(spark, sf, "v_query"), [c[1] for c in D.KB_COMPANIES], limit=3)
    return best.withColumn("score", F.round("score", 9))


# --- a knowledge base the size of the part table --------------------------------
_COMPANY = ("select name_id as id, name, concat(name, ' Group') as alias_a, concat('Brand ', cast(name_id % 50 as varchar(9))) as alias_b, "
            "case when name_id % 3 = 0 then '' else concat('T', cast(name_id as varchar(12))) end as ticker from v_name")


def part_kb(spark, sf):
    t = spark.sql(_COMPANY.replace("from v_name", "from {names}"), names=view(spark, sf, "v_name"))
    return K.with_normalized(t.select(
        F.col("id").cast("string").alias("id"), F.col("id").alias("ord"), "name",
        F.array("alias_a", "alias_b").alias("aliases"), "ticker", F.lit("X").alias("exchange"),
        F.lit("Parts").alias("industry"), F.lit("corporation").alias("type"),
        F.array().cast("array<string>").alias("subsidiaries"),
        F.when(F.col("ord") % 5 == 0, F.array(F.concat(F.lit("Old "), "name"))).alias("previous_names")))


@query("kb_candidate_texts", f"""{cte('v_name')}, c as ({_COMPANY}),
t as (select id, 0 as sub, name as text, 'name' as kind from c union all select id, 1, alias_a, 'alias' from c
  union all select id, 2, alias_b, 'alias' from c union all select id, 3, ticker, 'ticker' from c where ticker <> '')
select cast(id as varchar) as company_id, text, kind, case when kind = 'ticker' then upper(text) else n end as normalized,
  case kind when 'name' then 1.0::double when 'alias' then 0.9::double else 0.8::double end as boost from {Q.normalized('t', 'text', 'n')} z""")
def kb_candidate_texts(spark, sf):
    return K.kb_candidates(part_kb(spark, sf)).select("company_id", "text", "kind", "normalized", "boost")


@query("kb_name_variations", f"""{cte('v_name')}, c as ({_COMPANY}),
l as (select id, unnest([name, alias_a, alias_b, n, ticker, case when id % 5 = 0 then concat('Old ', name) end]) as variation from {Q.normalized('c', 'name', 'n')} z)
select distinct cast(id as varchar) as company_id, variation from l where variation is not null""")
def kb_name_variations(spark, sf):
    return K.name_variations(part_kb(spark, sf)).select("company_id", "variation")


@query("kb_upsert", f"""{cte('v_name')}, c as ({_COMPANY}),
u as (select id, case when id % 2 = 0 then concat(name, ' Corp') else name end as name,
  case when id % 4 = 0 then concat('N', cast(id as varchar)) else ticker end as ticker,
  case when id % 4 = 1 then 'Updated' else 'Parts' end as industry from c)
select cast(id as varchar) as id, name, ticker, industry, n as normalized_name, id % 2 = 0 or id % 4 = 1 as updated from {Q.normalized('u', 'name', 'n')} z""")
def kb_upsert(spark, sf):
    base = part_kb(spark, sf).drop("normalized_name").withColumn("date_added", F.lit("2024-01-01").cast("timestamp")).withColumn(
        "last_updated", F.lit(None).cast("timestamp"))
    i = F.col("ord")
    updates = base.filter((i % 2 == 0) | (i % 4 == 1)).select(
        "id", F.when(i % 2 == 0, F.concat("name", F.lit(" Corp"))).alias("name"),
        F.when(i % 4 == 0, F.concat(F.lit("N"), "id")).alias("ticker"),
        F.when(i % 4 == 1, F.lit("Updated")).alias("industry"))
    out = K.upsert_companies(base, updates, F.lit("2024-02-01").cast("timestamp"))
    return out.select("id", "name", "ticker", "industry", "normalized_name", F.col("last_updated").isNotNull().alias("updated"))


def _part_search_sql(threshold: float) -> str:
    """All pairs, cut by a bound from lengths and tokens before the edit ratios; the windowed ratio counts as 1 there, the bonus as given."""
    side = lambda source, text: f"""(select *, lower(trim({text})) as l, array_to_string(list_sort({Q.tokens(text)}), ' ') as sorted,
      list_distinct({Q.tokens(text)}) as d, case when len(list_filter(list_distinct({Q.tokens(text)}), lambda x: not list_contains({Q.list_of(D.STOP_WORDS)}, x))) > 0
        then list_filter(list_distinct({Q.tokens(text)}), lambda x: not list_contains({Q.list_of(D.STOP_WORDS)}, x)) else list_distinct({Q.tokens(text)}) end as e from {source})"""  # noqa: E731
    share = lambda x, y: f"least(length({x}), length({y}))::double / greatest(length({x}), length({y}), 1)"
    return f"""{cte('v_name')}, c as ({_COMPANY}),
t as (select id, 0 as sub, name as text, 'name' as kind, 1.0::double as boost from c union all select id, 1, alias_a, 'alias', 0.9::double from c
  union all select id, 2, alias_b, 'alias', 0.9::double from c),
cand as (select cast(id as varchar) as company_id, text, kind, boost, id::bigint * 4294967296 + sub as ord, n as b from {Q.normalized('t', 'text', 'n')} x),
q as (select distinct p_name as query, n as a from {Q.normalized('part', 'p_name', 'n')} z),
near as (select query, company_id, text, kind, boost, ord, a, b from
  (select q.*, cand.* exclude (l, sorted, d, e), q.e as qe, cand.e as ce from {side('q', 'a')} q join {side('cand', 'b')} cand
   on (0.2 * {share('q.l', 'cand.l')} + 0.2 + 0.3 * {share('q.sorted', 'cand.sorted')} + 0.4) * boost >= {threshold} - 1e-9
   and (0.2 * {share('q.l', 'cand.l')} + 0.3 + 0.3 * {share('q.sorted', 'cand.sorted')} + 0.3 * len(list_intersect(q.e, cand.e)) / greatest(len(list_distinct(list_concat(q.e, cand.e))), 1)) * boost >= {threshold} - 1e-9) y),
{Q.pair_ctes('near')},
sc as (select query, company_id, text, kind, ord, least(1e0, name_ratio + bonus) * boost as score from p5),
best as (select * from sc where score >= {threshold} qualify row_number() over (partition by query, company_id order by score desc, ord) = 1)
select query, cast(1 as integer) as rank, company_id, round(score, 9) as score, kind as match_type, text as matched_text from best
qualify row_number() over (partition by query order by score desc, ord) = 1"""


@query("part_name_search", _part_search_sql(0.8))
def part_name_search(spark, sf):
    """Fuzzy join of two table-sized sides: order-entry spellings against the part KB."""
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("query"))
    return K.fuzzy_search(names, part_kb(spark, sf), limit=1, threshold=0.8, tickers=False).withColumn("score", F.round("score", 9))

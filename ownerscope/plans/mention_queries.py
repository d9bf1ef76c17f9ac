"""Mention extraction, ranking and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ownerscope import dictionaries as D
from ownerscope.functions import text as T
from ownerscope.functions.text import (
    entity_key, is_ticker, keep_ambiguous, describe_context, normalize_mention, sanitize_boundary, sanitize_nlp,
    sanitize_page,
)
from ownerscope.operators import detect as X
from ownerscope.operators import kb as K
from ownerscope.operators import mentions as M
from ownerscope.plans import sqlparts as Q
from ownerscope.plans.registry import query
from ownerscope.plans.workload import cte, table, view
from ownerscope.session import materialize

_CTRL = r"'[\x00-\x1F\x7F-\x9F]'"
_CLEAN = ("trim(regexp_replace(regexp_replace(translate({0}, '<>', ''), '[\\x{{0000}}-\\x{{001F}}\\x{{007F}}-\\x{{009F}}]', '', 'g'), "
          "'[\\s\\x{{00A0}}]+', ' ', 'g'))")


def clean(expr: str) -> str:
    return _CLEAN.format(expr)


@query("sanitised_text", f"""select conv_id, turn, md5({clean("t")}) as nlp,
  md5(regexp_replace(translate(t, '<>', ''), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')) as page,
  md5(regexp_replace(translate(t, '<>', ''), '(?i)javascript:', '', 'g')) as boundary
from (select conv_id, turn, concat('  <b>JavaScript:x</b> ', text, ' ') as t from conversations) c""")
def sanitised_text(spark, sf):
    t = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("  <b>JavaScript:x</b> "), "text", F.lit(" ")).alias("t"))
    return t.select("conv_id", "turn", F.md5(sanitize_nlp(F.col("t"))).alias("nlp"),
                    F.md5(sanitize_page(F.col("t"))).alias("page"), F.md5(sanitize_boundary(F.col("t"))).alias("boundary"))


def _extract_ctes() -> str:
    """All pattern hits with offsets, then first hit per text, checks and order."""
    parts, fam_ord = [], 0
    for name, (kind, conf, patterns) in D.MENTION_FAMILIES.items():
        for re_ord, (flags, pattern, *_) in enumerate(patterns):
            p = Q.rx(pattern, flags)
            parts.append(
                f"select doc_id, {fam_ord} as fo, {re_ord} as ro, i, g[i] as text, {Q.s(kind)} as type, {conf}::double as confidence, "
                f"{Q.s(name)} as pattern, cast(list_sum(list_transform(parts[1:i], lambda x: length(x))) "
                f"+ coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) as integer) as position "
                f"from (select doc_id, w, g, parts, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(t, {p}, 0) as w, "
                f"regexp_extract_all(t, {p}, 1) as g, string_split_regex(t, {p}) as parts from clean) a) b")
        fam_ord += 1
    context = " or ".join(f"regexp_matches(t, {Q.rx(p, f)})" for f, p in D.AMBIGUOUS_CONTEXT)
    trail = Q.s(r"""[.,;:!?'"]+$""")
    lead = Q.s(r"""^['"]+""")
    return f"""clean as (select doc_id, {clean('text')} as t from v_text),
hits as ({" union all ".join(parts)}),
named as (select *, regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), {trail}, '', 'g'), {lead}, '', 'g') as normalized from hits),
firsts as (select * from named qualify row_number() over (partition by doc_id, normalized order by fo, ro, i) = 1),
ctx as (select doc_id, {context} as has_context from clean),
mention as (select f.doc_id, cast(row_number() over (partition by f.doc_id order by fo, ro, i) - 1 as integer) as ord,
    text, normalized, type, confidence, pattern, position
  from firsts f join ctx using (doc_id)
  where (type <> 'ticker' or (regexp_matches(replace(text, '$', ''), '^[A-Z]{{1,5}}$') and text not in {Q.strings(D.EXCLUDED_TICKERS)}))
    and (has_context or normalized not in {Q.strings(D.AMBIGUOUS_WORDS)})),
ranked as (select *, cast(row_number() over (partition by doc_id order by confidence desc, position, ord) as integer) as rank from mention)"""


_MENTIONS = f"{cte('v_text')}, {_extract_ctes()}"


def _arrays(spark, sf):
    return M.mention_arrays(view(spark, sf, "v_text"))


@query("extracted_mentions", f"{_MENTIONS} select doc_id, ord, text, normalized, type, confidence, pattern, position from mention")
def extracted_mentions(spark, sf):
    return M.explode_mentions(_arrays(spark, sf), ["doc_id"])


@query("ranked_mentions", f"{_MENTIONS} select doc_id, rank, text, type, position from ranked")
def ranked_mentions(spark, sf):
    rows = _arrays(spark, sf).withColumn("mentions", M.ranked(F.col("mentions")))
    return M.explode_mentions(rows, ["doc_id"]).select("doc_id", (F.col("ord") + 1).alias("rank"), "text", "type", "position")


_W = "case type " + " ".join(f"when '{k}' then {v}::double" for k, v in D.TYPE_WEIGHTS.items()) + f" else {D.TYPE_WEIGHT_OTHER}::double end"


@query("document_confidence", f"""{_MENTIONS} select doc_id, round(sum(confidence * {_W}) / sum({_W}), 9) as confidence, count(*) as mentions
from mention group by doc_id""")
def document_confidence(spark, sf):
    rows = M.explode_mentions(_arrays(spark, sf), ["doc_id"])
    return M.document_confidence(rows, ["doc_id"]).withColumn("confidence", F.round("confidence", 9))


@query("mention_summary", f"""{_MENTIONS} select doc_id, count(*) as mentions, max(case when rank = 1 then text end) as top_text,
  max(case when rank = 1 then type end) as top_type from ranked group by doc_id""")
def mention_summary(spark, sf):
    return M.mention_summary(M.explode_mentions(_arrays(spark, sf), ["doc_id"]), ["doc_id"])


@query("mentions_per_company", f"""{_MENTIONS}, q as (select distinct query, n as qn from {Q.normalized('(select normalized as query from mention)', 'query', 'n')} z),
{Q.candidates_cte()},
h as (select query, company_id, 1.0::double as score from q join cand on kind = 'name' and b = qn
  union all select query, company_id, 0.9::double from q join cand on kind = 'ticker' and b = upper(query)
  union all select query, company_id, 0.8::double from q join cand on kind = 'alias' and b = qn),
best as (select query, company_id, max(score) as score from h group by query, company_id)
select company_id, count(*) as mentions, count(distinct doc_id) as documents, round(avg(best.score), 9) as mean_score
from mention join best on best.query = mention.normalized group by company_id""")
def mentions_per_company(spark, sf):
    """Mentions resolved by the exact cascade, counted per company."""
    # read twice below, so the extraction is written once
    per_doc = materialize(M.explode_mentions(_arrays(spark, sf), ["doc_id"]).groupBy("normalized", "doc_id").agg(F.count("*").alias("n")))
    hits = K.exact_search(per_doc, K.shipped_kb(spark), "normalized")
    return per_doc.join(hits, per_doc["normalized"] == hits["query"]).groupBy("company_id").agg(
        F.sum("n").alias("mentions"), F.countDistinct("doc_id").alias("documents"),
        F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 9).alias("mean_score"))


@query("entity_keys", f"{_MENTIONS} select distinct concat(normalized, '_', type) as entity_key from mention")
def entity_keys(spark, sf):
    return M.explode_mentions(_arrays(spark, sf), ["doc_id"]).select(
        entity_key(F.col("normalized"), F.col("type")).alias("entity_key")).distinct()


@query("extraction_stats", f"""{cte('v_text')} select count(*) as processed, count(distinct text) as distinct_texts,
  round((count(*) - count(distinct text))::double / count(*), 9) as repeat_rate from v_text where length(text) > 0""")
def extraction_stats(spark, sf):
    return M.extraction_stats(view(spark, sf, "v_text")).withColumn("repeat_rate", F.round("repeat_rate", 9))


_AMB = "case p_partkey % 20 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(D.AMBIGUOUS_WORDS)) + " else p_brand end"
_AMB_TEXT = "concat(p_name, case p_partkey % 5 when 0 then ' shares rose' when 1 then ' cloud data' when 2 then ' (NASDAQ: X)' else ' plain words' end)"
_AMB_TICKER = "case p_partkey % 6 when 0 then '$AAPL' when 1 then 'I' when 2 then 'TOOLONG' when 3 then 'abc' when 4 then 'O' else 'GE' end"


@query("word_and_ticker_checks", f"""select p_partkey, w not in {Q.strings(D.AMBIGUOUS_WORDS)} or {" or ".join(f"regexp_matches(t, {Q.rx(p, f)})" for f, p in D.AMBIGUOUS_CONTEXT)} as keep,
  regexp_matches(replace(k, '$', ''), '^[A-Z]{{1,5}}$') and replace(k, '$', '') not in ('I', 'O') as ticker,
  regexp_replace(trim(concat(' ', w, '.,; ')), '[.,;:!?]+$', '', 'g') as normalized
from (select p_partkey, {_AMB} as w, {_AMB_TEXT} as t, {_AMB_TICKER} as k from part) x""")
def word_and_ticker_checks(spark, sf):
    p = table(spark, sf, "part")
    w, t, k = F.expr(_AMB), F.expr(_AMB_TEXT), F.expr(_AMB_TICKER)
    return p.select("p_partkey", keep_ambiguous(w, t).alias("keep"), is_ticker(k).alias("ticker"),
                    normalize_mention(F.concat(F.lit(" "), w, F.lit(".,; "))).alias("normalized"))


def _context_sql() -> str:
    inds = ", ".join(f"case when regexp_matches(w, {Q.rx(p, 'i')}) then '{n}' end" for n, p in D.CONTEXT_INDUSTRIES)
    figs = ", ".join(f"case when regexp_matches(w, {Q.rx(p, f)}) then concat('{n}=', regexp_extract(w, {Q.rx(p, f)}, 0)) end"
                     for n, f, p in D.CONTEXT_FINANCIAL)
    pos = f"len(regexp_extract_all(w, {Q.rx(D.CONTEXT_POSITIVE, 'i')}))"
    neg = f"len(regexp_extract_all(w, {Q.rx(D.CONTEXT_NEGATIVE, 'i')}))"
    return f"""{_MENTIONS},
win as (select m.doc_id, m.ord, substr(t, greatest(0, position - 50) + 1,
    least(length(t), position + length(text) + 50) - greatest(0, position - 50)) as w from mention m join clean using (doc_id))
select doc_id, ord, w as context, array_to_string(list_filter([{inds}], lambda x: x is not null), '|') as industries,
  array_to_string(list_filter([{figs}], lambda x: x is not null), '|') as figures,
  case when {pos} > {neg} then 'positive' when {neg} > {pos} then 'negative' else 'neutral' end as sentiment from win"""


@query("mention_context", _context_sql())
def mention_context(spark, sf):
    rows = _arrays(spark, sf).select("doc_id", "clean_text", F.posexplode("mentions").alias("ord", "m"))
    c = rows.select("doc_id", "ord", T.mention_context(F.col("clean_text"), F.col("m.position"), F.col("m.text")).alias("c"))
    figures = F.transform(F.map_entries("c.financial"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return c.select("doc_id", "ord", F.col("c.text").alias("context"), F.array_join("c.industries", "|").alias("industries"),
                    F.coalesce(F.array_join(figures, "|"), F.lit("")).alias("figures"), F.col("c.sentiment").alias("sentiment"))


def _variation_source() -> str:
    base = (f"(select *, case when type in ('company', 'company_intl') and n <> '' then n else normalized end as st "
            f"from {Q.normalized('mention', 'text', 'n')} z)")
    return f"""{_MENTIONS}, st as {base},
src as (select l.doc_id, l.ord, r.ord as other_ord, r.text as variation, r.type as variation_type, l.st as a, r.normalized as b
  from st l join mention r on l.doc_id = r.doc_id and l.ord <> r.ord),
{Q.pair_ctes('src')}"""


@query("mention_variations", f"{_variation_source()} select doc_id, ord, variation, variation_type, round(name_ratio, 9) as similarity from p5 where name_ratio >= 0.75")
def mention_variations(spark, sf):
    rows = M.explode_mentions(M.with_variations(_arrays(spark, sf)), ["doc_id"])
    return rows.select("doc_id", "ord", F.explode("variations").alias("v")).select(
        "doc_id", "ord", F.col("v.text").alias("variation"), F.col("v.type").alias("variation_type"),
        F.round("v.similarity", 9).alias("similarity"))


@query("coreference_merge", f"""{_MENTIONS.replace('with ', 'with recursive ', 1)},
pro as (select *, {" or ".join(f"regexp_matches(text, {Q.rx(p, f)})" for f, p in D.PRONOUN_PATTERNS)} as pronoun from ranked),
fold as (
  select doc_id, 1 as step, [{{'r': rank, 'key': lower(normalized), 'pos': position}}] as kept, rank as target from pro where rank = 1
  union all
  select f.doc_id, f.step + 1, case when x.t is null then list_append(f.kept, {{'r': p.rank, 'key': lower(p.normalized), 'pos': p.position}}) else f.kept end,
    coalesce(x.t, p.rank)
  from fold f join pro p on p.doc_id = f.doc_id and p.rank = f.step + 1,
  lateral (select coalesce(case when p.pronoun then list_filter(f.kept, lambda k: k.pos < p.position)[1].r end,
    list_filter(f.kept, lambda k: contains(k.key, lower(p.normalized)) or contains(lower(p.normalized), k.key))[1].r) as t) x)
select f.doc_id, m.text, m.type, m.confidence, m.position, count(*) - 1 as merged
from fold f join ranked m on m.doc_id = f.doc_id and m.rank = f.target group by f.doc_id, m.text, m.type, m.confidence, m.position""")
def coreference_merge(spark, sf):
    rows = M.explode_mentions(M.resolve_coreferences(_arrays(spark, sf)), ["doc_id"])
    return rows.select("doc_id", "text", "type", "confidence", "position", F.size("refs").cast("bigint").alias("merged"))


def _enriched(spark, sf):
    return M.enrich(_arrays(spark, sf), K.shipped_kb(spark), ["doc_id"])


def _enriched_sql() -> str:
    return f"""{_MENTIONS}, st as (select *, case when type in ('company', 'company_intl') and n <> '' then n else normalized end as st
  from {Q.normalized('mention', 'text', 'n')} z),
texts as (select distinct st as query, type = 'ticker' as is_ticker from st),
q as (select query, is_ticker, n as qn from {Q.normalized('texts', 'query', 'n')} z), {Q.candidates_cte()},
src as (select query, is_ticker, company_id, kind, boost, ord, qn as a, b from q join cand on is_ticker or kind <> 'ticker'),
{Q.pair_ctes('src')},
hit as (select query, is_ticker, company_id, least(1e0, name_ratio + bonus) * boost as kb_score from p5 where least(1e0, name_ratio + bonus) * boost >= 0.75
  qualify row_number() over (partition by query, is_ticker order by least(1e0, name_ratio + bonus) * boost desc, ord) = 1),
vs as (select l.doc_id, l.ord, l.st as a, r.normalized as b from st l join mention r on l.doc_id = r.doc_id and l.ord <> r.ord),
{Q.pair_ctes('vs', 'v')},
nv as (select doc_id, ord, count(*) as variations from v5 where name_ratio >= 0.75 group by doc_id, ord),
win as (select m.doc_id, m.ord, substr(t, greatest(0, position - 50) + 1,
    least(length(t), position + length(text) + 50) - greatest(0, position - 50)) as w from mention m join clean using (doc_id)),
fin as (select doc_id, ord, {" or ".join(f"regexp_matches(w, {Q.rx(p, f)})" for _, f, p in D.CONTEXT_FINANCIAL)} as has_figures from win),
en as (select st.doc_id, st.ord, st.text, st.type, st.position, company_id as kb_company, kb_score, coalesce(variations, 0) as variations, has_figures,
    case when company_id is not null then least(1e0, confidence + 0.1::double) else confidence end as confidence
  from st left join hit on hit.query = st.st and hit.is_ticker = (st.type = 'ticker')
  left join nv on nv.doc_id = st.doc_id and nv.ord = st.ord join fin on fin.doc_id = st.doc_id and fin.ord = st.ord)"""


_ORDER = ("case type " + " ".join(f"when '{k}' then {v}" for k, v in D.TYPE_ORDER.items()) + " else 0 end")


@query("enriched_mentions", f"""{_enriched_sql()}
select doc_id, ord, text, kb_company, round(kb_score, 9) as kb_score, round(confidence, 9) as confidence, variations, has_figures,
  cast(row_number() over (partition by doc_id order by coalesce(kb_score > 0.8, false) desc, confidence desc, {_ORDER} desc, position, ord) as integer) as rank from en""")
def enriched_mentions(spark, sf):
    return _enriched(spark, sf).select(
        "doc_id", "ord", "text", "kb_company", F.round("kb_score", 9).alias("kb_score"),
        F.round("confidence", 9).alias("confidence"), F.size("variations").cast("bigint").alias("variations"),
        F.col("context.financial").isNotNull().alias("has_figures"), "rank")


@query("enriched_document_confidence", f"""{_enriched_sql()},
w as (select *, (case when kb_company is not null then 1.2::double else 1e0 end) * (case when variations > 0 then 1.1::double else 1e0 end)
  * (case when has_figures then 1.1::double else 1e0 end) as wt from en)
select doc_id, round(sum(greatest(confidence, coalesce(kb_score, 0)) * wt) / sum(wt), 9) as confidence, count(*) as mentions from w group by doc_id""")
def enriched_document_confidence(spark, sf):
    return M.enhanced_confidence(_enriched(spark, sf), ["doc_id"]).withColumn("confidence", F.round("confidence", 9))


_KB_ROWS = "(values " + ", ".join("(" + ", ".join(Q.s(x) for x in (c[0], c[3], c[4], c[5])) + ")" for c in D.KB_COMPANIES) + ") kb(kb_company, ticker, exchange, industry)"


@query("entity_cards", f"""{_enriched_sql()}
select en.text as title, case when en.type in ('company', 'company_intl') and n <> en.text then n end as base,
  concat_ws(' | ', ticker || coalesce(' (' || exchange || ')', ''), industry) as listing, cast(floor(en.confidence * 100 + 0.5) as integer) as confidence_pct,
  en.kb_company is not null as verified
from en join st on st.doc_id = en.doc_id and st.ord = en.ord left join {_KB_ROWS} on kb.kb_company = en.kb_company""")
def entity_cards(spark, sf):
    kb = K.shipped_kb(spark).select(F.col("id").alias("kb_company"), "ticker", "exchange", "industry")
    rows = _enriched(spark, sf)
    return X.entity_card(rows.join(kb, "kb_company", "left"))


# --- layered and listed detection on conversation turns ----------------------
_SAY = ("concat(case conv_id % 9 when 0 then 'BlackRock manages trillions ' when 1 then 'Acme Inc announces ' when 2 then 'Chase bank statement ' "
        "when 3 then 'CEO of tiny Startup ' when 4 then 'Goldman Sachs analysis ' when 5 then 'The Energy Trust ' when 6 then 'Ocean Capital ' "
        "when 7 then 'Tesla ' else '' end, coalesce(text, ''))")
_HREF = "case when turn % 3 = 0 then '/company/x' when turn % 3 = 1 then '/quote/T' else '/other' end"
_PARENT = "case when conv_id % 2 = 0 then 'h1' else 'div' end"


def _layered_sql() -> str:
    extra = ("(case when contains(href, 'company') or contains(href, 'quote') then 0.1::double else 0e0 end) "
             "+ (case when parent in ('h1', 'h2') then 0.1::double else 0e0 end)")
    opts = []
    for i, (strategy, p) in enumerate(D.LAYERED_PATTERNS):
        base = 0.5 + {"strict": 0.3, "flexible": 0.2}.get(strategy, 0.0)
        opts.append(f"select conv_id, turn, {i} as i, least(1e0, {base}::double + {extra}) as confidence, "
                    f"regexp_extract(t, {Q.rx(p, 'i')}, {0 if i == 2 else 1}) as company, '{strategy}' as strategy from s where regexp_matches(t, {Q.rx(p, 'i')})")
    return f"""with s as (select conv_id, turn, trim({_SAY}) as t, {_HREF} as href, {_PARENT} as parent from conversations),
o as ({" union all ".join(opts)})
select conv_id, turn, company, round(confidence, 9) as confidence, strategy from o
qualify row_number() over (partition by conv_id, turn order by confidence desc, i) = 1 and confidence >= 0.7"""


@query("layered_detection", _layered_sql())
def layered_detection(spark, sf):
    t = table(spark, sf, "conversations")
    d = X.detect_layered(F.expr(_SAY), F.expr(_HREF), F.expr(_PARENT))
    return t.select("conv_id", "turn", d.alias("d")).filter(F.col("d").isNotNull()).select(
        "conv_id", "turn", F.col("d.company").alias("company"), F.round("d.confidence", 9).alias("confidence"),
        F.col("d.strategy").alias("strategy"))


_LIST_TEXT = "concat(' ', case when doc_id % 3 = 0 then 'x{' else '' end, {0})"


@query("listed_detection", f"""with s as (select conv_id, turn, trim(concat({_SAY}, case when turn % 5 = 4 then '{{' else '' end)) as t from conversations),
c as (select *, length(t) between 3 and 100 and not {Q.contains_any('t', D.CANDIDATE_REJECTS)} as candidate,
  list_filter({Q.list_of(D.LISTED_COMPANIES)}, lambda n: contains(lower(t), lower(n)))[1] as listed,
  {" or ".join(f"contains(t, ' {x}') or t like '%{x}'" for x in D.LISTED_SUFFIXES)} as suffix,
  {Q.contains_any('lower(t)', [x.lower() for x in D.LISTED_TYPES])} as kind,
  {" or ".join(f"t like '{x}%'" for x in D.LISTED_COMMON_WORDS)} as common from s)
select conv_id, turn, candidate, case when candidate then coalesce(listed, case when (suffix or kind) and regexp_matches(t, '^[A-Z]') and not common then t end) end as company from c""")
def listed_detection(spark, sf):
    t = F.concat(F.expr(_SAY), F.when(F.col("turn") % 5 == 4, "{").otherwise(""))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.candidate_text(t).alias("candidate"), X.detect_listed(t).alias("company"))

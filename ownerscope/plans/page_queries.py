"""Page scanning, DOM context and confidence-scoring queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions.text import literal_map
from ownerscope.operators import detect as X
from ownerscope.operators import mentions as M
from ownerscope.operators import scoring as C
from ownerscope.plans import sqlparts as Q
from ownerscope.plans.registry import query
from ownerscope.plans.workload import cte, table, view
from ownerscope.session import materialize
from ownerscope.sources import pages as P, tags as G

_PAGE = cte("v_page")
_HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_SITE = "case " + _HOST + " " + " ".join(f"when '{h}' then '{s}'" for h, s in D.SITE_HOSTS.items()) + " end"


@query("site_routing", f"""{_PAGE} select page_id, {_SITE} as site, case {" ".join(f"when regexp_matches(url, {Q.rx(p)}) then '{s}'" for s, p in D.TRUSTED_ORIGINS)} end as trusted from v_page""")
def site_routing(spark, sf):
    u = F.col("url")
    return view(spark, sf, "v_page").select("page_id", P.site_of(u).alias("site"), P.trusted_site(u).alias("trusted"))


def _any(expr: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({expr}, {Q.rx(p)})" for p in patterns) + ")"


@query("page_types", f"""{_PAGE}, u as (select page_id, url, {_PATH} as p from v_page)
select page_id, {_any('lower(p)', D.COMPANY_PAGE_PATHS)} or {Q.contains_any('lower(url)', D.COMPANY_PAGE_PARTS)} as company_page,
  contains(p, '/story/') or contains(p, '/articles/') as article, contains(p, '/investing/stock/') as quote, contains(p, '/markets') as markets,
  contains(p, '/watchlist') as watchlist, p in ('/', '/latest-news') as home, contains(p, '/markets/') as market_news, contains(p, '/company/') as company_news,
  contains(p, '/opinion/') as opinion, case when contains(p, '/companies/') then 'company-profile' when contains(p, '/lists/') then 'list' end as page_type,
  case when contains(p, '/companies/') then regexp_extract(p, '/companies/([^/]*)', 1) end as slug from u""")
def page_types(spark, sf):
    u = F.col("url")
    return view(spark, sf, "v_page").select(
        "page_id", P.is_company_page(u).alias("company_page"), P.page_flags(u).alias("f"), P.list_site_context(u).alias("c")).select(
        "page_id", "company_page", "f.*", "c.*")


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_SLUGS = ", ".join(f"nullif(regexp_extract(lower({_PATH}), {Q.rx(p)}, 1), '')" for p in D.COMPANY_SLUGS)
_TITLES = ", ".join(f"nullif(regexp_extract(trim(title), {Q.rx(p, f)}, 1), '')" for f, p in D.COMPANY_TITLES)


_TAGS = ("h1", "h2", "h3", "p", "span", "a")


def _decoded(expr: str) -> str:
    for ref, char in G.ENTITIES:
        expr = f"replace({expr}, {Q.s(ref)}, {Q.s(char)})"
    return expr


def _element_ctes(tags=_TAGS) -> str:
    """The last table, ``el``, has the elements of some tags (all, for none): page_id, url, elem_id, tag, ord, class, token, text."""
    wanted = lambda column, more=(): f"{column} in {some({*tags, *more})}" if tags else "true"
    some = lambda names: Q.strings(sorted(names))
    return f"""{_PAGE},
tk as (select page_id, k, token, not regexp_matches(token, {Q.rx(G.MARKUP)}) as is_text,
  lower(regexp_extract(token, {Q.rx(G.NAME)}, 1)) as tag_name from
  (select page_id, unnest(l) as token, unnest(range(0, len(l))) as k from (select page_id, regexp_extract_all(html, {Q.rx(G.TOKEN)}) as l from v_page) x) y),
pt as (select page_id, string_agg({_decoded('token')}, '' order by k) as page_text from tk where is_text group by page_id),
o1 as (select *, count(*) filter (not is_text and tag_name <> '' and token not like '</%') over (partition by page_id order by k rows unbounded preceding) - 1 as elem_id,
  case when is_text or tag_name = '' or tag_name in {some(P.VOID | P.HIDDEN)} then 0 when token like '</%' then -1 else 1 end as step,
  coalesce(sum(case when is_text then length({_decoded('token')}) else 0 end) over (partition by page_id order by k rows between unbounded preceding and 1 preceding), 0) as off from tk),
fa as (select page_id, k, elem_id, token, off, step, tag_name as family, step = 1 as begins from o1 where step <> 0 and {wanted('tag_name', ('p',))}
  union all select page_id, k, elem_id, token, off, step, 'p', false from o1 where tag_name <> 'p' and (step = 1 and tag_name in {some(G.STARTS_P)} or step = -1 and tag_name in {some(G.ENDS_P)})),
de as (select *, sum(step) over w as depth, sum(begins::int) over w - 1 as ord from fa window w as (partition by page_id, family order by k rows unbounded preceding)),
le as (select *, lead(off, 1, 1000000000000) over l as fin, lead(k, 1, 1000000000000) over l as final from de
  window l as (partition by page_id, family, case when family = 'p' then 0 when step = 1 then depth else depth + 1 end order by k)),
lp as (select *, last_value(case when family = 'p' and begins then fin end ignore nulls) over w as p_fin, last_value(case when family = 'p' and begins then final end ignore nulls) over w as p_final
  from le window w as (partition by page_id order by k rows unbounded preceding)),
el as (select page_id, url, elem_id, family as tag, ord, token, regexp_extract(token, {Q.rx(G.CLASS)}, 1) as class,
  coalesce(substr(page_text, (off + 1)::bigint, (least(fin, case when p_final > k then p_fin else fin end, length(page_text)) - off)::bigint), '') as text
  from lp join v_page using (page_id) left join pt using (page_id) where begins and {wanted('family')})"""


_ELEMENTS = _element_ctes()


@query("page_companies", f"""{_element_ctes(('h1',))}, hs as (select page_id, list(text order by ord) as h from el group by page_id),
t as (select page_id, url, concat(case page_id % 4 when 0 then 'Acme | ' when 1 then 'Acme Stock Price ' else '' end, {_TITLE}) as title, coalesce(h, []) as h from v_page left join hs using (page_id))
select page_id, coalesce(trim(replace(coalesce({_SLUGS}), '-', ' ')), trim(coalesce({_TITLES})),
  list_filter(list_transform(h, lambda x: trim(x)), lambda x: length(x) > 2 and length(x) < 50)[1]) as company from t""")
def page_companies(spark, sf):
    title = F.concat(F.expr("case page_id % 4 when 0 then 'Acme | ' when 1 then 'Acme Stock Price ' else '' end"),
                     F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    h1 = F.transform("elements", lambda e: e["text"])
    return G.tag_texts(view(spark, sf, "v_page"), ("h1",)).select("page_id", P.page_company(F.col("url"), title, h1).alias("company"))


@query("simple_elements", f"""{_ELEMENTS} select page_id, tag, cast(ord as integer) as ord, text from el""")
def simple_elements(spark, sf):
    return G.tag_elements(view(spark, sf, "v_page"), _TAGS).select("page_id", "tag", "ord", "text")


@query("eligible_elements", f"""{_ELEMENTS} select page_id, tag, cast(ord as integer) as ord, text from el where length(trim(text)) between 2 and 200
and (tag in {Q.strings(D.ELIGIBLE_TAGS)} or regexp_matches(class, {Q.rx(D.ELIGIBLE_CLASS, 'i')}) or regexp_matches(trim(text), {Q.rx(D.ELIGIBLE_TEXT)}))""")
def eligible_elements(spark, sf):
    e = G.tag_elements(view(spark, sf, "v_page"), _TAGS)
    return e.filter(X.eligible_element(F.col("tag"), F.col("class"), F.col("text"))).select("page_id", "tag", "ord", "text")


@query("lead_paragraphs", f"""{_ELEMENTS} select page_id, cast(ord + 1 as integer) as paragraph, ord = 0 as first_paragraph, text from el where tag = 'p' and ord < 3""")
def lead_paragraphs(spark, sf):
    e = G.tag_elements(view(spark, sf, "v_page"), ("p",)).filter(F.col("ord") < 3)
    return e.select("page_id", (F.col("ord") + 1).alias("paragraph"), (F.col("ord") == 0).alias("first_paragraph"), "text")


def _group(expr: str, pattern: str, n: int = 1) -> str:
    return f"nullif(regexp_extract({expr}, {Q.rx(pattern)}, {n}), '')"


_FULL = r"\b([A-Z]{1,5})(?:\s+(US|LN|HK|JP|GR|FP))(?:\s+(Equity))?\b"
_SHORT = r"([A-Z]{1,5}):([A-Z]{2})"
_ISIN = r"\b([A-Z]{2}[A-Z0-9]{10})\b"
_BRACKET = r"\(([A-Z]{1,5})(?::([A-Z]+))?\)"
_CHANGE = r"([A-Z]{1,5})\s+[+-]?\d+\.?\d*%"


@query("text_tickers", f"""{_ELEMENTS}, k as (select *, case when regexp_matches(text, {Q.rx(_FULL)}) then 'full' when regexp_matches(text, {Q.rx(_SHORT)}) then 'short'
  when regexp_matches(text, {Q.rx(_ISIN)}) then 'isin' end as kind from el)
select page_id, tag, cast(ord as integer) as ord, {_group('text', r'([A-Z]{1,5})[ ]*[+-][0-9]+[.][0-9]+%')} as quote_ticker,
  case kind when 'full' then {_group('text', _FULL)} when 'short' then {_group('text', _SHORT)} when 'isin' then {_group('text', _ISIN)} end as terminal_ticker,
  case kind when 'full' then {_group('text', _FULL, 2)} when 'short' then {_group('text', _SHORT, 2)} end as exchange,
  coalesce({_group('text', _BRACKET)}, {_group('text', _CHANGE)}) as market_ticker,
  coalesce(list_filter([{", ".join(f"case when contains(text, '{c}') or contains(text, '{n}') then '{c}' end" for c, n in D.EXCHANGE_NAMES.items())}], lambda x: x is not null)[1], 'US') as exchange_hint from k""")
def text_tickers(spark, sf):
    e = G.tag_elements(view(spark, sf, "v_page"), _TAGS)
    none, t = F.lit(None).cast("string"), F.col("text")
    terminal, market = X.terminal_ticker(t), X.market_ticker(t, none, none, none)
    return e.select("page_id", "tag", "ord", X.quote_ticker(t, none, none).alias("quote_ticker"),
                    terminal["ticker"].alias("terminal_ticker"), terminal["exchange"].alias("exchange"),
                    market["ticker"].alias("market_ticker"), X.exchange_hint(t).alias("exchange_hint"))


def _clue_sql() -> str:
    parts = [f"select page_id, tag, ord, '{n}' as type, regexp_extract(text, {Q.rx(p)}, 1) as value from s where site = '{site}' and regexp_matches(text, {Q.rx(p)})"
             for site, ps in D.SITE_PATTERNS.items() for n, p in ps]
    return (f"{_ELEMENTS}, s as (select *, {_SITE} as site from el), c as ({' union all '.join(parts)}) "
            "select page_id, tag, cast(ord as integer) as ord, type, value from c")


@query("text_clues", _clue_sql())
def text_clues(spark, sf):
    e = G.tag_elements(view(spark, sf, "v_page"), _TAGS)
    none = F.lit(None).cast("string")
    return e.select("page_id", "tag", "ord", F.explode(X.clues(P.site_of(F.col("url")), F.col("text"), none, none)).alias("c")).select(
        "page_id", "tag", "ord", F.col("c.type").alias("type"), F.col("c.value").alias("value"))


# --- scoring on flat inputs: order lines stand for detected elements ---------------
_KIND = "case l_linenumber % 5 when 0 then 'ticker' when 1 then 'company' when 2 then 'company_formal' when 3 then 'company_context' else 'company_intl' end"
_POS = "case l_suppkey % 6 when 0 then 'h1' when 1 then 'h2' when 2 then 'firstParagraph' when 3 then 'body' when 4 then 'headline' else '' end"
_CLUE = "case l_partkey % 6 when 0 then 'dataAttribute' when 1 then 'tickerPattern' when 2 then 'companyLink' when 3 then 'href_tickerInUrl' when 4 then 'symbolPattern' else '' end"
_TEXT = ("case l_partkey % 9 when 0 then 'AAPL' when 1 then 'Apple' when 2 then 'chase  jpmorgan & co.' when 3 then 'Bank of America Corporation' when 4 then 'America of Bank Corporation' "
         "when 5 then 'BlackRock' when 6 then '$MSFT' when 7 then 'state street' else concat('Maker ', cast(l_suppkey as varchar(20))) end")
_ELEM = f"""select l_orderkey, l_linenumber, {_KIND} as kind, {_POS} as pos, {_CLUE} as clue, {_TEXT} as text, l_discount * 10 as conf, l_tax * 12.5 as conf2,
  case l_suppkey % 4 when 0 then 'forbes' when 1 then 'yahoo' when 2 then 'bloomberg' else 'marketwatch' end as site,
  case l_suppkey % 3 when 0 then 'tech' when 1 then 'banking' end as industry from lineitem"""


def _known_values() -> str:
    keyed = {}
    for name, aliases, ticker, sector in D.KNOWN_ENTITIES:
        for k in [name, *aliases, *([ticker, f"${ticker}"] if ticker else [])]:
            keyed[k.lower()] = (name, ticker, sector)
    return "(select * from (values " + ", ".join(
        f"({Q.s(k)}, {Q.s(n)}, {Q.s(t) if t else 'null'}, {Q.s(s)})" for k, (n, t, s) in keyed.items()) + ") v(key, known_name, known_ticker, sector))"


_SECTOR_OK = "(" + " or ".join(f"(sector = '{s}' and {Q.contains_any('lower(industry)', ws)})" for s, ws in D.SECTOR_KEYWORDS.items()) + ")"


def _mult(site_map: str, name: str) -> str:
    return "case site " + " ".join(f"when '{s}' then {m[name]}::double" for s, m in D.SITE_MULTIPLIERS.items() if name in m) + " end"


_SCORED = f"""with e as ({_ELEM}), known as {_known_values()},
texts as (select distinct lower(text) as k, list_distinct(string_split_regex(lower(text), '\\s+')) as w from e),
fuzzy as (select k, max(len(list_intersect(w, string_split_regex(key, '\\s+')))::double / len(list_distinct(list_concat(w, string_split_regex(key, '\\s+'))))) as j from texts cross join known group by k),
x as (select e.*, case when known_name is not null then least(1e0, (case when kind = 'ticker' and known_ticker = upper(text) then 1e0 else 0.9::double end)
    * case when industry is not null then case when {_SECTOR_OK} then 1.1::double else 0.9::double end else 1e0 end) when j > 0.8 then j * 0.8::double else 0e0 end as xref
  from e left join known on key = lower(text) left join fuzzy on k = lower(text)),
dom as (select *, least(1e0, case pos {" ".join(f"when '{k}' then {v}::double" for k, v in D.POSITION_WEIGHTS.items())} when '' then 0e0 else 0.5::double end
   * case when pos = 'h1' then coalesce({_mult('', 'inHeadline')}, 1e0) else 1e0 end * case when pos = 'firstParagraph' then coalesce({_mult('', 'inFirstParagraph')}, 1e0) else 1e0 end
   * case when clue = 'dataAttribute' and ({_mult('', 'hasDataSymbol')}) is not null then {_mult('', 'hasDataSymbol')}
          when contains(clue, 'ticker') and ({_mult('', 'hasTicker')}) is not null then {_mult('', 'hasTicker')}
          when contains(clue, 'company') and ({_mult('', 'hasCompanyTag')}) is not null then {_mult('', 'hasCompanyTag')} else 1e0 end) as dom_conf from x),
f as (select *, least(1e0, conf * case kind when 'ticker' then 1.2::double when 'company_formal' then 1.1::double when 'company_context' then 0.8::double else 1e0 end) as f1,
  least(1e0, dom_conf * case pos when 'h1' then 1.3::double when 'h2' then 1.2::double when 'firstParagraph' then 1.15::double else 1e0 end * case when clue = 'dataAttribute' or contains(clue, 'ticker') then 1.25::double else 1e0 end) as f2,
  least(1e0, conf * case when conf > 0.9 then 1.15::double else 1e0 end * case when conf2 > 0.7 then 1.1::double else 1e0 end) as f3, xref as f4,
  case when clue = '' then 0.6::double when kind = 'ticker' then case when contains(clue, 'ticker') or contains(clue, 'symbol') then 1e0 else 0.6::double end
       when contains(clue, 'company') then 1e0 else 0.6::double end as f5a from dom),
g as (select *, (f5a + case when text = 'Apple' then 1e0 when text = 'state street' then 0.5::double else 0.5::double end) / 2 as f5 from f),
sc as (select *, (f1 * 0.25::double + f2 * 0.2::double + f3 * 0.25::double + f4 * 0.15::double + f5 * 0.15::double) as score from g),
lv as (select *, case when score >= 0.85 then 'high' when score >= 0.65 then 'medium' when score >= 0.45 then 'low' else 'reject' end as level from sc)"""


def _scored(spark, sf):
    e = spark.sql(_ELEM.replace("from lineitem", f"from parquet.`{sf}/lineitem.parquet`"))
    e = e.withColumn("normalized", F.col("text")).withColumn("type", F.col("kind"))
    e = C.cross_reference(e, C.known_entities(spark), industry="industry")
    words = lambda c: F.filter(F.array(c), lambda x: x != "")
    pos, clue = words("pos"), words("clue")
    mult = F.create_map(*[x for s, m in D.SITE_MULTIPLIERS.items() for x in (F.lit(s), literal_map(m))])
    e = e.withColumn("dom_conf", C.dom_confidence(pos, clue, F.try_element_at(mult, F.col("site"))))
    return C.score_entities(e, {
        "patternMatch": C.pattern_factor(F.col("conf"), F.col("type")),
        "domContext": C.dom_factor(F.col("dom_conf"), pos, clue),
        "nlpConfidence": C.nlp_factor(F.col("conf"), F.array("conf", "conf2")),
        "crossReference": F.col("cross_reference"),
        "contextConsistency": C.consistency_factor(F.lit("apple"), F.col("text"), clue, F.col("type"))})


@query("cross_reference", f"""{_SCORED} select l_orderkey, l_linenumber, text, round(xref, 9) as cross_reference from x""")
def cross_reference(spark, sf):
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", "text", F.round("cross_reference", 9).alias("cross_reference"))


_REC = """case level when 'high' then 'Entity highly reliable - proceed with confidence' when 'low' then 'Entity uncertain - additional validation recommended'
 when 'reject' then 'Entity not reliable - consider rejection' else concat('Entity moderately reliable - verify ', case when least(f1, f2, f3, f4, f5) >= 1 then 'unknown factor'
 when f1 = least(f1, f2, f3, f4, f5) then 'pattern matching' when f2 = least(f1, f2, f3, f4, f5) then 'DOM position' when f3 = least(f1, f2, f3, f4, f5) then 'NLP extraction'
 when f4 = least(f1, f2, f3, f4, f5) then 'entity verification' else 'context consistency' end) end"""


@query("entity_scores", f"""{_SCORED} select l_orderkey, l_linenumber, round(f1, 9) as pattern, round(f2, 9) as dom, round(f3, 9) as nlp, round(f4, 9) as xref, round(f5, 9) as consistency,
  round(score, 9) as score, level, {_REC} as recommendation from lv""")
def entity_scores(spark, sf):
    b = F.col("breakdown")
    r = lambda k: F.round(b[k], 9)
    return _scored(spark, sf).select(
        "l_orderkey", "l_linenumber", r("patternMatch").alias("pattern"), r("domContext").alias("dom"), r("nlpConfidence").alias("nlp"),
        r("crossReference").alias("xref"), r("contextConsistency").alias("consistency"), F.round("score", 9).alias("score"), "level", "recommendation")


@query("score_statistics", f"""{_SCORED} select level, count(*) as n, (select count(*) from lv) as total, round((select avg(score) from lv), 6) as mean_score,
  round(count(*)::double / (select count(*) from lv) * 100, 6) as percent from lv group by level""")
def score_statistics(spark, sf):
    return C.score_stats(_scored(spark, sf)).withColumn("mean_score", F.round("mean_score", 6)).withColumn("percent", F.round("percent", 6))


@query("site_metrics", f"""{_SCORED} select site as source, count(*) as detections, round(avg(score), 6) as mean_score from lv where score >= 0.45 group by rollup(site)""")
def site_metrics(spark, sf):
    d = _scored(spark, sf).filter(F.col("score") >= D.MIN_SCORE_ADAPTER)
    return C.site_metrics(d, "site").select(F.col("site").alias("source"), "detections", F.round("mean_score", 6).alias("mean_score"))


@query("deduplicated_detections", f"""{_SCORED} select l_orderkey, text as normalized, kind as type, l_linenumber, round(score, 9) as score from lv where score >= 0.45
qualify row_number() over (partition by l_orderkey, text, kind order by score desc, l_linenumber, l_partkey_ord) = 1""".replace(", l_partkey_ord", ""))
def deduplicated_detections(spark, sf):
    rows = _scored(spark, sf).select("l_orderkey", "normalized", "type", F.col("l_linenumber").alias("ord"), "l_linenumber", "score")
    return M.detected(rows, "l_orderkey").select("l_orderkey", "normalized", "type", "l_linenumber", F.round("score", 9).alias("score"))


# --- the element tree --------------------------------------------------------------
def _elements(spark, sf):
    return P.page_elements(view(spark, sf, "v_page"))


def _site_elements(spark, sf):
    """Elements of the four sites' pages; other pages are not parsed."""
    site = P.site_of(F.col("url"))
    return P.page_elements(view(spark, sf, "v_page").filter(site.isNotNull())).withColumn("site", site)


@query("page_element_counts", f"""{_PAGE} select page_id, len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>', '', 'g'), '<a[ >]')) as links,
  len(regexp_extract_all(html, '<h1[ >]')) as h1, len(regexp_extract_all(html, '<span[ >]')) as spans from v_page""")
def page_element_counts(spark, sf):
    """Element scan: links, headings and spans found by the tree."""
    e = _elements(spark, sf).groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(n) for t, n in (("a", "links"), ("h1", "h1"), ("span", "spans"))])
    return e


@query("site_candidate_elements")
def site_candidate_elements(spark, sf):
    """Candidate elements of each site in their processing order."""
    e = materialize(_site_elements(spark, sf))
    out = P.all_site_candidates(e).select("page_id", "site", "elem_id", "tag", "priority")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("priority"), "elem_id"))
    return out.withColumn("position", order)


def _attr(name: str) -> str:
    return f"nullif(regexp_extract(token, {Q.rx('[ ]' + name + '[ ]*=[ ]*\"([^\"]*)\"')}, 1), '')"


_SITE_TICKERS = f"""{_element_ctes(())}, st as (select page_id, url, {_SITE} as site, elem_id, upper(case {_SITE}
  when 'yahoo' then coalesce({_attr('data-symbol')}, {_group(_attr('href'), '/quote/([A-Z]{1,5})')}, {_group('text', r'([A-Z]{1,5})[ ]*[+-][0-9]+[.][0-9]+%')})
  when 'bloomberg' then case when regexp_matches(text, {Q.rx(_FULL)}) then {_group('text', _FULL)} when regexp_matches(text, {Q.rx(_SHORT)}) then {_group('text', _SHORT)}
    when regexp_matches(text, {Q.rx(_ISIN)}) then {_group('text', _ISIN)} end
  when 'marketwatch' then coalesce({_attr('data-ticker')}, {_attr('data-symbol')}, {_group(_attr('href'), '/investing/stock/([A-Z]{1,5})')}, {_group('text', _BRACKET)}, {_group('text', _CHANGE)},
    case when tag = 'bg-quote' then coalesce({_attr('symbol')}, {_attr('channel')}) end) end) as ticker from el)"""


@query("site_element_tickers", f"{_SITE_TICKERS} select page_id, site, cast(elem_id as integer) as elem_id, ticker from st where ticker is not null")
def site_element_tickers(spark, sf):
    return X.site_tickers(_site_elements(spark, sf)).select("page_id", "site", "elem_id", "ticker")


@query("related_tickers", f"""{_SITE_TICKERS}, pr as (select page_id, {_group(_PATH, '/quote/([A-Z]{1,5})')} as primary_ticker, ticker from st where ticker is not null)
select page_id, primary_ticker as primary, coalesce(list_sort(list(distinct ticker) filter (primary_ticker is null or ticker <> primary_ticker)), []) as related from pr group by page_id, primary_ticker""")
def related_tickers(spark, sf):
    return X.related_tickers(X.site_tickers(_site_elements(spark, sf)))


@query("watchlist_tickers", f"""{_PAGE} select distinct page_id, upper(trim(unnest(regexp_extract_all(html, '<span class="watchlist__symbol">([^<]*)', 1)))) as ticker from v_page""")
def watchlist_tickers(spark, sf):
    return X.watchlist(_elements(spark, sf))


@query("market_summary", f"""{_PAGE} select page_id, 'DJIA' as ticker, '100.5' as price, '1.5' as change, '1.5%' as percent from v_page where contains(html, 'markets__item')""")
def market_summary(spark, sf):
    return X.market_summary(_elements(spark, sf))


@query("profile_headers", f"""{_PAGE} select page_id, trim(regexp_extract(html, '<h1 class="listuser-header__name">([^<]*)', 1)) as text, 'company' as type, 0.95::double as score, 'high' as level from v_page
where {_SITE} = 'forbes' and contains(html, 'listuser-header__name')""")
def profile_headers(spark, sf):
    return X.profile_headers(_elements(spark, sf)).drop("elem_id")


@query("page_quotes", f"""{_PAGE} select page_id, 'TSLA' as ticker, 250.1::double as price, 2.5::double as change, 1.0::double as percent, cast(1000 as bigint) as volume from v_page where contains(html, 'data-last-price')""")
def page_quotes(spark, sf):
    return X.latest_quotes(_elements(spark, sf))


def _attr_value(name: str) -> str:
    return f"regexp_extract(token, {Q.rx('[ ]' + name + '[ ]*=[ ]*\"([^\"]*)\"')}, 1)"


def _matches(selector: tuple) -> str:
    """An element (tag, class, token) matches a selector itself."""
    tag, cls, attr, part = selector
    tests = [f"tag = '{tag}'"] * bool(tag) + [f"list_contains(string_split_regex(class, '[ ]+'), '{cls}')"] * bool(cls)
    if attr:
        tests.append(f"regexp_matches(token, {Q.rx('[ ]' + attr + '[ ]*=')})" if not part else
                     f"{_attr_value(attr)} = '{part}'" if attr in P.EXACT_ATTRS else f"contains({_attr_value(attr)}, '{part}')")
    return "(" + " and ".join(tests) + ")"


def _matches_any(selectors: list[tuple]) -> str:
    return "(" + " or ".join(_matches(x) for x in selectors) + ")"


#: ``ae`` has all elements of the four sites' pages, ``up`` each of them with itself and its ancestors: intervals that contain its own
_TREE = f"""{_element_ctes(())},
ae as (select *, {_SITE} as site from (
  select page_id, url, k, elem_id, family as tag, token, regexp_extract(token, {Q.rx(G.CLASS)}, 1) as class, least(final, case when p_final > k then p_final else final end) as final,
    coalesce(substr(page_text, (off + 1)::bigint, (least(fin, case when p_final > k then p_fin else fin end, length(page_text)) - off)::bigint), '') as text
  from lp join v_page using (page_id) left join pt using (page_id) where begins
  union all select page_id, url, k, elem_id, tag_name, token, regexp_extract(token, {Q.rx(G.CLASS)}, 1), k, '' from o1 join v_page using (page_id)
  where step = 0 and not is_text and tag_name <> '' and token not like '</%') z where {_SITE} is not null),
up as (select e.k as ek, e.elem_id as own_id, e.tag as own_tag, e.text as own_text, o.* from ae e join ae o on o.page_id = e.page_id and (o.k = e.k or (o.k < e.k and o.final > e.k and o.final >= e.final)))"""


def _positions_sql() -> str:
    inner = "".join(f", bool_or(site = '{site}' and {_matches_any(sel)}) as s{i}_{j}" for i, (site, st) in enumerate(D.SITE_STRUCTURE.items()) for j, sel in enumerate(st.values()))
    names = [f"case when s{i}_{j} then '{name}' end" for i, st in enumerate(D.SITE_STRUCTURE.values()) for j, name in enumerate(st)]
    quote = _matches_any([("blockquote", None, None, None), ("q", None, None, None), (None, "quote", None, None)])
    return f"""{_TREE},
pa as (select page_id, ek, max(k) filter (tag = 'article') as article from up where own_tag = 'p' group by page_id, ek having max(k) filter (tag = 'article') is not null),
p1 as (select page_id, min(ek) as k from pa group by page_id, article),
el2 as (select up.page_id, own_id, own_tag, own_text, bool_or(tag = 'h1') as h1, bool_or(tag = 'h2') as h2, bool_or(tag = 'h3') as h3, bool_or(p1.k is not null) as first_p,
  bool_or({quote}) as quoted{inner} from up left join p1 on p1.page_id = up.page_id and p1.k = up.k group by up.page_id, own_id, own_tag, own_text)
select page_id, cast(own_id as integer) as elem_id, own_tag as tag, array_to_string(list_filter([case when h1 then 'h1' when h2 then 'h2' when h3 then 'h3' end, {", ".join(names)},
  case when first_p then 'firstParagraph' end, case when quoted or regexp_matches(own_text, '".*"') then 'quote' end], lambda x: x is not null), '|') as positions from el2"""


_AUTHOR = "(" + " or ".join(f"(site = '{s}' and {_matches_any(st['metadata'])})" for s, st in D.SITE_STRUCTURE.items()) + ")"


@query("page_metadata", f"""{_TREE}, ia as (select ae.* from ae where exists (select 1 from up where up.page_id = ae.page_id and up.ek = ae.k and up.tag = 'article')),
se as (select *, coalesce(nullif({_attr_value('data-section')}, ''), nullif(regexp_extract(class, 'section-(\\w+)', 1), '')) as section_name from ia)
select page_id, arg_min(coalesce(nullif({_attr_value('datetime')}, ''), text), elem_id) filter (tag = 'time') as publish_date,
  arg_min(trim(text), elem_id) filter ({_AUTHOR}) as author, arg_min(section_name, elem_id) filter (section_name is not null) as section from se group by page_id""")
def page_metadata(spark, sf):
    return X.page_metadata(_elements(spark, sf))


def _clued(spark, sf):
    """Site elements with their own and their neighbours' clue types."""
    e = materialize(X.with_clues(_site_elements(spark, sf)))
    near = X.surrounding_clues(e).groupBy("page_id", "elem_id").agg(F.collect_list("type").alias("near"))
    none = F.array().cast("array<string>")
    return e.join(near, ["page_id", "elem_id"], "left").withColumn(
        "all_clue_types", F.concat(F.transform("clues", lambda c: c["type"]), F.coalesce("near", none))).drop("near")


@query("surrounding_clues")
def surrounding_clues(spark, sf):
    e = materialize(X.with_clues(_site_elements(spark, sf)))
    return X.surrounding_clues(e)


@query("structural_positions", _positions_sql())
def structural_positions(spark, sf):
    e = _site_elements(spark, sf)
    return e.select("page_id", "elem_id", "tag", F.array_join(X.positions(F.col("site")), "|").alias("positions"))


def _entities(spark, sf):
    return X.page_entities(P.all_site_candidates(_clued(spark, sf)), C.known_entities(spark))


@query("page_entities")
def page_entities(spark, sf):
    """Scored entities of every finance page."""
    return _entities(spark, sf).select("page_id", "normalized", "type", "text", "source", F.round("score", 6).alias("score"), "level")


@query("best_entity_per_element")
def best_entity_per_element(spark, sf):
    return X.best_entity(_elements(spark, sf), materialize(_entities(spark, sf)))

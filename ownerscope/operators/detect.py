"""Detection on page elements: tickers, layered and list detection, DOM clues, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions.text import any_of, literal_array, literal_map, regex, sanitize_page
from ownerscope.operators import mentions as M
from ownerscope.operators import scoring as C
from ownerscope.sources.pages import closest, node_matches, self_matches, site_of, url_path
from ownerscope.session import computed_once


def attr(name: str) -> Column:
    return F.nullif(F.try_element_at(F.col("attrs"), F.lit(name)), F.lit(""))


def group(text: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, regex(pattern), n), F.lit(""))


# --- layered and listed names ------------------------------------------------
def detect_layered(text: Column, href: Column, parent_tag: Column, min_score: float = D.MIN_SCORE_LAYERED,
                   max_chars: int | None = None) -> Column:
    """Best of the strict, flexible and contextual patterns; null below the minimum.

    The flexible pattern yields its whole match: its only group is the suffix.
    """
    clean = sanitize_page(text, max_chars)
    extra = (F.when(href.contains("company") | href.contains("quote"), 0.1).otherwise(0.0),
             F.when(F.upper(parent_tag).isin("H1", "H2"), 0.1).otherwise(0.0))
    options = []
    for i, (strategy, pattern) in enumerate(D.LAYERED_PATTERNS):
        p = regex(pattern, "i")
        base = 0.5 + {"strict": 0.3, "flexible": 0.2}.get(strategy, 0.0)
        score = F.least(F.lit(1.0), F.lit(base) + extra[0] + extra[1])
        whole = i == 2
        options.append(F.when(clean.rlike(p), F.struct(
            score.alias("confidence"), F.lit(-i).alias("rank"),
            F.regexp_extract(clean, p, 0 if whole else 1).alias("company"), F.lit(strategy).alias("strategy"))))
    best = F.array_max(F.filter(F.array(*options), lambda o: o.isNotNull()))
    return F.when(best["confidence"] >= min_score, F.struct(
        best["company"].alias("company"), best["confidence"].alias("confidence"), best["strategy"].alias("strategy")))


def candidate_text(c: Column, product_name: str | None = None) -> Column:
    """Text worth checking; ``product_name`` excludes a tool's own label on the page."""
    rejects = D.CANDIDATE_REJECTS + ([product_name] if product_name else [])
    return F.length(F.trim(c)).between(3, 100) & ~any_of([F.trim(c).contains(r) for r in rejects])


def detect_listed(c: Column) -> Column:
    """Listed company contained in the text, else the text itself if it looks like a name."""
    text = F.trim(c)
    low = F.lower(text)
    listed = F.filter(literal_array(D.LISTED_COMPANIES), lambda n: low.contains(F.lower(n)))
    suffix = any_of([text.contains(" " + s) | text.endswith(s) for s in D.LISTED_SUFFIXES])
    kind = any_of([low.contains(t.lower()) for t in D.LISTED_TYPES])
    common = any_of([text.startswith(w) for w in D.LISTED_COMMON_WORDS])
    named = F.when((suffix | kind) & text.rlike("^[A-Z]") & ~common, text)
    return F.when(candidate_text(c), F.coalesce(F.try_element_at(listed, F.lit(1)), named))


def eligible_element(tag: Column, cls: Column, text: Column) -> Column:
    t = F.trim(text)
    good = (tag.isin(*D.ELIGIBLE_TAGS) | cls.rlike("(?i)" + D.ELIGIBLE_CLASS) | t.rlike(regex(D.ELIGIBLE_TEXT)))
    return ~tag.isin(*D.SKIPPED_TAGS) & F.length(t).between(2, 200) & good


# --- site tickers ------------------------------------------------------------
def quote_ticker(text: Column, symbol: Column, href: Column) -> Column:
    """Quote site: data-symbol, quote link, then 'T +1.2%'."""
    return F.coalesce(symbol, group(href, r"\/quote\/([A-Z]{1,5})"), group(text, r"([A-Z]{1,5})\s*[+-]\d+\.\d+%"))


def terminal_ticker(text: Column) -> Column:
    """Terminal formats: 'T US Equity', 'T:US' or an ISIN, with the exchange captured."""
    full = r"\b([A-Z]{1,5})(?:\s+(US|LN|HK|JP|GR|FP))(?:\s+(Equity))?\b"
    short = r"([A-Z]{1,5}):([A-Z]{2})"
    isin = r"\b([A-Z]{2}[A-Z0-9]{10})\b"
    kind = F.when(text.rlike(regex(full)), "full").when(text.rlike(short), "short").when(text.rlike(regex(isin)), "isin")
    exchange = F.when(kind == "full", group(text, full, 2)).when(kind == "short", group(text, short, 2))
    return F.when(kind.isNotNull(), F.struct(
        F.when(kind == "full", group(text, full)).when(kind == "short", group(text, short))
         .otherwise(group(text, isin)).alias("ticker"),
        F.when(kind == "isin", "isin").otherwise("ticker").alias("type"),
        exchange.alias("exchange"),
        F.try_element_at(literal_map(D.EXCHANGE_NAMES), F.coalesce(exchange, F.lit(""))).alias("exchange_name")))


def market_ticker(text: Column, data_ticker: Column, data_symbol: Column, href: Column) -> Column:
    """Market site: attribute, stock link, '(T:EXCH)', then 'T 1.2%'."""
    in_link = group(href, r"\/investing\/stock\/([A-Z]{1,5})")
    bracket = r"\(([A-Z]{1,5})(?::([A-Z]+))?\)"
    change = group(text, r"([A-Z]{1,5})\s+[+-]?\d+\.?\d*%")
    direct = F.coalesce(data_ticker, data_symbol)
    ticker = F.coalesce(direct, in_link, group(text, bracket), change)
    return F.when(ticker.isNotNull(), F.struct(
        ticker.alias("ticker"),
        F.when(direct.isNotNull(), "data-attribute").when(in_link.isNotNull(), "href")
         .when(group(text, bracket).isNotNull(), "text-pattern").otherwise("percent-change").alias("found_in"),
        F.when(direct.isNull() & in_link.isNull(), group(text, bracket, 2)).alias("exchange")))


def site_tickers(elements: DataFrame) -> DataFrame:
    """Direct tickers of page elements by the rules of their site."""
    e = elements.withColumn("site", site_of(F.col("url"))).filter(F.col("site").isNotNull())
    market = market_ticker(F.col("text"), attr("data-ticker"), attr("data-symbol"), attr("href"))
    component = F.when(F.col("tag") == "bg-quote", F.coalesce(attr("symbol"), attr("channel")))
    ticker = (F.when(F.col("site") == "yahoo", quote_ticker(F.col("text"), attr("data-symbol"), attr("href")))
              .when(F.col("site") == "bloomberg", terminal_ticker(F.col("text"))["ticker"])
              .when(F.col("site") == "marketwatch", F.coalesce(market["ticker"], component)))
    return e.withColumn("ticker", F.upper(ticker)).filter(F.col("ticker").isNotNull())


def related_tickers(tickers: DataFrame) -> DataFrame:
    """Per page: the ticker of its address and the other tickers on it."""
    primary = group(url_path(F.col("url")), r"\/quote\/([A-Z]{1,5})")
    return tickers.withColumn("primary", primary).groupBy("page_id", "primary").agg(
        F.array_sort(F.collect_set(F.when(F.col("primary").isNull() | (F.col("ticker") != F.col("primary")),
                                          F.col("ticker")))).alias("related"))


def exchange_hint(text: Column) -> Column:
    """First exchange code or name contained in the text, US by default."""
    codes = F.array(*[F.when(text.contains(c) | text.contains(n), F.lit(c)) for c, n in D.EXCHANGE_NAMES.items()])
    return F.coalesce(F.try_element_at(F.filter(codes, lambda c: c.isNotNull()), F.lit(1)), F.lit("US"))


def watchlist(elements: DataFrame) -> DataFrame:
    return elements.filter(self_matches((None, "watchlist__symbol", None, None)) & (F.trim("text") != "")).select(
        "page_id", F.upper(F.trim("text")).alias("ticker")).distinct()


def market_summary(elements: DataFrame) -> DataFrame:
    """Summary items as (ticker, price, change, percent), from their child elements."""
    items = [(None, "markets__item", None, None), (None, "market-summary__item", None, None)]
    item = F.filter("ancestors", lambda a: any_of([node_matches(a["tag"], a["class"], a["attrs"], s) for s in items]))
    rows = elements.withColumn("item", F.try_element_at(item, F.lit(1))["id"]).filter(F.col("item").isNotNull())

    def child(selectors) -> Column:
        return F.min_by("text", F.when(any_of([self_matches(s) for s in selectors]), F.col("elem_id")))

    return rows.groupBy("page_id", "item").agg(
        F.upper(F.trim(child([(None, "ticker", None, None), (None, None, "data-ticker", "")]))).alias("ticker"),
        child([(None, "price", None, None)]).alias("price"), child([(None, "change", None, None)]).alias("change"),
        child([(None, "percent", None, None)]).alias("percent")).filter(
        (F.col("ticker") != "") & (F.col("price") != "")).drop("item")


def profile_headers(elements: DataFrame) -> DataFrame:
    """Profile headings of the list site: direct high-confidence entities."""
    head = self_matches((None, "listuser-header__name", None, None))
    return elements.filter((site_of(F.col("url")) == "forbes") & head).select(
        "page_id", "elem_id", F.trim("text").alias("text"), F.lit("company").alias("type"),
        F.lit(0.95).alias("score"), F.lit("high").alias("level"))


def latest_quotes(elements: DataFrame) -> DataFrame:
    """Price attributes per ticker element."""
    return elements.filter(attr("data-ticker").isNotNull() & attr("data-last-price").isNotNull()).select(
        "page_id", attr("data-ticker").alias("ticker"), attr("data-last-price").try_cast("double").alias("price"),
        attr("data-change").try_cast("double").alias("change"),
        attr("data-change-percent").try_cast("double").alias("percent"), attr("data-volume").try_cast("bigint").alias("volume"))


# --- DOM clues ---------------------------------------------------------------
def clues(site: Column, text: Column, symbol: Column, href: Column) -> Column:
    """Clues of one element: site patterns in its text and link, and data-symbol."""
    out = []
    for s, patterns in D.SITE_PATTERNS.items():
        for name, p in patterns:
            out.append(F.when((site == s) & text.rlike(regex(p)), F.struct(
                F.lit(name).alias("type"), F.regexp_extract(text, regex(p), 1).alias("value"),
                F.lit(0.9).alias("confidence"))))
    out.append(F.when(symbol.isNotNull(), F.struct(
        F.lit("dataAttribute").alias("type"), symbol.alias("value"), F.lit(0.95).alias("confidence"))))
    for s, patterns in D.SITE_PATTERNS.items():
        for name, p in patterns:
            out.append(F.when((site == s) & href.rlike(regex(p)), F.struct(
                F.lit("href_" + name).alias("type"), F.regexp_extract(href, regex(p), 1).alias("value"),
                F.lit(0.85).alias("confidence"))))
    return F.filter(F.array(*out), lambda c: c.isNotNull())


def with_clues(elements: DataFrame) -> DataFrame:
    e = elements.withColumn("site", site_of(F.col("url")))
    return computed_once(e, "clues", clues(F.col("site"), F.col("text"), attr("data-symbol"), attr("href")))


def surrounding_clues(elements: DataFrame) -> DataFrame:
    """Clues each element receives from three ancestor levels and two siblings a side.

    Both are equi-joins: an element names the neighbours it listens to (at most
    seven), and only elements that have clues are on the other side.
    """
    key = ["page_id", "elem_id"]
    giving = elements.filter(F.size("clues") > 0).select(
        "page_id", "parent_id", "sib_ord", F.col("elem_id").alias("from_id"), F.explode("clues").alias("c"))
    up = elements.select(*key, F.posexplode(F.slice("ancestors", 1, 3)).alias("d", "a")).select(
        *key, (F.col("d") + 1).alias("distance"), F.col("a.id").alias("from_id"))
    from_up = up.join(giving, ["page_id", "from_id"]).select(
        *key, F.col("c.type").alias("type"), F.col("c.value").alias("value"), "distance",
        (F.col("c.confidence") * (1 - F.col("distance") * 0.1)).alias("confidence"))
    offsets = F.array(*[F.lit(o) for o in (-2, -1, 1, 2)])
    side = elements.filter(F.col("parent_id").isNotNull()).select(
        *key, "parent_id", "sib_ord", F.explode(offsets).alias("o")).select(
        *key, "parent_id", (F.col("sib_ord") + F.col("o")).alias("sib_ord"), F.abs("o").alias("distance"))
    from_side = side.join(giving, ["page_id", "parent_id", "sib_ord"]).select(
        *key, F.col("c.type").alias("type"), F.col("c.value").alias("value"), "distance",
        (F.col("c.confidence") * 0.7).alias("confidence"))
    return from_up.unionByName(from_side)


def positions(site: Column) -> Column:
    """Structural positions of an element: heading, profile parts, first paragraph, quote."""
    def within(tag: str) -> Column:
        return (F.col("tag") == tag) | F.exists("ancestors", lambda a: a["tag"] == tag)

    heading = F.when(within("h1"), "h1").when(within("h2"), "h2").when(within("h3"), "h3")
    parts = [heading]
    for s, structure in D.SITE_STRUCTURE.items():
        for name, selectors in structure.items():
            parts.append(F.when((site == s) & closest(selectors), F.lit(name)))
    parts.append(F.when(F.col("p_rank") == 1, F.lit("firstParagraph")))
    quote = [("blockquote", None, None, None), ("q", None, None, None), (None, "quote", None, None)]
    parts.append(F.when(closest(quote) | F.col("text").rlike('".*"'), F.lit("quote")))
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def page_metadata(elements: DataFrame) -> DataFrame:
    """Date, author and section per page with an article, from its element table."""
    in_article = closest([("article", None, None, None)])
    e = elements.withColumn("site", site_of(F.col("url")))
    author = any_of([(F.col("site") == s) & any_of([self_matches(x) for x in st["metadata"]])
                     for s, st in D.SITE_STRUCTURE.items()])
    section = F.coalesce(attr("data-section"), group(F.col("class"), r"section-(\w+)"))
    first = lambda value, test: F.min_by(value, F.when(test, F.col("elem_id")))
    return e.filter(in_article & F.col("site").isNotNull()).groupBy("page_id").agg(
        first(F.coalesce(attr("datetime"), F.col("text")), F.col("tag") == "time").alias("publish_date"),
        first(F.trim("text"), author).alias("author"), first(section, section.isNotNull()).alias("section"))


def best_entity(elements: DataFrame, entities: DataFrame) -> DataFrame:
    """Best detected entity of the page for each element, at least 0.5.

    The entities of a page are few and gathered once per page; an element picks
    its best in place, so no element-entity pairs are produced.
    """
    per_page = entities.groupBy("page_id").agg(F.array_sort(F.collect_list(
        F.struct("ord", "text", "score", F.col("elem_id").alias("at")))).alias("entities"))
    t = F.trim("text")
    rows = elements.filter(F.length(t) > 0).withColumn("t", t).join(per_page, "page_id")

    def scored(e: Column) -> Column:
        share = F.length(e["text"]) / F.length("t")
        s = (e["score"] + F.when(F.contains(F.col("t"), e["text"]), 0.2).otherwise(0.0)
             + F.when(e["at"] == F.col("elem_id"), 0.3).otherwise(0.0)
             + F.when(share > 0.8, 0.1).when(share < 0.2, -0.1).otherwise(0.0))
        return F.struct(s.alias("score"), (-e["ord"]).alias("o"), e["text"].alias("text"))

    best = computed_once(rows, "best", F.array_max(F.transform("entities", scored)))
    return best.filter(F.col("best.score") >= 0.5).select(
        "page_id", "elem_id", F.col("best.text").alias("entity"), F.col("best.score").alias("score"))


# --- page entities -----------------------------------------------------------
def site_boost(score: Column, site: Column, primary: Column) -> Column:
    """Per-site adjustments, capped at 1."""
    tagged = self_matches((None, "company-tag", None, None)) | self_matches((None, None, "data-type", ""))
    market = closest([(None, "watchlist", None, None), (None, "markets-data", None, None), (None, "markets__group", None, None)])
    header = closest([(None, "listuser-header", None, None), (None, "profile-header", None, None)])
    block = self_matches((None, "listuser-block__title", None, None))
    return F.least(F.lit(1.0), F.when((site == "yahoo") & primary, score * 1.1)
                   .when((site == "bloomberg") & tagged, score * 1.15)
                   .when((site == "marketwatch") & market, score * 1.1)
                   .when(site == "forbes", F.least(F.lit(1.0), score + F.when(header, 0.2).otherwise(0.0))
                         + F.when(block, 0.1).otherwise(0.0))
                   .otherwise(score))


def page_entities(elements: DataFrame, known: DataFrame, min_score: float = D.MIN_SCORE_ADAPTER) -> DataFrame:
    """Scored entities of page elements: text mention, DOM context, known entities.

    Takes candidate elements with ``clues`` and ``all_clue_types`` (own and
    surrounding); returns one detection per page and (normalised, type).
    """
    e = M.resolve_coreferences(M.mention_arrays(elements)).filter(F.size("mentions") > 0)
    multipliers = F.create_map(*[x for s, m in D.SITE_MULTIPLIERS.items() for x in (F.lit(s), literal_map(m))])
    e = e.withColumn("positions", positions(F.col("site")))
    e = e.select("page_id", "url", "elem_id", "site", "tag", "class", "attrs", "ancestors", "all_clue_types", "positions",
                 F.try_element_at(multipliers, F.col("site")).alias("multipliers"),
                 M.array_confidence(F.col("mentions")).alias("nlp_confidence"),
                 F.transform("mentions", lambda m: m["confidence"]).alias("confidences"),
                 F.try_element_at("mentions", F.lit(1)).alias("m"))
    e = e.select("*", "m.text", "m.normalized", "m.type", "m.confidence").drop("m")
    dom = C.dom_confidence(F.col("positions"), F.col("all_clue_types"), F.col("multipliers"))
    e = C.cross_reference(e.withColumn("dom", dom), known)
    none = F.lit(None).cast("string")
    scored = C.score_entities(e, {
        "patternMatch": C.pattern_factor(F.col("confidence"), F.col("type")),
        "domContext": C.dom_factor(F.col("dom"), F.col("positions"), F.col("all_clue_types")),
        "nlpConfidence": C.nlp_factor(F.col("nlp_confidence"), F.col("confidences")),
        "crossReference": F.col("cross_reference"),
        "contextConsistency": C.consistency_factor(none, none, F.col("all_clue_types"), F.col("type")),
    })
    primary = group(url_path(F.col("url")), r"\/quote\/([A-Z]{1,5})")
    scored = scored.withColumn("score", site_boost(
        F.col("score"), F.col("site"), F.coalesce(F.col("normalized") == primary, F.lit(False))))
    return M.detected(scored.select("page_id", "elem_id", F.col("elem_id").alias("ord"), "text", "normalized", "type",
                                    F.col("site").alias("source"), "score", "level", "recommendation", "breakdown"),
                      "page_id", min_score=min_score)


def entity_card(df: DataFrame) -> DataFrame:
    """Display fields of an enriched mention joined with its company."""
    listing = F.when(F.col("ticker").isNotNull(), F.concat(
        F.col("ticker"), F.when(F.col("exchange").isNotNull(), F.concat(F.lit(" ("), "exchange", F.lit(")"))).otherwise("")))
    return df.select(
        F.col("text").alias("title"),
        F.when(F.col("base_name").isNotNull() & (F.col("base_name") != F.col("text")), F.col("base_name")).alias("base"),
        F.concat_ws(" | ", listing, F.col("industry")).alias("listing"),
        F.floor(F.col("confidence") * 100 + 0.5).cast("int").alias("confidence_pct"),
        F.col("kb_company").isNotNull().alias("verified"))

"""Enrichment marts: ownership, registry, contracts, macro series, news, merge."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions.text import (
    agency_weight, half_up, headline_sentiment, is_classified, is_offshore, key_indicators, literal_array,
    literal_map, money_text, ownership_relevance,
)


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First k rows per key, or all ranked. The rank limit also runs before the
    shuffle, so a hot key sends at most k rows per task."""
    w = Window.partitionBy(*key).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def contract_scan(contracts: DataFrame, start, end, text: str | None = None, k: int = 50) -> DataFrame:
    """Awards of contract types in a period, largest k per recipient, flattened."""
    kept = contracts.filter(F.col("award_type").isin(*D.AWARD_TYPES) & F.col("start_date").between(start, end))
    if text is not None:
        kept = kept.filter(F.lower("recipient_name").contains(text.lower()))
    rows = top_k(kept, ["recipient_id"], [F.desc("amount"), F.asc("award_id")], k)
    return rows.withColumn("is_classified", is_classified(F.col("description"))).withColumn(
        "agency_risk", agency_weight(F.col("agency")))


def series_scan(observations: DataFrame, newest: int = 12, keep: int = 6) -> DataFrame:
    """Newest observations per series; missing ones are dropped after the first cut."""
    recent = top_k(observations, ["series_id"], [F.desc("date")], newest)
    return top_k(recent.filter(F.col("value").isNotNull()), ["series_id"], [F.desc("date")], keep)


def news_scan(articles: DataFrame, phrase: Column, k: int | None = 20, since=None, until=None) -> DataFrame:
    """Articles with the phrase and an ownership keyword from leading sources.

    ``since`` and ``until`` are days of ``published_at``, both included.
    """
    day = F.to_date("published_at") if since is not None or until is not None else None
    if since is not None:
        articles = articles.filter(day >= F.lit(since).cast("date"))
    if until is not None:
        articles = articles.filter(day <= F.lit(until).cast("date"))
    text = F.lower(F.concat_ws(" ", "title", "description"))
    words = D.OWNERSHIP_KEYWORDS[:5]
    hit = text.contains(F.lower(phrase)) & text.rlike("|".join(words))
    kept = articles.filter(F.col("source_id").isin(*D.TIER1_SOURCES) & hit)
    return top_k(kept, ["company_id"], [F.asc("doc_id")], k)


# --- registry ----------------------------------------------------------------
def offshore_structure(entities: DataFrame, key: str) -> DataFrame:
    """Offshore counts, jurisdictions and risk per company, in two grouping steps."""
    per = entities.groupBy(key, "jurisdiction").agg(F.count("*").alias("n")).withColumn(
        "off", is_offshore(F.col("jurisdiction")))
    agg = per.groupBy(key).agg(
        F.sum(F.when(F.col("off"), F.col("n")).otherwise(0)).alias("offshore_count"),
        F.count("*").alias("jurisdictions"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("jurisdiction", "n")))).alias("breakdown"),
        F.coalesce(F.max(F.col("jurisdiction").isin(*D.SECRECY_CODES)), F.lit(False)).alias("_secret"))
    patterns = F.filter(F.array(
        F.when(F.col("offshore_count") > 2, F.lit("Multiple offshore jurisdictions detected")),
        F.when(F.col("_secret"), F.lit("High-secrecy jurisdiction detected")),
        F.when(F.col("jurisdictions") > 5, F.lit("Complex multi-jurisdictional structure"))),
        lambda x: x.isNotNull())
    out = agg.withColumn("patterns", patterns)
    n = F.size("patterns")
    return out.withColumn("risk", F.when((n >= 2) | (F.col("offshore_count") >= 3), "HIGH")
                          .when((n >= 1) | (F.col("offshore_count") >= 1), "MEDIUM").otherwise("LOW")).drop("_secret")


# --- contracts ---------------------------------------------------------------
def exact_sum(c: Column) -> Column:
    """Sum of doubles that are written with at most six decimals, without rounding on the way; other values sum as doubles.

    A sum of doubles depends on the order of its rows, and whole amounts come out a hair below or above.
    """
    decimal = c.try_cast("decimal(28,6)")
    fits = F.coalesce(decimal.cast("double") == c, F.lit(False))
    return F.when(F.count_if(c.isNotNull() & ~fits) == 0, F.sum(F.when(fits, decimal)).cast("double")).otherwise(F.sum(c))


def gov_dependency(contracts: DataFrame, key: str, high: float = 100e6, medium: float = 10e6,
                   defense: float = 0.3, concentration: float = 0.7) -> DataFrame:
    """Contract totals, agency and type distribution, risk level with its reasons."""
    total_of = exact_sum if contracts.schema["amount"].dataType.typeName() == "double" else F.sum
    base = contracts.groupBy(key, F.coalesce("agency", F.lit("Unknown")).alias("agency"),
                             F.coalesce("award_type", F.lit("Unknown")).alias("award_type")).agg(
        total_of(F.col("amount")).alias("amount"), F.count("*").alias("n"),
        F.sum(is_classified(F.col("description")).cast("bigint")).alias("cl"))
    agencies = base.groupBy(key, "agency").agg(total_of(F.col("amount")).alias("amount"), F.sum("cl").alias("cl")).groupBy(key).agg(
        total_of(F.col("amount")).alias("total_value"), F.sum("cl").alias("classified_count"),
        F.max("amount").alias("_top"),
        F.sum(F.when(F.col("agency") == "DEPARTMENT OF DEFENSE", F.col("amount"))).alias("_dod"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("agency", "amount")))).alias("agencies"))
    types = base.groupBy(key, "award_type").agg(F.sum("n").alias("n")).groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("award_type", "n")))).alias("types"))
    out = agencies.join(types, key)
    total = F.col("total_value")
    by_value = F.when(total > high, "HIGH").when(total > medium, "MEDIUM").otherwise("LOW")
    is_dod = F.coalesce(F.col("_dod") > total * defense, F.lit(False))
    is_one = (total > 0) & (F.try_divide(F.col("_top"), total) > concentration)
    reasons = F.filter(F.array(
        F.when(total > high, F.lit(f"High total contract value (>${high / 1e6:g}M)")).when(
            total > medium, F.lit(f"Significant contract value (>${medium / 1e6:g}M)")),
        F.when(is_dod, F.lit(f"High defense dependency (>{100 * defense:g}%)")),
        F.when(F.col("classified_count") > 0, F.lit("Classified/sensitive contracts detected")),
        F.when(is_one, F.lit(f"High agency concentration (>{100 * concentration:g}%)"))), lambda x: x.isNotNull())
    out = out.withColumn("reasons", reasons).withColumn(
        "risk", F.when(is_dod | (F.col("classified_count") > 0) | is_one, "HIGH").otherwise(by_value))
    return out.drop("_top", "_dod")


def dependency_text(df: DataFrame) -> DataFrame:
    total, risk = money_text(F.col("total_value")), F.col("risk")
    return df.withColumn("explanation", F.when(risk == "HIGH", F.concat(
        F.lit("High government dependency detected. Total contracts: "), total, F.lit(". Key risks: "),
        F.array_join("reasons", ", "), F.lit(".")))
        .when(risk == "MEDIUM", F.concat(F.lit("Moderate government exposure. Total contracts: "), total,
                                         F.lit(". Monitor for revenue concentration.")))
        .when(risk == "LOW", F.lit("Limited government contracts detected. Low dependency risk."))
        .otherwise(F.lit("No government contract exposure identified.")))


# --- macro -------------------------------------------------------------------
def series_trend(observations: DataFrame) -> DataFrame:
    """Trend per series from the two newest observations of the scan."""
    two = series_scan(observations).filter(F.col("rank") <= 2).groupBy("series_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("current"),
        F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("previous"),
        F.count("*").alias("n"))
    change = (F.col("current") - F.col("previous")) / F.nullif("previous", F.lit(0.0)) * 100
    rising = F.when(F.col("previous") == 0, F.col("current") > 0).otherwise(change > 0)
    return two.withColumn("trend", F.when(F.col("n") < 2, "INSUFFICIENT_DATA")
                          .when(F.abs(change) < 0.1, "STABLE").when(rising, "RISING").otherwise("FALLING")).drop("n")


def sector_series(df: DataFrame, sector: str = "sector") -> DataFrame:
    """One row per indicator of the row's sector; unknown sectors use the default list."""
    table = F.create_map(*chain.from_iterable((F.lit(k), literal_array(v)) for k, v in D.SECTOR_SERIES.items()))
    series = F.coalesce(F.try_element_at(table, F.col(sector)), literal_array(D.SECTOR_SERIES["Default"]))
    return df.select("*", F.posexplode(series).alias("indicator_ord", "series_id"))


def macro_context(companies: DataFrame, trends: DataFrame, key: str, sector: str = "sector") -> DataFrame:
    """Opportunities, risks and implications per company from the trends of its sector."""
    rows = sector_series(companies.withColumn("_s", F.coalesce(F.col(sector), F.lit("Default"))), "_s").join(
        trends.select("series_id", "trend"), "series_id", "left")
    wide = rows.groupBy(key, "_s").agg(F.map_from_entries(F.collect_list(
        F.struct("series_id", F.coalesce("trend", F.lit(""))))).alias("t"))

    def trend(series: str) -> Column:
        def one(s: str) -> Column:
            return F.nullif(F.try_element_at("t", F.lit(s)), F.lit(""))
        return F.coalesce(one("FEDFUNDS"), one("TB3MS")) if series == "RATES" else one(series)

    def sentences(kind: str) -> Column:
        return F.filter(F.array(*[
            F.when((trend(series) == wanted) & (F.lit(True) if sec is None else F.col("_s") == sec), F.lit(text))
            for k, sec, series, wanted, text in D.MACRO_RULES if k == kind]), lambda x: x.isNotNull())

    for kind in ("opportunities", "risks", "implications"):
        wide = wide.withColumn(kind, sentences(kind))

    def first(kind: str, lead: str, tail: str) -> Column:
        return F.when(F.size(kind) > 0, F.concat(F.lit(lead), F.lower(F.try_element_at(kind, F.lit(1))), F.lit(tail))).otherwise("")

    summary = F.trim(F.concat(
        F.lit("Economic context for "), F.col("_s"), F.lit(" sector: "),
        first("opportunities", "Opportunities include ", ". "), first("risks", "Key risks: ", ". "),
        first("implications", "Ownership impact: ", ".")))
    return wide.withColumn("summary", summary).withColumnRenamed("_s", "sector_used").drop("t")


# --- news --------------------------------------------------------------------
def scored_articles(articles: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "title", "description")
    return (articles.withColumn("relevance", ownership_relevance(text, F.col("source_id")))
            .withColumn("sentiment", headline_sentiment(text))
            .withColumn("indicators", key_indicators(text)))


TRIGGERS = [  # type, confidence, all of / any of the words
    ("ACTIVIST_ACTIVITY", 0.8, any, ["activist", "proxy"]),
    ("M&A_ACTIVITY", 0.9, any, ["acquisition", "merger"]),
    ("STAKE_INCREASE", 0.7, all, ["increased", "stake"]),
    ("POSITION_REDUCTION", 0.6, any, ["sold", "reduced"]),
]


def ownership_triggers(articles: DataFrame, k: int | None = 5) -> DataFrame:
    """Trigger events of relevant articles; top k per company by confidence."""
    low = F.lower(F.concat_ws(" ", "title", "description"))

    def test(how, words) -> Column:
        out = low.contains(words[0])
        for w in words[1:]:
            out = (out | low.contains(w)) if how is any else (out & low.contains(w))
        return out

    events = F.filter(F.array(*[
        F.when(test(how, words), F.struct(F.lit(i).alias("sub"), F.lit(name).alias("type"), F.lit(conf).alias("confidence")))
        for i, (name, conf, how, words) in enumerate(TRIGGERS)]), lambda x: x.isNotNull())
    rows = articles.select("company_id", "doc_id", "title", F.explode(events).alias("e")).select(
        "company_id", "doc_id", "title", "e.*")
    return rows if k is None else top_k(
        rows, ["company_id"], [F.desc("confidence"), F.asc("doc_id"), F.asc("sub")], k)


def sentiment_summary(articles: DataFrame, key: str) -> DataFrame:
    counts = articles.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("sentiment") == "POSITIVE", 1)).alias("p"),
        F.count(F.when(F.col("sentiment") == "NEGATIVE", 1)).alias("g"))
    pos, neg = F.col("p") / F.col("n"), F.col("g") / F.col("n")
    pct = lambda c: half_up(c * 100).cast("int")
    return counts.select(
        key, F.col("n").alias("articles"),
        F.when(pos > 0.6, "POSITIVE").when(neg > 0.6, "NEGATIVE").when(pos > neg, "SLIGHTLY_POSITIVE")
         .when(neg > pos, "SLIGHTLY_NEGATIVE").otherwise("NEUTRAL").alias("overall"),
        F.when(pos > 0.6, F.concat(pct(pos).cast("string"), F.lit("% positive coverage")))
         .when(neg > 0.6, F.concat(pct(neg).cast("string"), F.lit("% negative coverage")))
         .when(pos > neg, "Moderately positive sentiment").when(neg > pos, "Moderately negative sentiment")
         .otherwise("Mixed sentiment signals").alias("reason"),
        pct(pos).alias("positive_pct"), pct(neg).alias("negative_pct"),
        pct((F.col("n") - F.col("p") - F.col("g")) / F.col("n")).alias("neutral_pct"))


# --- ownership lookup --------------------------------------------------------
def ownership_key(name: Column) -> Column:
    """Table key of a company name: the first key contained either way, else default."""
    low = F.lower(name)
    head = F.split_part(low, F.lit(" "), F.lit(1))
    keys = literal_array(list(D.OWNERSHIP_TABLE))
    hits = F.filter(keys, lambda k: low.contains(k) | k.contains(head))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("default"))


def lookup_ownership(names: DataFrame, name: str = "name") -> DataFrame:
    """Owners of each name from the built-in table."""
    owners = F.create_map(*chain.from_iterable(
        (F.lit(k), F.array(*[F.struct(F.lit(n).alias("owner"), F.lit(p).alias("percent"),
                                      F.lit(s).cast("bigint").alias("shares")) for n, p, s in rows]))
        for k, rows in D.OWNERSHIP_TABLE.items()))
    keyed = names.withColumn("table_key", ownership_key(F.col(name)))
    return keyed.select("*", F.posexplode(F.try_element_at(owners, F.col("table_key"))).alias("owner_ord", "o")).select(
        *keyed.columns, "owner_ord", "o.*")


# --- multi-source merge ------------------------------------------------------
@dataclass(frozen=True)
class SourceSpec:
    """A feed the merge can use: its rows per company, (company_id, ord, item), and the field they fill.

    Items of a list field are appended, source by source and in order; items (key, value) of a map field are assigned, so the
    last one of a key wins. Sources that fill the same field share its item type.
    """
    name: str
    field: str
    flatten: Callable[[DataFrame], DataFrame]
    assigned: bool = False


SOURCES: dict[str, SourceSpec] = {}


def register_source(spec: SourceSpec) -> None:
    SOURCES[spec.name] = spec


def _items(*fields: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.select("company_id", "ord", F.struct(*fields).alias("item"))


def _pairs(d: DataFrame) -> DataFrame:
    return d.select("company_id", "ord", F.struct(F.col("field").alias("key"), F.col("value").cast("double").alias("value")).alias("item"))


# in the order in which their answers are merged
register_source(SourceSpec("yahoo", "owners", _items("name", "percent", "shares")))
register_source(SourceSpec("sec", "owners", _items("name", "percent", "shares")))
register_source(SourceSpec("opencorporates", "entities", _items("name", "jurisdiction", "status")))
register_source(SourceSpec("usaspending", "contracts", _items("award_id", "amount", "agency")))
register_source(SourceSpec("fred", "indicators", _pairs, assigned=True))
register_source(SourceSpec("news", "articles", _items("title", "sentiment")))

MARKET = SourceSpec("", "market", _pairs, assigned=True)  # market fields come with the owners of one source and count with it


def _placed(rows: DataFrame) -> DataFrame:
    """``ord`` as a struct that compares numbers as numbers and texts as texts, whatever the feed has."""
    kind = rows.schema["ord"].dataType.typeName()
    place = "s" if kind in ("string", "varchar", "char") else "n" if kind in ("byte", "short", "integer", "long") else "d"
    own = {"n": "bigint", "d": "double", "s": "string"}
    return rows.withColumn("ord", F.struct(*[(F.col("ord") if c == place else F.lit(None)).cast(t).alias(c) for c, t in own.items()]))


def tagged_rows(feeds: dict[str, DataFrame], market: DataFrame | None = None) -> DataFrame:
    """All feeds as one table: company_id, source, src (its place), ord, and a typed item column per field, null but for the row's own.

    This is the merge without lists: a company with any number of rows stays rows. Of a map field only the last item of a key is here.
    """
    order = {name: k for k, name in enumerate(SOURCES)}
    parts = [(SOURCES[name], feed) for name, feed in feeds.items()] + ([(MARKET, market)] if market is not None else [])
    rows, kinds = [], {}
    for spec, feed in parts:
        own = _placed(spec.flatten(feed))
        if spec.assigned:
            last = own.groupBy("company_id", F.col("item.key").alias("key")).agg(F.max_by(F.struct("ord", "item"), "ord").alias("x"))
            own = last.select("company_id", "x.ord", "x.item")
        kind = own.schema["item"].dataType.simpleString()
        if kinds.setdefault(spec.field, kind) != kind:
            raise ValueError(f"{spec.name}: items of {spec.field} are {kinds[spec.field]}, not {kind}")
        rows.append((spec, own))
    out = None
    for spec, own in rows:
        part = own.select("company_id", F.lit(spec.name).alias("source"), F.lit(order.get(spec.name, -1)).alias("src"), "ord", *[
            (F.col("item") if field == spec.field else F.lit(None).cast(kind)).alias(field) for field, kind in kinds.items()])
        out = part if out is None else out.unionByName(part)
    return out


def merge_sources(companies: DataFrame, feeds: dict[str, DataFrame], failed: DataFrame | None = None, market: DataFrame | None = None,
                  symbols: DataFrame | None = None, answered: DataFrame | None = None) -> DataFrame:
    """One record per company: lists and maps per field, symbol, sources, warnings, quality.

    The feeds, the answers, the failures and the companies themselves are one tagged table with one aggregation by company, so
    the rows of all sources travel once. A source counts when it has rows or is in ``answered`` (company_id, source): an empty list is
    an answer too. ``failed``: company_id, reason. ``symbols``: company_id, symbol, ord; the last one wins. Lists are complete; where
    a company may have more rows than a record should hold, use ``tagged_rows``.
    """
    order = {name: k for k, name in enumerate(SOURCES)}
    rows = tagged_rows(feeds, market)
    fields = rows.columns[4:]
    extra = [("known", F.lit(True), companies.select("company_id"))]
    if failed is not None:
        extra.append(("reason", F.col("reason"), failed))
    if symbols is not None:
        symbols = _placed(symbols)
        extra.append(("symbol", F.struct("ord", "symbol"), symbols))
    if answered is not None:
        extra.append(("answer", F.col("source"), answered.filter(F.col("source").isin(*feeds))))
    for name, value, table in extra:
        rows = rows.unionByName(table.select("company_id", value.alias(name)), allowMissingColumns=True)
    maps = {SOURCES[n].field for n in feeds if SOURCES[n].assigned} | {MARKET.field}

    def gathered(field: str) -> Column:
        every = F.array_sort(F.collect_list(F.when(F.col(field).isNotNull(), F.struct("src", "ord", F.col(field).alias("item")))))
        items = F.transform(every, lambda x: x["item"])
        # several sources may assign a key: the last one stays
        return F.map_from_entries(F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y["key"] == x["key"]))) \
            if field in maps else items

    has = lambda name: name in rows.columns
    out = rows.groupBy("company_id").agg(
        F.max("known").alias("_known"), *[gathered(f).alias(f) for f in fields],
        F.collect_set(F.when(F.col("source") != "", F.col("source"))).alias("_with_rows"),
        (F.collect_set("answer") if has("answer") else F.array().cast("array<string>")).alias("_answers"),
        (F.array_sort(F.collect_set("reason")) if has("reason") else F.array().cast("array<string>")).alias("warnings"),
        (F.max("symbol")["symbol"] if has("symbol") else F.lit(None).cast("string")).alias("symbol")).filter("_known")
    named = F.filter(literal_array(list(order)), lambda n: F.array_contains("_with_rows", n) | F.array_contains("_answers", n))
    out = out.withColumn("sources", named)
    return out.withColumn("quality_score", quality_score(out.columns)).drop("_known", "_with_rows", "_answers")


def quality_score(columns: list[str]) -> Column:
    def n(field: str) -> Column:
        return F.coalesce(F.size(field), F.lit(0)) if field in columns else F.lit(0)

    market = F.coalesce(F.size("market"), F.lit(0)) if "market" in columns else F.lit(0)
    score = (F.size("sources") * 15 + F.when(n("owners") > 0, 25).otherwise(0) + F.when(n("owners") > 5, 15).otherwise(0)
             + F.when(n("entities") > 0, 20).otherwise(0) + F.when(n("contracts") > 0, 20).otherwise(0)
             + F.when(market > 3, 15).otherwise(0))
    return F.least(F.lit(100), score)


def summary_card(merged: DataFrame, owners: int = 5, entities: int = 3, contracts: int = 3) -> DataFrame:
    """The first owners, registry entities and contracts of each company."""
    return merged.select("company_id", F.slice("owners", 1, owners).alias("owners"),
                         F.slice("entities", 1, entities).alias("entities"), F.slice("contracts", 1, contracts).alias("contracts"))

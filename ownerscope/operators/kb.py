"""Company knowledge base: lookups, exact and fuzzy search, upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions import similarity as S
from ownerscope.functions.text import normalize_company
from ownerscope.operators.blocking import candidate_pairs, length_bound
from ownerscope.session import computed_once, materialize

COMPANY_SCHEMA = (
    "id string, name string, aliases array<string>, ticker string, exchange string, "
    "industry string, type string, subsidiaries array<string>, previous_names array<string>"
)


def shipped_kb(spark: SparkSession) -> DataFrame:
    """The ten companies of the built-in dictionary, in their order."""
    rows = [(i, *c) for i, c in enumerate(D.KB_COMPANIES)]
    return with_normalized(spark.createDataFrame(rows, "ord int, " + COMPANY_SCHEMA))


def with_normalized(companies: DataFrame) -> DataFrame:
    return companies.withColumn("normalized_name", normalize_company(F.col("name")))


def upsert_companies(base: DataFrame, updates: DataFrame, stamp: Column) -> DataFrame:
    """Merge updates into companies by id; set fields win, the rest stays.

    One aggregation over base and updates together: `max_by` per field keeps the
    newest non-null value and combines on the map side.
    """
    fields = [c for c in base.columns if c not in ("id", "normalized_name", "date_added", "last_updated")]
    every = base.select("id", *fields, F.lit(0).alias("_v"), F.col("date_added")).unionByName(
        updates.select("id", *[F.col(c) if c in updates.columns else F.lit(None).cast(base.schema[c].dataType).alias(c)
                               for c in fields],
                       F.lit(1).alias("_v"), F.lit(None).cast("timestamp").alias("date_added")))
    merged = every.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_v"))).alias(c) for c in fields],
        F.min("date_added").alias("_added"), F.max("_v").alias("_touched"), F.min("_v").alias("_known"))
    out = merged.select(
        "id", *fields,
        F.coalesce("_added", stamp).alias("date_added"),
        F.when((F.col("_touched") == 1) & (F.col("_known") == 0), stamp).alias("last_updated"))
    return with_normalized(out)


# --- indexes as derived views ------------------------------------------------
def name_index(kb: DataFrame) -> DataFrame:
    return kb.groupBy(F.col("normalized_name").alias("key")).agg(
        F.min_by("id", "ord").alias("company_id"), F.min_by("name", "ord").alias("matched_text"))


def ticker_index(kb: DataFrame) -> DataFrame:
    """Upper-cased ticker -> company; the last company added owns the ticker."""
    return kb.filter(F.col("ticker") != "").groupBy(F.upper("ticker").alias("key")).agg(
        F.max_by("id", "ord").alias("company_id"), F.max_by("ticker", "ord").alias("matched_text"))


def alias_index(kb: DataFrame) -> DataFrame:
    return (kb.select(F.explode("aliases").alias("alias"), "id", "ord")
            .groupBy(normalize_company(F.col("alias")).alias("key"), F.col("id").alias("company_id"))
            .agg(F.min("ord").alias("alias_ord")))


def lookup_exact(queries: DataFrame, kb: DataFrame, by: str, query: str = "query") -> DataFrame:
    """Equi-join of distinct query texts on one index (name, ticker or alias)."""
    texts = queries.select(F.col(query).alias("query")).distinct()
    if by == "ticker":
        keyed, index = texts.withColumn("key", F.upper("query")), ticker_index(kb)
    elif by == "name":
        keyed, index = texts.withColumn("key", normalize_company(F.col("query"))), name_index(kb)
    else:
        keyed, index = texts.withColumn("key", normalize_company(F.col("query"))), alias_index(kb)
    return keyed.join(index, "key").drop("key")


def exact_search(queries: DataFrame, kb: DataFrame, query: str = "query") -> DataFrame:
    """Name, then ticker, then aliases; a company counts once, at its best tier.

    One equi-join: a query text carries its three keys, the indexes are one table.
    """
    tiers = [("name", name_index(kb), 1.0), ("ticker", ticker_index(kb), 0.9), ("alias", alias_index(kb), 0.8)]
    index = None
    for kind, rows, score in tiers:
        text = F.col("matched_text") if "matched_text" in rows.columns else F.lit(None).cast("string")
        part = rows.select(F.lit(kind).alias("match_type"), "key", "company_id", F.lit(score).alias("score"),
                           text.alias("matched_text"))
        index = part if index is None else index.unionByName(part)
    texts = queries.select(F.col(query).alias("query")).distinct()
    normalized = normalize_company(F.col("query"))
    keys = F.array(*[F.struct(F.lit(kind).alias("match_type"), key.alias("key")) for kind, key in
                     (("name", normalized), ("ticker", F.upper("query")), ("alias", normalized))])
    hits = texts.select("query", F.explode(keys).alias("k")).select("query", "k.*").join(index, ["match_type", "key"])
    best = hits.groupBy("query", "company_id").agg(F.max_by(
        F.struct("score", "match_type", F.coalesce("matched_text", "query").alias("matched_text")), "score").alias("hit"))
    return best.select("query", "company_id", "hit.*")


# --- fuzzy search ------------------------------------------------------------
def kb_candidates(kb: DataFrame, aliases: bool = True, tickers: bool = True) -> DataFrame:
    """Searchable texts: names, aliases and tickers with their boost and order."""
    def entry(text, normalized, kind, ord_):
        return F.struct(text.alias("text"), normalized.alias("normalized"), F.lit(kind).alias("kind"),
                        F.lit(D.CANDIDATE_BOOST[kind]).alias("boost"), ord_.cast("int").alias("sub"))

    none = F.array().cast("array<struct<text:string,normalized:string,kind:string,boost:double,sub:int>>")
    parts = [F.array(entry(F.col("name"), F.col("normalized_name"), "name", F.lit(0)))]
    if aliases:
        distinct = F.array_distinct("aliases")
        parts.append(F.transform(distinct, lambda a, i: entry(a, normalize_company(a), "alias", i + 1)))
    if tickers:
        parts.append(F.when(F.col("ticker") != "",
                            F.array(entry(F.col("ticker"), F.upper("ticker"), "ticker",
                                          F.size("aliases") + 1))).otherwise(none))
    return (kb.select(F.col("id").alias("company_id"), "ord", F.explode(F.concat(*parts)).alias("c"))
            .select("company_id", (F.shiftleft(F.col("ord").cast("bigint"), 32) + F.col("c.sub")).alias("ord"), "c.*"))


Scorer = Callable[[Column, Column], Column]


def scored_pairs(queries: DataFrame, candidates: DataFrame, threshold: float,
                 weights: dict[str, float] | None = None, query: str = "query",
                 scorer: Scorer | None = None) -> DataFrame:
    """Every (query, candidate) pair with boosted score >= threshold.

    ``blocking`` gives the pairs that can reach the threshold, by an equi-join
    on rare tokens and grams. Spark broadcasts the candidate side when its size
    allows and shuffles on the keys (with AQE skew splits) otherwise. A custom
    scorer has no known bound and must imply the built-in threshold.
    """
    w = S.merged_weights(weights)
    total = sum(w.values())
    texts = queries.select(F.col(query).alias("query")).distinct().filter(F.col("query").isNotNull())
    q = S.with_features(texts, normalize_company(F.col("query")), "q")
    c = S.with_features(candidates, F.col("normalized"), "c")
    fq, fc = S.feature_columns("q"), S.feature_columns("c")
    pairs = candidate_pairs(q, c, threshold, weights, boost=F.col("boost"))
    kept = ["query", "company_id", "ord", "text", "kind"]
    if scorer is not None:
        return (pairs.withColumn("score", scorer(fq["raw"], fc["raw"]) * F.col("boost"))
                .filter(F.col("score") >= threshold).select(*kept, "score"))
    # cheap parts first; the windowed partial ratio only where 1.0 could still pass
    parts = S.part_ratios(fq, fc)
    cheap = [k for k in w if k != "partial"]
    pairs = computed_once(pairs, "sure", F.struct(
        parts["tokenSet"].alias("tokenSet"), S.abbreviation_bonus(fq["low"], fc["low"]).alias("bonus")))
    needed = F.lit(threshold) / F.col("boost") - 1e-9
    pairs = pairs.filter(length_bound(fq, fc, F.col("sure.tokenSet"), F.col("sure.bonus"), weights) >= needed)
    pairs = computed_once(pairs, "p", F.struct(
        *[(F.col("sure.tokenSet") if k == "tokenSet" else parts[k]).alias(k) for k in cheap], F.col("sure.bonus").alias("bonus")))
    bound = sum((F.col("p")[k] * w[k] for k in cheap), F.lit(w["partial"])) / total + F.col("p.bonus")
    pairs = computed_once(pairs.filter(bound >= needed), "partial", parts["partial"])
    base = sum(((F.col("partial") if k == "partial" else F.col("p")[k]) * weight for k, weight in w.items()),
               F.lit(0.0)) / total
    score = F.least(F.lit(1.0), base + F.col("p.bonus")) * F.col("boost")
    return pairs.withColumn("score", score).filter(F.col("score") >= threshold).select(*kept, "score")


def fuzzy_search(queries: DataFrame, kb: DataFrame, limit: int | None = 5, threshold: float = 0.7,
                 aliases: bool = True, tickers: bool = True, query: str = "query",
                 weights: dict[str, float] | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Best companies per distinct query text: rank, score and what matched."""
    candidates = kb_candidates(kb, aliases, tickers)
    if limit == 1:
        # equal texts of equal boost score alike and the first one wins: each is searched once, however many companies have it
        candidates = candidates.groupBy("normalized", "boost").agg(
            F.max_by(F.struct("company_id", "ord", "text", "kind"), F.struct(-F.col("ord"))).alias("first")).select("normalized", "boost", "first.*")
    pairs = scored_pairs(queries, candidates, threshold, weights, query, scorer)
    best = pairs.groupBy("query", "company_id").agg(
        F.max_by(F.struct("score", "ord", "kind", "text"), F.struct("score", -F.col("ord"))).alias("hit"))
    hits = best.select("query", "company_id", F.col("hit.score").alias("score"), F.col("hit.ord").alias("ord"),
                       F.col("hit.kind").alias("match_type"), F.col("hit.text").alias("matched_text"))
    if limit == 1:
        top = hits.groupBy("query").agg(
            F.max_by(F.struct("company_id", "score", "match_type", "matched_text"),
                     F.struct("score", -F.col("ord"))).alias("hit"))
        return top.select("query", F.lit(1).alias("rank"), "hit.*")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.select("query", "rank", "company_id", "score", "match_type", "matched_text")


def resolve_names(names: DataFrame, kb: DataFrame, query: str = "query") -> DataFrame:
    """Each distinct name with its canonical company, null when nothing is close."""
    hit = fuzzy_search(names, kb, limit=1, query=query).select("query", "company_id", "score")
    return names.select(F.col(query).alias("query")).distinct().join(hit, "query", "left")


def suggestions(partials: DataFrame, kb: DataFrame, query: str = "query", limit: int = 10, threshold: float = 0.5) -> DataFrame:
    """The best completions of each partial name."""
    hits = fuzzy_search(partials, kb, limit=limit, threshold=threshold, query=query)
    named = kb.select(F.col("id").alias("company_id"), F.col("name").alias("text"), "ticker")
    return hits.join(named, "company_id").select("query", "rank", "text", "ticker", F.col("score").alias("confidence"))


def same_company(pairs: DataFrame, kb: DataFrame, a: str = "a", b: str = "b", threshold: float = 0.8) -> DataFrame:
    """Both names resolve (threshold 0.6) to one company, else the plain ratio decides."""
    names = pairs.select(F.col(a).alias("query")).union(pairs.select(F.col(b).alias("query")))
    # joined to both sides, so the search is written once
    hit = materialize(fuzzy_search(names, kb, limit=1, threshold=0.6).select("query", "company_id"))
    ha = hit.select(F.col("query").alias(a), F.col("company_id").alias("id_a"))
    hb = hit.select(F.col("query").alias(b), F.col("company_id").alias("id_b"))
    joined = pairs.join(ha, a, "left").join(hb, b, "left")
    return joined.withColumn("same", F.coalesce(
        F.col("id_a") == F.col("id_b"), S.is_match(F.col(a), F.col(b), threshold)))


MAX_CHOICES = 1000


def extract_best(queries: DataFrame, choices: Sequence[str], limit: int = 5, scorer: Scorer | None = None,
                 weights: dict[str, float] | None = None, query: str = "query") -> DataFrame:
    """Top choices per distinct query from a list given by the caller.

    The choices are a literal of checked size that travels with the plan, so the
    ranking is a per-row expression without any join or shuffle of the pairs.
    Lists beyond that size are tables: use ``fuzzy_search``.
    """
    if len(choices) > MAX_CHOICES:
        raise ValueError(f"more than {MAX_CHOICES} choices: put them in a table and use fuzzy_search")
    texts = queries.select(F.col(query).alias("query")).distinct().filter(F.col("query") != "")
    base = S.with_features(texts, F.col("query"), "q").withColumn(
        "choices", F.array(*[F.struct(F.lit(i).alias("ord"), S.features(F.lit(c)).alias("cf"))
                             for i, c in enumerate(choices)]))
    fq = S.feature_columns("q")

    def scored(c: Column) -> Column:
        value = (scorer(F.col("query"), c["cf"]["raw"]) if scorer
                 else S.name_ratio(fq, c["cf"], weights))
        return F.struct((-value).alias("neg"), c["ord"].alias("ord"), c["cf"]["raw"].alias("match"))

    ranked = F.slice(F.array_sort(F.transform("choices", scored)), 1, limit)
    out = base.select("query", F.posexplode(ranked).alias("pos", "hit"))
    score = -F.col("hit.neg")
    return out.select("query", (F.col("pos") + 1).alias("rank"), F.col("hit.match").alias("match"),
                      score.alias("score"), S.score_label(score).alias("confidence"))


def name_variations(kb: DataFrame) -> DataFrame:
    """Every spelling of a company: name, aliases, normalised, ticker, previous names."""
    every = F.array_distinct(F.concat(
        F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.array("normalized_name"),
        F.array("ticker"), F.coalesce("previous_names", F.array().cast("array<string>"))))
    return kb.select(F.col("id").alias("company_id"), F.posexplode(
        F.filter(every, lambda x: x.isNotNull())).alias("ord", "variation"))

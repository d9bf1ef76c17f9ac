"""Company mentions in text: extraction, ranking, coreference, enrichment.

Extraction up to coreference is a narrow transformation: the mentions of a text
live in one array column, so a document never shuffles before it is exploded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions import similarity as S
from ownerscope.functions.text import (
    company_suffixes, company_type, context_window, country_hints, describe_context, has_company_context, is_ticker,
    normalize_company, normalize_mention, any_of, literal_map, regex, sanitize_nlp,
)
from ownerscope.operators.kb import scored_pairs, kb_candidates
from ownerscope.session import computed_once, materialize

RAW = "array<struct<text:string,position:int>>"


@dataclass(frozen=True)
class PatternFamily:
    """Patterns of one mention kind; ``post_filter`` may reject an extracted text."""
    name: str
    type: str
    confidence: float
    patterns: list[tuple[str, str, list[str], str | None]] = field(hash=False)  # flags, regex, parts, ending
    post_filter: Callable[[Column], Column] | None = None


def default_families() -> list[PatternFamily]:
    return [PatternFamily(name, kind, conf, patterns, is_ticker if kind == "ticker" else None)
            for name, (kind, conf, patterns) in D.MENTION_FAMILIES.items()]


#: from frequent to rare; characters that are not listed are rarer
_FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


def rare_end(part: str) -> str:
    """A part from the rarest character of its first half on: a search compares whole words only where their first byte stands."""
    rank = [_FREQUENT.find(ch) % (len(_FREQUENT) + 1) for ch in part[:len(part) // 2 + 1]]
    return part[rank.index(max(rank)):]


def holds(text: Column, part: str) -> Column:
    """Whether a text contains a part; most texts are ruled out by the part's rare end."""
    end = rare_end(part)
    return text.contains(part) if end == part else text.contains(end) & text.contains(part)


def may_match(text: Column, low: Column, flags: str, parts: list[str], ending: str | None) -> Column:
    """Cheap necessary condition of a pattern: plain contains, then a short regex."""
    gate = any_of([holds(low if "i" in flags else text, p) for p in parts]) if parts else F.lit(True)
    return gate if ending is None else gate & text.rlike(ending)


def match_positions(text: Column, pattern: str, gate: Column) -> Column:
    """All matches of a pattern as (group 1, offset of the whole match).

    One pass puts each match and its group between control characters, which the
    sanitised text cannot hold; offsets come from the lengths of the pieces: before
    the first match, then a match, its group and what stands up to the next one.
    Texts failing the gate skip the pattern altogether.
    """
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\u0001$0\u0001$1\u0001")), "\u0001")
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("at"), F.array().cast(RAW).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        kind = acc["n"] % 3
        hit = F.struct(piece.alias("text"), acc["start"].alias("position"))
        return F.struct(
            (acc["n"] + 1).alias("n"), F.when(kind == 1, acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(kind == 2, acc["at"]).otherwise(acc["at"] + F.length(piece)).alias("at"),
            F.when(kind == 2, F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    hits = F.aggregate(pieces, zero, step, lambda acc: acc["out"])
    return F.when(gate, hits).otherwise(F.array().cast(RAW))


def _family_hits(fam: PatternFamily, hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(
        h["text"].alias("text"),
        normalize_mention(h["text"]).alias("normalized"),
        F.lit(fam.type).alias("type"),
        F.lit(fam.confidence).alias("confidence"),
        F.lit(fam.name).alias("pattern"),
        h["position"].alias("position"),
        (fam.post_filter(h["text"]) if fam.post_filter else F.lit(True)).alias("ok"),
    ))


def _candidates(text: Column, low: Column, families: list[PatternFamily]) -> Column:
    found = []
    for fam in families:
        for flags, pattern, parts, ending in fam.patterns:
            gate = may_match(text, low, flags, parts, ending)
            found.append(_family_hits(fam, match_positions(text, regex(pattern, flags), gate)))
    return F.concat(*found)


def mention_arrays(docs: DataFrame, text: str = "text", families: list[PatternFamily] | None = None,
                   max_chars: int | None = None, cap: int | None = None) -> DataFrame:
    """Adds ``mentions``: extraction order, one entry per normalised text.

    The first hit of a text decides: if it is rejected later hits are too.
    ``max_chars=1000, cap=20`` are the in-page guards; by default whole texts and
    all mentions are kept.
    """
    families = families or default_families()
    out = docs.withColumn("clean_text", sanitize_nlp(F.col(text), max_chars))
    out = out.withColumn("_low", F.lower("clean_text"))
    out = computed_once(out, "_found", _candidates(F.col("clean_text"), F.col("_low"), families)).drop("_low")
    # cheap test first: the context patterns only run where an ambiguous word was found
    out = out.withColumn("_context", F.when(
        F.exists("_found", lambda m: m["normalized"].isin(*D.AMBIGUOUS_WORDS)),
        has_company_context(F.col("clean_text"))).otherwise(F.lit(True)))
    out = computed_once(out, "_names", F.transform("_found", lambda x: x["normalized"]))
    first = F.filter("_found", lambda m, i: (F.array_position("_names", m["normalized"]) == i + 1)
        & m["ok"] & (F.col("_context") | ~m["normalized"].isin(*D.AMBIGUOUS_WORDS)))
    kept = F.transform(first, lambda m: m.dropFields("ok"))
    return computed_once(out, "mentions", kept if cap is None else F.slice(kept, 1, cap)).drop("_found", "_names", "_context")


def explode_mentions(df: DataFrame, keys: list[str], column: str = "mentions") -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("ord", "m")).select(*keys, "ord", "m.*")


def extract_mentions(docs: DataFrame, keys: list[str], **options) -> DataFrame:
    return explode_mentions(mention_arrays(docs, **options), keys)


def ranked(mentions: Column) -> Column:
    """Confidence first, then position; extraction order breaks ties."""
    keyed = F.array_sort(F.transform(mentions, lambda m, i: F.struct(
        (-m["confidence"]).alias("a"), m["position"].alias("b"), i.alias("c"), m.alias("m"))))
    return F.transform(keyed, lambda k: k["m"])


_KEPT = ("array<struct<text:string,normalized:string,type:string,confidence:double,pattern:string,"
         "position:int,refs:array<string>>>")


def resolved(ranked_mentions: Column, word_boundary: bool = False) -> Column:
    """Coreference fold over ranked mentions.

    A pronoun text joins the first kept mention that stands earlier in the text;
    a text contained in (or containing) a kept one joins the first such.
    """
    def contains(a: Column, b: Column) -> Column:
        if word_boundary:
            a, b = F.concat(F.lit(" "), a, F.lit(" ")), F.concat(F.lit(" "), b, F.lit(" "))
        return F.contains(a, b)

    def step(kept: Column, m: Column) -> Column:
        low = F.lower(m["normalized"])
        pronoun = any_of([m["text"].rlike(regex(p, f)) for f, p in D.PRONOUN_PATTERNS])

        def first(test) -> Column:
            flags = F.transform(kept, test)
            return F.array_position(flags, True)

        earlier = F.when(pronoun, first(lambda k: k["position"] < m["position"])).otherwise(F.lit(0))
        inside = first(lambda k: contains(F.lower(k["normalized"]), low) | contains(low, F.lower(k["normalized"])))
        target = F.when(earlier > 0, earlier).otherwise(inside)
        merged = F.transform(kept, lambda k, i: F.when(
            i + 1 == target,
            k.withField("refs", F.array_append(k["refs"], m["text"]))
             .withField("confidence", F.greatest(k["confidence"], m["confidence"]))).otherwise(k))
        fresh = F.array_append(kept, m.withField("refs", F.array().cast("array<string>")))
        return F.when(target > 0, merged).otherwise(fresh)

    return F.aggregate(ranked_mentions, F.array().cast(_KEPT), step)


def resolve_coreferences(df: DataFrame, column: str = "mentions", word_boundary: bool = False) -> DataFrame:
    out = computed_once(df, "_ranked", ranked(F.col(column))).drop(column)
    return computed_once(out, column, resolved(F.col("_ranked"), word_boundary)).drop("_ranked")


def type_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(D.TYPE_WEIGHTS), kind), F.lit(D.TYPE_WEIGHT_OTHER))


def array_confidence(mentions: Column) -> Column:
    """Type-weighted mean confidence of a mention array (0 when empty)."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    return F.aggregate(
        mentions, zero,
        lambda acc, m: F.struct((acc["s"] + m["confidence"] * type_weight(m["type"])).alias("s"),
                                (acc["w"] + type_weight(m["type"])).alias("w")),
        lambda acc: F.when(acc["w"] > 0, acc["s"] / acc["w"]).otherwise(F.lit(0.0)))


def document_confidence(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """The same mean over mention rows."""
    w = type_weight(F.col("type"))
    return mentions.groupBy(*keys).agg(
        (F.sum(F.col("confidence") * w) / F.sum(w)).alias("confidence"), F.count("*").alias("mentions"))


# --- enrichment --------------------------------------------------------------
def with_variations(df: DataFrame, column: str = "mentions", threshold: float = 0.75) -> DataFrame:
    """Adds ``variations`` per mention: other mentions of the text with a similar name.

    Pairs stay inside the text's own array. Without a common token the ratio is at
    most 0.7, so below that the pair is skipped before any edit distance.
    """
    # one step per derived value: an expression used inside the next one is repeated there
    named = F.transform(column, lambda m: F.struct(
        m["text"].alias("text"), m["type"].alias("type"), m["normalized"].alias("normalized"),
        F.when(m["type"].isin("company", "company_intl"), normalize_company(m["text"]))
        .otherwise(F.lit("")).alias("base")))
    prepared = F.transform(named, lambda m, i: F.struct(
        i.alias("i"), m["text"].alias("text"), m["type"].alias("type"),
        S.features(F.when(m["base"] != "", m["base"]).otherwise(m["normalized"])).alias("own"),
        S.features(m["normalized"]).alias("other")))
    out = computed_once(df, "_names", prepared)

    def similar(i: Column) -> Column:
        own = F.element_at("_names", i + 1)["own"]
        scored = F.transform("_names", lambda o: F.struct(
            o["text"].alias("text"),
            F.when((o["i"] != i) & (F.arrays_overlap(own["tokens"], o["other"]["tokens"])
                                    | ((F.size(own["tokens"]) == 0) & (F.size(o["other"]["tokens"]) == 0))
                                    | F.lit(threshold <= 0.7)),
                   S.name_ratio(own, o["other"])).alias("similarity"),
            o["type"].alias("type")))
        return F.filter(scored, lambda v: v["similarity"] >= threshold)

    varied = F.transform(column, lambda m, i: m.withField("variations", similar(i)))
    return computed_once(out, "_varied", varied).drop("_names", column).withColumnRenamed("_varied", column)


def enrich(docs: DataFrame, kb: DataFrame, keys: list[str], threshold: float = 0.75) -> DataFrame:
    """Mention rows with base name, best KB company, variations, context and rank.

    ``docs`` carries ``clean_text`` and a resolved ``mentions`` array. The mention
    rows are written once, because the KB search (per distinct search text) and
    the join back both read them.
    """
    wide = with_variations(docs, threshold=threshold)
    rows = wide.select(*keys, "clean_text", F.posexplode("mentions").alias("ord", "m"))
    formal = F.col("m.type").isin("company", "company_intl")
    suffixes = F.when(formal, company_suffixes(F.col("m.text")))
    rows = rows.select(
        *keys, "ord", "m.*",
        F.when(formal, normalize_company(F.col("m.text"))).alias("base_name"),
        suffixes.alias("suffixes"), company_type(suffixes).alias("company_type"),
        country_hints(suffixes).alias("country_hints"),
        context_window(F.col("clean_text"), F.col("m.position"), F.col("m.text")).alias("_near"))
    # bound once: the description reads the window many times
    rows = computed_once(rows, "_window", F.col("_near")).withColumn("context", describe_context(F.col("_window"))).drop("_near", "_window")
    base = F.nullif(F.coalesce(F.col("base_name"), F.lit("")), F.lit(""))
    rows = rows.withColumn("search_text", F.coalesce(base, F.col("normalized"), F.col("text")))
    rows = materialize(rows)
    hits = best_company(rows, kb, threshold)
    rows = rows.withColumn("is_ticker", F.col("type") == "ticker").join(
        hits, ["search_text", "is_ticker"], "left").drop("is_ticker")
    rows = rows.withColumn("base_confidence", F.col("confidence")).withColumn(
        "confidence", F.when(F.col("kb_company").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + 0.1))
        .otherwise(F.col("confidence")))
    return rows.withColumn("rank", F.row_number().over(enhanced_order(keys)))


def best_company(rows: DataFrame, kb: DataFrame, threshold: float) -> DataFrame:
    """Best KB hit per (search text, ticker or not); tickers match ticker texts only then."""
    texts = rows.groupBy("search_text").agg(F.collect_set(F.col("type") == "ticker").alias("uses"))
    pairs = scored_pairs(texts, kb_candidates(kb), threshold, query="search_text")
    uses = F.array(F.lit(True), F.lit(False))
    flagged = pairs.withColumn("is_ticker", F.explode(uses)).filter(F.col("is_ticker") | (F.col("kind") != "ticker"))
    top = flagged.groupBy("query", "is_ticker").agg(F.max_by(
        F.struct("company_id", "score", "kind", "text"), F.struct("score", -F.col("ord"))).alias("h"))
    return top.select(F.col("query").alias("search_text"), "is_ticker", F.col("h.company_id").alias("kb_company"),
                      F.col("h.score").alias("kb_score"), F.col("h.kind").alias("kb_match"),
                      F.col("h.text").alias("kb_text"))


def enhanced_order(keys: list[str]):
    kind = F.coalesce(F.try_element_at(literal_map(D.TYPE_ORDER), F.col("type")), F.lit(0))
    return Window.partitionBy(*keys).orderBy(
        F.desc(F.coalesce(F.col("kb_score") > 0.8, F.lit(False))), F.desc("confidence"), F.desc(kind),
        "position", "ord")


def enhanced_confidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Document confidence with KB, variation and figure weights."""
    weight = F.lit(1.0)
    weight = weight * F.when(F.col("kb_company").isNotNull(), 1.2).otherwise(1.0)
    weight = weight * F.when(F.size("variations") > 0, 1.1).otherwise(1.0)
    weight = weight * F.when(F.col("context.financial").isNotNull(), 1.1).otherwise(1.0)
    score = F.greatest(F.col("confidence"), F.coalesce("kb_score", F.lit(0.0)))
    return rows.withColumn("_w", weight).groupBy(*keys).agg(
        (F.sum(score * F.col("_w")) / F.sum("_w")).alias("confidence"), F.count("*").alias("mentions"))


def mention_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: number of mentions and the best one."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("mentions"),
        F.max_by(F.struct("text", "type"), F.struct("confidence", -F.col("position"), -F.col("ord"))).alias("top"),
    ).select(*keys, "mentions", F.col("top.text").alias("top_text"), F.col("top.type").alias("top_type"))


def extraction_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts processed and share of repeats (a repeat would be a cache hit)."""
    per_text = docs.filter(F.length(text) > 0).groupBy(F.xxhash64(text).alias("h"), F.md5(text).alias("d")).agg(
        F.count("*").alias("n"))
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("processed"), F.count("*").alias("distinct_texts"),
        ((F.sum("n") - F.count("*")) / F.sum("n")).alias("repeat_rate"))


def detected(rows: DataFrame, page: str, score: str = "score", min_score: float = D.MIN_SCORE_ADAPTER) -> DataFrame:
    """One detection per page and (normalised, type): highest score, first on ties."""
    keep = [c for c in rows.columns if c not in (page, "normalized", "type")]
    return (rows.filter(F.col(score) >= min_score).groupBy(page, "normalized", "type")
            .agg(F.max_by(F.struct(*keep), F.struct(F.col(score), -F.col("ord"))).alias("d"))
            .select(page, "normalized", "type", "d.*"))

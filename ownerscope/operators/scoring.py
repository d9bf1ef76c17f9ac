"""Confidence model: five factors per detected entity, levels and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions import similarity as S
from ownerscope.functions.text import any_of, literal_map
from ownerscope.session import computed_once


def pattern_factor(confidence: Column, kind: Column) -> Column:
    return F.least(F.lit(1.0), confidence * F.when(kind == "ticker", 1.2).when(kind == "company_formal", 1.1)
                   .when(kind == "company_context", 0.8).otherwise(1.0))


def dom_factor(confidence: Column, positions: Column, clue_types: Column) -> Column:
    boost = (F.when(F.array_contains(positions, "h1"), 1.3).when(F.array_contains(positions, "h2"), 1.2)
             .when(F.array_contains(positions, "firstParagraph"), 1.15).otherwise(1.0))
    strong = F.exists(clue_types, lambda t: (t == "dataAttribute") | t.contains("ticker"))
    return F.least(F.lit(1.0), confidence * boost * F.when(strong, 1.25).otherwise(1.0))


def nlp_factor(confidence: Column, entity_confidences: Column) -> Column:
    """``entity_confidences``: confidences of the text's entities, best first."""
    some = F.size(entity_confidences) > 0
    top = F.when(some & (F.try_element_at(entity_confidences, F.lit(1)) > 0.9), 1.15).otherwise(1.0)
    rest = F.slice(entity_confidences, F.lit(2), F.size(entity_confidences))
    more = F.when(some & F.exists(rest, lambda c: c > 0.7), 1.1).otherwise(1.0)
    return F.least(F.lit(1.0), confidence * top * more)


def consistency_factor(pattern_entity: Column, nlp_entity: Column, clue_types: Column, kind: Column) -> Column:
    same = F.lower(pattern_entity) == F.lower(nlp_entity)
    first = F.when(pattern_entity.isNotNull() & nlp_entity.isNotNull(),
                   F.when(same, 1.0).when(S.word_jaccard(pattern_entity, nlp_entity) > 0.7, 0.8).otherwise(0.5))
    relevant = F.exists(clue_types, lambda t: F.when(
        kind == "ticker", t.contains("ticker") | t.contains("symbol")).otherwise(t.contains("company")))
    second = F.when(clue_types.isNotNull() & kind.isNotNull(), F.when(relevant, 1.0).otherwise(0.6))
    return (F.when(first.isNull() & second.isNull(), 0.7).when(first.isNull(), second)
            .when(second.isNull(), first).otherwise((first + second) / 2))


def dom_confidence(positions: Column, clue_types: Column, multipliers: Column) -> Column:
    """Structural weight times the site's multipliers; clues are words, multipliers a map."""
    weights = literal_map(D.POSITION_WEIGHTS)
    weight = F.coalesce(F.array_max(F.transform(positions, lambda p: F.coalesce(
        F.try_element_at(weights, p), F.lit(D.POSITION_WEIGHT_OTHER)))), F.lit(0.0))

    def factor(name: str) -> Column:
        return F.coalesce(F.try_element_at(multipliers, F.lit(name)), F.lit(1.0))

    def has(name: str) -> Column:
        return F.try_element_at(multipliers, F.lit(name)).isNotNull()

    start = (weight * F.when(F.array_contains(positions, "h1"), factor("inHeadline")).otherwise(1.0)
             * F.when(F.array_contains(positions, "firstParagraph"), factor("inFirstParagraph")).otherwise(1.0))
    total = F.aggregate(clue_types, start, lambda acc, t: acc * (
        F.when((t == "dataAttribute") & has("hasDataSymbol"), factor("hasDataSymbol"))
        .when(t.contains("ticker") & has("hasTicker"), factor("hasTicker"))
        .when(t.contains("company") & has("hasCompanyTag"), factor("hasCompanyTag")).otherwise(F.lit(1.0))))
    return F.least(F.lit(1.0), total)


# --- cross reference ---------------------------------------------------------
def known_entities(spark: SparkSession) -> DataFrame:
    """Lower-cased name, alias, ticker and $ticker -> entity; the last writer of a key wins."""
    keyed: dict[str, tuple] = {}
    for name, aliases, ticker, sector in D.KNOWN_ENTITIES:
        for key in [name, *aliases, *([ticker, f"${ticker}"] if ticker else [])]:
            keyed[key.lower()] = (key.lower(), name, ticker, sector)
    return spark.createDataFrame(list(keyed.values()), "key string, known_name string, known_ticker string, sector string")


def sector_consistent(industry: Column, sector: Column) -> Column:
    low = F.lower(industry)
    return any_of([(sector == s) & any_of([low.contains(w) for w in words])
                   for s, words in D.SECTOR_KEYWORDS.items()])


def jaccard_prefix(words: Column, above: float) -> Column:
    """Words of which two sets with Jaccard > ``above`` must share one.

    Such sets share more than ``above`` of the larger one, so in a common word
    order the first (size - floor(above * size)) words of each suffice.
    """
    n = F.size(words)
    keep = F.greatest(n - F.floor(n * above + 1e-9), F.lit(1)).cast("int")
    return F.slice(F.array_sort(words), 1, keep)


def cross_reference(mentions: DataFrame, known: DataFrame, industry: str | None = None,
                    above: float = 0.8) -> DataFrame:
    """Adds ``cross_reference``: exact key .9/1.0 with sector check, else .8 x word Jaccard.

    Work is per distinct mention text: an equi-join for exact keys, and for the
    rest an equi-join on prefix words that finds every pair above the bound.
    """
    low = F.lower(F.coalesce("normalized", "text"))
    exact = mentions.withColumn("_key", low).join(known.withColumnRenamed("key", "_key"), "_key", "left")
    split = lambda c: F.array_distinct(F.split(c, r"\s+"))
    left = mentions.select(low.alias("_key")).distinct().withColumn("_a", split(F.col("_key")))
    right = known.select("key", split(F.col("key")).alias("_b"))
    pairs = (left.withColumn("w", F.explode(jaccard_prefix(F.col("_a"), above)))
             .join(right.withColumn("w", F.explode(jaccard_prefix(F.col("_b"), above))), "w"))
    similar = pairs.withColumn("j", F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))).filter(
        F.col("j") > above).groupBy("_key").agg((F.max("j") * 0.8).alias("_fuzzy"))
    out = exact.join(similar, "_key", "left")
    hit = F.when((F.col("type") == "ticker") & (F.col("known_ticker") == F.upper("text")), 1.0).otherwise(0.9)
    if industry is not None:
        hit = hit * F.when(F.col(industry).isNotNull() & F.col("sector").isNotNull(),
                           F.when(sector_consistent(F.col(industry), F.col("sector")), 1.1).otherwise(0.9)).otherwise(1.0)
    score = F.when(F.col("known_name").isNotNull(), F.least(F.lit(1.0), hit)).otherwise(F.coalesce("_fuzzy", F.lit(0.0)))
    return out.withColumn("cross_reference", score).drop("_key", "_fuzzy")


# --- weighted score ----------------------------------------------------------
FACTORS = list(D.FACTOR_WEIGHTS)


def level(score: Column, thresholds: dict[str, float] | None = None) -> Column:
    t = {**D.LEVEL_THRESHOLDS, **(thresholds or {})}
    return (F.when(score >= t["high"], "high").when(score >= t["medium"], "medium")
            .when(score >= t["low"], "low").otherwise("reject"))


def weakest_factor(factors: dict[str, Column]) -> Column:
    """Name of the first strictly lowest factor below 1."""
    lowest = F.least(*factors.values())
    out = F.when(lowest >= 1.0, "unknown factor")
    for k, c in factors.items():
        out = out.when(c == lowest, D.FACTOR_NAMES[k])
    return out


def score_entities(df: DataFrame, factors: dict[str, Column], weights: dict[str, float] | None = None,
                   thresholds: dict[str, float] | None = None) -> DataFrame:
    """Adds score, level, breakdown and recommendation from the five factor Columns."""
    w = {**D.FACTOR_WEIGHTS, **(weights or {})}
    out = df
    for k in FACTORS:
        out = out.withColumn("f_" + k, factors[k])
    cols = {k: F.col("f_" + k) for k in FACTORS}
    total, score = 0.0, F.lit(0.0)
    for k in FACTORS:
        score, total = score + cols[k] * w[k], total + w[k]
    # a filter on the score would repeat all factors below the projection
    out = computed_once(out, "score", score / total).withColumn("level", level(F.col("score"), thresholds))
    recommendation = (F.when(F.col("level") == "high", F.lit("Entity highly reliable - proceed with confidence"))
                      .when(F.col("level") == "medium", F.concat(F.lit("Entity moderately reliable - verify "), weakest_factor(cols)))
                      .when(F.col("level") == "low", F.lit("Entity uncertain - additional validation recommended"))
                      .otherwise(F.lit("Entity not reliable - consider rejection")))
    return out.withColumn("recommendation", recommendation).withColumn(
        "breakdown", F.struct(*[F.col("f_" + k).alias(k) for k in FACTORS])).drop(*["f_" + k for k in FACTORS])


def score_stats(scored: DataFrame) -> DataFrame:
    """Count, mean and share per level; one row per level, totals on every row."""
    per = scored.groupBy("level").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    every = Window.partitionBy(F.lit(1))  # at most one row per level
    return per.select(
        "level", "n", F.sum("n").over(every).alias("total"),
        (F.sum("s").over(every) / F.sum("n").over(every)).alias("mean_score"),
        (F.col("n") / F.sum("n").over(every) * 100).alias("percent"))


def site_metrics(detected: DataFrame, source: str = "source") -> DataFrame:
    """Detections and mean score per source and overall (source null)."""
    return detected.rollup(source).agg(F.count("*").alias("detections"), F.avg("score").alias("mean_score"))

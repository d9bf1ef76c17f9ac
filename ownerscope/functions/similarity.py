"""Name similarity as Columns.

A name is prepared once (``features`` as a struct, ``with_features`` as flat
columns) and pairs of prepared names are scored (``name_ratio``), so the string
work is per distinct name and not per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions.text import SPACES, any_of

_TRIM = f"^[{SPACES}]+|[{SPACES}]+$"


def lowered(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), _TRIM, "")


def tokenize(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 0)


def _effective(distinct: Column) -> Column:
    kept = F.filter(distinct, lambda t: ~t.isin(*D.STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(distinct)


def features(c: Column) -> Column:
    """Prepared name as a struct: raw, lower-cased, sorted tokens as text, token set."""
    text = F.coalesce(c, F.lit(""))
    toks = tokenize(text)
    return F.struct(
        text.alias("raw"),
        lowered(text).alias("low"),
        F.array_join(F.array_sort(toks), " ").alias("sorted"),
        _effective(F.array_distinct(toks)).alias("tokens"),
    )


def with_features(df: DataFrame, c: Column, prefix: str) -> DataFrame:
    """Prepared name as flat columns ``<prefix>_raw/_low/_sorted/_tokens``.

    Flat and in steps: the optimizer would inline the fields of a struct into
    every use and repeat the string work per use.
    """
    df = df.withColumn(f"{prefix}_raw", F.coalesce(c, F.lit("")))
    df = df.withColumn(f"{prefix}_low", lowered(F.col(f"{prefix}_raw")))
    df = df.withColumn(f"{prefix}_words", F.array_sort(tokenize(F.col(f"{prefix}_raw"))))
    df = df.withColumn(f"{prefix}_sorted", F.array_join(f"{prefix}_words", " "))
    df = df.withColumn(f"{prefix}_words", F.array_distinct(f"{prefix}_words"))
    return df.withColumn(f"{prefix}_tokens", _effective(F.col(f"{prefix}_words"))).drop(f"{prefix}_words")


def feature_columns(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}_{k}") for k in ("raw", "low", "sorted", "tokens")}


def _edit_ratio(a: Column, b: Column) -> Column:
    """Ratio of two non-empty prepared texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return (F.when(a == b, F.lit(1.0))
            .when(longest == 0, F.lit(1.0))
            .otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest))


def _empty(a: Column, b: Column) -> Column:
    return (F.length(a) == 0) | (F.length(b) == 0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(_empty(a, b), F.lit(0.0)).otherwise(_edit_ratio(lowered(a), lowered(b)))


def _partial(low_a: Column, low_b: Column) -> Column:
    """Best ratio of the shorter text against every equal-length window of the longer."""
    swap = F.length(low_a) > F.length(low_b)
    short, long_ = F.when(swap, low_b).otherwise(low_a), F.when(swap, low_a).otherwise(low_b)
    n = F.length(short)

    def window(i: Column) -> Column:
        part = F.trim(F.substr(long_, i, n))
        return F.when(_empty(short, part), F.lit(0.0)).otherwise(_edit_ratio(short, part))

    starts = F.sequence(F.lit(1), F.length(long_) - n + 1)
    return F.when(low_a == low_b, F.lit(1.0)).otherwise(F.array_max(F.transform(starts, window)))


def partial_ratio(a: Column, b: Column) -> Column:
    return F.when(_empty(a, b), F.lit(0.0)).otherwise(_partial(lowered(a), lowered(b)))


def _jaccard(ta: Column, tb: Column) -> Column:
    union = F.size(F.array_union(ta, tb))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(ta, tb)) / union)


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of white-space words, no stop words."""
    wa = F.array_distinct(F.split(F.lower(a), f"[{SPACES}]+"))
    wb = F.array_distinct(F.split(F.lower(b), f"[{SPACES}]+"))
    return _jaccard(wa, wb)


def part_ratios(fa: Column, fb: Column) -> dict[str, Column]:
    """The four part ratios of two prepared names."""
    none = _empty(fa["raw"], fb["raw"])

    def unless_empty(c: Column) -> Column:
        return F.when(none, F.lit(0.0)).otherwise(c)

    sorted_empty = _empty(fa["sorted"], fb["sorted"])
    return {
        "ratio": unless_empty(_edit_ratio(fa["low"], fb["low"])),
        "partial": unless_empty(_partial(fa["low"], fb["low"])),
        "tokenSort": F.when(none | sorted_empty, F.lit(0.0)).otherwise(_edit_ratio(fa["sorted"], fb["sorted"])),
        "tokenSet": unless_empty(_jaccard(fa["tokens"], fb["tokens"])),
    }


def merged_weights(weights: dict[str, float] | None) -> dict[str, float]:
    return {**D.RATIO_WEIGHTS, **(weights or {})}


def name_ratio(fa: Column, fb: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted company-name ratio of two prepared names."""
    w = merged_weights(weights)
    parts = part_ratios(fa, fb)
    total = 0.0
    score = F.lit(0.0)
    for key, weight in w.items():
        score = score + parts[key] * weight
        total += weight
    return score / total if total > 0 else F.lit(0.0)


def abbreviation_bonus(low_a: Column, low_b: Column) -> Column:
    crossed = any_of([
        (low_a.contains(s) & low_b.contains(f)) | (low_a.contains(f) & low_b.contains(s))
        for s, f in D.ABBREVIATION_PAIRS])
    return F.when(crossed, F.lit(D.ABBREVIATION_BONUS)).otherwise(F.lit(0.0))


def enhanced_ratio(fa: Column, fb: Column, weights: dict[str, float] | None = None) -> Column:
    return F.least(F.lit(1.0), name_ratio(fa, fb, weights) + abbreviation_bonus(fa["low"], fb["low"]))


def company_name_ratio(a: Column, b: Column, weights: dict[str, float] | None = None) -> Column:
    return name_ratio(features(a), features(b), weights)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return part_ratios(features(a), features(b))["tokenSort"]


def token_set_ratio(a: Column, b: Column) -> Column:
    return part_ratios(features(a), features(b))["tokenSet"]


def score_label(c: Column) -> Column:
    out = F
    for bound, label in D.SCORE_LABELS:
        out = out.when(c >= bound, label)
    return out.otherwise("very_low")


def is_match(a: Column, b: Column, threshold: float | None = None) -> Column:
    return company_name_ratio(a, b) >= (threshold or 0.8)

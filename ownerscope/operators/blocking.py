"""Candidate pairs of prepared names: a prefix filter in the order of document frequency.

A name's score is a weighted sum of the token Jaccard J, two edit ratios (as written, and of the sorted tokens), the windowed ratio (at
most 1) and a bonus. So a pair that reaches the threshold either has J of at least tau, or one of its edit ratios is at least

    m(tau) = (threshold - bonus - w_windowed - w_jaccard * tau) / (w_written + w_sorted).

The first kind meets on tokens. A name of x tokens shares at least o(x, y) = tau / (1 + tau) * (x + y) tokens with one of y tokens (the
length filter leaves y between tau * x and x / tau), so they share one of the x - o + 1 rarest tokens of the one and of the y - o + 1
rarest of the other: one key for each such token and y (the positional filter as part of the key). A token that most names have is
the last of its name and is a key only where it decides alone. The second kind meets on bigrams, of which c = (2m - 1) n - 1 stay
common: on two of the n - 1 - c + 2 rarest at once, or, where lengths leave too few or make too many pairs, on one of the n - 1 - c + 1
rarest, or, where bigrams leave none, on one of the rarest characters, of which m n stay. Only a pair of which one side has the short
and the other the full form of an abbreviation gets the bonus; the lower floor it allows holds for keys that carry both the gram and
the abbreviation's number and side.

``tau`` puts the edit floor at ``FLOOR``, where bigrams still tell names apart; where even a pair without a common token may
have a lower edit ratio, tau is just above zero: any common token is a key. The order is the number of candidates with the token
or gram (ties by itself); what no candidate has comes first and makes no key. All of this depends on names and parameters, not on the size
of the tables, and no pair is lost (``tests/test_names.py`` scores all pairs of a fixture).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions.similarity import merged_weights
from ownerscope.session import computed_once, materialize

FLOOR = 0.85
PAIRS_FROM = 0.7     # edit floor from which two rare bigrams make a key
PAIRS_TO = 40        # characters up to which they do
EPS = 1e-9


def edit_floor(threshold, bonus: float, tau: float, weights: dict[str, float] | None = None):
    """Edit ratio (plain or token-sorted) that a pair with a token Jaccard below ``tau`` needs."""
    w = merged_weights(weights)
    return ((threshold - bonus) * sum(w.values()) - w["partial"] - w["tokenSet"] * tau) / (w["ratio"] + w["tokenSort"])


def jaccard_split(threshold: float, weights: dict[str, float] | None = None) -> float:
    """The token Jaccard from which pairs meet on tokens; 0 stands for any common token."""
    w = merged_weights(weights)
    free = edit_floor(threshold, 0.0, 0.0, weights) - FLOOR
    if free <= 0 or w["tokenSet"] <= 0:
        return 0.0
    return min(1.0, free * (w["ratio"] + w["tokenSort"]) / w["tokenSet"])


def _numbered(grams: Column) -> Column:
    """Repeated grams get an occurrence number, so sets count like bags."""
    zero = F.struct(F.lit("").alias("g"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, g: Column) -> Column:
        n = F.when(acc["g"] == g, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("g"), n.alias("n"), F.array_append(acc["out"], F.concat(g, F.lit("#"), n.cast("string"))).alias("out"))

    return F.aggregate(F.array_sort(grams), zero, step, lambda acc: acc["out"])


def _tagged(items: Column, tag: str) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(tag), x))


def _bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))).otherwise(
        F.array().cast("array<string>"))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: F.length(x) > 0)


def _short(m: Column) -> Column:
    """Texts of fewer characters than this may share no bigram at an edit ratio of m."""
    return F.when(m > 0.55, F.lit(2.0) / (m * 2 - 1)).otherwise(F.lit(1e9))


def _bigram_prefix(n: Column, m: Column) -> Column:
    return n - 1 - F.greatest(F.ceil((m * 2 - 1) * n - 1 - EPS), F.lit(1)) + 1


def _character_prefix(n: Column, m: Column) -> Column:
    return F.when(n < _short(m), n - F.greatest(F.ceil(m * n - EPS), F.lit(1)) + 1).otherwise(F.lit(0))


def _sides(low: Column, query_side: bool) -> Column:
    """Numbers of the abbreviations a name has a side of, as ``number + side``: the other side's partner writes the same."""
    short, full = ("a", "b") if query_side else ("b", "a")
    none = F.lit(None).cast("string")
    found = F.array(*[x for k, (s, f) in enumerate(D.ABBREVIATION_PAIRS) for x in (
        F.when(low.contains(s), F.lit(f"{k}{short}")).otherwise(none), F.when(low.contains(f), F.lit(f"{k}{full}")).otherwise(none))])
    return F.filter(found, lambda x: x.isNotNull())


def _reachable(m: Column) -> Column:
    """An edit ratio of 1 means equal tokens, which meet as tokens."""
    return m < 1 - EPS


def _two_of(items: Column) -> Column:
    """Every two items, in their order; the array is bound once."""
    def pairs(a: Column) -> Column:
        return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.concat(x, F.lit("&"), y))))

    return F.flatten(F.transform(F.array(items), pairs))


class Blocker:
    """Keys of prepared names (columns ``<prefix>_low/_sorted/_tokens``) for one threshold and its weights."""

    def __init__(self, threshold: float, weights: dict[str, float] | None = None, bonus: float = D.ABBREVIATION_BONUS):
        self.threshold, self.weights, self.bonus = threshold, weights, bonus
        self.tau = jaccard_split(threshold, weights)
        self.floor = float(edit_floor(threshold, 0.0, self.tau, weights))  # the lowest of all candidates', whatever their boost

    def _floor(self, extra: float, boost: Column | None) -> Column:
        threshold = F.lit(self.threshold) if boost is None else F.lit(self.threshold) / boost
        return F.greatest(edit_floor(threshold, extra, self.tau, self.weights), F.lit(0.01))

    def with_items(self, names: DataFrame, p: str, boost: Column | None) -> DataFrame:
        """Adds the floors and ``items``: tagged tokens (t), bigrams (2) and characters (1) of the written (r) and sorted (s) text."""
        query_side = boost is None
        names = names.withColumn("m", self._floor(0.0, boost)).withColumn("mb", self._floor(self.bonus, boost))
        names = computed_once(names, "sides", _sides(F.col(f"{p}_low"), query_side))
        lowest = F.when(F.size("sides") > 0, F.least("m", "mb")).otherwise(F.col("m"))
        tokens = F.when(F.size(f"{p}_tokens") == 0, F.array(F.lit(""))).otherwise(F.col(f"{p}_tokens"))
        parts = [_tagged(tokens, "t:")]
        for tag, text in (("r", F.col(f"{p}_low")), ("s", F.col(f"{p}_sorted"))):
            grams = F.when(_reachable(lowest), _numbered(_bigrams(text))).otherwise(F.array().cast("array<string>"))
            single = F.when(_reachable(lowest) & (F.length(text) < _short(lowest)), _numbered(_characters(text))).otherwise(
                F.array().cast("array<string>"))
            parts += [_tagged(grams, f"{tag}2:"), _tagged(single, f"{tag}1:")]
        return computed_once(names.withColumn("n_tokens", F.size(tokens)), "items", F.concat(*parts))

    def keys(self, p: str, query_side: bool) -> Column:
        """Keys from ``found``: the name's items that candidates have, the rarest first, as (n, item)."""
        none = F.array().cast("array<string>")

        def rarest(tag: str, total: Column, prefix: Column) -> Column:
            own = F.filter("found", lambda x: x["item"].startswith(tag))
            return F.transform(F.slice(own, 1, F.greatest(prefix - (total - F.size(own)), F.lit(0)).cast("int")), lambda x: x["item"])

        x = F.col("n_tokens")
        if self.tau <= 0:
            token_keys = rarest("t:", x, x)
        else:
            tau = self.tau

            def with_size(y: Column) -> Column:
                common = F.greatest(F.ceil((x + y) * (tau / (1 + tau)) - EPS), F.lit(1))
                sizes = F.concat_ws(">", *((x, y) if query_side else (y, x)))
                return F.transform(rarest("t:", x, x - common + 1), lambda t: F.concat(sizes, t))

            sizes = F.sequence(F.greatest(F.ceil(x * tau - EPS), F.lit(1)).cast("int"), F.floor(x / tau + EPS).cast("int"))
            token_keys = F.flatten(F.transform(sizes, with_size))
        plain, by_side = [], []
        for tag, text in (("r", F.col(f"{p}_low")), ("s", F.col(f"{p}_sorted"))):
            n = F.length(text)
            for m, out in (("m", plain), ("mb", by_side)):
                floor, total = F.col(m), F.greatest(n - 1, F.lit(0))
                one = rarest(f"{tag}2:", total, _bigram_prefix(n, floor))
                if m == "m" and self.floor >= PAIRS_FROM:
                    # both lengths of a pair within [least, PAIRS_TO], or both sides have single keys
                    least = math.floor(2 / (2 * self.floor - 1)) + 1
                    two = _two_of(rarest(f"{tag}2:", total, _bigram_prefix(n, floor) + 1))
                    one = F.concat(F.when(n.between(least, PAIRS_TO), two).otherwise(none),
                                   F.when((n * self.floor < least + EPS) | (n / self.floor > PAIRS_TO - EPS), one).otherwise(none))
                out.append(F.when(_reachable(floor), F.concat(
                    one, F.when(n < _short(floor), rarest(f"{tag}1:", n, _character_prefix(n, floor))).otherwise(none))).otherwise(none))
        sided = F.when(F.size("sides") > 0, F.flatten(F.transform(
            F.concat(*by_side), lambda g: F.transform("sides", lambda s: F.concat(s, F.lit("|"), g))))).otherwise(none)
        return F.array_distinct(F.concat(token_keys, *plain, sided) if self.bonus else F.concat(token_keys, *plain))


def _found(names: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each name with ``found``, its items that stand in the table of frequencies, the rarest first; names without any go."""
    columns = [c for c in names.columns if c != "items"]
    rows = names.withColumn("_id", F.monotonically_increasing_id()).select("_id", F.struct(*columns).alias("_row"), F.explode("items").alias("item"))
    held = rows.join(frequency, "item").groupBy("_id").agg(
        F.first("_row").alias("_row"), F.sort_array(F.collect_list(F.struct("n", "item"))).alias("found"))
    return held.select("_row.*", "found")


def candidate_pairs(queries: DataFrame, candidates: DataFrame, threshold: float, weights: dict[str, float] | None = None,
                    boost: Column | None = None, bonus: float = D.ABBREVIATION_BONUS) -> DataFrame:
    """Pairs of a query (columns ``q_*``) and a candidate (``c_*``), each once: all that can reach the threshold, and some others."""
    blocker = Blocker(threshold, weights, bonus)
    c = materialize(blocker.with_items(candidates, "c", F.lit(1.0) if boost is None else boost))
    frequency = materialize(c.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")))
    q = computed_once(_found(blocker.with_items(queries, "q", None), frequency), "q_keys", blocker.keys("q", True))
    c = computed_once(_found(c, frequency), "c_keys", blocker.keys("c", False))
    drop = ["m", "mb", "sides", "n_tokens", "found"]
    pairs = q.drop(*drop).withColumn("key", F.explode("q_keys")).join(c.drop(*drop).withColumn("key", F.explode("c_keys")), "key")
    # a pair that shares several keys is kept at the smallest of them
    pairs = pairs.filter(F.array_min(F.array_intersect("q_keys", "c_keys")) == F.col("key")).drop("q_keys", "c_keys", "key")
    return pairs


def length_bound(fq: dict[str, Column], fc: dict[str, Column], jaccard: Column, bonus: Column, weights: dict[str, float] | None) -> Column:
    """What a pair can score at most, from its lengths and its token Jaccard."""
    w = merged_weights(weights)

    def most(a: Column, b: Column) -> Column:
        return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))

    total = most(fq["low"], fc["low"]) * w["ratio"] + w["partial"] + most(fq["sorted"], fc["sorted"]) * w["tokenSort"] + jaccard * w["tokenSet"]
    return total / sum(w.values()) + bonus

"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Only DataFrame functions run here. Everything about a document is narrow work on its row; what is learned comes from
the counts of vote patterns over all documents (at most 2 ** len(RULES) rows).

Defined results: a null text is an empty one, without words; it fails the base rules. An empty table gives no rows.
Repeated rows are judged alike. Only the id and text columns are looked at; ``keep`` returns the others unchanged.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from ownerscope.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
ITERATIONS = 12


def _joined(hashes: str, step: int) -> Column:
    """Hashes of twice as many words: each with the one ``step`` later."""
    left = F.size(hashes) - step
    return F.zip_with(F.slice(hashes, 1, left), F.slice(hashes, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))


def _has_twins(hashes: str) -> Column:
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """What the rules look at. ``keep`` names further columns of the documents to carry along in a struct."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        F.col(id_col).alias("doc"), *([F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit(r"[^\p{L}\x20\x09-\x0D]")).cast("long").alias("n_others"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(t, F.lit("[!?]")).cast("long").alias("n_shouts"),
        F.explode(F.array(F.array_remove(F.split(t, SPACE), ""))).alias("w"),
    )
    scalars = ["doc", *(["row"] if keep else []), "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_others", "n_capitals", "n_shouts"]
    # 8-word windows by hash, doubled from words to pairs to fours to eights; a text whose fours all differ has no window
    # twice. Positions of windows found twice come from adjacent equals of the sorted hashes.
    n = F.size("w")
    rows = rows.select(*scalars, n.cast("long").alias("n_words"), F.explode(F.array(
        F.when(n >= WINDOW, F.transform("w", lambda x: F.xxhash64(x))))).alias("h"))
    scalars.append("n_words")
    for step in (1, 2):
        rows = rows.select(*scalars, F.explode(F.array(F.when(F.col("h").isNotNull(), _joined("h", step)))).alias("h"))
    rows = rows.select(*scalars, F.explode(F.array(F.when(_has_twins("h"), _joined("h", 4)))).alias("h"))
    rows = rows.select(*scalars, F.explode(F.array(F.when(_has_twins("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))).alias("s"))
    m = F.size("s")
    rows = rows.select(*scalars, F.explode(F.array(F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(
        F.filter(F.zip_with(F.slice("s", 1, m - 1), F.slice("s", 2, m - 1),
                            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))))))).alias("p"))
    k = F.size("p")
    gaps = F.zip_with(F.slice("p", 1, k - 1), F.slice("p", 2, k - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.col("p").isNotNull(), F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(0)
    return rows.select(*scalars, covered.cast("long").alias("n_repeat_words"))


#: rule, value, when it votes, its vote: 1 speaks for the text, -1 against; otherwise the rule abstains
RULES = [
    ("capitals", "n_capitals / nullif(word_chars - n_others, 0)", "> 0.6", -1),
    ("symbols", "n_symbols / n_words", "> 0.15", -1),
    ("shouts", "n_shouts / n_words", "> 0.35", -1),
    ("repeats", "n_repeat_words / n_words", "> 0.3", -1),
    ("lines", "n_dup_lines / nullif(n_lines, 0)", "> 0.6", -1),
    ("long words", "word_chars / n_words", "> 18", -1),
    ("letters", "n_others / word_chars", "> 0.3", -1),
    ("prose", "(word_chars - n_others - n_capitals) / word_chars", ">= 0.9", 1),
    ("calm", "(n_symbols + n_shouts) / n_words", "< 0.02", 1),
]


def _vote(value: str, when: str, vote: int) -> Column:
    """Documents without words, and values that don't exist, get no vote."""
    return F.when((F.col("n_words") > 0) & F.expr(f"coalesce(({value}) {when}, false)"), vote).otherwise(0)


def _patterns(feats: DataFrame) -> DataFrame:
    votes = F.array(*[_vote(value, when, vote) for _, value, when, vote in RULES])
    return feats.withColumn("votes", votes)


def _posterior(accuracies: list[float]) -> Column:
    """Probability of good quality given the votes: each vote counts by the log odds of its rule's accuracy.

    The odds are one array literal, so that every step of the fit runs the same compiled code.
    """
    odds = F.array(*[F.lit(log(a / (1 - a))) for a in accuracies])
    total = F.aggregate(F.zip_with("votes", odds, lambda v, o: v * o), F.lit(0.0), lambda acc, x: acc + x)
    return 1 / (1 + F.exp(-total))


def learn(voted: DataFrame, iterations: int = ITERATIONS) -> list[float]:
    """Accuracy of each rule's votes by expectation-maximisation; votes are independent given the quality.

    Both qualities are equally likely before the votes. The start takes each rule to be right nine times out of ten, and
    the same belief counts as ten votes in each step. A step is one aggregate over the counts of vote patterns of all
    documents.
    """
    patterns = materialize(voted.groupBy("votes").count().coalesce(1))
    accuracies = [0.9] * len(RULES)
    for _ in range(iterations):
        weighed = patterns.select("votes", "count", _posterior(accuracies).alias("good"))
        rows = weighed.select(F.posexplode("votes").alias("r", "v"), "count", "good").where("v <> 0")
        right = F.when(F.col("v") == 1, F.col("good")).otherwise(1 - F.col("good")) * F.col("count")
        got = {x["r"]: (x["right"], x["n"]) for x in rows.groupBy("r").agg(F.sum(right).alias("right"), F.sum("count").alias("n")).collect()}
        accuracies = [min(max((got.get(r, (0, 0))[0] + 9) / (got.get(r, (0, 0))[1] + 10), 0.01), 0.99) for r in range(len(RULES))]
    return accuracies


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Features, base rules, posterior and verdict of every document."""
    voted = materialize(_patterns(features(docs, id_col, text_col, keep)))
    accuracies = learn(voted)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = voted.withColumn("posterior", _posterior(accuracies)).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    return judge(docs, id_col, text_col, tuple(docs.columns)).where("kept").select("row.*")

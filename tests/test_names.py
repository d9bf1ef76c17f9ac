"""Name normalising, similarity and knowledge-base search."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ownerscope import dictionaries as D
from ownerscope.functions import similarity as S
from ownerscope.functions import text as T
from ownerscope.operators import kb as K


def column(spark, values, expr, name="x"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@pytest.mark.parametrize("dotted, want", [
    ("literal", ["Apple .", "Apple", "JPMorgan Chase & .", "Toyota", "Microsoft .", "International Business Machines", "é x", ""]),
    ("strip", ["Apple", "Apple", "JPMorgan Chase", "Toyota", "Microsoft", "International Business Machines", "é x", ""])])
def test_normalize(spark, dotted, want):
    names = ["Apple Inc.", "Apple Inc", "JPMorgan Chase & Co.", "Toyota KK", "Microsoft Corp., Ltd", "IBM", "éCo x", None]
    assert column(spark, names, T.normalize_company(F.col("x"), dotted)) == want


def test_ratios(spark):
    pairs = [("JPMorgan Chase", "JP Morgan", 0.4278), ("Microsoft Corp", "Microsoft Corporation", 0.8333),
             ("Berkshire Hathaway", "Berkshire Hathaway Inc.", 0.9020), ("Apple", "Apple .", 0.9429),
             ("Meta", "Meta .", 0.9333), ("Facebook", "Meta Platforms .", 0.0929), ("", "x", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.select("want", S.company_name_ratio(F.col("a"), F.col("b")).alias("got")).collect():
        assert round(r.got, 4) == r.want


def test_custom_weights_and_scorer(spark):
    q = spark.createDataFrame([("tesla",)], "query string")
    best = K.extract_best(q, ["Tesla Inc.", "Apple"], 1, scorer=S.partial_ratio)
    assert best.first().match == "Tesla Inc."
    with pytest.raises(ValueError):
        K.extract_best(q, ["x"] * (K.MAX_CHOICES + 1))


def mutate(rng, word):
    chars = list(word)
    for _ in range(rng.randint(0, 3)):
        if not chars:
            break
        i, how = rng.randrange(len(chars)), rng.random()
        if how < 0.4:
            chars[i] = rng.choice("abcdefgh ")
        elif how < 0.7:
            chars.pop(i)
        else:
            chars.insert(i, rng.choice("aeiou ."))
    return "".join(chars)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.7, 0.75, 0.85])
def test_search_equals_brute_force(spark, threshold):
    """Blocking keys lose no pair: all pairs of a small fixture are scored for comparison."""
    rng = random.Random(7)
    extra = ["ycompany", "zcompany", "abcompany", "Acme management", "tech ltdx", "pharmaceutical foo", "株", "ab", "aaaa"]
    rows = [(i, *c) for i, c in enumerate(D.KB_COMPANIES)] + [
        (100 + i, f"z{i}", n, [n + " tech", n + "corp"], "", None, None, None, [], []) for i, n in enumerate(extra)]
    kb = K.with_normalized(spark.createDataFrame(rows, "ord int, " + K.COMPANY_SCHEMA))
    base = [c[1] for c in D.KB_COMPANIES] + [a for c in D.KB_COMPANIES for a in c[2]] + extra + ["xcompany", "acme mgmt", "pharmco"]
    words = sorted({mutate(rng, b) for b in base for _ in range(2)})
    queries = spark.createDataFrame([(w,) for w in words], "query string")
    cands = K.kb_candidates(kb)
    got = {(r.query, r.company_id, r.text, round(r.score, 9)) for r in K.scored_pairs(queries, cands, threshold).collect()}
    wide = S.with_features(queries, T.normalize_company(F.col("query")), "q").join(
        S.with_features(cands, F.col("normalized"), "c"), F.lit(True))
    score = S.enhanced_ratio(S.feature_columns("q"), S.feature_columns("c")) * F.col("boost")
    want = {(r.query, r.company_id, r.text, round(r.score, 9))
            for r in wide.withColumn("score", score).filter(F.col("score") >= threshold).collect()}
    assert got == want and want


names = st.text(alphabet="abcdeé &.-XYZ", max_size=14)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(names, names), min_size=1, max_size=40))
def test_ratio_properties(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    ab, ba = S.company_name_ratio(F.col("a"), F.col("b")), S.company_name_ratio(F.col("b"), F.col("a"))
    for r in df.select("a", "b", ab.alias("ab"), ba.alias("ba"), S.company_name_ratio(F.col("a"), F.col("a")).alias("aa")).collect():
        assert -1e-9 <= r.ab <= 1 + 1e-9
        assert abs(r.ab - r.ba) < 1e-9
        if any(ch.isascii() and ch.isalnum() for ch in r.a):
            assert abs(r.aa - 1) < 1e-9


def test_kb_files(spark, tmp_path):
    from ownerscope.sources import feeds
    kb = K.shipped_kb(spark)
    feeds.write_kb(kb, str(tmp_path / "kb"))
    back = feeds.read_kb(spark, str(tmp_path / "kb"))
    assert {(r.id, r.normalized_name, tuple(r.aliases)) for r in back.collect()} == {
        (r.id, r.normalized_name, tuple(r.aliases)) for r in kb.collect()}
    assert K.kb_candidates(back).count() == 59
    (tmp_path / "export.json").write_text('{"companies": [{"id": "a", "name": "Acme Inc", "aliases": ["Acme"]}], "metadata": {"count": 1}}')
    assert feeds.read_kb_export(spark, str(tmp_path / "export.json")).first().normalized_name == "Acme"


def test_kb_export(spark, tmp_path):
    from ownerscope.sources import feeds

    kb = K.shipped_kb(spark)
    feeds.write_kb_export(kb, str(tmp_path / "out"), "2026-01-02")
    meta = spark.read.json(str(tmp_path / "out" / "metadata")).first()
    assert (meta["version"], meta["exportDate"], meta["count"]) == ("1.0", "2026-01-02", kb.count())
    again = feeds.read_kb(spark, str(tmp_path / "out" / "companies"))
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in kb.collect())


def test_news_days(spark):
    from pyspark.sql import functions as F

    from ownerscope import dictionaries as D
    from ownerscope.operators import marts as R

    word, source = D.OWNERSHIP_KEYWORDS[0], D.TIER1_SOURCES[0]
    rows = [(1, i, f"Acme {word}", None, source, f"2024-03-0{i}T10:00:00Z") for i in range(1, 6)]
    news = spark.createDataFrame(rows, "company_id int, doc_id int, title string, description string, source_id string, published_at string")
    days = lambda **k: [r["doc_id"] for r in R.news_scan(news, F.lit("acme"), **k).orderBy("doc_id").collect()]
    assert days(since="2024-03-02", until="2024-03-04") == [2, 3, 4] and days() == [1, 2, 3, 4, 5] and days(until="2024-03-01", k=None) == [1]


@pytest.mark.parametrize("shared", [("Company", "Holdings"), ("Capital", "Systems")])
def test_common_words_make_few_pairs(spark, shared):
    """2,000 names that all have one of two words: the candidate pairs are a small share of all, and none is lost."""
    from ownerscope.operators.blocking import candidate_pairs

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    names = [f"{word().capitalize()} {word().capitalize()} {rng.choice(shared)}" for _ in range(2000)]
    near = [mutate(rng, n) for n in names[:300]]
    rows = [(i, f"c{i}", n, [], "", None, None, None, [], []) for i, n in enumerate(names)]
    kb = K.with_normalized(spark.createDataFrame(rows, "ord int, " + K.COMPANY_SCHEMA))
    queries = spark.createDataFrame([(n,) for n in sorted({*names, *near})], "query string")
    q = S.with_features(queries, T.normalize_company(F.col("query")), "q")
    c = S.with_features(K.kb_candidates(kb), F.col("normalized"), "c")
    pairs = candidate_pairs(q, c, 0.7, boost=F.col("boost"))
    assert pairs.count() < 0.05 * queries.count() * len(names)
    some = queries.filter(F.xxhash64("query") % 40 == 0)
    got = {(r.query, r.company_id, round(r.score, 9)) for r in K.scored_pairs(some, K.kb_candidates(kb), 0.7).collect()}
    wide = q.join(some, "query", "left_semi").join(c, F.lit(True))
    score = S.enhanced_ratio(S.feature_columns("q"), S.feature_columns("c")) * F.col("boost")
    want = {(r.query, r.company_id, round(r.score, 9)) for r in wide.withColumn("score", score).filter(F.col("score") >= 0.7).collect()}
    assert got == want and len(want) > 40


def test_equal_texts_are_searched_once(spark, monkeypatch):
    """Companies with the same names cost one candidate per text when only the best company is asked for, and the first one wins."""
    rows = [(i, f"c{i}", ("Acme Widgets", "Blue Rivet")[i % 2], ["Brand 1", f"Own {i}"], "", None, None, None, [], []) for i in range(400)]
    rows.append((None, "none", "Green Bolt", ["Acme Widgets"], "", None, None, None, [], []))
    kb = K.with_normalized(spark.createDataFrame(rows, "ord int, " + K.COMPANY_SCHEMA))
    queries = spark.createDataFrame([("acme widget",), ("Blue Rivets",), ("Brand 1",), ("Green Bolts",)], "query string")
    searched, real = [], K.candidate_pairs
    monkeypatch.setattr(K, "candidate_pairs", lambda q, c, *a, **k: (searched.append(c.count()), real(q, c, *a, **k))[1])
    best = lambda limit: {(r["query"], r["company_id"], r["match_type"], r["matched_text"], round(r["score"], 9)) for r in K.fuzzy_search(queries, kb, limit=limit).collect() if r["rank"] == 1}
    got = best(1)
    assert searched == [2 + 1 + 1 + 400 + 1] and {g[1] for g in got if g[0] != "Brand 1"} == {"c0", "c1", "none"}
    assert got == best(3)

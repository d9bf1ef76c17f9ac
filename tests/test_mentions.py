"""Mention extraction, detection and page parsing."""

from pyspark.sql import functions as F

from ownerscope import dictionaries as D
from ownerscope.operators import detect as X
from ownerscope.operators import mentions as M
from ownerscope.sources import pages as P


def mentions(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.asDict() for r in M.extract_mentions(df, ["doc_id"], **options).orderBy("doc_id", "ord").collect()]


def test_article(spark):
    text = ("today, shares of Berkshire Hathaway Inc, rose, while it holds Apple Inc, and stakes in, Bank of America Corp and "
            "Coca-Cola Company, sources said.")
    found = [m["normalized"] for m in mentions(spark, text) if m["pattern"] == "company_formal"]
    assert found[:3] == ["Berkshire Hathaway Inc", "Apple Inc", "Bank of America Corp and Coca-Cola Company"]
    for m in mentions(spark, text):
        assert text[m["position"]:].startswith(m["text"]) or m["type"] == "company_context"


def test_rejected_first_hit_blocks_later_ones(spark):
    assert [m["text"] for m in mentions(spark, "we like $I and $GE here")] == ["GE"]
    assert mentions(spark, "they bought Apple") == []
    assert [m["text"] for m in mentions(spark, "they bought Apple, stock rose")] == ["Apple"]


def test_guards_are_optional(spark):
    text = "x" * 1200 + " and $TSLA"
    assert [m["text"] for m in mentions(spark, text)] == ["TSLA"]
    assert mentions(spark, text, max_chars=1000) == []
    many = " ".join(f"${a}{b}" for a in "ABCDE" for b in "FGHKL")
    assert len(mentions(spark, many)) == 25 and len(mentions(spark, many, cap=20)) == 20


def test_custom_family(spark):
    fam = M.PatternFamily("isin", "isin", 0.99, [("", r"\b([A-Z]{2}[0-9]{10})\b", [], None)], lambda c: c.startswith("US"))
    got = mentions(spark, "buy US0378331005 or DE0007164600", families=[fam])
    assert [(m["text"], m["position"]) for m in got] == [("US0378331005", 4)]


def test_coreference_and_confidence(spark):
    df = spark.createDataFrame([(0, "see Nvidia Corp, and Nvidia Corp Holdings, $NVDA")], "doc_id int, text string")
    out = M.resolve_coreferences(M.mention_arrays(df)).withColumn("c", M.array_confidence(F.col("mentions"))).first()
    assert [m.normalized for m in out.mentions] == ["NVDA", "Nvidia Corp"]
    assert out.mentions[1].refs == ["Nvidia Corp Holdings"]
    assert abs(out.c - (0.95 * 1.0 + 0.9 * 0.9) / 1.9) < 1e-12


def layered(spark, text, href=None, parent=None):
    df = spark.createDataFrame([(text, href, parent)], "t string, h string, p string")
    return df.select(X.detect_layered(F.col("t"), F.coalesce("h", F.lit("")), F.coalesce("p", F.lit(""))).alias("d")).first().d


def test_layered_detection(spark):
    for text in ("BlackRock manages trillions", "Vanguard Group leads the industry", "Goldman Sachs analysis"):
        assert layered(spark, text).strategy == "strict" and layered(spark, text).confidence >= 0.7
    for text in ("Acme Inc", "TechCorp LLC", "Global Industries Ltd", "Innovative Solutions Company"):
        assert layered(spark, text).strategy == "flexible"
    assert layered(spark, "Acme Inc").company == "Acme Inc"
    assert layered(spark, "BofA quarterly results") is not None
    assert layered(spark, "CEO of tiny Startup") is None and layered(spark, "") is None
    assert abs(layered(spark, "BlackRock", "/company/x", "H1").confidence - 1.0) < 1e-12


def test_listed_detection(spark):
    rows = [("Shares of tesla today", "Tesla"), ("Ocean Capital", "Ocean Capital"), ("The Trust", None), ("x{", None), ("small bank", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("want", X.detect_listed(F.col("t")).alias("got")).collect():
        assert r.got == r.want


PAGE = ("<html><head><title>Acme | News</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></li></ul></nav>"
        "<article><h1 data-symbol='AAPL'>Apple Inc.</h1><p><b>First<br><p>second <span class='ticker'>MSFT US Equity</span></article></body></html>")


def test_page_tree(spark):
    df = spark.createDataFrame([(1, "https://finance.yahoo.com/quote/AAPL", PAGE)], "page_id bigint, url string, html string")
    e = {(r.tag, r.sib_ord): r for r in P.page_elements(df).collect()}
    assert e[("p", 1)].p_rank == 1 and e[("p", 2)].p_rank == 2 and e[("span", 0)].p_rank == 2
    assert [a.tag for a in e[("span", 0)].ancestors] == ["p", "article", "body", "html"]
    assert e[("h1", 0)].attrs == {"data-symbol": "AAPL"} and e[("h1", 0)].title == "Acme | News"
    assert "var t" not in e[("html", 0)].text
    tickers = X.site_tickers(P.page_elements(df)).filter(F.col("tag") == "h1").first()
    assert tickers.ticker == "AAPL"


def test_surrounding_clues_brute_force(spark):
    """Ancestor and sibling clues equal a direct walk over the tree of a fixture page."""
    df = spark.createDataFrame([(1, "https://finance.yahoo.com/quote/AAPL", PAGE)], "page_id bigint, url string, html string")
    e = X.with_clues(P.page_elements(df)).cache()
    rows = {r.elem_id: r for r in e.collect()}
    want = []
    for r in rows.values():
        for d, a in enumerate(r.ancestors[:3], 1):
            want += [(r.elem_id, c.type, round(c.confidence * (1 - d * 0.1), 9)) for c in rows[a.id].clues]
        for s in rows.values():
            if r.parent_id is not None and s.parent_id == r.parent_id and 0 < abs(s.sib_ord - r.sib_ord) <= 2:
                want += [(r.elem_id, c.type, round(c.confidence * 0.7, 9)) for c in s.clues]
    got = [(r.elem_id, r.type, round(r.confidence, 9)) for r in X.surrounding_clues(e).collect()]
    assert sorted(got) == sorted(want) and want


def test_candidates_of_any_tag_are_scored(spark, monkeypatch):
    """Elements picked by class or attribute on list items, cells and headings of lower order reach both page queries."""
    from ownerscope.plans import page_queries as Q

    html = ("<html><body><ul><li class='company-name'>Apple Inc.</li></ul><table><tr><td data-symbol='MSFT'>Microsoft Corporation</td></tr></table>"
            "<h4 class='company-name'>Tesla Inc.</h4><div>Boeing Company</div></body></html>")
    rows = [(1, "https://finance.yahoo.com/quote/AAPL", html), (2, "https://example.org/", html)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    monkeypatch.setattr(Q, "view", lambda *_: df)
    found = Q.page_entities(spark, None).collect()
    assert {r.page_id for r in found} == {1}
    assert any("Apple" in r.text for r in found) and any("Microsoft" in r.text for r in found) and any("Tesla" in r.text for r in found)
    tags = {r.elem_id: r.tag for r in P.page_elements(df).filter("page_id = 1").collect()}
    assert {"li", "td", "h4"} <= {tags[r.elem_id] for r in Q.best_entity_per_element(spark, None).collect()}

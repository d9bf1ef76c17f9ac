"""Whole element texts by tag intervals."""

import random

from pyspark.sql import functions as F

from ownerscope.sources import pages as P
from ownerscope.sources import tags as G

TAGS = ("h1", "h2", "h3", "p", "span", "a")


def texts(spark, html, tags=TAGS):
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    rows = G.tag_elements(df, tags).orderBy("at").collect()
    return [(r["tag"], r["ord"], r["text"]) for r in rows]


def test_whole_texts_and_implied_ends(spark):
    html = ("<!DOCTYPE html><body><h1 class=\"Big name\" title='a > b'>A <b>bold</b> &amp; <i>x</i></h1><p><b>first<br>line<p>second <a href=\"/q\">link"
            "<span>in</span></a> end<ul><li>no text of p</ul><!-- <p>gone</p> --><script>var t = '<p>x</p>';</script>"
            "<span>outer <SPAN>inner</SPAN> rest</span><p>last 1 < 2 &copy;</div>")
    assert texts(spark, html) == [
        ("h1", 0, "A bold & x"), ("p", 0, "firstline"), ("p", 1, "second linkin end"), ("a", 0, "linkin"), ("span", 0, "in"),
        ("span", 1, "outer inner rest"), ("span", 2, "inner"), ("p", 2, "last 1 < 2 ©")]
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [r["class"] for r in G.tag_elements(df, ("h1",)).collect()] == ["Big name"]


def test_edges(spark):
    assert texts(spark, None) == [] and texts(spark, "") == [] and texts(spark, "no tags") == []
    assert texts(spark, "</p></span>x<span>never closed <a>also") == [("span", 0, "never closed also"), ("a", 0, "also")]
    assert texts(spark, "<p></p><h2/>x") == [("p", 0, ""), ("h2", 0, "x")]
    long_ = "<p>" + "word <b>bold</b> " * 40_000
    assert texts(spark, long_) == [("p", 0, "word bold " * 40_000)]
    rows = [(1, "<p>a</p>")] * 2 + [(None, "<p>b</p>"), (2, None)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("elements_", F.lit(0)).withColumn("text", F.lit("mine"))
    got = [(r["page_id"], r["text"], [e["text"] for e in r["elements"]]) for r in G.tag_texts(df, ("p",)).collect()]
    assert sorted(got, key=str) == sorted([(1, "mine", ["a"]), (1, "mine", ["a"]), (None, "mine", ["b"]), (2, "mine", [])], key=str)


def test_equals_the_tree(spark):
    """Random nesting with implied paragraph ends: the intervals give the texts of the parsed tree."""
    rng = random.Random(2)

    def part(depth):
        kind = rng.choice(["text", "text", "span", "a", "b", "div", "p", "h2", "open p"] if depth < 5 else ["text"])
        if kind == "text":
            return rng.choice(["alpha ", "beta &amp; ", "1 ", " gamma"])
        inner = "".join(part(depth + 1) for _ in range(rng.randint(0, 3)))
        if kind in ("span", "a", "b", "h2"):  # inline elements do not hold blocks
            inner = rng.choice(["x ", "y <b>z</b>", "<span>in <i>in</i></span> beta &amp; "])
        return f"<p>{inner}" if kind == "open p" else f"<{kind}>{inner}</{kind}>"

    pages = [(i, "u", "<body><article>" + "".join(part(0) for _ in range(12)) + "</article></body>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    tree = {(r["page_id"], r["tag"], r["n"]): r["text"] for r in P.page_elements(df).filter(F.col("tag").isin(*TAGS)).selectExpr(
        "page_id", "tag", "text", "row_number() over (partition by page_id, tag order by elem_id) - 1 as n").collect()}
    got = {(r["page_id"], r["tag"], r["ord"]): r["text"] for r in G.tag_elements(df, TAGS).collect()}
    assert got == tree and len(got) > 200


def test_containment(spark):
    html = "<span>a<a>b</a></span><a>c</a>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    row = G.tag_texts(df, TAGS).select(F.transform("elements", lambda e: G.inside(e, F.col("elements"), "span")).alias("x")).first()
    assert row["x"] == [False, True, False]

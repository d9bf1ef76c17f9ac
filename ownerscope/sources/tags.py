"""Whole element texts by tag intervals: DataFrame functions only, no Python and no tree.

A page is a sequence of tokens: comments and hidden elements as a whole, tags, and text between them. Running sums over a page's
tokens number them before and after: how much text stands before a token, and how deep it stands among the tags of its
name. A start tag's element ends at the next end tag of that depth; a paragraph, which is rarely closed, ends at the next tag that
closes one, and what began inside it ends with it. So an element is an interval of tokens, its text a slice of the page's text, and an element stands inside another
when its interval does.

The windows are over one page's tokens, which travel once, by page; the page's text travels in one more row and is sliced after the
windows.

Defined results: a null page has no elements. An element that is never closed reaches to the end of its page. Text in
comments, scripts and styles is no text. ``ENTITIES`` are replaced, other character references stay as written. Repeated pages
are pages of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ownerscope.sources.pages import CLOSES_P, HIDDEN, VOID

_HIDDEN = "|".join(sorted(HIDDEN))
TOKEN = (rf"(?si)<!--.*?-->|<(?:{_HIDDEN})\b[^>]*>.*?</(?:{_HIDDEN})\s*>"
         r"""|<[/!?]?[a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|[^<]+|<""")
NAME = r"^</?([a-zA-Z][a-zA-Z0-9-]*)"
CLASS = r"""(?i)\sclass\s*=\s*"([^"]*)\""""
MARKUP = "^<[/!?a-zA-Z]"
#: tags whose end also ends an open paragraph
ENDS_P = sorted((CLOSES_P - {"hr"}) | {"body", "html", "li", "td"})
STARTS_P = sorted(CLOSES_P - {"p"})

# Character references and what they stand for; the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&")]


def decoded(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def tag_texts(pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Each page with ``elements``: of the wanted tags, in document order, (tag, ord, class, at, to, text).

    ``ord`` counts from 0 within the tag; ``at`` and ``to`` are the first token and the token that ends the element.
    """
    columns = pages.columns
    none = F.lit(None).cast("string")
    tokens = F.coalesce(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    plain = lambda t: ~t.rlike(MARKUP)
    text = F.array_join(F.transform(F.filter("_tokens", plain), decoded), "")
    # the page itself is the row after its last token
    rows = pages.withColumn("_row", F.monotonically_increasing_id()).withColumn("_tokens", tokens)
    every = F.concat(
        F.transform("_tokens", lambda t, k: F.struct(k.alias("k"), t.alias("token"), none.alias("text"))),
        F.array(F.struct(F.size("_tokens").alias("k"), none.alias("token"), text.alias("text"))))
    page = F.struct(*[F.col(c) for c in columns])
    rows = rows.select("_row", page.alias("_page"), F.explode(every).alias("t")).select(
        "_row", "t.*", F.when(F.col("t.token").isNull(), F.col("_page")).alias("_page"))
    is_text = F.col("token").isNotNull() & plain(F.col("token"))
    rows = rows.withColumn("off", F.coalesce(F.sum(F.when(is_text, F.length(decoded(F.col("token")))).otherwise(0)).over(
        Window.partitionBy("_row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    name = F.lower(F.regexp_extract("token", NAME, 1))
    rows = rows.withColumn("name", F.when(is_text | F.col("token").isNull(), "").otherwise(name))
    step = F.when(F.col("name").isin("", *VOID, *HIDDEN), 0).when(F.col("token").startswith("</"), -1).otherwise(1)
    rows = rows.withColumn("step", step)
    closes = ((F.col("step") == 1) & F.col("name").isin(*STARTS_P)) | ((F.col("step") == -1) & F.col("name").isin(*ENDS_P))
    families = [F.when(F.col("token").isNull(), ""), F.when(F.col("name").isin("p", *tags) & (F.col("step") != 0), F.col("name")),
                F.when(closes & (F.col("name") != "p"), "p")]
    rows = rows.withColumn("family", F.explode(F.filter(F.array(*families), lambda f: f.isNotNull())))
    begins = (F.col("step") == 1) & (F.col("name") == F.col("family"))
    within = Window.partitionBy("_row", "family").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ord", F.sum(begins.cast("int")).over(within) - 1).withColumn("depth", F.sum("step").over(within))
    level = F.when(F.col("family").isin("p", ""), 0).when(F.col("step") == 1, F.col("depth")).otherwise(F.col("depth") + 1)
    following = Window.partitionBy("_row", "family", "level").orderBy("k")
    far = F.lit(2**31 - 1)
    rows = rows.withColumn("level", level).withColumn("to", F.coalesce(F.lead("k").over(following), far)).withColumn(
        "end", F.coalesce(F.lead("off").over(following), far))
    paragraph = F.when((F.col("family") == "p") & begins, F.struct("to", "end"))
    rows = rows.withColumn("_p", F.last(paragraph, ignorenulls=True).over(
        Window.partitionBy("_row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    open_ = F.coalesce(F.col("_p.to") > F.col("k"), F.lit(False))
    rows = rows.withColumns({c: F.when(open_, F.least(c, f"_p.{c}")).otherwise(F.col(c)) for c in ("to", "end")})
    element = F.struct(F.col("k").alias("at"), F.col("family").alias("tag"), F.col("ord").cast("int").alias("ord"),
                       F.regexp_extract("token", CLASS, 1).alias("class"), "to", "off", "end")
    whole = rows.groupBy("_row").agg(
        F.first("_page", ignorenulls=True).alias("_page"), F.first("text", ignorenulls=True).alias("_text"), F.max("k").alias("_last"),
        F.sort_array(F.collect_list(F.when(begins & F.col("family").isin(*tags), element))).alias("_e"))
    sliced = F.transform("_e", lambda e: F.struct(
        e["tag"].alias("tag"), e["ord"].alias("ord"), e["class"].alias("class"), e["at"].alias("at"), F.least(e["to"], F.col("_last")).alias("to"),
        F.substr(F.col("_text"), (e["off"] + 1).cast("int"), (F.least(e["end"], F.length("_text")) - e["off"]).cast("int")).alias("text")))
    return whole.select("_page.*", sliced.alias("elements"))


def tag_elements(pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """One row per element of the wanted tags: page_id, url, tag, ord, class, at, to, text."""
    return tag_texts(pages.select("page_id", "url", "html"), tags).select("page_id", "url", F.explode("elements").alias("e")).select(
        "page_id", "url", "e.*")


def inside(element: Column, elements: Column, tag: str) -> Column:
    """Whether an element stands inside one of a tag: interval containment."""
    return F.exists(elements, lambda o: (o["tag"] == tag) & (o["at"] < element["at"]) & (o["to"] >= element["to"]))

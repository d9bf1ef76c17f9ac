"""Page sources: elements of raw HTML pages, and the Columns that read a URL."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ownerscope import dictionaries as D
from ownerscope.functions.text import any_of, literal_map

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4",
            "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

NODE = "struct<id:int,tag:string,class:string,attrs:map<string,string>>"
ELEMENT_SCHEMA = (
    "page_id bigint, url string, elem_id int, parent_id int, depth int, sib_ord int, tag string, class string, "
    f"attrs map<string,string>, text string, ancestors array<{NODE}>, p_rank int, title string"
)
_ATTRS = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("elem_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()),
    ("sib_ord", pa.int32()), ("tag", pa.string()), ("class", pa.string()), ("attrs", _ATTRS), ("text", pa.string()),
    ("ancestors", pa.list_(pa.struct([("id", pa.int32()), ("tag", pa.string()), ("class", pa.string()), ("attrs", _ATTRS)]))),
    ("p_rank", pa.int32()), ("title", pa.string())])
#: a task hands its rows on when they hold about so many bytes
CHUNK = 2_000_000


class _Tree(HTMLParser):
    """Elements in document order; tolerant of unclosed tags.

    The text of an element is ``pieces[begin:end]``, so a tree is as large as its page however deep the elements lie.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[int] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close("p", stop={"article", "div", "section", "body"})
        if tag == "li":
            self._close("li", stop={"ul", "ol"})
        parent = self.stack[-1] if self.stack else None
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "parent": parent, "begin": len(self.pieces),
                "end": None, "children": 0, "sib": 0, "depth": len(self.stack)}
        if parent is not None:
            node["sib"] = self.nodes[parent]["children"]
            self.nodes[parent]["children"] += 1
        self.nodes.append(node)
        if tag in VOID:
            node["end"] = node["begin"]
        else:
            self.stack.append(len(self.nodes) - 1)

    def _close(self, tag, stop=()):
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.nodes[self.stack[i]]["tag"]
            if name == tag:
                for j in self.stack[i:]:
                    self.nodes[j]["end"] = len(self.pieces)
                del self.stack[i:]
                return
            if name in stop:
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if self.stack and self.nodes[self.stack[-1]]["tag"] not in HIDDEN:
            self.pieces.append(data)

    def text(self, node: dict) -> str:
        return "".join(self.pieces[node["begin"]:node["end"]])


def _rows(page_id, url, html) -> Iterator[tuple[tuple, int]]:
    """The elements of a page, each with about the bytes it takes in a batch."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = tree.nodes
    title = next((tree.text(n).strip() for n in nodes if n["tag"] == "title"), "")
    paragraphs: dict[int | None, int] = {}
    rank: dict[int, int] = {}

    def chain(i):
        while i is not None:
            yield i
            i = nodes[i]["parent"]

    for i, n in enumerate(nodes):
        if n["tag"] == "p":
            article = next((j for j in chain(n["parent"]) if nodes[j]["tag"] == "article"), None)
            if article is not None:
                paragraphs[article] = paragraphs.get(article, 0) + 1
                rank[i] = paragraphs[article]
    known = [{"id": i, "tag": n["tag"], "class": n["attrs"].get("class", ""), "attrs": list(n["attrs"].items())} for i, n in enumerate(nodes)]
    size: list[int] = []  # of an element's attributes and those of all its ancestors
    for n in nodes:
        size.append(100 + sum(len(k) + len(v) for k, v in n["attrs"].items()) + (0 if n["parent"] is None else size[n["parent"]]))
    shared = len(url or "") + len(title)
    for i, n in enumerate(nodes):
        text = tree.text(n)
        up = list(chain(n["parent"]))
        in_p = next((rank[j] for j in [i, *up] if j in rank), None)
        yield (page_id, url, i, n["parent"], n["depth"], n["sib"], n["tag"], known[i]["class"], known[i]["attrs"],
               text, [known[j] for j in up], in_p, title), shared + len(text) + size[i]


def _chunks(pages: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The elements of the pages in batches of bounded size, whatever the number of pages and of a page's elements."""
    rows, held = [], 0
    for page in pages:
        for row, size in _rows(*page):
            rows.append(row)
            held += size
            if held >= CHUNK:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def page_elements(pages: DataFrame) -> DataFrame:
    """Every element of every page with its place in the tree.

    Parsing needs a tokenizer Spark does not have; it runs per Arrow batch and a
    page never leaves its task. A task holds one page's tree and at most ``CHUNK``
    bytes of its rows at a time. ``p_rank`` is the number, within the article, of
    the paragraph the element is in.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _chunks(tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(parse, ELEMENT_SCHEMA)


# --- selectors ---------------------------------------------------------------
EXACT_ATTRS = ("role", "data-type", "data-test", "data-field")


def node_matches(tag: Column, cls: Column, attrs: Column, selector: tuple) -> Column:
    want_tag, want_class, attr, part = selector
    tests = []
    if want_tag:
        tests.append(tag == want_tag)
    if want_class:
        tests.append(F.array_contains(F.split(cls, r"\s+"), want_class))
    if attr:
        value = F.try_element_at(attrs, F.lit(attr))
        tests.append(value.isNotNull() if not part else
                     F.coalesce(value == part if attr in EXACT_ATTRS else value.contains(part), F.lit(False)))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def self_matches(selector: tuple) -> Column:
    return node_matches(F.col("tag"), F.col("class"), F.col("attrs"), selector)


def inside(selectors: list[tuple]) -> Column:
    """Some ancestor matches one of the selectors."""
    return F.exists("ancestors", lambda a: any_of(
        [node_matches(a["tag"], a["class"], a["attrs"], s) for s in selectors]))


def closest(selectors: list[tuple]) -> Column:
    """The element itself or some ancestor matches."""
    return any_of([self_matches(s) for s in selectors]) | inside(selectors)


def candidate(path: list[tuple]) -> Column:
    """Element reached by a selector path [outer, ..., inner]."""
    out = self_matches(path[-1])
    for outer in path[:-1]:
        out = out & inside([outer])
    return out


def site_candidates(elements: DataFrame, site: str) -> DataFrame:
    """Candidate elements of one site: selectors, page chrome removed, priority keys.

    A company profile page of the list site only yields its profile heading.
    """
    rows = elements.filter(any_of([candidate(p) for p in D.SITE_CANDIDATES[site]]))
    if site in D.CHROME:
        rows = rows.filter(~closest(D.CHROME[site]))
    false = F.lit(False)
    if site == "yahoo":
        keys = [self_matches((None, None, "data-symbol", "")), closest([(None, "quote-header-section", None, None)]),
                F.col("tag") == "h1"]
    elif site == "bloomberg":
        keys = [F.col("class").contains("ticker") | self_matches((None, None, "data-ticker", "")),
                closest([(None, "headline", None, None), (None, "article-headline", None, None)]), false]
    elif site == "marketwatch":
        keys = [closest([(None, None, "data-ticker", ""), (None, "element--intraday", None, None), ("bg-quote", None, None, None)]),
                closest([(None, "watchlist", None, None)]), false]
    else:
        profile = self_matches(("h1", "profile-name", None, None)) | self_matches(("h1", "listuser-header__name", None, None)) | (
            (F.col("tag") == "h1") & closest([(None, "profile-heading", None, None)]))
        heads = rows.filter(url_path(F.col("url")).contains("/companies/") & profile & (F.trim("text") != ""))
        first = heads.groupBy("page_id").agg(F.min("elem_id").alias("_head"))
        rows = rows.join(first, "page_id", "left").filter(F.col("_head").isNull() | (F.col("_head") == F.col("elem_id"))).drop("_head")
        keys = [false, false, false]
    return rows.withColumn("priority", F.array(*[k.cast("int") for k in keys]))


def all_site_candidates(elements: DataFrame) -> DataFrame:
    """Candidate elements of every page with a ``site``, each by the selectors of its own, of any tag."""
    parts = [site_candidates(elements.filter(F.col("site") == s), s) for s in D.SITE_CANDIDATES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- URLs --------------------------------------------------------------------
def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def site_of(url: Column) -> Column:
    """Site of a page by host, null when it is none of the four."""
    return F.try_element_at(literal_map(D.SITE_HOSTS), F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def trusted_site(origin: Column) -> Column:
    return F.coalesce(*[F.when(origin.rlike(p), F.lit(s)) for s, p in D.TRUSTED_ORIGINS])


def is_company_page(url: Column) -> Column:
    low, path = F.lower(url), F.lower(url_path(url))
    return any_of([path.rlike(p) for p in D.COMPANY_PAGE_PATHS] + [low.contains(p) for p in D.COMPANY_PAGE_PARTS])


def page_flags(url: Column) -> Column:
    p = url_path(url)
    return F.struct(
        (p.contains("/story/") | p.contains("/articles/")).alias("article"),
        p.contains("/investing/stock/").alias("quote"), p.contains("/markets").alias("markets"),
        p.contains("/watchlist").alias("watchlist"), p.isin("/", "/latest-news").alias("home"),
        p.contains("/markets/").alias("market_news"), p.contains("/company/").alias("company_news"),
        p.contains("/opinion/").alias("opinion"))


def list_site_context(url: Column) -> Column:
    p = url_path(url)
    return F.struct(
        F.when(p.contains("/companies/"), "company-profile").when(p.contains("/lists/"), "list").alias("page_type"),
        F.when(p.contains("/companies/"), F.regexp_extract(p, r"/companies/([^/]*)", 1)).alias("slug"))


def _first(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def page_company(url: Column, title: Column, headings: Column) -> Column:
    """Company a page is about: URL slug, title, then the first usable h1."""
    slug = F.trim(F.replace(_first(F.lower(url_path(url)), D.COMPANY_SLUGS), F.lit("-"), F.lit(" ")))
    named = F.trim(_first(F.trim(title), [("(?i)" if f else "") + p for f, p in D.COMPANY_TITLES]))
    h1 = F.filter(F.transform(headings, lambda h: F.trim(h)), lambda h: (F.length(h) > 2) & (F.length(h) < 50))
    return F.coalesce(slug, named, F.try_element_at(h1, F.lit(1)))

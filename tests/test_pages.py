"""Elements of raw pages."""

import tracemalloc

from ownerscope.sources import pages as P


def test_elements_leave_in_bounded_batches():
    html = "<body>" + "<div class='a'><p>some words <b>bold</b></p></div>" * 50 + "</body>"
    taken = []

    def pages(n, text):
        for i in range(n):
            taken.append(i)
            yield i, "u", text

    batches = P._chunks(pages(600, html))
    first = next(batches)
    assert len(taken) < 300 and first.num_rows < 50_000  # not all pages' elements at once
    rows = first.num_rows + sum(b.num_rows for b in batches)
    assert rows == 600 * 151
    # one large page is no single batch either
    sizes = [b.num_rows for b in P._chunks(pages(1, "<b>x</b>" * 100_000))]
    assert sum(sizes) == 100_000 and max(sizes) < 50_000
    assert list(P._chunks(iter([(1, "u", None), (2, "u", "no tags")]))) == []


def test_elements_keep_their_columns(spark):
    html = '<body class="top"><article><p>one<p id=x hidden>two <b>bold</b></article>'
    df = spark.createDataFrame([(2**60 + 1, "u", html), (None, None, "<p>y"), (3, "u", None)], "page_id long, url string, html string").coalesce(1)
    got = {(r["page_id"], r["elem_id"]): r for r in P.page_elements(df).collect()}
    assert sorted(got, key=str) == sorted([(2**60 + 1, i) for i in range(5)] + [(None, 0)], key=str)
    bold = got[2**60 + 1, 4]
    assert (bold["tag"], bold["text"], bold["parent_id"], bold["depth"], bold["p_rank"]) == ("b", "bold", 3, 3, 2)
    assert [(a["id"], a["tag"], a["class"], a["attrs"]) for a in bold["ancestors"]] == [
        (3, "p", "", {"id": "x", "hidden": ""}), (1, "article", "", {}), (0, "body", "top", {"class": "top"})]
    assert got[None, 0]["url"] is None and got[2**60 + 1, 0]["parent_id"] is None


def test_attributes_of_ancestors_count_in_a_batch():
    html = f'<div style="{"x" * 20_000}">' + "<p>y</p>" * 400 + "</div>"  # 400 rows that each repeat the style
    batches = list(P._chunks((i, "u", html) for i in range(3)))
    assert sum(b.num_rows for b in batches) == 3 * 401
    assert max(b.nbytes for b in batches) < 2 * P.CHUNK


def test_a_deep_page_takes_a_tree_of_its_size():
    html = "<i>x " * 3_000
    tracemalloc.start()
    try:
        next(P._rows(1, "u", html))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 10_000_000  # every piece of text once, not once an ancestor


def test_texts_are_those_between_the_tags():
    html = "a<div>b<br>c<p>d<script>e</script>f<div>g</div></p>h<noscript>i<b>j</b></noscript><li>k<li>l</div>m<i>n"
    rows = [(r[6], r[9]) for r, _ in P._rows(1, "u", html)]
    assert rows == [("div", "bcdfghjkl"), ("br", ""), ("p", "df"), ("script", ""), ("div", "g"), ("noscript", "j"), ("b", "j"),
                    ("li", "k"), ("li", "l"), ("i", "n")]

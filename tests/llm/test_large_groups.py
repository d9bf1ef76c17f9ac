"""Groups of near copies that are alike without all being linked: equal to all pairs, with rows that follow the group's size."""

import random

import brute
import pytest

from ownerscope.llm import jaccard_join


def loose_group(n, seed=8):
    """Copies of one text with up to twelve changed words each: some pairs link and some do not."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
        out.append((i, " ".join(w)))
    return out


@pytest.fixture
def counted(monkeypatch):
    """Rows that the steps over members of a bucket's lead give."""
    rows = {}
    for name in ("close_members", "links_across"):
        def step(*args, _name=name, _step=getattr(jaccard_join, name)):
            out = _step(*args).cache()
            rows[_name] = out.count()
            return out

        monkeypatch.setattr(jaccard_join, name, step)
    return rows


def components(spark, texts):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(
        spark.createDataFrame(texts, "doc_id long, text string"), 4, 85, 100).collect()}


def test_rows_follow_the_group(spark, counted):
    found = []
    for n in (100, 400):
        texts = loose_group(n)
        assert components(spark, texts) == brute.jaccard(texts)
        found.append(dict(counted))
    assert found[1]["close_members"] <= 40 * 400 and found[1]["links_across"] < 400
    assert found[1]["close_members"] < 8 * max(found[0]["close_members"], 100)


def test_blocks(spark, counted, monkeypatch):
    """Blocks of a few members: all pairs of blocks are compared."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 10_000)
    texts = loose_group(120, 3)
    assert components(spark, texts) == brute.jaccard(texts)
    assert counted["close_members"]

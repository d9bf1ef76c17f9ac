"""The pipeline's stages against plain versions, one after the other."""

import pathlib

import corpus_pipeline
from ownerscope.session import checkpoint_dir

import brute


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, docs, texts, tmp_path):
    base = docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, base, "")
    assert good.columns == base.columns
    left = rows(good)
    failed = {d for d, t in texts if brute.quality(t)[5]}
    assert left and not failed & {d for d, _ in left} and set(left) <= set(texts)
    unique = stages["exact dedup"](spark, good, "")
    stays = brute.exact(left)
    left = [x for x in left if stays[x[0]][2]]
    assert rows(unique) == left
    apart = stages["n-gram Jaccard join"](spark, unique, "")
    part = brute.jaccard(left, 80, 100, 5)
    left = [x for x in left if part[x[0]][1] == x[0]]
    assert rows(apart) == left
    cut = stages["suffix-array dedup"](spark, apart, "")
    gone = brute.repeats(left)
    assert cut.columns == base.columns
    got = {r["doc_id"]: (len(r["text"].encode()), r["n_chars"], len(r["text"])) for r in cut.collect()}
    assert set(got) == set(gone)
    assert all(got[d][0] <= gone[d][0] - gone[d][1] and got[d][1] == got[d][2] for d in got)
    packed = stages["packing"](spark, cut, "")
    assert packed.groupBy("doc_id").count().count() == len(left)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_intermediate_tables_go(spark, sf):
    """Each stage deletes what the one before left, and nothing is left after the run."""
    folder = pathlib.Path(checkpoint_dir(spark).removeprefix("file://"))
    corpus_pipeline.clear(spark)
    before = set(folder.glob("llm-*"))
    corpus_pipeline.run(spark, sf)
    assert set(folder.glob("llm-*")) == before


def test_stages_at_the_edges(spark):
    """Empty table, null ids and texts, columns with the names that operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, tag int, digest string"
    prose = " ".join(f"word{i} other{i % 7}" for i in range(60))
    some = [(1, prose, "en", "s", 1, "x", 1, "y"), (None, prose + " more", "en", "s", 1, "x", 1, "y"), (3, None, "en", "s", 1, "x", 1, "y"), (4, "", None, None, None, None, None, None)]
    for rows_, least in (([], 0), (some, 1)):
        docs = spark.createDataFrame(rows_, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= least

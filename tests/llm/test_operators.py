"""Operators against plain versions on a small corpus, and their defined results at the edges."""

import collections
import math
import random

import brute
import numpy as np
import pytest

from ownerscope.llm import (
    exact_dedup, jaccard_join, language_model, licenses, packing, quality, sentencepieces, suffix_dedup, token_file, toxicity,
)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def repeated(spark, docs):
    """Two whole rows again, and a row without an id."""
    again = docs.where("doc_id < 8")
    return docs.unionByName(again).unionByName(docs.where("doc_id < 3").selectExpr("cast(null as bigint) as doc_id", "'no id at all' as text", "doc", "tag", "name"))


def test_exact_dedup(docs, texts):
    for block in (4096, 16):
        got = by_id(exact_dedup.groups(docs, block_bytes=block), "keep_id", "group_size", "kept", "text_sha256")
        assert got == brute.exact(texts)


def test_exact_dedup_edges(spark, docs, empty):
    assert exact_dedup.groups(empty).count() == 0
    got = exact_dedup.groups(repeated(spark, docs))
    assert got.count() == docs.count() + 1  # whole repeats count once; the row without an id is one more
    assert got.where("doc_id is null").first()["group_size"] == 1
    kept = exact_dedup.drop_copies(repeated(spark, docs))
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_suffix_dedup(docs, texts):
    for size, gram in ((200, 64), (60, 20), (200, 150)):
        got = by_id(suffix_dedup.remove_repeats(docs, size, gram), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.repeats(texts, size)


def test_suffix_dedup_edges(spark, docs, empty, texts):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    cut = suffix_dedup.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    sizes = brute.repeats(texts)
    for d, t in by_id(cut, "text").items():
        assert len((t or "").encode()) <= sizes[d][0] - sizes[d][1]
    doubled = by_id(suffix_dedup.remove_repeats(docs.where("length(text) > 400").unionByName(docs.where("length(text) > 400"))), "n_bytes", "n_removed")
    assert doubled and all(a == b for a, b in doubled.values())


def test_suffix_runs_over_bucket_ends(spark, texts):
    """Many buckets, so that anchors and strings have to be compared across them."""
    many = [(d * 7 + k, (t or "") + " " + str(k) * 30) for d, t in texts for k in range(2)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = by_id(suffix_dedup.remove_repeats(df), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute.repeats(many)


def test_jaccard_join(docs, texts):
    for k, num, den in ((4, 85, 100), (5, 80, 100), (1, 50, 100)):
        got = by_id(jaccard_join.join(docs, k, num, den), "n_shingles", "component_id")
        assert got == brute.jaccard(texts, num, den, k)


def test_jaccard_edges(spark, docs, empty):
    assert jaccard_join.join(empty).count() == 0
    got = jaccard_join.join(repeated(spark, docs))
    assert got.count() == repeated(spark, docs).count()
    assert got.where("doc_id is null").first()["component_id"] is None
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    base = " ".join(f"w{i}" for i in range(60))
    same_id = [(5, "q r s t u v w x"), (5, base), (3, base + " end"), (2, "q r s t u v w x y"), (9, None)]
    parts = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.join(
        spark.createDataFrame(same_id, "doc_id long, text string"), 4, 80, 100).collect()}
    assert parts == {(5, 5): 2, (5, 57): 2, (3, 58): 2, (2, 6): 2, (9, 0): 9}


def test_components_of_a_loose_group(spark):
    """Copies with several changes each: some pairs of a bucket link and some don't."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
        texts.append((i, " ".join(w)))
    got = by_id(jaccard_join.join(spark.createDataFrame(texts, "doc_id long, text string"), 4, 85, 100), "n_shingles", "component_id")
    assert got == brute.jaccard(texts)


@pytest.mark.parametrize("num", [50, 80, 85, 95])
def test_sketches_meet(num):
    """Every pair of similar sets shares a bucket, whatever its sizes."""
    rng = np.random.default_rng(num)
    for n in [*range(1, 40), 100, 333, 2000]:
        a = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        for extra in {0, 1, int(n * (100 - num) / num), int(n * (100 - num) / (100 + num))}:
            gone = max(0, min(n - 1, int((n * (100 - num) - extra * num) / 100)))  # as different as the bound allows
            b = np.concatenate([a[gone:], rng.integers(0, 2 ** 63, extra).astype(np.uint64)])
            shared, union = n - gone, n + extra
            if 100 * shared < num * union or (gone == 0 and extra == 0):
                continue
            owner, key = jaccard_join.sketch_keys([np.unique(a), np.unique(b)], num, 100)
            assert set(key[owner == 0]) & set(key[owner == 1]), (n, gone, extra)


def test_components_of_a_chain(spark):
    rng = random.Random(1)
    nodes = list(range(60))
    rng.shuffle(nodes)
    links = spark.createDataFrame(list(zip(nodes, nodes[1:])) + [(100, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard_join.components(links).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 200: 100}


def test_quality_base(docs, texts):
    got = by_id(quality.judge(docs).withColumnRenamed("doc", "doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: brute.quality(t) for d, t in texts}


def test_quality_verdicts(spark, sf, docs, empty):
    """On labelled rows nothing good is rejected beyond the base rules, and most of the rest is."""
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = judged.join(labels, judged["doc"] == labels["doc_id"])
    found = collections.Counter((r["quality"], r["base_failed"], r["kept"]) for r in rows.collect())
    assert found[(1, False, False)] <= 0.02 * max(1, found[(1, False, True)])
    assert found[(0, False, True)] + found[(1, False, False)] <= 2
    assert quality.judge(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns


def test_licenses(docs, empty, texts):
    got = by_id(licenses.scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {d: brute.licenses(t) for d, t in texts}
    assert licenses.scan(empty).count() == 0


def test_license_notices(spark):
    notice = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License as published by the Free Software Foundation")
    rows = [(1, "x " * 50 + notice), (2, notice.replace("modify", "change")), (3, "free software is good; all rights are reserved"),
            (4, "under the mit license under the MIT-license"), (5, None)]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), "n_base", "labels", "score")
    assert got[1] == (0, "gpl", 1.0)
    assert got[2][1] == "gpl" and 0.9 < got[2][2] < 1
    assert got[3] == (0, "", 0.0) and got[5] == (0, "", 0.0)
    assert got[4] == (2, "mit", 1.0)


def test_token_file(spark, docs, empty, texts):
    folder = token_file.new_folder(spark)
    token_file.write_file(docs, folder)
    got = by_id(token_file.read_file(spark, folder, with_ids=True), "start", "n_tokens", "ids_crc32", "ids")
    ordered = sorted(texts)
    at, expected = 0, {}
    for (d, _), ids in zip(ordered, brute.tokens([t for _, t in ordered])):
        expected[d] = (at, len(ids), brute.id_crc(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert got == expected
    folder = token_file.new_folder(spark)
    token_file.write_file(empty, folder)
    assert token_file.read_file(spark, folder).count() == 0


def test_token_blocks():
    rng = np.random.default_rng(0)
    for top in (1, 2, 100, 49408, 2 ** 32):
        docs = [rng.integers(0, top, rng.integers(0, 3000)).astype(np.uint32) for _ in range(20)]
        raw = token_file.write_block(docs)
        assert all(np.array_equal(a, b) for a, b in zip(docs, token_file.read_block(raw)))
        ids = np.concatenate(docs)
        assert np.array_equal(token_file.read_group(raw, 2), ids[2048:3072])
    assert token_file.read_block(token_file.write_block([])) == []


def test_packing(docs, empty, texts):
    ids = dict(zip([d for d, _ in texts], brute.tokens([t for _, t in texts])))
    for longest in (2048, 64):
        rows = packing.pack(docs, longest, with_ids=True).collect()
        assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
        held = collections.defaultdict(dict)
        for r in rows:
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= longest and r["offset"] == 0
            piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert r["ids"] == np.array(piece, "<u4").tobytes() and r["ids_crc32"] == brute.id_crc(piece)
            held[r["doc_id"]][r["start"]] = r["length"]
        for d, x in ids.items():
            at = 0
            while at < len(x):
                at += held[d][at]
            assert at == len(x)
    assert packing.pack(empty).count() == 0


def test_language_model(docs, empty, texts, monkeypatch):
    whole = by_id(language_model.score(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    expected = brute.language(texts)
    for d, row in whole.items():
        assert row[:4] == expected[d][:4]
        assert math.isclose(row[4], expected[d][4], rel_tol=1e-9)
    plain = automaton(texts)
    for d, row in whole.items():
        assert math.isclose(row[5], plain[d], rel_tol=1e-9, abs_tol=1e-9)
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(language_model, "SHARD_KEYS", 200)
    cut = by_id(language_model.score(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert all(np.allclose(cut[d][4:], whole[d][4:]) and cut[d][:4] == whole[d][:4] for d in whole)
    assert language_model.score(empty).count() == 0


def automaton(texts):
    """The model's scores by dictionaries."""
    toks = {d: [*brute.re.findall(brute.SPACE, (t or "").translate(brute.FOLD)), None] for d, t in texts}
    train = [ts for d, ts in toks.items() if brute.crc(d, 10)]
    c = collections.Counter(x for ts in train for x in ts)
    n, v = sum(c.values()), len(c)
    n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    disc = n1 / (n1 + 2 * n2)
    least = max(1, math.ceil(n / language_model.STATE_SHARE))
    states = {w for w, x in c.items() if x >= least}
    arcs = collections.Counter((a, b) for ts in train for a, b in zip([None, *ts], ts) if a in states and b in states)
    mass = collections.Counter()
    for (a, _), x in arcs.items():
        mass[a] += x - language_model.DISCOUNT
    out = {}
    for d, ts in toks.items():
        total = 0.0
        for a, b in zip([None, *ts], ts):
            root = (c[b] - disc) / n if c[b] else disc * v / n
            if a in states:
                direct = (arcs[a, b] - language_model.DISCOUNT) / c[a] if b in states and arcs[a, b] else 0
                total += math.log10(direct + (1 - mass[a] / c[a]) * root)
            else:
                total += math.log10(root)
        out[d] = total
    return out


def test_language_model_rare_words(spark, monkeypatch):
    """In a text of many tokens, bigrams of rare words count as those of frequent words do."""
    rng = random.Random(5)
    texts = [(d, " ".join(f"w{int(rng.paretovariate(.6)) % 4000}" for _ in range(300)) + f" rare{d % 40} pair{d % 40}") for d in range(120)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(language_model, "SHARD_KEYS", 3_000)
    got, plain = by_id(language_model.score(rows), "score"), bigrams(texts)
    assert sum(len(t.split()) + 1 for d, t in texts if brute.crc(d, 10)) > 30_000
    assert all(math.isclose(got[d], plain[d], rel_tol=1e-9) for d, _ in texts)


def bigrams(texts):
    """Scores by a dictionary of all training bigrams."""
    toks = {d: [*t.split(), None] for d, t in texts}
    train = [ts for d, ts in toks.items() if brute.crc(d, 10)]
    c = collections.Counter(x for ts in train for x in ts)
    arcs = collections.Counter(p for ts in train for p in zip([None, *ts], ts))
    follow = collections.Counter(a for a, _ in arcs)
    n, v, once, twice = sum(c.values()), len(c), *(sum(x == k for x in c.values()) for k in (1, 2))
    disc = once / (once + 2 * twice)

    def weight(a, b):
        root = (c[b] - disc) / n if c[b] else disc * v / n
        own = (arcs[a, b] - language_model.DISCOUNT) / c[a] if arcs[a, b] else 0
        return own + language_model.DISCOUNT * follow[a] / c[a] * root if c[a] else root

    return {d: sum(math.log10(weight(a, b)) for a, b in zip([None, *ts], ts)) for d, ts in toks.items()}


def test_language_model_without_training(spark):
    alone = next(d for d in range(100) if brute.crc(d, 10) == 0)
    rows = spark.createDataFrame([(alone, "a b")], "doc_id long, text string")
    r = language_model.score(rows).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_sentencepiece(docs, empty, texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentencepieces.encode(docs)
    got = by_id(encoded, "ids")
    assert all(np.frombuffer(got[d], "<u4").tolist() == sp.encode(t or "") for d, t in texts)
    back = by_id(sentencepieces.decode(encoded), "text")
    assert all(back[d] == (t or "") for d, t in texts)
    assert sentencepieces.encode(empty).count() == 0


def test_sentencepiece_window():
    """Ids are given out before the text ends, and the window stays short."""
    model = sentencepieces.pieces(sentencepieces.default_path())
    rng = random.Random(2)
    text = sentencepieces.MARK + "".join(rng.choice("abcdefghijklmnop") for _ in range(3000))
    seen, given = [0], []

    def symbols():
        for k, s in enumerate(text):
            seen[0] = k
            yield s

    for i in model.stream(symbols()):
        given.append((i, seen[0]))
    assert [i for i, _ in given] == model.model.encode(text[1:])
    assert given[0][1] < 200


def test_toxicity(spark, sf, docs, empty):
    rng = random.Random(5)
    lexicon = ["".join(rng.choice(["an", "er", "ou", "sh", "in"]) for _ in range(3)) for _ in range(80)]
    bad = ["idiot", "scumbag", "worthless"]
    made = []
    for i in range(400):
        w = [rng.choice(lexicon) for _ in range(rng.choice([10, 40, 150]))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        made.append((i, " ".join(w), int(i % 4 == 0)))
    model = toxicity.train([t for i, t, _ in made if i % 5], [y for i, _, y in made if i % 5])
    own = toxicity.Scorer(model)
    right = sum((own.score(t) >= 0.5) == y for i, t, y in made if i % 5 == 0)
    assert right >= 76
    around = lambda w: own.score(" ".join(lexicon[:30]) + f" {w} " + " ".join(lexicon[30:60]))
    assert around("scumbagg") >= 0.5 and around("worthles") >= 0.5  # unseen spellings
    assert around("idiiot") > 10 * around(lexicon[70])
    assert 0 <= own.score("") == own.score(None) < 0.5
    frame = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made] + [(None, 1), (9999, 0)], "doc_id long, toxic int")
    fitted = toxicity.fit(frame, labels, most=150)
    assert toxicity.scores(frame, fitted).count() == 400
    assert toxicity.scores(docs, fitted).count() == docs.count() and toxicity.scores(empty, fitted).count() == 0
    nothing = toxicity.fit(frame, labels.limit(0))
    assert max(by_id(toxicity.scores(docs, nothing), "score").values()) < 1e-9


def test_toxicity_long_runs():
    """Every n-gram of a run without spaces is in a piece, and what is said late in it reaches the score."""
    rng = random.Random(6)
    run = bytes(rng.randrange(97, 123) for _ in range(1003))
    assert toxicity.words_of("a" * 64) == [b"a" * 64]
    for k in range(60, 130):
        grams = {p[i:i + 5] for p in toxicity.words_of(run[:k].decode()) for i in range(len(p) - 4)}
        assert grams == {run[i:i + 5] for i in range(k - 4)}
    signs = [chr(0x4E00 + k) for k in range(200)]
    bad = "".join(chr(0x7000 + k) for k in range(6))

    def sentence(toxic):
        s = "".join(rng.choice(signs) for _ in range(150))
        return s[:90] + bad + s[90:] if toxic else s

    labels = [int(k % 4 == 0) for k in range(240)]
    own = toxicity.Scorer(toxicity.train([sentence(y) for y in labels], labels))
    assert sum((own.score(sentence(y)) >= 0.5) == y for y in labels[:60]) >= 57

"""SimHash, importance resampling and the Merkle manifest against plain versions, and their defined results at the edges."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ownerscope.llm import manifest, resampling, simhash


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_simhash(docs, texts):
    for errors, words, capacity in ((2, 3, 4), (5, 1, 2048), (0, 3, 16)):
        got = by_id(simhash.near_copies(docs, errors, words, capacity), "fingerprint", "component_id")
        assert got == brute.simhash(texts, errors, words), (errors, words, capacity)


def test_simhash_edges(spark, docs, empty):
    assert simhash.near_copies(empty).count() == 0
    rows = [(5, None, 1), (None, "", 2), (3, " \t", 3), (None, "alone here", 4), (9, "A b", 5), (9, "a B", 6), (9, "a B", 6), (4, "word " * 300_000, 7)]
    got = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"] or 0) for r in simhash.near_copies(
        spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect())
    one, long_ = f"{simhash.fingerprint('a b'):016x}", f"{simhash.fingerprint('word word word'):016x}"
    assert got == sorted([(5, "0" * 16, 3), (0, "0" * 16, 3), (3, "0" * 16, 3), (0, f"{simhash.fingerprint('alone here'):016x}", 0),
                          *[(9, one, 9)] * 3, (4, long_, 4)])


@pytest.mark.parametrize("errors", [1, 2, 3, 6])
def test_trie_walk_finds_all_close_pairs(errors):
    """Random leaves with groups of near ones; each pair within the budgets, and nothing else."""
    rng = np.random.default_rng(errors)
    base = rng.integers(0, 2 ** 64, 40, dtype=np.uint64)
    near = base.repeat(8)
    for _ in range(errors):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64))
    a = np.unique(np.concatenate([base, near, rng.integers(0, 2 ** 64, 300, dtype=np.uint64)]))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= errors}
    swapped = np.sort(simhash._swapped(a))
    place = {int(x): k for k, x in enumerate(a)}
    got = set()
    for trie, leaves in enumerate([a, swapped][:len(simhash.half_budgets(errors))]):
        i, j = simhash.close_leaves(leaves, None, 0, 0, simhash.half_budgets(errors)[trie], errors)
        ids = [place[int(x)] for x in (simhash._swapped(leaves) if trie else leaves)]
        got |= {tuple(sorted((ids[x], ids[y]))) for x, y in zip(i.tolist(), j.tolist())}
    assert got == want
    top = a < np.uint64(1 << 63)  # two nodes below the root's children
    i, j = simhash.close_leaves(a[top], a[~top], 1, 1, errors, errors)
    n = int(top.sum())
    assert set(zip(i.tolist(), (j + n).tolist())) == {(x, y) for x, y in want if x < n <= y}


def test_simhash_rows_of_a_large_group(spark):
    """2,000 fingerprints that are all close to others: the links are a forest per node pair, not all pairs."""
    rng = random.Random(1)
    numbers = sorted({0xABCDEF0123456789 ^ sum(1 << b for b in rng.sample(range(14), rng.randint(0, 4))) ^ rng.choice([0, 0, 0, 1 << 50]) for _ in range(4000)})
    fps = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in numbers], "fp long")
    found = simhash.links(fps, 2, 64)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    assert len(pairs) < 20 * len(numbers)
    want = brute.linked_numbers(numbers, 2)
    up = {x: x for x in numbers}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a % 2 ** 64), find(b % 2 ** 64)
        up[max(a, b)] = min(a, b)
    assert {x: find(x) for x in numbers} == want


def test_resampling(spark, docs, texts):
    goals = [(1, texts[3][1]), (2, None), (3, "One 2 three. four-five"), (4, texts[20][1])]
    targets = spark.createDataFrame(goals, "item_id long, text string")
    for longest, buckets in ((2, 10_000), (3, 50), (1, 7)):
        got = by_id(resampling.resample(docs, targets, longest=longest, buckets=buckets), "n_features", "weight", "score", "rank")
        assert got == brute.resampling(texts, [t for _, t in goals], buckets, longest)


def test_resampling_edges(spark, docs, empty):
    targets = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(empty, targets).count() == 0
    few = docs.where("doc_id < 30")
    plain = brute.resampling([(r["doc_id"], r["text"]) for r in few.collect()], [])
    assert by_id(resampling.resample(few, targets.limit(0)), "n_features", "weight", "score", "rank") == plain
    long_ = "äb c " * 400_000  # one text of over two megabytes
    rows = [(None, "x " * 30, 1)] * 2 + [(7, long_, 2)] * 6
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string, weight int"), targets).collect()
    assert len(got) == 8 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert {(r["doc_id"], r["n_features"]) for r in got} == {(None, 59), (7, 1_599_999)}


def test_resampling_ties_go_to_smaller_ids(spark):
    rows = spark.createDataFrame([(k, 5) for k in range(100)], "doc long, score long").repartition(7)
    got = {r["doc"]: r["rank"] for r in resampling.ranked(rows, [F.desc("score"), "doc"], 25).collect()}
    assert got == {k: k + 1 if k < 25 else None for k in range(100)}


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, g int, node string"


def key(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("levels", [7, 2, 1])
def test_manifest(spark, texts, levels):
    """Superblocks of 2,187, 9 and 3 nodes, so that trees of up to five superblock levels are met."""
    rng = random.Random(levels)
    rows = [(d, rng.choice([None, "", "src0", "src0", "src0", "s", "ß", "z" * 9]), rng.choice(["en", None]), len(t or ""), t) for d, t in texts]
    rows += [(10_000 + k, f"only{k}", "de", None, "a\nb") for k in range(30)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], FIELDS).repartition(6)
    got = [tuple(r) for r in manifest.manifest(df, manifest.without_line_ends(df), levels=levels).collect()]
    assert key(got) == key(brute.manifest(rows))
    assert {v for *_, v in got} == {True, False}
    assert all(r["verified"] for r in manifest.manifest(df).collect())


def test_manifest_edges(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert manifest.manifest(empty).count() == 0
    alone = [(4, None, None, None, None)]
    same = [(None, "a", "x", 1, "t\n"), (None, "a", "x", 1, "t\n"), (2, "a", "x", 1, "t\n"), (2, "a", "x", 1, "t\n"), (2, "a", "x", 1, "u\n")]
    for rows in (alone, same, [(1, "s", "", 0, "line\n" * 400_000)]):
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], FIELDS)
        got = [tuple(r) for r in manifest.manifest(df, manifest.without_line_ends(df)).collect()]
        assert key(got) == key(brute.manifest(rows))

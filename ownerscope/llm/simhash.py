"""SimHash near-dedup by a self-join of binary tries.

A fingerprint has one bit per bit position of the shingles' hashes: 1 if over half the shingles (repeats included) have it
set. Equal fingerprints form a class. Classes whose fingerprints differ in at most ``errors`` bits are found by walking pairs of
trie nodes together from the root: a pair carries the bits in which its two prefixes differ and ends where they exceed the
budget. If two fingerprints differ in at most e bits, their upper halves differ in at most e // 2, or their lower halves in at most
e - e // 2 - 1. So the walk goes over two tries, one of them with the halves swapped, and each has the smaller budget in its
first 32 levels, where all the nodes are: at two errors a node has 1 + depth partners and not their square.

Across tasks the walk takes eight levels a round: children of open nodes are counted, and the pairs of children come from an
equi-join on the child that a mask of differing bits leads to. A node with at most ``capacity`` fingerprints is closed: it is one packed
row, and its pairs are walked to the leaves inside a task. An open node paired with a closed one is cut into packed rows of that size
too, so no row or task holds more, whatever prefix a group of near copies shares. A task sends on a forest of its links and
not the links themselves, so a group never makes more rows than it has fingerprints times its nodes' partners.

Defined results: null and empty texts and texts without words have fingerprint 0 and are linked like others. Texts with fewer
words than a shingle have one shingle. Rows with the same id are linked through their own fingerprints only. A null id is never a
component's name: a component of null ids has a null name. An empty table gives no rows; repeated rows give equal rows. Only the
id and text columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ownerscope.llm.common import materialize, slices
from ownerscope.llm.jaccard_join import components

SEED, WORDS, ERRORS = 42, 3, 2
STRIDE, HALF, BITS = 8, 32, 64
CAPACITY = 2048
DIRECT = 32  # node pairs with so few leaf pairs are compared leaf by leaf
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return 0
    joined = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    size = min(words, len(raw))
    starts, ends = starts[:len(raw) - size + 1].tolist(), ends[size - 1:].tolist()
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, len(starts), 1 << 16):
        pieces = [joined[a:b] for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    held = (counts @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * held > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc and fp (the fingerprint's 64 bits as a long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, fp long")


def close_leaves(a: np.ndarray, b: np.ndarray | None, depth: int, differ: int, half: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of two nodes' sorted leaves (without ``b``: of one node's) within the budgets.

    The nodes stand at ``depth`` and differ in ``differ`` bits so far; at most ``half`` in the first 32 levels.
    """
    self_join = b is None
    b = a if self_join else b
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pairs = np.array([[0, len(a), 0, len(b), differ]], np.int64)
    for t in range(depth, BITS + 1):
        budget = half if t < HALF else errors
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= DIRECT) if t < BITS else np.ones(len(pairs), bool)
        done, pairs = pairs[small], pairs[~small]
        if len(done):  # all leaf pairs of these node pairs
            na, nb = done[:, 1] - done[:, 0], done[:, 3] - done[:, 2]
            owner = np.repeat(np.arange(len(done)), na * nb)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            i, j = done[owner, 0] + k // nb[owner], done[owner, 2] + k % nb[owner]
            x = a[i] ^ b[j]
            ok = (np.bitwise_count(x) <= errors) & (np.bitwise_count(x >> np.uint64(HALF)) <= half)
            if self_join:
                ok &= i < j
            found.append((i[ok], j[ok]))
        if not len(pairs):
            break
        bit, keep = np.uint64(1 << (BITS - 1 - t)), np.uint64((1 << BITS) - (1 << (BITS - t)))
        low_a, high_a, low_b, high_b, d = pairs.T
        mid_a = np.searchsorted(a, (a[low_a] & keep) | bit)
        mid_b = np.searchsorted(b, (b[low_b] & keep) | bit)
        same = self_join & (low_a == low_b) & (high_a == high_b)
        children = [np.stack(c, 1) for c in (
            (low_a, mid_a, low_b, mid_b, d), (mid_a, high_a, mid_b, high_b, d), (low_a, mid_a, mid_b, high_b, d + 1))]
        crossed = np.stack((mid_a, high_a, low_b, mid_b, d + 1), 1)[~same]  # of a node with itself, one of the two is enough
        pairs = np.concatenate([*children, crossed])
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes, the smallest node that the links (i, j) lead to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        after = label.copy()
        for side in (i, j):
            np.minimum.at(after, side, least)
            np.minimum.at(after, label[side], least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _swapped(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(HALF)) | (x >> np.uint64(HALF))


def walked(pairs: DataFrame, errors: int) -> DataFrame:
    """Links (a, b) of fingerprints, a forest for each pair of packed nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            columns = [batch.column(c).to_pylist() for c in ("trie", "level", "same", "differ")]
            for k, (trie, level, same, differ) in enumerate(zip(*columns)):
                a = np.sort(batch.column("fa")[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                b = None if same else np.sort(batch.column("fb")[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                i, j = close_leaves(a, b, level * STRIDE, differ, half_budgets(errors)[trie], errors)
                every = a if same else np.concatenate([a, b])
                label = forest(len(every), i, j if same else j + len(a))
                moved = np.flatnonzero(label != np.arange(len(every)))
                every = _swapped(every) if trie else every
                left.append(every[moved])
                right.append(every[label[moved]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def half_budgets(errors: int) -> list[int]:
    """Of each trie, the bits that may differ in its first half."""
    return [errors // 2] + ([errors - errors // 2 - 1] if errors else [])


def _masks(most: int) -> list[int]:
    return [m for m in range(1 << STRIDE) if bin(m).count("1") <= most]


def links(fps: DataFrame, errors: int = ERRORS, capacity: int = CAPACITY) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fp`` to the components of differences of at most ``errors`` bits."""
    spark = fps.sparkSession
    halves = half_budgets(errors)
    swapped = F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))
    turned = [F.struct(F.lit(k).alias("trie"), (swapped if k else F.col("fp")).alias("r")) for k in range(len(halves))]
    leaves = fps.select(F.explode(F.array(*turned)).alias("x")).select("x.trie", "x.r", F.lit(0).cast("long").alias("p"))
    frontier = spark.createDataFrame([(k, 0, 0, 0) for k in range(len(halves))], "trie int, a long, b long, differ int")
    closed_pairs, blocks = None, None
    for level in range(1, BITS // STRIDE + 1):
        children = leaves.select("trie", "r", F.shiftrightunsigned("r", BITS - STRIDE * level).alias("p"))
        nodes = materialize(children.groupBy("trie", "p").agg(F.count("*").alias("n")))
        # pairs of children: the left child, and each mask of differing bits that the budget still allows
        left = nodes.select("trie", F.shiftrightunsigned("p", STRIDE).alias("a"), F.col("p").alias("ca"), F.col("n").alias("na"))
        budget = F.lit(errors) if STRIDE * level > HALF else F.element_at(F.array(*[F.lit(h) for h in halves]), F.col("trie") + 1)
        masks = F.element_at(F.array(*[F.array(*[F.lit(m) for m in _masks(k)]) for k in range(min(errors, STRIDE) + 1)]),
                             F.least(budget - F.col("differ"), F.lit(STRIDE)) + 1)
        met = frontier.join(left, ["trie", "a"]).select("trie", "a", "b", "differ", "ca", "na", F.explode(masks).alias("m"))
        met = met.withColumn("cb", F.shiftleft("b", STRIDE).bitwiseOR(F.col("ca").bitwiseAND(255).bitwiseXOR(F.col("m").cast("long"))))
        met = met.where("a <> b or ca <= cb").join(nodes.select("trie", F.col("p").alias("cb"), F.col("n").alias("nb")), ["trie", "cb"])
        met = materialize(met.select("trie", F.lit(level).alias("level"), F.col("ca").alias("a"), F.col("cb").alias("b"),
                                     (F.col("differ") + F.bit_count(F.col("m"))).cast("int").alias("differ"), "na", "nb"))
        closed = met.where((F.col("na") <= capacity) | (F.col("nb") <= capacity)).drop("na", "nb")
        frontier = met.where((F.col("na") > capacity) & (F.col("nb") > capacity)).select("trie", "a", "b", "differ")
        wanted = closed.select("trie", F.col("a").alias("p")).unionByName(closed.select("trie", F.col("b").alias("p"))).distinct()
        own = children.join(nodes.join(wanted, ["trie", "p"], "left_semi"), ["trie", "p"])
        packed = own.groupBy("trie", "p", F.pmod(F.xxhash64("r"), F.ceil(F.col("n") / capacity)).alias("block")).agg(
            F.collect_list("r").alias("f")).select("trie", F.lit(level).alias("level"), "p", "block", "f")
        closed_pairs = closed if closed_pairs is None else closed_pairs.unionByName(closed)
        blocks = packed if blocks is None else blocks.unionByName(packed)
        if frontier.isEmpty():
            break
        leaves = children.join(nodes.where(F.col("n") > capacity), ["trie", "p"], "left_semi").select("trie", "r", "p")
    blocks = materialize(blocks)
    side = lambda c: blocks.select("trie", "level", F.col("p").alias(c), F.col("block").alias(f"block_{c}"), F.col("f").alias(f"f{c}"))
    both = closed_pairs.join(side("a"), ["trie", "level", "a"]).join(side("b"), ["trie", "level", "b"])
    return walked(both.select("trie", "level", (F.col("a") == F.col("b")).alias("same"), "differ", "fa", "fb"), errors)


def near_copies(docs: DataFrame, errors: int = ERRORS, words: int = WORDS, capacity: int = CAPACITY, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), component_id."""
    every = materialize(fingerprints(docs, id_col, text_col, words))
    classes = materialize(every.groupBy("fp").agg(F.min("doc").alias("first")))
    parts = components(links(classes.select("fp"), errors, capacity)).withColumnRenamed("node", "fp")
    of = classes.join(parts, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    of = materialize(of)
    names = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.select("fp", "component").join(names, "component").select("fp", "component_id")
    return every.join(named, "fp").select(
        F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Documents with equal sets form a class, and classes are joined. For each
size band, a class's shingles are dealt by hash to B blocks and each block's codes are XORed to one word: the sketch.
Each differing shingle changes one block, so the number of differing blocks is at most the size of the symmetric
difference. A similarity threshold bounds that difference by d for the sizes of a band, so of B = d + 1 + e blocks at least
1 + e are equal (pigeonhole), and one of these is not empty unless both sides have more than e empty blocks; such documents are
sketched again with another seed until they have not. What still has after ``SEEDS`` of them (at low thresholds, where differences
are nearly as large as sets) meets on its least shingle hashes instead, the prefix filter. Hence every link meets in a bucket.

A second, dense sketch gives each class one bit per hash value, the parity of its shingles there; the Hamming distance of
two is at most the symmetric difference too and rules out most pairs before their sets are looked at.

In a bucket each class is compared with the smallest one, its lead; pairs whose dense sketches are close enough are verified on the
whole sets, and links are joined to components. Only leads whose members then lie in more than one component are gone through again:
tasks compare the dense sketches of members across components and name the members that are close to another one. For
these, the difference between their set and their lead's is gathered; two such differences give the difference of any two members,
so a task verifies the close pairs exactly where it finds them and sends on links between components only. A pair is never a row:
rows follow the members, groups of mutually similar documents cost a star and not all pairs, and a large group is cut into blocks whose pairs
are compared in separate tasks. A batch of documents sends one row per bucket to the shuffle, and the others as pairs, so that a bucket that a
third of the documents share arrives pre-aggregated.

Defined results: null and empty texts and texts without words have an empty set, are linked with nothing and are their own
component. Rows with the same id count as linked. Rows with a null id have no component. An empty table gives no rows.
Ids are integers. Only the id and text columns are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ownerscope.llm.common import M64, materialize, mix64, slices
from ownerscope.llm.shingles import shingle_set, word_hashes, words_of

SEEDS = 64
BLOCK = 32 << 20  # bytes of a lead's members that a task compares with as many others
MOST_BITS = 14  # of a dense sketch, as a power of two: beyond it the sketch only rules out fewer pairs


@lru_cache(maxsize=None)
def bands(num: int, den: int, most: int) -> tuple[list[int], list[int], list[int]]:
    """Smallest sizes of the bands up to size ``most``; of each band joined with the next: largest size and difference bound."""
    lows, reach, bounds = [1], [], []
    while True:
        top = lows[-1] * den // num
        far = top * den // num
        s = top + far
        # of sets of a and b elements at least ceil(num (a + b) / (num + den)) are shared
        bounds.append(max(x - 2 * -(-num * x // (num + den)) for x in range(max(2, s - 4 * (num + den)), s + 1)))
        reach.append(far)
        if lows[-1] > most:
            return lows, reach, bounds
        lows.append(top + 1)


def blocks_for(bound: int) -> tuple[int, int]:
    """Blocks of a sketch and how many of them may be empty."""
    spare = 1 + bound // 16
    return bound + 1 + spare, spare


def sketch_keys(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``sets``, bucket key) of every block of every sketch that is not empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    lows, reach, bounds = bands(num, den, 1 << max(4, int(sizes.max(initial=1)).bit_length()))
    band = np.searchsorted(np.array(lows), sizes, side="right") - 1
    owners, keys = [], []
    jobs = []  # (set, band)
    for i, (n, k) in enumerate(zip(sizes.tolist(), band.tolist())):
        if n:
            if bounds[k] > 0:
                jobs.append((i, k))
            if k and bounds[k - 1] > 0 and n <= reach[k - 1]:
                jobs.append((i, k - 1))
    for seed in range(SEEDS):
        if not jobs:
            break
        again = []
        for at in range(0, len(jobs), 512):
            part = jobs[at:at + 512]
            counts = np.array([blocks_for(bounds[k])[0] for _, k in part], np.int64)
            spare = np.array([blocks_for(bounds[k])[1] for _, k in part], np.int64)
            lengths = sizes[[i for i, _ in part]]
            job = np.repeat(np.arange(len(part)), lengths)
            h = np.concatenate([sets[i] for i, _ in part])
            dealt = mix64(h + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & M64)) >> np.uint64(32)
            block = ((dealt * counts[job].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            slot = first[job] + block
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            word = np.bitwise_xor.reduceat(mix64(h ^ np.uint64(0xD6E8FEB86659FD93))[order], starts)
            held = slot[starts]
            owner = np.searchsorted(first, held, side="right") - 1
            place = (held - first[owner]).astype(np.uint64)
            tag = np.array([k for _, k in part], np.uint64)[owner] * np.uint64(1 << 20) + np.uint64(seed)
            keys.append(mix64(word ^ mix64(tag * np.uint64(1 << 24) + place)))
            owners.append(np.array([i for i, _ in part], np.int64)[owner])
            empty = counts - np.bincount(owner, minlength=len(part))
            again += [part[j] for j in np.flatnonzero(empty > spare)]
        jobs = again
    for i, _ in jobs:  # sketches cannot tell these apart: two of them meet on one of the least hashes that similar sets share
        least = sets[i][:sizes[i] - -(-num * sizes[i] // den) + 1]
        keys.append(mix64(least ^ np.uint64(0xA0761D6478BD642F)))
        owners.append(np.full(len(least), i, np.int64))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


def _sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    return [shingle_set(word_hashes(words_of(t)), k) for t in texts]


def dense_sketch(s: np.ndarray) -> bytes:
    """Parities of the set by hash value, about two bits per shingle; the number of bits is a power of two."""
    bits = 1 << min(MOST_BITS, max(6, (2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches at the size of the shortest: the upper half is XORed onto the lower one, which keeps parities."""
    size = min(map(len, sketches))
    out = np.empty((len(sketches), size // 8), np.uint64)
    for i, raw in enumerate(sketches):
        words = np.frombuffer(raw, np.uint64)
        while len(words) > size // 8:
            half = len(words) // 2
            words = words[:half] ^ words[half:]
        out[i] = words
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def classes(docs: DataFrame, k: int) -> DataFrame:
    """doc, n_shingles, digest and dense sketch of the shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = _sets(batch.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.array([dense_sketch(s) for s in sets], pa.binary())],
                names=["doc", "n", "digest", "sketch"])

    return docs.mapInArrow(run, "doc long, n long, digest binary, sketch binary")


def _differ_at_most(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest symmetric difference of linked sets with ``n`` elements in all."""
    return n - 2 * -(-num * n // (num + den))


def close_pairs(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and dense sketches allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sa"):
            ok = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))):
                two = folded([x, y])
                ok.append(int(np.bitwise_count(two[0] ^ two[1]).sum()) <= na + nb - 2 * -(-num * (na + nb) // (num + den)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    fits = (den * F.col("na") >= num * F.col("nb")) & (den * F.col("nb") >= num * F.col("na"))
    return pairs.where(fits).mapInArrow(run, "a binary, b binary")


def outsiders_first(component: np.ndarray) -> tuple[np.ndarray, int]:
    """An order of the members in which those of the largest component are last, and the number of the others."""
    names, kind, counts = np.unique(component, return_inverse=True, return_counts=True)
    largest = kind == counts.argmax()
    return np.argsort(largest, kind="stable"), int((~largest).sum())


class Group:
    """Members of one lead (or of two of its blocks), to be compared across components."""

    def __init__(self, members: list[bytes], n: list[int], component: list[int], sketch: list[bytes], side: list[int], both: bool):
        component_ = np.array(component, np.int64)
        order, self.outsiders = outsiders_first(component_)
        self.members = [members[k] for k in order.tolist()]
        self.order, self.n, self.component = order, np.array(n, np.int64)[order], component_[order]
        self.words = folded([sketch[k] for k in order.tolist()])
        self.side, self.both = np.array(side, np.int64)[order], both

    def close(self, i: int, num: int, den: int) -> np.ndarray:
        """Members after the i-th, of other components, whose sizes and sketches allow a link with it."""
        j = np.arange(i + 1, len(self.n))
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        keep = (self.component[j] != self.component[i]) & (den * low >= num * high)
        if not self.both:  # members of one block meet elsewhere
            keep &= self.side[j] != self.side[i]
        j = j[keep]
        found = []
        for at in range(0, len(j), 4096):
            part = j[at:at + 4096]
            far = np.bitwise_count(self.words[part] ^ self.words[i]).sum(1, dtype=np.int64)
            found.append(part[far <= _differ_at_most(self.n[part] + self.n[i], num, den)])
        return np.concatenate(found) if found else j


def grouped(members: DataFrame, columns: list[str]) -> DataFrame:
    """Members of split leads with the pairs of blocks (p, q) that they are compared in, those of a pair together and in order."""
    held = sum((F.length(c) for c in ("sketch", "far") if c in columns), F.lit(200))
    sizes = members.groupBy("lead").agg(F.sum(held).alias("_bytes"))
    cut = members.join(sizes, "lead").withColumn("_blocks", F.ceil(F.col("_bytes") / BLOCK).cast("int")).withColumn(
        "side", F.pmod(F.xxhash64("member"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    cut = cut.select("lead", "side", other.alias("_q"), *columns)
    cut = cut.select("lead", F.least("side", "_q").alias("p"), F.greatest("side", "_q").alias("q"), "side", *columns)
    return cut.repartition("lead", "p", "q").sortWithinPartitions("lead", "p", "q", "member")


def _by_group(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bytes, bool, dict[str, list]]]:
    """(lead, whether the group is one block, its columns), one group after the other."""
    now, held = None, {c: [] for c in columns}
    for batch in batches:
        for lead, p, q, *row in zip(*(batch.column(c).to_pylist() for c in ("lead", "p", "q", *columns))):
            if (lead, p, q) != now:
                if now is not None:
                    yield now[0], now[1] == now[2], held
                now, held = (lead, p, q), {c: [] for c in columns}
            for c, v in zip(columns, row):
                held[c].append(v)
    if now is not None:
        yield now[0], now[1] == now[2], held


MEMBER = ["member", "n", "component", "sketch"]


def close_members(members: DataFrame, num: int, den: int) -> DataFrame:
    """(lead, member) of the members that may link with one of another component under the same lead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lead, both, held in _by_group(batches, ["side", *MEMBER]):
            group = Group(held["member"], held["n"], held["component"], held["sketch"], held["side"], both)
            hit = np.zeros(len(group.members), bool)
            for i in range(group.outsiders):
                j = group.close(i, num, den)
                hit[j] = True
                hit[i] |= len(j) > 0
            found = [group.members[k] for k in np.flatnonzero(hit).tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([lead] * len(found), pa.binary()), pa.array(found, pa.binary())], names=["lead", "member"])

    return grouped(members, MEMBER).mapInArrow(run, "lead binary, member binary").distinct()


def with_differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with ``far``, the packed symmetric difference of their set and their lead's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sm"):
            far = [np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).tobytes()
                   for x, y in zip(batch.column("sl").to_pylist(), batch.column("sm").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("member"), pa.array(far, pa.binary())], names=["lead", "member", "far"])

    both = members.select("lead", "member").join(sets.select(F.col("digest").alias("lead"), F.col("s").alias("sl")), "lead").join(
        sets.select(F.col("digest").alias("member"), F.col("s").alias("sm")), "member").select("lead", "member", "sl", "sm")
    far = both.mapInArrow(run, "lead binary, member binary, far binary")
    return members.join(far, ["lead", "member"])


def links_across(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components that members of a lead link, at most one less than there are in a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, both, held in _by_group(batches, ["side", *MEMBER, "far"]):
            group = Group(held["member"], held["n"], held["component"], held["sketch"], held["side"], both)
            far = [np.frombuffer(held["far"][k], np.uint64) for k in group.order.tolist()]
            most = np.array([len(x) for x in far])
            found = []
            for i in range(group.outsiders):
                for j in group.close(i, num, den).tolist():
                    if group.component[i] == group.component[j]:
                        continue  # joined meanwhile
                    allowed = int(_differ_at_most(group.n[i] + group.n[j], num, den))
                    if abs(int(most[i]) - int(most[j])) > allowed:
                        continue
                    all_ = np.sort(np.concatenate([far[i], far[j]]))
                    if len(all_) - 2 * int((all_[1:] == all_[:-1]).sum()) <= allowed:
                        found.append((group.members[i], group.members[j]))
                        group.component[group.component == group.component[j]] = group.component[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], names=["a", "b"])

    return grouped(members, [*MEMBER, "far"]).mapInArrow(run, "a binary, b binary").distinct()


def bucket_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, a, b): with b, two documents of a bucket; without, the bucket's only row of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            docs_of = np.array(batch.column("doc").to_pylist(), np.int64)
            sets, ids, seen = [], [], set()
            for d, s in zip(docs_of.tolist(), _sets(batch.column("text").to_pylist(), k)):
                own = _digest(s)
                if own not in seen and len(s):
                    seen.add(own)
                    sets.append(s)
                    ids.append(d)
            if not sets:
                continue
            owner, key = sketch_keys(sets, num, den)
            a = np.array(ids, np.int64)[owner]
            order = np.lexsort((a, key))
            a, key = a[order], key[order]
            new = np.append(True, key[1:] != key[:-1])[:len(key)]
            lead = a[np.flatnonzero(new)][np.cumsum(new) - 1]
            pair = ~new & (a != lead)
            show = new | pair
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[show].view(np.int64)), pa.array(np.where(pair, lead, a)[show]), pa.array(a[show], mask=~pair[show])],
                names=["key", "a", "b"])

    return docs.mapInArrow(run, "key long, a long, b long")


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each document of a bucket (b) with the bucket's smallest one, its lead (a)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, lead = None, None
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            a = batch.column("a").to_numpy(zero_copy_only=False)
            b = batch.column("b")
            local = b.is_valid().to_numpy(zero_copy_only=False)
            other = np.where(local, b.fill_null(0).to_numpy(zero_copy_only=False), a)
            new = np.append(True, key[1:] != key[:-1])
            new[0] = key[0] != last_key
            leads = np.empty(len(key), np.int64)
            at = np.flatnonzero(new)
            if not new[0]:
                leads[:at[0] if len(at) else len(key)] = lead
            if len(at):
                leads[at[0]:] = a[at][np.cumsum(new[at[0]:]) - 1]
            last_key, lead = int(key[-1]), int(leads[-1])
            joins = other != leads
            if joins.any():
                yield pa.RecordBatch.from_arrays([pa.array(leads[joins]), pa.array(other[joins])], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "a").mapInArrow(run, "a long, b long").distinct()


def sets_of(digests: DataFrame, leaders: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(digest, s): the whole packed shingle sets of some classes, computed from their leaders' texts."""
    ids = leaders.join(digests.distinct(), "digest", "left_semi").select(F.col("leader").alias("doc")).distinct()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = _sets(batch.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["digest", "s"])

    return docs.join(ids, "doc", "left_semi").mapInArrow(hashes, "digest binary, s binary").dropDuplicates(["digest"])


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sa"):
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(den * shared >= num * (len(x) + len(y) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.join(sets.select(F.col("digest").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("digest").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(
        compare, "a binary, b binary")


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: each task joins the nodes it holds to the smallest of their component there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up.setdefault(y, y)
                x = up[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = [x for x in list(up) if root(x) != x]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links, the component being its smallest node.

    Each round contracts the links within tasks and then takes a large-star and a small-star step across them, which join the
    neighbours of a node to the smallest of them, until the links are stars. Every step is written, so that no plan grows.
    """
    edges = materialize(contracted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.count_distinct("u")).first()
        # one edge per node and no root below another: the links are stars
        if state == before or state[0] == state[2] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        before = state
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v")))
        edges = materialize(contracted(small).distinct())
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id under links of similarity num / den or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    # texts are read once for the classes and once for the sketches: parsing twice is cheaper than keeping the sets
    every = materialize(classes(rows, k))
    known = rows.where("doc is not null")
    shown = every.where("n > 0 and doc is not null")
    leaders = materialize(shown.groupBy("digest").agg(F.min("doc").alias("leader"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    of = materialize(shown.select("doc", "digest").distinct())
    met = bucket_pairs(bucket_rows(known, k, num, den))
    first = materialize(met.join(of.select(F.col("doc").alias("a"), F.col("digest").alias("da")), "a").join(
        of.select(F.col("doc").alias("b"), F.col("digest").alias("db")), "b").where("da <> db").select(
        F.col("da").alias("a"), F.col("db").alias("b")).distinct())
    side = lambda c: leaders.select(F.col("digest").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    close = materialize(close_pairs(first.join(side("a"), "a").join(side("b"), "b"), num, den))
    sets = materialize(sets_of(close.select(F.col("a").alias("digest")).unionByName(close.select(F.col("b").alias("digest"))), leaders, known, k))

    def by_leader(found: DataFrame) -> DataFrame:
        name = lambda c: leaders.select(F.col("digest").alias(c), F.col("leader").alias(f"l{c}"))
        return found.join(name("a"), "a").join(name("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))

    links = materialize(by_leader(verified(close, sets, num, den)))
    parts = components(links)
    # leads whose members still lie in several components: members across them that were not yet compared
    placed = materialize(leaders.join(parts, F.col("leader") == F.col("node"), "left").select(
        F.col("digest").alias("member"), "n", F.coalesce("component", "leader").alias("component"), "sketch"))
    members = first.select(F.col("a").alias("lead"), F.col("b").alias("member"))
    members = members.unionByName(members.select("lead", F.col("lead").alias("member")).distinct()).join(placed, "member")
    split = members.groupBy("lead").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("z")).where("x <> y and z > 2")
    members = members.join(split.select("lead"), "lead", "left_semi")
    near = materialize(close_members(members, num, den))
    if not near.isEmpty():
        near = near.join(placed, "member")
        wanted = near.select(F.col("lead").alias("digest")).unionByName(near.select(F.col("member").alias("digest")))
        far = with_differences(near, materialize(sets_of(wanted, leaders, known, k)))
        links = materialize(links.unionByName(by_leader(links_across(materialize(far), num, den))))
        parts = components(links)
    found = of.join(leaders.select("digest", "leader"), "digest").select("doc", "leader")
    # rows that share an id are one node: the component of a document is the least over its classes
    found = found.join(parts.withColumnRenamed("node", "leader"), "leader", "left").groupBy("doc").agg(
        F.min(F.least(F.coalesce("component", "leader"), "doc")).alias("component_id"))
    return every.join(found, "doc", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are linked, directly or not, to one with a smaller id."""
    dropped = join(docs, k, num, den, id_col, text_col).where(f"component_id <> {id_col}").select(F.col(id_col).alias("_dropped"))
    return docs.join(dropped, F.col(id_col) == F.col("_dropped"), "left_anti")

"""Suffix-array dedup: bytes covered by a string of ``size`` bytes that also starts elsewhere.

Sorting every suffix of the corpus would move each byte hundreds of times. A string of ``size`` bytes contains a smallest
k-gram by hash, its anchor, wherever it stands; consecutive starts with the same anchor form a run. Equal strings have
equal anchors, so only suffixes whose leading k-gram (the anchor) occurs twice need to be sorted at all. These anchored
suffixes are range-partitioned by sampled splitters over their leading token and content, each bucket is sorted (first by
the anchor, ties by the content of the whole run, ties by place) and equal neighbours are found. What an anchor's group shares
with the bucket before or after is compared across boundaries by aggregation, so an anchor that a third of all documents share is
spread over buckets.

Runs with equal content are repeated as a whole. Where an anchor has several contents, one run of each is cut into its
strings, which are sorted within the anchor's bucket in the same way, so a start counts when exactly its string starts elsewhere.
Strings are compared by 64-bit hashes of their bytes.

Defined results: a null text is empty; texts shorter than ``size`` lose nothing; an empty table gives no rows. Rows repeated with id
and text are documents of their own and so copies of each other. Kept bytes may be cut within a character; ``removed``
texts decode with such bytes dropped. Ids are integers or null. Only the id and text columns are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ownerscope.llm.common import materialize, mix64, slices

SIZE, GRAM = 200, 64
_BASE = 0x9E3779B97F4A7C15
_CODES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, kept per worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Hashes of any stretch of some bytes: equal bytes have equal hashes wherever they stand."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODES[raw] * up[:len(raw)], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.down[:n])


def find_runs(texts: list[bytes], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, content hash, first start, number of starts) of every run of every text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    count = len(raw) - size + 1
    if count <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])
    rolling = Rolling(raw)
    hashes = rolling.all(gram)
    low, span, width = hashes, 1, size - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[:count], low[width - span:width - span + count])
    own = owner[:count]
    whole = own == owner[size - 1:size - 1 + count]
    new = np.ones(count, bool)
    # the anchor changes with its hash, and after a start that is the anchor's own place
    new[1:] = (low[1:] != low[:-1]) | (hashes[:count - 1] == low[:-1]) | (own[1:] != own[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, count))
    keep = whole[start]
    start, n = start[keep], n[keep]
    return own[start], low[start], rolling.at(start, n + size - 1), start - first[own[start]], n


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def runs(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor, content, doc, tag, place): place is first start * 256 + number of starts - 1."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            text, anchor, content, start, n = find_runs(_texts(batch), size, gram)
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor), _signed(content), batch.column("doc").take(pa.array(text)), batch.column("tag").take(pa.array(text)),
                     pa.array(start * 256 + n - 1)], names=["anchor", "content", "doc", "tag", "place"])

    return docs.mapInArrow(cut, "anchor long, content long, doc long, tag int, place long")


RUN = "anchor long, content long, doc long, tag int, place long"


def _bounds(x: np.ndarray) -> np.ndarray:
    return np.append(True, x[1:] != x[:-1])


def grouped_runs(rows: DataFrame) -> DataFrame:
    """Runs whose anchor occurs twice: with ``same`` (its content does) and ``mixed`` (the anchor has several contents).

    A group that touches a bucket's ends may go on in the next one: its marks come from counts over all buckets. Only one row
    per content and bucket takes part; a content met twice within a bucket is repeated whatever the others hold.
    """
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at_edge = None, True  # rows of the open group; whether it may have rows in what was passed on before
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            last = int(np.flatnonzero(_bounds(table.column("anchor").to_numpy()))[-1])
            if last:
                yield from mark(table.slice(0, last), at_edge, False)
                at_edge = False
            held = table.slice(last).combine_chunks().to_batches()[0]
            if held.num_rows > 100_000:  # a long group is passed on in parts, which are counted across buckets
                yield from mark(pa.Table.from_batches([held]), True, True)
                held, at_edge = None, True
        if held is not None:
            yield from mark(pa.Table.from_batches([held]), True, True)

    def mark(table: pa.Table, first_is_edge: bool, last_is_edge: bool) -> Iterator[pa.RecordBatch]:
        a = table.column("anchor").to_numpy()
        c = table.column("content").to_numpy()
        new = _bounds(a)
        group = np.cumsum(new) - 1
        fresh = new | _bounds(c)
        kind = np.cumsum(fresh) - 1
        many = np.bincount(group)[group] > 1
        same = np.bincount(kind)[kind] > 1
        mixed = np.bincount(group, fresh)[group] > 1
        edge = np.zeros(len(a), bool)
        if first_is_edge:
            edge |= group == 0
        if last_is_edge:
            edge |= group == group[-1]
        keep = pa.array(many | edge)
        out = table.append_column("same", pa.array(same)).append_column("mixed", pa.array(mixed)).append_column(
            "lead", pa.array(fresh)).append_column("edge", pa.array(edge)).append_column(
            "n", pa.array(np.bincount(kind)[kind])).filter(keep)
        yield from out.combine_chunks().to_batches()

    order = ["anchor", "content", "doc", "tag", "place"]
    found = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        neighbours, RUN + ", same boolean, mixed boolean, lead boolean, edge boolean, n long"))
    flags = ["same", "mixed", "lead"]
    inner = found.where("not (edge and lead)").select(*order, *flags)  # of edge groups only rows that are repeated for certain
    shared = found.where("edge and lead").select(*order, "n")
    by_content = shared.groupBy("anchor", "content").agg(F.sum("n").alias("all"), F.min(F.struct("doc", "tag", "place")).alias("first"))
    by_anchor = by_content.groupBy("anchor").agg(F.sum("all").alias("rows"), F.count("*").alias("kinds"))
    marked = shared.join(by_content, ["anchor", "content"]).join(by_anchor, "anchor").where("rows > 1").select(
        *order, (F.col("all") > 1).alias("same"), (F.col("kinds") > 1).alias("mixed"),
        F.struct("doc", "tag", "place").eqNullSafe(F.col("first")).alias("lead"))
    return inner.unionByName(marked)


def cut_docs(docs: DataFrame, marked: DataFrame, size: int) -> DataFrame:
    """Documents with their runs: kind 0, a document (text only where runs remain); kind 1, the strings of a leading run.

    ``spans`` packs (start, end) of what is repeated for certain, ``open`` (anchor, content, place) of the other runs.
    """
    per_doc = marked.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "content", "place", "same", "mixed", "lead")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            docs_of, tags = batch.column("doc").to_pylist(), batch.column("tag").to_pylist()
            out = {k: [] for k in ("kind", "doc", "tag", "n_bytes", "sha", "raw", "spans", "open", "anchor", "content", "strings")}

            def put(**row):
                for k, v in out.items():
                    v.append(row.get(k))

            for d, tag, raw, own in zip(docs_of, tags, _texts(batch), batch.column("runs")):
                if not own.is_valid:
                    put(kind=0, doc=d, tag=tag, n_bytes=len(raw), sha=hashlib.sha256(raw).hexdigest())
                    continue
                field = own.values.field
                anchor, content, place = (field(k).to_numpy(zero_copy_only=False) for k in range(3))
                same, mixed, lead = (field(k).to_numpy(zero_copy_only=False).astype(bool) for k in range(3, 6))
                start, n = place // 256, place % 256 + 1
                spans = np.stack([start[same], start[same] + n[same] + size - 1], 1).astype(np.int64)
                rest = ~same & mixed
                opened = np.stack([anchor[rest], content[rest], place[rest]], 1).astype(np.int64)
                put(kind=0, doc=d, tag=tag, n_bytes=len(raw), raw=raw, spans=spans.tobytes(), open=opened.tobytes())
                shown = np.flatnonzero(lead & mixed)
                if len(shown):
                    rolling = Rolling(np.frombuffer(raw, np.uint8))
                    for k in shown.tolist():
                        at = np.arange(start[k], start[k] + n[k])
                        put(kind=1, anchor=int(anchor[k]), content=int(content[k]), strings=rolling.at(at, size).tobytes())
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    on = docs["doc"].eqNullSafe(per_doc["doc"]) & (docs["tag"] == per_doc["tag"])
    joined = docs.join(per_doc, on, "left").select(docs["doc"], docs["tag"], docs["text"], per_doc["runs"])
    return joined.mapInArrow(cut, "kind int, doc long, tag int, n_bytes long, sha string, raw binary, spans binary, open binary, "
                                  "anchor long, content long, strings binary")


def repeated_strings(leads: DataFrame) -> DataFrame:
    """(anchor, content, hits): for each run content, which of its strings start elsewhere too (one byte per string).

    Strings that are equal have the same anchor. Buckets are ranges of anchors; strings equal within a bucket are found by
    sorting it. Only an anchor that ends one bucket and begins another has strings that may be equal to ones elsewhere: those
    are compared across buckets, one of each that its bucket already has twice. They travel packed by ranges of their
    hashes, so a batch sends one row per range whatever it holds.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[tuple[int, int, np.ndarray]] = []
        first, kept, flushed = None, 0, 0

        def resolve(edge_anchors: set[int]):
            lengths = np.array([len(s) for _, _, s in held], np.int64)
            flat = np.concatenate([s for _, _, s in held]) if held else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            ordered = flat[order]
            twin = np.zeros(len(flat), bool)
            equal = ordered[1:] == ordered[:-1]
            twin[order[1:]] |= equal
            twin[order[:-1]] |= equal
            parts = np.split(twin, np.cumsum(lengths)[:-1]) if held else []
            rows = [(a, c, t.astype(np.uint8).tobytes(), s.tobytes() if a in edge_anchors else None)
                    for (a, c, s), t in zip(held, parts)]
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            parts_of = pa.array(np.full(len(rows), 1 << 20, np.int64) * task + flushed)  # a task's flushes are compared like tasks
            return pa.RecordBatch.from_arrays([*(pa.array(list(x), t) for x, t in zip(columns, types)), parts_of],
                                              names=["anchor", "content", "hits", "strings", "part"])

        for batch in batches:
            for a, c, s in zip(*(batch.column(k).to_pylist() for k in ("anchor", "content", "strings"))):
                if first is None:
                    first = a
                if held and a != held[-1][0] and kept > 2_000_000:
                    yield resolve({first})
                    held, kept, flushed = [], 0, flushed + 1
                elif held and kept > 8_000_000:  # one anchor fills the bucket: its strings are counted across buckets anyway
                    yield resolve({first, a})
                    held, kept, first, flushed = [], 0, a, flushed + 1
                held.append((a, c, np.frombuffer(s, np.uint64)))
                kept += len(held[-1][2])
        if held:
            yield resolve({first, held[-1][0]})

    found = materialize(leads.repartitionByRange("anchor", "content").sortWithinPartitions("anchor", "content").mapInArrow(
        local, "anchor long, content long, hits binary, strings binary, part long"))
    ranges = 4 * int(leads.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = [np.frombuffer(x, np.uint64) for x in batch.column("strings").to_pylist()]
            flat = np.concatenate(strings) if strings else np.zeros(0, np.uint64)
            if not len(flat):
                continue
            lengths = np.array([len(x) for x in strings])
            hit = np.concatenate([np.frombuffer(x, np.uint8) for x in batch.column("hits").to_pylist()]).astype(bool)
            owner = np.repeat(np.arange(len(strings)), lengths)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            anchor, content = (batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("anchor", "content"))
            _, one = np.unique(flat[hit], return_index=True)  # those that are repeated anyway: one of each, for the others' sake
            rows = np.stack([flat.view(np.int64), anchor, content, place], 1)
            rows = np.concatenate([rows[~hit], np.stack([rows[hit][one][:, 0], *[np.full(len(one), -1)] * 3], 1)])
            into = ((rows[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(into, kind="stable")
            rows, into = rows[order], into[order]
            starts = np.flatnonzero(_bounds(into))
            yield pa.RecordBatch.from_arrays(
                [pa.array(into[starts]), pa.array([x.tobytes() for x in np.split(rows, starts[1:])], pa.binary())], names=["range", "rows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            new = _bounds(rows[:, 0])
            group = np.cumsum(new) - 1
            rows = rows[(np.bincount(group)[group] > 1) & (rows[:, 3] >= 0)]
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
            if len(rows):
                starts = np.flatnonzero(_bounds(rows[:, 1]) | _bounds(rows[:, 2]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[starts, 1]), pa.array(rows[starts, 2]), pa.array([x.tolist() for x in np.split(rows[:, 3], starts[1:])], pa.list_(pa.int32()))],
                    names=["anchor", "content", "places"])

        for batch in batches:
            for range_, raw in zip(batch.column("range").to_pylist(), batch.column("rows").to_pylist()):
                if range_ != now:
                    if held:
                        yield from flush()
                    now, held = range_, []
                held.append(np.frombuffer(raw, np.int64).reshape(-1, 4))
        if held:
            yield from flush()

    ends = found.where("strings is not null")
    shared = ends.groupBy("anchor").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("anchor")
    packed = ends.join(shared, "anchor", "left_semi").select("anchor", "content", "hits", "strings").mapInArrow(pack, "range long, rows binary")
    met = packed.repartition("range").sortWithinPartitions("range").mapInArrow(meet, "anchor long, content long, places array<int>")
    across = met.groupBy("anchor", "content").agg(F.flatten(F.collect_list("places")).alias("more"))
    return found.select("anchor", "content", "hits").join(across, ["anchor", "content"], "left")


def _merge(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint (start, end) of the union; spans that touch are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], np.append(reach[at[1:] - 1], reach[-1])], 1)


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and the text that is kept)."""
    gram = min(gram, size)
    if not 0 < size - gram < 255:
        raise ValueError("a run's number of starts must fit a byte")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "tag", F.hash("text"))
    marked = grouped_runs(runs(rows, size, gram))
    pieces = materialize(cut_docs(rows, marked, size))
    hits = repeated_strings(pieces.where("kind = 1").select("anchor", "content", "strings"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_of, tags = batch.column("doc").to_pylist(), batch.column("tag").to_pylist()
            found = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in batch.column("open").to_pylist()]
            n = np.array([len(x) for x in found])
            if n.sum():
                flat, take = np.concatenate(found), pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(take), batch.column("tag").take(take), *(pa.array(flat[:, k]) for k in range(3))],
                    names=["doc", "tag", "anchor", "content", "place"])

    open_runs = pieces.where("kind = 0 and raw is not null").select("doc", "tag", "open").mapInArrow(
        opened, "doc long, tag int, anchor long, content long, place long")
    more = open_runs.join(hits, ["anchor", "content"]).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("place", "hits", "more")).alias("found"))
    whole = pieces.where("kind = 0 and raw is not null").select("doc", "tag", "raw", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "raw"):
            n_bytes, removed, n_spans, sha, text = [], [], [], [], []
            for raw, spans, found in zip(*(batch.column(c).to_pylist() for c in ("raw", "spans", "found"))):
                every = [np.frombuffer(spans, np.int64).reshape(-1, 2)]
                for one in found or []:
                    at = np.flatnonzero(np.frombuffer(one["hits"], np.uint8))
                    if one["more"]:
                        at = np.union1d(at, one["more"])
                    at = at + one["place"] // 256
                    every.append(np.stack([at, at + size], 1))
                gone = _merge(np.concatenate(every))
                edges = [0, *gone.ravel().tolist(), len(raw)]
                kept = b"".join(raw[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(kept))
                n_spans.append(len(gone))
                sha.append(hashlib.sha256(kept).hexdigest())
                text.append(kept.decode("utf-8", "ignore") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tag"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(text, pa.string())],
                names=["doc", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    on = whole["doc"].eqNullSafe(more["doc"]) & (whole["tag"] == more["tag"])
    changed = whole.join(more, on, "left").select(whole["doc"], whole["tag"], "raw", "spans", "found").mapInArrow(
        finish, "doc long, tag int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    columns = ["doc", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    plain = pieces.where("kind = 0 and raw is null").select(
        "doc", "tag", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    out = changed.unionByName(plain).select(*columns)
    return out.select(F.col("doc").alias(id_col), *columns[2:-1], *(["tag", "kept_text"] if with_text else []))


def drop_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated bytes cut out of the text; all other columns as they were."""
    cut = remove_repeats(docs, size, gram, id_col, text_col, with_text=True).where("n_removed > 0").select(
        F.col(id_col).alias("_doc"), F.col("tag").alias("_tag"), "kept_text").dropDuplicates(["_doc", "_tag"])
    tag = F.hash(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(cut, F.col(id_col).cast("long").eqNullSafe(F.col("_doc")) & (tag == F.col("_tag")), "left")
    text = F.when(F.col("_tag").isNotNull(), F.col("kept_text")).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])

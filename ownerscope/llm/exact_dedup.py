"""Exact dedup by deterministic block naming.

Texts (A-Z in lower case) are cut into fixed-size blocks of bytes. Blocks are sorted and equal ones get the same integer
name; then adjacent names of a document are paired and the pairs named the same way, until every document has one name.
Names are ranks in a sort of the contents themselves, so no two contents share one: the identity (level, name) has no
collisions. The sort is by range over (content, document), so a block that a third of all documents share is spread
over many tasks; a task ranks its own rows and one row per task joins the ranks of neighbouring tasks.

Defined results: null is an empty text, and empty texts are copies of each other. Of equal texts the row with the
largest id stays. Rows repeated with the same id and text count once; rows with the same id and different texts are
different documents. An empty table gives no rows. Null ids are kept and are smaller than any other id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ownerscope.llm.common import lower_ascii, materialize, slices

BLOCK_BYTES = 4096


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: doc, digest of the whole text (tells apart rows with the same id), idx, content."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            take, digest, idx, content = [], [], [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass").lower()
                own = hashlib.sha256(raw).digest()
                for i, at in enumerate(range(0, max(len(raw), 1), block_bytes)):
                    take.append(k)
                    digest.append(own)
                    idx.append(i)
                    content.append(raw[at:at + block_bytes])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(take, pa.int32())), pa.array(digest, pa.binary()), pa.array(idx, pa.int64()),
                 pa.array(content, pa.binary())], names=["doc", "digest", "idx", "content"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"doc {id_type}, digest binary, idx long, content binary")


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (doc, digest, idx, keys) with an integer ``name`` in place of the keys: equal names mean equal keys.

    Each task of a range sort ranks the distinct keys it holds. The first key of a task may be the last key of the task
    before; one row per task carries both keys, and running sums over those rows turn local ranks into global ones.
    """
    key_fields = [rows.schema[k] for k in keys]
    id_type = rows.schema["doc"].dataType.simpleString()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, first, local = TaskContext.get().partitionId(), None, None, -1
        types = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            types = {f.name: f.type for f in batch.schema}
            columns = [batch.column(k) for k in keys]
            changed = np.ones(n, bool)
            if n > 1:
                same = np.ones(n - 1, bool)
                for c in columns:
                    a, b = c.slice(1), c.slice(0, n - 1)
                    equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                    same &= equal.to_numpy(zero_copy_only=False)
                changed[1:] = ~same
            head = tuple(c[0].as_py() for c in columns)
            if first is None:
                first = head
            changed[0] = head != last
            last = tuple(c[n - 1].as_py() for c in columns)
            ranks = local + np.cumsum(changed)
            local = int(ranks[-1])
            nothing = [pa.nulls(n, t) for k in keys for t in (types[k], types[k])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("digest"), batch.column("idx"), pa.array([part] * n, pa.int32()),
                 pa.array(ranks, pa.int64()), pa.array(np.zeros(n, bool)), *nothing], names=out_names)
        if first is not None:
            edges = [pa.array([v], types[k]) for i, k in enumerate(keys) for v in (first[i], last[i])]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, types["doc"]), pa.nulls(1, types["digest"]), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()),
                 pa.array([local], pa.int64()), pa.array([True]), *edges], names=out_names)

    edge_names = [f"{side}_{k}" for k in keys for side in ("first", "last")]
    out_names = ["doc", "digest", "idx", "part", "rank", "is_edge", *edge_names]
    edge_types = ", ".join(f"{side}_{f.name} {f.dataType.simpleString()}" for f in key_fields for side in ("first", "last"))
    order = [*keys, "doc", "digest", "idx"]
    # ranges are over a hash of the keys, so that the sampled splitters are small; the sort compares the keys themselves
    dealt = rows.withColumn("_deal", F.xxhash64(*keys))
    ranked = materialize(dealt.repartitionByRange("_deal", "doc", "idx").sortWithinPartitions("_deal", *order).drop("_deal").mapInArrow(
        rank, f"doc {id_type}, digest binary, idx long, part int, rank long, is_edge boolean, {edge_types}"))
    by_part = Window.orderBy("part")
    joined = F.lit(True)
    for k in keys:
        joined = joined & F.col(f"first_{k}").eqNullSafe(F.lag(f"last_{k}").over(by_part))
    tasks = ranked.where("is_edge").select("part", "rank", (joined & (F.row_number().over(by_part) > 1)).alias("joined"))
    # the task's first rank: all ranks before it, one less for each key that two tasks share
    new = F.col("rank") + 1 - F.when(F.col("joined"), 1).otherwise(0)
    offsets = tasks.select("part", (F.sum(new).over(by_part.rowsBetween(Window.unboundedPreceding, 0))
                                    - F.col("rank") - 1).alias("base"))
    return ranked.where("not is_edge").join(offsets, "part").select(
        "doc", "digest", "idx", (F.col("rank") + F.col("base")).alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc, digest, level and name of every document; equal texts and only they have equal (level, name)."""
    level = 0
    rows = materialize(named(blocks(docs, id_col, text_col, block_bytes), ["content"]))
    done = []
    while True:
        sizes = rows.groupBy("doc", "digest").agg(F.max("idx").alias("top"), F.max("name").alias("name"))
        done.append(sizes.where("top = 0").select("doc", "digest", F.lit(level).alias("level"), "name"))
        pairs = rows.groupBy("doc", "digest", F.shiftright("idx", 1).alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("right"),
        )
        # a document is done when its only row is a pair without a right half
        open_pairs = materialize(pairs.where("not (idx = 0 and right is null)"))
        if open_pairs.isEmpty():
            break
        level += 1
        rows = materialize(named(open_pairs, ["left", "right"]))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, keep_id, group_size, kept, text_sha256."""
    every = materialize(identities(docs, id_col, text_col, block_bytes))
    # of rows that share id and text one remains; the largest id of a group stays
    stays = every.groupBy("level", "name").agg(F.max("doc").alias("keep_id"), F.count("*").alias("group_size"))
    return every.join(stays, ["level", "name"]).select(
        F.col("doc").alias(id_col), "keep_id", "group_size", F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text one is kept."""
    dropped = groups(docs, id_col, text_col).where("not kept").select(
        F.col(id_col).alias("_dropped"), F.col("text_sha256").alias("_digest"))
    digest = F.sha2(lower_ascii(F.col(text_col)), 256)
    stays = docs.join(dropped, F.col(id_col).eqNullSafe(F.col("_dropped")) & (digest == F.col("_digest")), "left_anti")
    return stays.dropDuplicates([id_col, text_col])

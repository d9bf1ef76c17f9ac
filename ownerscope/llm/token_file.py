"""Token ids in a binary format: Simple-8b words in blocks.

A 64-bit word holds a 4-bit selector and 60 bits of payload: selector s of SELECTORS packs ``count`` ids of ``width``
bits. Ids of more than 60 bits do not occur (they are 32-bit), so the escape is the selector of one id of 60 bits.
A block is a row: documents of one task in order, at most BLOCK_IDS ids (a longer document is a block of its own),

    magic "S8B1" | n_docs u32 | n_ids u64 | n_words u64 | n_groups u32 | ids per document u32[n_docs]
    | first word of each group of GROUP ids u32[n_groups] | words u64[n_words]

all little-endian. A group's first word lets a reader decode any group alone. Rows are written by Spark's own Parquet
committer, so a lost executor's blocks are written again and never twice; ``payload`` in the order of (part, block) is
the file's byte stream.

Defined results: a null text is empty and holds the end id alone; an empty table gives an empty file; documents with
equal ids follow one another in any order, null ids come first; other columns are not looked at.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ownerscope.llm.common import slices
from ownerscope.llm.tokens import END_ID, default_path, encoder
from ownerscope.session import checkpoint_dir

#: ids in a word and bits of an id, by selector
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
             (2, 30), (1, 60)]
GROUP, BLOCK_IDS = 1024, 1 << 16
HEAD = struct.Struct("<4sIQQI")


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of a block and each group's first word.

    Each word takes the selector that holds the most of the ids that follow; a group starts on a word of its own. The
    widest of each ``count`` following ids comes from running maxima over powers of two.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    left = GROUP - np.arange(n) % GROUP
    left = np.minimum(left, n - np.arange(n))
    widest = {1: np.concatenate([bits, np.full(64, 255, np.uint8)])}
    for p in (2, 4, 8, 16, 32):
        half = widest[p // 2]
        widest[p] = half.copy()
        np.maximum(half[:-(p // 2)], half[p // 2:], out=widest[p][:-(p // 2)])
    fits = np.full(n, len(SELECTORS) - 1, np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[s]
        p = 1 << (count.bit_length() - 1)
        most = np.maximum(widest[p][:n], widest[p][count - p:n + count - p])
        fits[(most <= width) & (left >= count)] = s
    steps = np.array([c for c, _ in SELECTORS], np.uint8)[fits].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    chosen = fits[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    wide_ids = ids.astype(np.uint64)
    for s in np.unique(chosen):
        count, width = SELECTORS[s]
        own = np.flatnonzero(chosen == s)
        value = np.zeros(len(own), np.uint64)
        for k in range(count):
            value |= wide_ids[starts[own] + k] << np.uint64(k * width)
        words[own] |= value
    return words, np.searchsorted(starts, np.arange(0, n, GROUP))


def unpack_words(words: np.ndarray) -> np.ndarray:
    """Ids of consecutive words, decoded selector by selector."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[chosen]
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(starts[-1]), np.uint32)
    for s in np.unique(chosen):
        count, width = SELECTORS[s]
        own = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            out[starts[own] + k] = (words[own] >> np.uint64(k * width)) & mask
    return out


def write_block(docs: list[np.ndarray]) -> bytes:
    """Bytes of one block."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    words, firsts = pack_words(ids)
    return b"".join([
        HEAD.pack(b"S8B1", len(docs), len(ids), len(words), len(firsts)),
        np.array([len(d) for d in docs], "<u4").tobytes(), firsts.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
    ])


def read_block(raw: bytes) -> list[np.ndarray]:
    """The documents' ids of a block."""
    magic, n_docs, n_ids, n_words, n_groups = HEAD.unpack_from(raw)
    if magic != b"S8B1":
        raise ValueError("not a token block")
    sizes = np.frombuffer(raw, "<u4", n_docs, HEAD.size)
    words = np.frombuffer(raw, "<u8", n_words, HEAD.size + 4 * (n_docs + n_groups))
    ids = unpack_words(words)
    if len(ids) != n_ids:
        raise ValueError("a token block is damaged")
    return np.split(ids, np.cumsum(sizes.astype(np.int64))[:-1]) if n_docs else []


def read_group(raw: bytes, group: int) -> np.ndarray:
    """The ids of one group of GROUP ids, without decoding the rest of the block."""
    _, n_docs, _, n_words, n_groups = HEAD.unpack_from(raw)
    firsts = np.frombuffer(raw, "<u4", n_groups, HEAD.size + 4 * n_docs)
    first, last = int(firsts[group]), int(firsts[group + 1]) if group + 1 < n_groups else n_words
    return unpack_words(np.frombuffer(raw, "<u8", last - first, HEAD.size + 4 * (n_docs + n_groups) + 8 * first))


def encode_blocks(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the documents in ascending id order: part, block, ids of the documents, n_ids, payload."""
    path = path or default_path()
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held, names, n = TaskContext.get().partitionId(), 0, [], [], 0
        enc = encoder(path)

        def flush():
            nonlocal block, held, names, n
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([names], pa.list_(kind)),
                 pa.array([n], pa.int64()), pa.array([write_block(held)], pa.binary())],
                names=["part", "block", "docs", "n_ids", "payload"])
            block, held, names, n = block + 1, [], [], 0
            return row

        for batch in slices(batches, "text"):
            kind = batch.schema.field("doc").type
            for d, body in zip(batch.column("doc").to_pylist(), enc.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.frombuffer(body + end, "<u4")
                if held and n + len(ids) > BLOCK_IDS:
                    yield flush()
                held.append(ids)
                names.append(d)
                n += len(ids)
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc").sortWithinPartitions("doc")
    return ordered.mapInArrow(encode, f"part int, block long, docs array<{id_type}>, n_ids long, payload binary")


def write_file(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents' ids as a token file into ``folder``."""
    encode_blocks(docs, path, id_col, text_col).write.option("compression", "none").parquet(folder)


def read_file(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of a token file: id, start, n_tokens, ids_crc32 (and ids).

    Starts are sums in two levels: of the tasks' totals (one row per task), and of the blocks within a task.
    """
    blocks = spark.read.parquet(folder)
    id_type = blocks.schema["docs"].dataType.elementType.simpleString()
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", "n_ids").select(
        "part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("block_start")).join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.col("block_start")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            for docs, first, raw in zip(*(batch.column(c).to_pylist() for c in ("docs", "first", "payload"))):
                ids = read_block(raw)
                sizes = np.array([len(x) for x in ids], np.int64)
                begin = first + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                bodies = [x.astype("<u4").tobytes() for x in ids]
                arrays = [pa.array(docs, batch.schema.field("docs").type.value_type), pa.array(begin, pa.int64()),
                          pa.array(sizes, pa.int64()), pa.array([zlib.crc32(b) for b in bodies], pa.int64())]
                names = ["doc", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(bodies, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = blocks.join(starts, ["part", "block"]).select("docs", "first", "payload").mapInArrow(
        decode, f"doc {id_type}, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return found.withColumnRenamed("doc", id_col)


def new_folder(spark: SparkSession) -> str:
    """A folder for a token file in the cluster's shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"tokens-{uuid.uuid4().hex}")

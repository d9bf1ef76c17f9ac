"""Packing by power-of-two decomposition: pieces of one document fill sequences without padding.

A document of n tokens is cut into n // longest pieces of the longest length and one piece for each set bit of the rest,
in falling order. Pieces of equal length share a bucket; each piece is a sequence of its own, so no sequence crosses
documents and none is padded. Sequence ids are dense within a bucket, buckets of long sequences first.

Defined results: a null text is empty and gives one piece, the end id; an empty table gives no rows; rows repeated in
the input give pieces of their own; documents with a null id are packed like others. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ownerscope.llm.common import materialize, slices
from ownerscope.llm.tokens import END_ID, default_path, encoder


def piece_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole ``longest`` pieces, then the set bits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, longest: int = 2048, path: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document with the task and the place in the task's bucket that number them later."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    path = path or default_path()
    end = np.array([END_ID], "<u4").tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(path)
        seen: dict[int, int] = {}
        for batch in slices(batches, "text"):
            ids = batch.column("doc").to_pylist()
            doc, start, length, crc, total, place, raw = [], [], [], [], [], [], []
            for d, body in zip(ids, enc.encode([t or "" for t in batch.column("text").to_pylist()])):
                body += end
                n, at = len(body) // 4, 0
                for size in piece_lengths(n, longest):
                    piece = body[4 * at:4 * (at + size)]
                    doc.append(d)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    place.append(seen.get(size, 0))
                    seen[size] = place[-1] + 1
                    if with_ids:
                        raw.append(piece)
                    at += size
            arrays = [pa.array(doc, batch.schema.field("doc").type), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)),
                      pa.array([part] * len(doc), pa.int32()), pa.array(place, pa.int64())]
            names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "part", "place"]
            if with_ids:
                arrays.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = (f"doc {id_type}, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"
              + (", ids binary" if with_ids else ""))
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, longest: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence; ``with_ids`` adds the ids as little-endian 32-bit bytes.

    The pieces are written once, so that their numbering cannot change; the counts joined to them are one row for each
    task and bucket (at most 12 buckets), and only those are ordered in one task.
    """
    cut = materialize(pieces(docs, longest, path, id_col, text_col, with_ids))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = cut.join(offsets, ["length", "part"])
    return numbered.select(
        F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )

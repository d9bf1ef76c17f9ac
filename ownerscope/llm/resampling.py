"""Target-distribution importance resampling over hashed n-grams.

Features are all runs of one to ``longest`` words of a text; a feature's bucket is the crc32 of its bytes modulo ``buckets``. Counts per
bucket over all documents and over all target texts give each bucket a gain, the logarithm of its ratio; a document's weight is the
mean gain of its features. With Gumbel noise from a hash of the id added, the highest scores are a draw without replacement.

A batch's texts are joined with a separator that is no word character, and one pass of a regular expression finds the words of
all of them. Looking up word starts among the document offsets tells each word's document, so n-grams that would cross into the next
document are masked; buckets are then counted at once. The crc32 of an n-gram follows from those of its words, since appending
bytes is linear, so each distinct word is hashed once.

What leaves a task is one row per bucket; the table of gains has ``buckets`` entries whatever the input. The draw is ranked by a range
sort: each task numbers its own rows, and one row per task carries the numbers before it.

Defined results: null and empty texts and texts without words have no features, weight 0, and are never drawn; ids order the
ties, a null id last and hashed as an empty text. Repeated rows count and are drawn one by one, their order among themselves free.
An empty table gives no rows; empty targets count nothing. Only the id and text columns are looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ownerscope.llm.common import materialize, slices

BUCKETS, LONGEST, SEED = 10_000, 2, 7
LEAST_WORDS, SHARE = 20, (25, 100)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_REMEMBERED = 400_000


class WordCodes:
    """crc32 of words alone and after a space, remembered up to a bound, and of n-grams from those of their words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.crc, self.spaced, self.size = [], [], []
        self.shifts: dict[int, np.ndarray] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        """A number for each word."""
        if len(self.known) > _REMEMBERED:
            self.known, self.crc, self.spaced, self.size = {}, [], [], []
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            for k, v in enumerate(got):
                if v is None:
                    w = words[k]
                    v = known.get(w)
                    if v is None:
                        v = known[w] = len(self.crc)
                        self.crc.append(zlib.crc32(w))
                        self.spaced.append(zlib.crc32(b" " + w))
                        self.size.append(len(w) + 1)
                    got[k] = v
        return np.array(got, np.int64)

    def shift(self, n: int) -> np.ndarray:
        """Table (4, 256): what the crc32's bytes become when n bytes follow."""
        if n not in self.shifts:
            if len(self.shifts) > 4096:
                self.shifts.clear()
            zeros = bytes(n)
            none = zlib.crc32(zeros)
            # crc32(x + zeros) is affine in x's crc: the difference of two is the shift of their difference
            bit = [_after(1 << k, zeros) ^ none for k in range(32)]
            table = np.zeros((4, 256), np.uint32)
            for part in range(4):
                for v in range(1, 256):
                    low = v & -v
                    table[part, v] = table[part, v ^ low] ^ np.uint32(bit[8 * part + low.bit_length() - 1])
            self.shifts[n] = table
        return self.shifts[n]

    def appended(self, before: np.ndarray, sizes: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """crc32 of texts with crc ``before`` after a space and a word of crc ``spaced`` and ``sizes`` bytes."""
        lengths, kind = np.unique(sizes, return_inverse=True)
        out = spaced.copy()
        if not len(lengths):
            return out
        tables = np.stack([self.shift(n) for n in lengths.tolist()])
        for part in range(4):
            out ^= tables[kind, part, (before >> np.uint32(8 * part)) & np.uint32(255)]
        return out


def _after(crc: int, more: bytes) -> int:
    """crc32 after ``more`` of a text whose crc32 differs from the empty text's by ``crc``."""
    return zlib.crc32(more, crc)


_CODES: list[WordCodes] = []


def word_codes() -> WordCodes:
    """One store per Python worker."""
    if not _CODES:
        _CODES.append(WordCodes())
    return _CODES[0]


def features(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: each feature's document and bucket, and each document's number of words."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = b"\0".join(raw)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
    matches = list(_WORD.finditer(joined))
    starts = np.fromiter((m.start() for m in matches), np.int64, len(matches))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    codes = word_codes()
    number = codes.of([m.group() for m in matches])
    alone, spaced, size = (np.array(x, t) for x, t in ((codes.crc, np.uint32), (codes.spaced, np.uint32), (codes.size, np.int64)))
    crc = alone[number]
    docs_of, found = [doc], [crc]
    for n in range(2, longest + 1):
        if len(number) < n:
            break
        last = number[n - 1:]
        crc = codes.appended(crc[:len(last)], size[last], spaced[last])
        within = doc[n - 1:] == doc[:len(last)]  # not across documents
        docs_of.append(doc[:len(last)][within])
        found.append(crc[within])
    return np.concatenate(docs_of), np.concatenate(found).astype(np.int64) % buckets, np.bincount(doc, minlength=len(texts))


def bucket_counts(rows: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> dict[int, int]:
    """How often each bucket's features occur in all texts: at most ``buckets`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(features(batch.column("text").to_pylist(), longest, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counted = rows.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(k, 0) + 1.0) * s_all / ((source.get(k, 0) + 1.0) * t_all))) for k in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """doc, n_words, n_features, weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, bucket, words = features(batch.column("text").to_pylist(), longest, len(gain))
            n = np.bincount(doc, minlength=batch.num_rows)
            total = np.bincount(doc, gain[bucket], minlength=batch.num_rows).astype(np.int64)  # whole numbers: exact in doubles
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             names=["doc", "n_words", "n_features", "weight"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc {id_type}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, drawn: int) -> DataFrame:
    """The rows with their rank by ``order`` from 1, null beyond ``drawn``."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)),
                                                  pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, "part", "at"])
                at += batch.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, part int, at long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("at") + 1
    return placed.join(starts, "part").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, targets: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
             longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text") -> DataFrame:
    """Per document: id, n_features, weight, score, and rank where it is drawn."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(targets, target_text_col, longest, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))) * -1000.0).cast("long")
    every = materialize(weights(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + noise))
    fit, columns = F.col("n_words") >= least_words, ["doc", "n_features", "weight", "score"]
    drawn = every.where(fit).count() * share[0] // share[1]
    best = ranked(every.where(fit).select(columns), [F.desc("score"), F.asc_nulls_last("doc")], drawn)
    rest = every.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    return best.unionByName(rest).withColumnRenamed("doc", id_col)

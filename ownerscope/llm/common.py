"""Helpers of the operators: inputs, intermediate tables, Arrow batches, hashing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ownerscope.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[list[str]] = []  # of each open ``recording``, the tables written meanwhile


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of the intermediate tables that are written within the block."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared checkpoint folder and read back: cuts the lineage and survives lost executors."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"llm-{uuid.uuid4().hex}")
    for made in _MADE:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of a string column, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lower_ascii(text):
    """A-Z in lower case, null as an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

"""Documents to packed training sequences: rules, exact copies, near copies, repeated passages, packing.

Every stage takes null texts as empty, keeps rows of an empty table empty and passes on all columns, whatever their names. A null id is
an id like others for the rules and exact copies; near copies are only looked for among rows with an id, and rows without one stay.
A stage's output is written and read again as the next one's input; its intermediate tables are deleted when the next stage begins.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ownerscope.llm import common, exact_dedup, jaccard_join, packing, quality, suffix_dedup
from ownerscope.session import checkpoint_dir


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_LEFT: dict[str, list[str]] = {}  # application -> intermediate tables of its last stage


def staged(build: Stage) -> Stage:
    """A stage that first deletes the intermediate tables of the one before, whose output has been written by then."""
    @wraps(build)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, docs)
        with common.recording() as made:
            out = build(spark, docs, sf_dir)
        _LEFT.setdefault(spark.sparkContext.applicationId, []).extend(made)
        return out

    return stage


def clear(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """Deletes what the last stage left, but for tables that ``docs`` still reads (its output was not written)."""
    left = _LEFT.pop(spark.sparkContext.applicationId, [])
    files = docs.inputFiles() if left and docs is not None else []
    used = {path for path in left if any(os.path.basename(path) in f for f in files)}
    common.delete(spark, [path for path in left if path not in used])
    _LEFT[spark.sparkContext.applicationId] = sorted(used)


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose votes speak for them."""
    return quality.keep_good(docs)


@staged
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return exact_dedup.drop_copies(docs)


@staged
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts (five words, 0.8 or more), the one with the smallest id."""
    return jaccard_join.keep_one(docs)


@staged
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes covered by a 200-byte string that also starts elsewhere; n_chars counts what is left."""
    return suffix_dedup.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

#: Learned votes, components and token ids are beyond SQL; tests/llm compares run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    clear(spark)
    return docs

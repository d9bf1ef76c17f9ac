"""Sinks of streams that end: a table of what came out, and an exactly-once split into clean and quarantined records."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ownerscope.operators.integrity import running_failures, split_quarantine
from ownerscope.session import checkpoint_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"ownerscope-{kind}-{uuid.uuid4().hex}")


def landed(df: DataFrame, path: str) -> None:
    """Adds a batch of rows to a landing folder."""
    df.write.mode("append").parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what has landed and returns all it gave: appended rows, or the last complete result."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is replayed writes the same folder again
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'batch=' + str(batch_id) if mode == 'append' else 'all'}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start()
    query.awaitTermination()
    if not _exists(spark, f"{folder}/rows"):  # nothing has landed
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/*")


class SplitSink:
    """Clean and quarantined records under one batch id, exactly once.

    Each batch overwrites its own partition of every table and then its commit, so a batch that is replayed, whole or after it
    broke off between the tables, leaves the same rows. Readers see committed batches only. Failures of a source count over all
    batches in arrival order: a batch starts from the sums of the committed batches before it, never from its own.
    """

    TABLES = ("clean", "quarantined", "failures")

    def __init__(self, spark: SparkSession, folder: str, schema, payload: list[str], source: str = "source",
                 order: list[str] | None = None, limit: int = 5):
        self.folder, self.payload, self.source, self.order, self.limit = folder, payload, source, order or [], limit
        empty = spark.createDataFrame([], schema).withColumn("failures", F.lit(0).cast("bigint"))
        clean, held = split_quarantine(empty, payload)
        self.schemas = {"clean": clean.schema, "quarantined": held.schema, "failures": empty.select(source, "failures").schema}

    def _put(self, name: str, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")

    def committed(self, spark: SparkSession, name: str) -> DataFrame:
        """A table's rows of committed batches, with their ``batch``."""
        schema = StructType([*self.schemas[name].fields, StructField("batch", LongType())])
        # the folders exist from the first commit on
        if not _exists(spark, f"{self.folder}/commits"):
            return spark.createDataFrame([], self.schemas[name]).withColumn("batch", F.lit(0).cast("bigint"))
        done = spark.read.schema("rows bigint, batch bigint").parquet(f"{self.folder}/commits").select("batch")
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}").join(done, "batch", "left_semi").select(schema.fieldNames())

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: checked records with ``failed`` and ``action``."""
        spark = batch.sparkSession
        before = self.committed(spark, "failures").where(F.col("batch") < batch_id).groupBy(self.source).agg(F.sum("failures").alias("_before"))
        counted = running_failures(batch, self.source, self.order, self.limit, before=before)
        clean, held = split_quarantine(counted, self.payload)
        self._put("clean", clean, batch_id)
        self._put("quarantined", held, batch_id)
        self._put("failures", counted.groupBy(self.source).agg(F.count_if("failed").alias("failures")), batch_id)
        self._put("commits", clean.agg(F.count("*").alias("rows")), batch_id)

    def run(self, stream: DataFrame) -> None:
        """Splits all that has landed."""
        stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

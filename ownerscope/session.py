"""Session helper: settings the library relies on."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def get_session(cores: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ownerscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's setting or the context's checkpoint folder; only a local master
    may fall back to a folder of its own machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if of_context.isDefined():
        return of_context.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def materialize(df: DataFrame) -> DataFrame:
    """Write a result used more than once to the shared folder and read it back.

    The work before it runs once, its plan stays out of the plans that follow,
    and lost executors read it again instead of recomputing it.
    """
    path = os.path.join(checkpoint_dir(df.sparkSession), f"ownerscope-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose expression later filters and projections do not inline.

    The optimizer pushes a filter on a computed column below the projection by
    repeating the expression; it does not do so through a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: setting of the caller: into how many partitions inputs with much work per row are dealt before that work
PARTITIONS = "spark.ownerscope.partitions"


def dealt(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as the session says, or as they are read where it says nothing.

    A scan cannot split a row group, so a table in few large row groups leaves most cores idle; only the caller knows both.
    """
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, where it isn't installed there."""
    context = spark.sparkContext
    if getattr(context, "_ownerscope_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="spark-")  # the driver's copy; Spark serves it to the executors
    archive = shutil.make_archive(os.path.join(folder, "ownerscope"), "zip", root, "ownerscope")
    context.addPyFile(archive)
    context._ownerscope_shipped = True

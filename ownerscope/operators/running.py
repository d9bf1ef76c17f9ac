"""Running values per key that survive a hot key.

A window over a whole key sorts that key in one task. Here the rows are cut into chunks of bounded size: a range partitioning by
(key, order) samples its splitters from the rows, so a key with most of the rows is cut into many chunks and many small keys share
one. Totals per (key, chunk) come first, their running value over the few chunks of a key is the carry, and the ordered window
only covers one chunk of one key.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ownerscope.session import materialize

PART = "_part"


def balanced(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The rows with ``_part``, a chunk number that does not decrease along (keys, order).

    Written once: the numbers follow from sampled splitters, and totals and rows must agree on them.
    """
    return materialize(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str | Column], chunk: Column,
            sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
            inclusive: bool = True) -> DataFrame:
    """Adds running sums (0 based) and maxima (null based) in order within each key.

    ``chunk`` must not decrease along ``order``; ``inclusive=False`` leaves the
    current row out. Rows without a key form a key of their own, and rows without
    an order come first.
    """
    sums, maxes = sums or {}, maxes or {}
    base = df.withColumn("_chunk", chunk)
    for name, value in {**sums, **maxes}.items():
        base = base.withColumn("_v_" + name, value)
    totals = base.groupBy(*keys, "_chunk").agg(
        *[F.sum("_v_" + n).alias("_t_" + n) for n in sums], *[F.max("_v_" + n).alias("_t_" + n) for n in maxes])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    side = {k: f"_k{i}" for i, k in enumerate([*keys, "_chunk"])}
    carry = totals.select(*[F.col(k).alias(own) for k, own in side.items()],
                          *[F.sum("_t_" + n).over(before).alias("_c_" + n) for n in sums],
                          *[F.max("_t_" + n).over(before).alias("_c_" + n) for n in maxes])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(own)) for k, own in side.items()])
    out = base.join(carry, same, "left").drop(*side.values())
    for n in sums:
        out = out.withColumn(n, F.coalesce("_c_" + n, F.lit(0)) + F.coalesce(F.sum("_v_" + n).over(inside), F.lit(0)))
    for n in maxes:
        out = out.withColumn(n, F.greatest("_c_" + n, F.max("_v_" + n).over(inside)))
    return out.drop("_chunk", *["_v_" + n for n in (*sums, *maxes)], *["_c_" + n for n in (*sums, *maxes)])


def idle_sessions(df: DataFrame, keys: list[str], ts: str, order: list[str], gap_seconds: float,
                  name: str = "session") -> DataFrame:
    """Numbers the stretches of a key that are separated by at least ``gap_seconds``."""
    us, chunk = F.unix_micros(F.col(ts).cast("timestamp")), F.col(PART)
    out = running(balanced(df, keys, order), keys, order, chunk, maxes={"_prev": us}, inclusive=False)
    fresh = F.coalesce(us - F.col("_prev") >= int(gap_seconds * 1_000_000), F.lit(True))
    return running(out.withColumn("_new", fresh.cast("bigint")), keys, order, chunk,
                   {name: F.col("_new")}).drop("_prev", "_new", PART)

"""Join helpers: size-checked broadcast and the range join.

A side is broadcast only if the planner's own size estimate of it (file bytes, pruned columns) is
below a byte bound. The estimate is read from the optimized plan: no job runs, nothing is collected.
Above the bound the plain DataFrame is returned and Spark/AQE choose a shuffle join, or convert
it at runtime when the shuffled side turns out small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the bytes ``df`` yields (very large where it knows nothing)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    return planned_bytes(df) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if its estimated size is below the bound."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def range_join(left: DataFrame, ranges: DataFrame, value: Column, low: Column,
               high: Column | None, extra: Column | None = None) -> DataFrame:
    """Rows of ``left`` joined with every range ``low <= value <= high`` of dates or timestamps.

    ``high`` NULL means an open end. Each range is spread over the months it covers, up to the
    greatest month that ``left`` has, so the join is an equi-join on the month with the exact condition
    behind it: any number of ranges works, and a month's rows can be split like any other join key.
    """
    keyed = left.withColumn("_month", F.trunc(value, "month"))
    last = keyed.agg(F.max("_month").alias("_last"), F.min("_month").alias("_first"))  # one row
    first, end = F.greatest(F.trunc(low, "month"), F.col("_first")), F.lit(None) if high is None else F.trunc(high, "month")
    spread = (ranges.join(F.broadcast(last))
              .withColumn("_from", first).withColumn("_to", F.least(F.coalesce(end, F.col("_last")), F.col("_last")))
              .filter(F.col("_from") <= F.col("_to"))
              .withColumn("_month", F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))))
              .drop("_from", "_to", "_first", "_last"))
    cond = (value >= low) & (high.isNull() | (value <= high)) if high is not None else (value >= low)
    if extra is not None:
        cond = cond & extra
    return keyed.join(broadcast_if_small(spread), "_month").filter(cond).drop("_month")

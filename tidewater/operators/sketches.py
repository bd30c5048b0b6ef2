"""Mergeable distinct counts (AGG-3): one HyperLogLog sketch per day, merged for any range.

An exact COUNT(DISTINCT) over a range has to see every value again. A sketch of a day is written once (at most
2**lg_k bytes per group), is merged with others by a union that does not depend on their order, and estimates the distinct
values of any set of days. Relative standard error: about 1.04 / sqrt(2**lg_k); ``error_bound`` gives three of it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12


def error_bound(lg_k: int = LG_K) -> float:
    """Three relative standard errors."""
    return 3 * 1.04 / math.sqrt(2 ** lg_k)


def daily_sketches(df: DataFrame, ts: str, value: str, dims: list[str], lg_k: int = LG_K) -> DataFrame:
    """(day, dims, sketch, values): a sketch of ``value`` per day and group, and how many values went in. NULL values and
    NULL times count for nothing. Partial sketches are merged before the shuffle, so a busy day sends one per task."""
    return (df.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day"), *dims)
            .agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"), F.count(value).alias("values")))


def merged_distinct(sketches: DataFrame, dims: list[str], first=None, last=None) -> DataFrame:
    """(dims, estimate): distinct values per group over the days ``first`` to ``last`` (both ends included, None: open)."""
    own = sketches
    if first is not None:
        own = own.filter(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        own = own.filter(F.col("day") <= F.lit(last).cast("date"))
    return own.groupBy(*dims).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))

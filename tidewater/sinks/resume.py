"""Full load by key ranges that goes on where it stopped (SNK-3).

A manifest, written once, cuts a table into ranges of one column. Each range is written to a folder of its own and then
marked as done, with its number of rows; a load that died is started again in the same way and writes only the ranges
without a mark, over whatever a dead task left. Readers take the marked ranges alone. Ranges are loaded by up to
``max_parallel`` threads of the driver; the driver holds the bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import is_missing
from .target import MAX_PARALLEL_TABLES


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if is_missing(error):
            return None
        raise


def plan_ranges(df: DataFrame, key: str, ranges: int) -> DataFrame:
    """(part, lo, hi): ``ranges`` ranges lo <= key < hi of about as many rows (NULL: open end), and part -1 for NULL keys.

    The cuts are approximate quantiles; equal keys always share a range."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    if kind == "string":
        raise ValueError("give a key column with an order that quantiles know: a number, date or timestamp")
    shares = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), 10 * ranges).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []))
    rows = [(-1, None, None), *[(i, a, b) for i, (a, b) in enumerate(zip([None, *cuts], [*cuts, None]))]]
    return spark.createDataFrame(rows, f"part int, lo {kind}, hi {kind}")


def _within(key: str, part: int, lo, hi) -> Column:
    if part < 0:
        return F.col(key).isNull()
    bounds = [F.col(key).isNotNull()] + ([F.col(key) >= F.lit(lo)] if lo is not None else []) + ([F.col(key) < F.lit(hi)] if hi is not None else [])
    return reduce(lambda a, b: a & b, bounds)


def resumable_load(df: DataFrame, root: str, key: str, ranges: int = 16, max_parallel: int = MAX_PARALLEL_TABLES,
                   before_part: Callable[[int], None] | None = None) -> list[int]:
    """Load ``df`` under ``root`` and return the parts that this call wrote. Repeat after a failure.

    The manifest of the first call stays: a row that the source got since then goes to its range, or is left to the
    change log if that was loaded already. ``before_part`` is called with each part's number before it is written.
    """
    spark = df.sparkSession
    base = root.rstrip("/")
    manifest = _read(spark, f"{base}/_manifest")
    if manifest is None:
        plan_ranges(df, key, ranges).coalesce(1).write.mode("overwrite").parquet(f"{base}/_manifest")
        manifest = spark.read.parquet(f"{base}/_manifest")
    done = done_parts(spark, root)
    open_parts = [r for r in manifest.orderBy("part").collect() if r.part not in done]

    def load(r) -> int:
        if before_part is not None:
            before_part(r.part)
        path = f"{base}/part={r.part}"
        df.filter(_within(key, r.part, r.lo, r.hi)).write.mode("overwrite").parquet(path)
        n = spark.read.schema(df.schema).parquet(path).count()
        spark.createDataFrame([(r.part, n)], "part int, n long").coalesce(1).write.mode("overwrite").parquet(f"{base}/_done/{r.part}")
        return r.part

    with ThreadPoolExecutor(max_workers=max(1, max_parallel)) as pool:
        return list(pool.map(load, open_parts))


def done_parts(spark: SparkSession, root: str) -> dict[int, int]:
    """Rows per range that is loaded."""
    marks = _read(spark, f"{root.rstrip('/')}/_done/*")
    return {} if marks is None else {r.part: r.n for r in marks.collect()}


def load_complete(spark: SparkSession, root: str) -> bool:
    manifest = _read(spark, f"{root.rstrip('/')}/_manifest")
    return manifest is not None and {r.part for r in manifest.collect()} <= set(done_parts(spark, root))


def read_loaded(spark: SparkSession, root: str, schema) -> DataFrame:
    """The rows of the ranges that are loaded."""
    paths = [f"{root.rstrip('/')}/part={p}" for p in sorted(done_parts(spark, root))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

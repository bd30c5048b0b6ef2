"""Validation and audit (VAL-1, VAL-2, VAL-3).

Count parity compares exact row counts of each table on the source and the
target side; a side that cannot be read is an error, not a zero. The
target name of a table goes through the same rename function the loader
used, so a prefixed load is compared with its own source table.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import signed_delta_status, starts_with_any

COUNTS_SCHEMA = T.StructType([T.StructField("table_name", T.StringType()),
                              T.StructField("row_count", T.LongType()),
                              T.StructField("readable", T.BooleanType())])


# what Spark says of files that are not there or cannot be read as a table; all other failures are raised
_UNREADABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "FileNotFoundException",
               "is not a Parquet file")


def is_unreadable(error: Exception) -> bool:
    """True for errors that say that a table's files are missing or corrupt; not for lost executors or full disks."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    return condition.startswith(_UNREADABLE[:4]) or any(mark in str(error) for mark in _UNREADABLE)


def table_counts(spark: SparkSession, tables: dict[str, DataFrame | None], max_parallel: int = 8) -> DataFrame:
    """(table_name, row_count, readable) for every named table; None = unreadable.

    Each table is counted by a job of its own (from file footers where the store allows), up to ``max_parallel`` at
    a time, so that one whose files are missing or corrupt becomes unreadable instead of failing the others. Any
    other failure is raised.
    """
    def count(item: tuple[str, DataFrame | None]) -> tuple[str, int | None, bool]:
        name, df = item
        try:
            return name, None if df is None else df.count(), df is not None
        except (Py4JJavaError, PySparkException) as error:
            if is_unreadable(error):
                return name, None, False
            raise

    with ThreadPoolExecutor(max_workers=max_parallel) as pool:
        return spark.createDataFrame(list(pool.map(count, tables.items())), COUNTS_SCHEMA)


def count_parity(spark: SparkSession, source: dict[str, DataFrame | None], target: dict[str, DataFrame | None],
                 tables: list[str], rename: Callable[[str], str] = lambda t: t) -> DataFrame:
    """Per table: source rows, target rows, delta = target - source, status.

    status is ``MATCH``, ``MISMATCH`` or ``ERR`` (either side unreadable);
    ``label`` repeats it the way the source script prints it (MATCH, the
    signed delta, or ERR).
    """
    src = table_counts(spark, {t: source.get(t) for t in tables})
    dst = table_counts(spark, {t: target.get(rename(t)) for t in tables})
    s, d = src.alias("s"), dst.alias("d")
    j = s.join(d, F.col("s.table_name") == F.col("d.table_name"), "full")
    ok = F.col("s.readable") & F.col("d.readable")
    return j.select(
        F.coalesce("s.table_name", "d.table_name").alias("table_name"),
        F.col("s.row_count").alias("source_rows"),
        F.col("d.row_count").alias("target_rows"),
        F.when(ok, F.col("d.row_count") - F.col("s.row_count")).alias("delta"),
        F.when(~ok, F.lit("ERR")).when(F.col("s.row_count") == F.col("d.row_count"), F.lit("MATCH"))
        .otherwise(F.lit("MISMATCH")).alias("status"),
        signed_delta_status("s.row_count", "d.row_count", "s.readable", "d.readable").alias("label"),
    ).withColumn("target_table", _rename_col(rename, tables))


def _rename_col(rename, tables) -> Column:
    expr = None
    for t in tables:
        expr = (F.when(F.col("table_name") == t, F.lit(rename(t))) if expr is None
                else expr.when(F.col("table_name") == t, F.lit(rename(t))))
    return expr


def cutover_gate(parity: DataFrame, raise_on_fail: bool = False) -> DataFrame:
    """One row: passed / failed / total and whether cutover may proceed (VAL-2)."""
    out = parity.agg(
        F.sum(F.when(F.col("status") == "MATCH", 1).otherwise(0)).cast("long").alias("passed"),
        F.sum(F.when(F.col("status") != "MATCH", 1).otherwise(0)).cast("long").alias("failed"),
        F.count(F.lit(1)).cast("long").alias("total"))
    out = out.withColumn("safe_to_cutover", F.col("failed") == 0)
    if raise_on_fail:
        row = out.first()
        if not row["safe_to_cutover"]:
            raise RuntimeError(f"cutover blocked: {row['failed']} of {row['total']} tables differ")
    return out


UNREADABLE = ":unreadable"


def audit_snapshot(spark: SparkSession, tables: dict[str, DataFrame | None], recorded_at: Column | None = None,
                   event: str = "post_load_snapshot",
                   exclude_prefixes: tuple[str, ...] = ("_",)) -> DataFrame:
    """Audit rows (event, table_name, row_count, recorded_at) with exact counts
    (VAL-3). Internal tables are skipped by literal prefix, not by LIKE. A table that cannot be read has no count,
    and its event says so."""
    keep = {n: df for n, df in tables.items() if not n.startswith(tuple(exclude_prefixes))}
    counts = table_counts(spark, keep).filter(~starts_with_any("table_name", list(exclude_prefixes)))
    ts = recorded_at if recorded_at is not None else F.current_timestamp()
    said = F.when(F.col("readable"), F.lit(event)).otherwise(F.lit(event + UNREADABLE))
    return counts.select(said.alias("event"), "table_name", "row_count", ts.alias("recorded_at"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """The appended audit rows with their ids, in order of time, event and table."""
    from .keys import assign_ids
    return assign_ids(spark.read.parquet(path), "audit_id", ["recorded_at", "event", "table_name"])

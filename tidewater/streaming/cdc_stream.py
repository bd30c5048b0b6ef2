"""Two-phase migration: full load, then changes (CDC-1), as Structured Streaming.

Phase one writes the snapshot as version 0 of a versioned target. Phase two
follows the change stream from the snapshot position: every micro-batch is
applied with ``apply_changes`` inside ``foreachBatch`` and committed as
version ``batch_id + 1``. A batch that is replayed after a failure finds its
version already committed and is skipped; even if it ran again, changes at or
below each row's ``_pos`` are ignored, so replays cannot double-apply.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cdc import (after_position, apply_changes, live, select_changes, snapshot_target,
                             split_key_changes)
from ..sinks.target import (current_version, merge_into_buckets, read_bucketed, read_current, select_tables,
                            write_bucketed, write_version)
from ..sources.tables import is_missing


def migrate(spark: SparkSession, snapshot: DataFrame, changes: DataFrame, target_root: str, key: str,
            columns: list[str], start_pos, checkpoint_location: str, pos: str = "pos", op: str = "op",
            available_now: bool = True, processing_time: str | None = None, buckets: int | None = None,
            applied_root: str | None = None, clock: Callable[[int], dt.datetime] | None = None):
    """Run both phases; returns the streaming query (already finished when
    ``available_now``). Read the result with ``read_live``.

    With ``buckets`` the target is partitioned by key hash and each
    micro-batch rewrites only the buckets its keys fall in (the layout for
    large tables); without, every batch commits a new version of the whole
    table (atomic switch, fine for small tables). With ``applied_root`` the time at which each
    change was committed is recorded there (``record_applied``, by ``clock``; read it with ``applied_times``).
    """
    def applied(batch: DataFrame, batch_id: int) -> None:
        if applied_root is not None:
            record_applied(batch, applied_root, batch_id, pos, clock)

    if buckets is not None:
        return _migrate_bucketed(spark, snapshot, changes, target_root, key, columns, start_pos,
                                 checkpoint_location, pos, op, available_now, processing_time, buckets, applied)
    if current_version(spark, target_root) is None:
        write_version(snapshot_target(snapshot.select(key, *columns), start_pos), target_root, 0)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        done = current_version(spark, target_root)
        if done is None or done < version:  # else committed before a restart
            current = read_current(spark, target_root)
            new = apply_changes(current, batch, key, columns, pos=pos, op=op)
            write_version(new, target_root, version)
        applied(batch, batch_id)

    writer = (after_position(changes, start_pos, pos).writeStream
              .foreachBatch(apply_batch).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time or "1 minute")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def _migrate_bucketed(spark, snapshot, changes, target_root, key, columns, start_pos, checkpoint_location,
                      pos, op, available_now, processing_time, buckets, applied):
    marker = f"{target_root.rstrip('/')}/_snapshot_done"
    if current_version(spark, marker) is None:
        write_bucketed(snapshot_target(snapshot.select(key, *columns), start_pos), f"{target_root}/data",
                       key, buckets)
        write_version(spark.range(0), marker, 0)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        merge_into_buckets(spark, f"{target_root}/data", batch, key, buckets,
                           lambda cur, ch: apply_changes(cur, ch, key, columns, pos=pos, op=op), batch_id + 1)
        applied(batch, batch_id)
        batch.unpersist()

    writer = (after_position(changes, start_pos, pos).writeStream
              .foreachBatch(apply_batch).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time or "1 minute")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


@dataclass(frozen=True)
class MigratedTable:
    """A table of a migration: its snapshot (at position ``start_pos``), key columns and other columns."""

    snapshot: DataFrame
    key: list[str]
    columns: list[str]


def migrate_tables(spark: SparkSession, tables: dict[str, MigratedTable], changes: DataFrame, target_root: str,
                   checkpoint_location: str, start_pos=-1, include: list[str] | None = None,
                   exclude: list[str] | None = None, prefix: str = "", buckets: int = 16, available_now: bool = True,
                   processing_time: str | None = None):
    """Both phases for many tables from one change log.

    ``changes``: table_name, pos, op, and the row images before and after as JSON. The load's selection and
    rename apply to the log too; a key-changing update deletes the old key and inserts the new one; late and
    replayed changes lose against what a row already has. Read a table with
    ``read_live(spark, f"{target_root}/{prefix}{table}")``.
    """
    chosen = {prefix + t: tables[t] for t in select_tables(spark, sorted(tables), include or ["%"], exclude or [])}
    for name, table in chosen.items():
        root = f"{target_root.rstrip('/')}/{name}"
        if current_version(spark, f"{root}/_snapshot_done") is None:
            write_bucketed(snapshot_target(table.snapshot.select(*table.key, *table.columns), start_pos), f"{root}/data",
                           table.key, buckets)
            write_version(spark.range(0), f"{root}/_snapshot_done", 0)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        batch = select_changes(batch, include or ["%"], exclude, prefix).persist()
        for name, table in chosen.items():
            types = table.snapshot.select(*table.key, *table.columns).schema
            before = F.from_json("before", table.snapshot.select(*table.key).schema)
            rows = (batch.filter(F.col("table_name") == name)
                    .select("pos", "op", F.from_json(F.coalesce("after", "before"), types).alias("_a"), before.alias("_b"))
                    .select("pos", "op", "_a.*", *[F.col(f"_b.{k}").alias(f"_before_{k}") for k in table.key]))
            rows = split_key_changes(rows, table.key, [f"_before_{k}" for k in table.key])
            merge_into_buckets(spark, f"{target_root.rstrip('/')}/{name}/data", rows, table.key, buckets,
                               lambda cur, ch, t=table: apply_changes(cur, ch, t.key, t.columns), batch_id + 1)
        batch.unpersist()

    writer = (after_position(changes, start_pos).writeStream
              .foreachBatch(apply_batch).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time or "1 minute")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def record_applied(batch: DataFrame, root: str, batch_id: int, pos: str = "pos",
                   clock: Callable[[int], dt.datetime] | None = None) -> None:
    """Write the batch's log positions with the time of its commit: now, or ``clock(batch_id)``. A batch that was
    recorded before a restart keeps its time."""
    path = f"{root.rstrip('/')}/batch={batch_id}"
    try:
        batch.sparkSession.read.parquet(path)
        return
    except AnalysisException as error:
        if not is_missing(error):
            raise
    at = clock(batch_id) if clock else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    batch.select(F.col(pos).cast("long").alias("pos"), F.lit(at).cast("timestamp_ntz").alias("applied_at")).write.mode("overwrite").parquet(path)


def applied_times(spark: SparkSession, root: str) -> DataFrame:
    """(pos, applied_at): when each change was first committed to the target (UTC wall clock)."""
    return spark.read.parquet(root).groupBy("pos").agg(F.min("applied_at").alias("applied_at"))


def read_live(spark: SparkSession, target_root: str) -> DataFrame:
    """Current rows of a migrated table (tombstones removed)."""
    if current_version(spark, f"{target_root.rstrip('/')}/_snapshot_done") is not None:
        return live(read_bucketed(spark, f"{target_root}/data"))
    return live(read_current(spark, target_root))

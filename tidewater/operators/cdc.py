"""Change-data-capture apply (CDC-2..CDC-5).

A change row carries the position in the source log (``pos``), the
operation (``I``/``U``/``D``), the key and the full after-image of the row.
Applying a batch of changes to a target:

* per key only the latest change (greatest ``pos``) matters: a grouped
  ``max_by`` with map-side partial aggregation, so a key with very many
  changes costs one row per task before the shuffle;
* the target keeps ``_pos``, the position of the last change applied to each
  key; a change at or below it is a late or replayed duplicate and is
  ignored (CDC-3), which makes a re-run of the same batch a no-op;
* deletes leave a tombstone (``_deleted`` true, ``_pos`` kept) so a late
  update cannot revive a deleted row; ``live`` hides tombstones;
* an update whose before-key differs from its after-key becomes a delete of
  the old key plus an upsert of the new one (``split_key_changes``).

Keys are unique on both sides of the final join, so it has no hot keys
regardless of how skewed the change log is; a batch that is small after the
per-key reduction is broadcast and the target is not shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import like_any
from .joins import BROADCAST_BYTES, is_small
from .merge import keyed_outer_join, latest_per_key

INSERT, UPDATE, DELETE = "I", "U", "D"


def snapshot_target(df: DataFrame, pos=-1) -> DataFrame:
    """A full-load snapshot as a CDC target: every row at position ``pos``."""
    return df.withColumn("_pos", F.lit(pos).cast("long")).withColumn("_deleted", F.lit(False))


def live(target: DataFrame) -> DataFrame:
    """Rows that exist (tombstones removed), without the bookkeeping columns."""
    return target.filter(~F.col("_deleted")).drop("_deleted")


def split_key_changes(changes: DataFrame, key: str | list[str], before_key: str | list[str], op: str = "op") -> DataFrame:
    """Rewrite key-changing updates as delete(old key) + upsert(new key)."""
    key, before = ([k] if isinstance(k, str) else list(k) for k in (key, before_key))
    known, differs = F.lit(True), F.lit(False)
    for k, b in zip(key, before):
        known, differs = known & F.col(b).isNotNull(), differs | (F.col(b) != F.col(k))
    moved = F.coalesce((F.col(op) == UPDATE) & known & differs, F.lit(False))
    deletes = (changes.filter(moved).withColumns({k: F.col(b) for k, b in zip(key, before)})
               .withColumn(op, F.lit(DELETE)))
    return changes.withColumn(op, F.when(moved, F.lit(INSERT)).otherwise(F.col(op))).unionByName(deletes)


def apply_changes(target: DataFrame, changes: DataFrame, key: str | list[str], columns: list[str],
                  pos: str = "pos", op: str = "op", keep_tombstones: bool = True,
                  max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Apply a batch of changes to a target that has ``_pos`` / ``_deleted``.

    ``columns`` are the row columns (besides the key) taken from the change's
    after-image. Deletes among equal positions are ordered after inserts and
    updates of the same position (a key change at one position).
    """
    key = [key] if isinstance(key, str) else list(key)
    rank = F.when(F.col(op) == DELETE, 1).otherwise(0)
    ch = changes.select(*key, F.struct(F.col(pos).alias("p"), rank.alias("r")).alias("_ord"),
                        F.col(pos).alias("_cpos"), F.col(op).alias("_op"), *[F.col(c).alias(f"_c_{c}") for c in columns])
    last = latest_per_key(ch, key, "_ord").drop("_ord")
    if "_pos" not in target.columns:
        target = snapshot_target(target)
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in [*key, *columns, "_pos", "_deleted"]])
    j = keyed_outer_join(t, last, [f"_t_{k}" for k in key], key, max_broadcast_bytes,
                         small=is_small(changes, max_broadcast_bytes))
    newer = F.col("_in_s").isNotNull() & (F.col("_in_t").isNull() | F.col("_t__pos").isNull() | (F.col("_cpos") > F.col("_t__pos")))
    is_del = F.col("_op") == DELETE
    out_cols = [F.coalesce(F.col(f"_t_{k}"), F.col(k)).alias(k) for k in key]
    for c in columns:
        out_cols.append(F.when(newer & ~is_del, F.col(f"_c_{c}"))
                        .when(newer & is_del, F.lit(None))
                        .otherwise(F.col(f"_t_{c}")).cast(target.schema[c].dataType).alias(c))
    out_cols.append(F.when(newer, F.col("_cpos")).otherwise(F.col("_t__pos")).cast("long").alias("_pos"))
    out_cols.append(F.when(newer, is_del).otherwise(F.col("_t__deleted")).alias("_deleted"))
    out = j.select(*out_cols)
    return out if keep_tombstones else out.filter(~F.col("_deleted"))


def cdc_latency(changes: DataFrame, committed: str = "committed_at", captured: str = "captured_at",
                applied: str | None = None) -> DataFrame:
    """Source latency (capture - commit) and, if given, target latency
    (apply - commit), in seconds, exact to the microsecond (CDC-4)."""
    def secs(later, earlier):
        micros = F.timestamp_diff("MICROSECOND", F.col(earlier), F.col(later))
        return (micros.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    out = changes.withColumn("source_latency_s", secs(captured, committed))
    if applied is not None:
        out = out.withColumn("target_latency_s", secs(applied, committed))
    return out


def after_position(changes: DataFrame, start_pos, pos: str = "pos") -> DataFrame:
    """Changes that follow a snapshot taken at ``start_pos`` (CDC-1 phase two)."""
    return changes.filter(F.col(pos) > F.lit(start_pos))


def select_changes(changes: DataFrame, include: list[str], exclude: list[str] | None = None,
                   prefix: str = "", table: str = "table_name") -> DataFrame:
    """The load's table selection (LIKE patterns) and rename applied to the
    change log too (CDC-5), so both phases land in the same target tables."""
    out = changes.filter(like_any(table, include) & ~like_any(table, exclude or []))
    return out.withColumn(table, F.concat(F.lit(prefix), F.col(table))) if prefix else out


def purge_tombstones(target: DataFrame, keep_after_pos) -> DataFrame:
    """Drop tombstones at or below a log position (tombstone retention).

    Once every change up to ``keep_after_pos`` has been applied, no late
    change can still refer to those deletes, so their tombstones can go.
    """
    return target.filter(~F.col("_deleted") | (F.col("_pos") > F.lit(keep_after_pos)))

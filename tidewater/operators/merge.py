"""Data-changing operators (DML-1, DML-2, DML-5).

Parquet tables cannot be updated in place (``MERGE INTO`` needs a table
format that is not installed), so a change produces a new version of the
table as a DataFrame; ``sinks.target.write_version`` commits it by writing a
new folder and switching the pointer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import BROADCAST_BYTES, is_small


def keyed_outer_join(t: DataFrame, s: DataFrame, t_keys: list[str], s_keys: list[str],
                     max_broadcast_bytes: int = BROADCAST_BYTES, small: bool | None = None) -> DataFrame:
    """Full outer join of a target with a batch that is unique per key, with
    ``_in_t`` / ``_in_s`` markers (NULL when that side has no row).

    Small batch (estimated bytes): target LEFT JOIN broadcast(batch) streams the
    target without a shuffle; the batch rows with new keys are found with a
    broadcast semi-join over the target's key columns only, and appended.
    Large batch: one shuffled full outer join. ``small`` lets the caller
    decide from the raw batch instead of ``s``, which may be an aggregate.
    """
    t = t.withColumn("_in_t", F.lit(True))
    s = s.withColumn("_in_s", F.lit(True))
    cond = None
    for tk, sk in zip(t_keys, s_keys):
        c = t[tk] == s[sk]
        cond = c if cond is None else cond & c
    if not (is_small(s, max_broadcast_bytes) if small is None else small):
        return t.join(s, cond, "full")
    sb = F.broadcast(s)
    matched = t.join(sb, cond, "left")
    seen = (t.select(*[F.col(k).alias(sk) for k, sk in zip(t_keys, s_keys)])
            .join(F.broadcast(s.select(*s_keys)), s_keys, "left_semi"))
    new = s.join(seen, s_keys, "left_anti")
    for f in t.schema.fields:
        new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
    return matched.unionByName(new.select(*matched.columns))


def latest_per_key(df: DataFrame, key: list[str], order_by: str) -> DataFrame:
    """Keep, per key, the row with the greatest ``order_by`` (the last write wins).

    A grouped ``max_by`` on a struct of the row: partial aggregation runs
    before the shuffle, so a key with very many rows costs one row per task.
    """
    others = [c for c in df.columns if c not in key]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*key).agg(F.max_by(packed, F.col(order_by)).alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]))


def unique_per_key(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, failing when it runs if a key occurs twice (one shuffle on the key, counted before it)."""
    others = [c for c in df.columns if c not in key]
    packed = F.struct(*[F.col(c) for c in others]) if others else F.lit(True)
    one = df.groupBy(*key).agg(F.first(packed).alias("_r"), F.count(F.lit(1)).alias("_n"))
    checked = one.withColumn("_r", F.when(F.col("_n") == 1, F.col("_r")).otherwise(
        F.raise_error(F.lit(f"repeated key ({', '.join(key)}) in the batch: give order_by"))))
    return checked.filter(F.col("_r").isNotNull()).select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def upsert(target: DataFrame, source: DataFrame, key: list[str] | str, update_cols: list[str],
           touch: str | None = None, now: Column | None = None, touch_always: bool = False,
           order_by: str | None = None, max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Keyed upsert with a per-table list of columns to overwrite (DML-1).

    * key in both: ``update_cols`` take the incoming value, every other
      column keeps the target value; ``touch`` (e.g. updated_at) is set to
      ``now`` when an updated column really changed (CON-13), with
      ``touch_always`` on every match.
    * key only in source: the incoming row is inserted (``touch`` = now).
    * key only in target: unchanged.

    Duplicate keys inside the source batch: with ``order_by`` the last one
    wins (as applying the rows in order would); without it a repeated key
    fails the query. Keys are unique on both sides, so the join has no hot
    keys; a batch of at most ``max_broadcast_bytes`` rows is broadcast and the
    target is not shuffled (``keyed_outer_join``).
    """
    return _upserted(target, source, key, update_cols, touch, now, touch_always, order_by, max_broadcast_bytes).drop("_fresh")


def _upserted(target: DataFrame, source: DataFrame, key: list[str] | str, update_cols: list[str], touch: str | None,
              now: Column | None, touch_always: bool, order_by: str | None, max_broadcast_bytes: int) -> DataFrame:
    """The upserted table, with ``_fresh`` for the rows that the target did not have. One join."""
    key = [key] if isinstance(key, str) else list(key)
    now = now if now is not None else F.current_timestamp()
    small = is_small(source, max_broadcast_bytes)  # raw batch: at least as big as the deduplicated one
    if order_by is not None:
        source = latest_per_key(source, key, order_by).drop(order_by) if order_by not in target.columns \
            else latest_per_key(source, key, order_by)
    else:
        source = unique_per_key(source, key)
    tcols = target.columns
    t = target.select(*[F.col(c).alias(f"t__{c}") for c in tcols])
    s = source.select(*[F.col(c).alias(f"s__{c}") for c in source.columns])
    j = keyed_outer_join(t, s, [f"t__{k}" for k in key], [f"s__{k}" for k in key], max_broadcast_bytes, small)
    in_t, in_s = F.col("_in_t").isNotNull(), F.col("_in_s").isNotNull()
    changed = F.lit(False)
    for c in update_cols:
        changed = changed | ~F.col(f"t__{c}").eqNullSafe(F.col(f"s__{c}"))
    out = []
    for c in tcols:
        tc = F.col(f"t__{c}")
        sc = F.col(f"s__{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        if c in key:
            v = F.coalesce(tc, sc)
        elif c == touch:
            v = (F.when(in_t & in_s, F.when(F.lit(touch_always) | changed, now).otherwise(tc))
                 .when(in_s, F.coalesce(sc, now)).otherwise(tc))
        elif c in update_cols:
            v = F.when(in_s, sc).otherwise(tc)
        else:
            v = F.when(in_t, tc).otherwise(sc)
        out.append(v.cast(target.schema[c].dataType).alias(c))
    return j.select(*out, F.col("_in_t").isNull().alias("_fresh"))


def upsert_rows(target: DataFrame, source: DataFrame, key: list[str], update_cols: list[str], id_col: str,
                defaults: dict[str, object], order_by: str | None = None, touch: str | None = None,
                now: Column | None = None) -> DataFrame:
    """The upsert with its insert half (DML-1): new rows get the declared defaults where the batch has no
    value, and surrogate ids that go on after the target's greatest, in key order.
    """
    both = _upserted(target, source, key, update_cols, touch, now, False, order_by, BROADCAST_BYTES)
    return both.filter(~F.col("_fresh")).drop("_fresh").unionByName(with_ids(
        target, both.filter("_fresh").drop("_fresh"), key, id_col, defaults, now))


def with_ids(target: DataFrame, fresh: DataFrame, order: list[str], id_col: str, defaults: dict[str, object],
             now: Column | None = None) -> DataFrame:
    """New rows as the target takes them: declared defaults, and ids after the target's greatest, in ``order``."""
    from .integrity import apply_defaults
    from .keys import assign_ids
    fresh = apply_defaults(fresh.drop(id_col), {c: v for c, v in defaults.items() if c in target.columns}, target.schema, now)
    fresh = assign_ids(fresh, id_col, order, existing_max=target.select(id_col))
    return fresh.select(*[
        F.col(f.name).cast(f.dataType) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in target.schema.fields])


def update_where(df: DataFrame, cond: Column, sets: dict[str, Column]) -> DataFrame:
    """``UPDATE t SET c = v WHERE cond`` as a projection (DML-2)."""
    return df.withColumns({c: F.when(cond, v).otherwise(F.col(c)) for c, v in sets.items()})


def mark_migrated(orders: DataFrame, ts: Column | None = None) -> DataFrame:
    """Stamp every order whose ``migrated_at`` is NULL (VAL-5).

    Done as the source script does it: every NULL row is stamped, including
    rows that were created natively on the target.
    """
    ts = ts if ts is not None else F.current_timestamp()
    return update_where(orders, F.col("migrated_at").isNull(),
                        {"migrated_at": ts.cast(orders.schema["migrated_at"].dataType)})


def active(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    """Rows not soft-deleted (DML-5)."""
    return df.filter(F.col(deleted_at).isNull())


def soft_delete(df: DataFrame, cond: Column, ts: Column | None = None, deleted_at: str = "deleted_at") -> DataFrame:
    """Mark matching live rows as deleted instead of removing them."""
    ts = ts if ts is not None else F.current_timestamp()
    return update_where(df, cond & F.col(deleted_at).isNull(),
                        {deleted_at: ts.cast(df.schema[deleted_at].dataType)})

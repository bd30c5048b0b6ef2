"""Upsert on any unique key (DML-1), under the lookup collation.

A source row meets a target row if they agree on the primary key or on any unique key (CON-5, all parts set), strings
compared without regard to case, accents and trailing spaces. All keys of all rows are compared in one join: each side
is laid out as one row per key (number of the key, its parts), so the target's key columns are read once. The
earliest key in the list decides which target row is meant; a row whose keys mean different targets is a conflict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .integrity import LOOKUP_COLLATION, apply_defaults
from .joins import broadcast_if_small
from .merge import latest_per_key, with_ids


@dataclass(frozen=True)
class Resolved:
    """``table``: the target after the upsert. ``conflicts``: (batch columns, reason) of the rows that were not applied."""

    table: DataFrame
    conflicts: DataFrame


def _parts(df: DataFrame, key: list[str], width: int, collation: str) -> list[Column]:
    """The parts of a key as collated strings, all keys of one width."""
    def part(c: str) -> Column:
        return F.col(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("string")
    return [F.collate(F.coalesce(part(c), F.lit("")) if c else F.lit(""), collation) for c in [*key, *[""] * (width - len(key))]]


def _laid_out(df: DataFrame, keys: list[list[str]], collation: str, carry: list[str]) -> DataFrame:
    """One row per row and key without a NULL part: ``carry``, _key (its number) and its parts _p0, _p1, ..."""
    width = max(map(len, keys))
    entries = []
    for number, key in enumerate(keys):
        known = F.lit(True)
        for c in key:
            known = known & F.col(c).isNotNull()
        fields = [F.lit(number).alias("_key"), *[p.alias(f"_p{i}") for i, p in enumerate(_parts(df, key, width, collation))]]
        entries.append(F.when(known, F.struct(*fields)))
    return (df.select(*carry, F.explode(F.array(*entries)).alias("_e")).filter(F.col("_e").isNotNull())
            .select(*carry, "_e.*"))


def upsert_any_key(target: DataFrame, source: DataFrame, primary: str, unique: list[list[str]], update_cols: list[str],
                   defaults: dict[str, object], order_by: str, touch: str | None = None, now: Column | None = None,
                   collation: str = LOOKUP_COLLATION) -> Resolved:
    """Update the target rows that source rows meet by ``primary`` or any key of ``unique``, insert the others.

    Key columns never change (``update_cols`` must not name one). Several source rows that meet one target row: the
    last by ``order_by`` wins. Rows that meet none become one new row if they agree on all keys (the last wins), with
    declared defaults and, where they bring none, the next ids in the order of the first unique key. Reported as conflicts and not applied: rows
    whose keys mean different target rows, and new rows that share one key but differ in another. A row without any key
    set is new. ``touch`` is set to ``now`` where an updated column changed. The batch is checkpointed with a number per row.
    """
    keys = [[primary], *[list(k) for k in unique]]
    every = [c for k in keys for c in k]
    if set(update_cols) & set(every):
        raise ValueError(f"key columns cannot be updated: {sorted(set(update_cols) & set(every))}")
    now = now if now is not None else F.current_timestamp()
    checkpoint_dir(source.sparkSession)
    batch_cols = source.columns
    for c in every:
        if c not in source.columns:
            source = source.withColumn(c, F.lit(None).cast(target.schema[c].dataType))
    batch = source.withColumn("_rid", F.monotonically_increasing_id()).checkpoint(eager=True)
    ours = _laid_out(batch, keys, collation, ["_rid"])
    on = [c for c in ours.columns if c != "_rid"]
    theirs = _laid_out(target.select(*dict.fromkeys(every)).withColumn("_id", F.col(primary)), keys, collation, ["_id"])
    met = theirs.join(broadcast_if_small(ours), on).groupBy("_rid").agg(
        F.min_by("_id", "_key").alias("_id"), (F.min("_id") != F.max("_id")).alias("_several"))
    resolved = batch.join(met, "_rid", "left").checkpoint(eager=True)
    split = resolved.filter(F.col("_several")).withColumn("reason", F.lit("keys of different rows"))
    # rows that meet one target row: the last one's values
    values = [c for c in update_cols if c in batch_cols]
    last = latest_per_key(resolved.filter(~F.col("_several")).select(
        F.col("_id"), F.struct(order_by, "_rid").alias("_order"), *[F.col(c).alias(f"_s_{c}") for c in values]), ["_id"], "_order")
    joined = target.join(broadcast_if_small(last), target[primary] == F.col("_id"), "left")
    hit, changed = F.col("_id").isNotNull(), F.lit(False)
    for c in values:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_s_{c}").cast(target.schema[c].dataType))
    out = []
    for f in target.schema.fields:
        v = F.col(f.name)
        if f.name == touch:
            v = F.when(hit & changed, now).otherwise(v)
        elif f.name in values:
            v = F.when(hit, F.col(f"_s_{f.name}")).otherwise(v)
        out.append(v.cast(f.dataType).alias(f.name))
    updated = joined.select(*out)
    # new rows: one per identity (all unique keys together); a key that two identities share is a conflict of both
    fresh = resolved.filter(F.col("_id").isNull())
    identity = [F.struct(*[F.when(F.col(c).isNotNull(), p).alias(f"p{i}_{j}") for j, (c, p) in enumerate(
        zip(k, _parts(batch, k, len(k), collation)))]).alias(f"_i{i}") for i, k in enumerate(keys)]
    flat = [F.col(f"_i{i}.p{i}_{j}").alias(f"_i{i}_{j}") for i, k in enumerate(keys) for j in range(len(k))]
    named = fresh.select(*[c for c in fresh.columns if c not in ("_id", "_several")], *identity).select("*", *flat).drop(
        *[f"_i{i}" for i in range(len(keys))])
    names = [f"_i{i}_{j}" for i, k in enumerate(keys) for j in range(len(k))]
    some = F.lit(False)
    for n in names:
        some = some | F.col(n).isNotNull()
    anonymous = named.filter(~some)
    one = latest_per_key(named.filter(some).withColumn("_order", F.struct(order_by, "_rid")), names, "_order")
    one = one.drop(*names).checkpoint(eager=True)
    shared = _laid_out(one, keys, collation, ["_rid"])
    clash = shared.join(shared.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), on, "left_semi").select("_rid").distinct()
    refused = one.join(broadcast_if_small(clash), "_rid", "left_semi").withColumn("reason", F.lit("new rows share a key"))
    new = one.join(broadcast_if_small(clash), "_rid", "left_anti").unionByName(anonymous.drop(*names), allowMissingColumns=True)
    wanted = [c for c in new.columns if c in target.columns]
    given = apply_defaults(new.filter(F.col(primary).isNotNull()).select(*wanted), {
        c: v for c, v in defaults.items() if c in target.columns}, target.schema, now)
    given = given.select(*[(F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in target.schema.fields])
    counted = with_ids(target.unionByName(given), new.filter(F.col(primary).isNull()).select(*wanted, "_rid"),
                       [*unique[0], "_rid"], primary, defaults, now)
    inserted = given.unionByName(counted)
    conflicts = split.select(*batch_cols, "reason").unionByName(refused.select(*batch_cols, "reason"))
    return Resolved(updated.unionByName(inserted), conflicts)

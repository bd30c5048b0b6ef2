"""Deleting rows through a graph of foreign keys (CON-9 to CON-11).

A purge names rows of any tables. By CASCADE the rows that refer to them go too, and so on through the graph: a worklist
of newly doomed keys per table, until a round finds none. Cycles (a table that refers to itself, or to one that
refers back) end because a row is doomed once. Then RESTRICT decides: a row that stays but refers to a doomed one
blocks the whole purge. Last, SET NULL empties the references of the rows that stay.

A round reads only the tables that refer to newly doomed rows, and of them only key columns; the worklists are
keys alone, checkpointed to the shared folder. The number of rounds is the length of the longest chain of cascades.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FOREIGN_KEYS, PRIMARY_KEYS, ForeignKey
from ..session import checkpoint_dir
from .joins import broadcast_if_small


@dataclass(frozen=True)
class Purge:
    """What a purge does: ``tables`` afterwards (unchanged if ``refused``), the ``doomed`` keys per table, and ``blocked``:
    (child, column, parent, parent_key, child_rows) per doomed row that a staying row refers to by RESTRICT."""

    tables: dict[str, DataFrame]
    doomed: dict[str, DataFrame]
    blocked: DataFrame
    refused: bool


def _refers(child: DataFrame, column: str, keys: DataFrame, parent_column: str, how: str) -> DataFrame:
    """Rows of ``child`` that refer (left_semi) or do not refer (left_anti) to one of ``keys``."""
    side = broadcast_if_small(keys.select(F.col(parent_column).alias("_parent")).distinct())
    return child.join(side, child[column] == side["_parent"], how)


def purge(tables: dict[str, DataFrame], roots: dict[str, DataFrame], foreign_keys: list[ForeignKey] | None = None,
          keys: dict[str, list[str]] | None = None) -> Purge:
    """Delete the rows of ``tables`` whose key is in ``roots`` (key columns per table), with all that follows.

    Foreign keys of tables that are not given, or without the column, do not count; a foreign key refers to the
    parent's key, of one column. Rows that the purge itself deletes block nothing. A NULL reference refers to nothing;
    ids in ``roots`` that no row has delete nothing. Runs one job per round.
    """
    graph = [fk for fk in (FOREIGN_KEYS if foreign_keys is None else foreign_keys)
             if fk.child in tables and fk.parent in tables and fk.column in tables[fk.child].columns]
    keys = {t: (keys or PRIMARY_KEYS)[t] for t in tables}
    for fk in graph:
        if keys[fk.parent] != [fk.parent_column]:
            raise ValueError(f"{fk.child}.{fk.column} must refer to the key of {fk.parent}, of one column")
    spark = next(iter(tables.values())).sparkSession
    checkpoint_dir(spark)
    doomed: dict[str, list[DataFrame]] = {}
    fresh = {t: tables[t].select(*keys[t]).join(r.select(*keys[t]).distinct(), keys[t], "left_semi") for t, r in roots.items()}
    while fresh:
        found = {t: df.checkpoint(eager=True) for t, df in fresh.items()}
        found = {t: df for t, df in found.items() if not df.isEmpty()}
        for t, df in found.items():
            doomed.setdefault(t, []).append(df)
        fresh = {}
        for fk in graph:
            if fk.on_delete != "CASCADE" or fk.parent not in found:
                continue
            key = keys[fk.child]
            own = tables[fk.child].select(*dict.fromkeys([*key, fk.column]))
            hit = _refers(own, fk.column, found[fk.parent], fk.parent_column, "left_semi").select(*key)
            fresh[fk.child] = fresh[fk.child].unionByName(hit) if fk.child in fresh else hit
        for t in fresh:
            new = fresh[t].distinct()
            for known in doomed.get(t, []):
                new = new.join(broadcast_if_small(known), keys[t], "left_anti")
            fresh[t] = new
    gone = {}
    for t, parts in doomed.items():
        gone[t] = parts[0]
        for p in parts[1:]:
            gone[t] = gone[t].unionByName(p)
    stay = {t: df.join(broadcast_if_small(gone[t]), keys[t], "left_anti") if t in gone else df for t, df in tables.items()}
    blocked = spark.createDataFrame([], "child string, column string, parent string, parent_key string, child_rows long")
    for fk in graph:
        if fk.on_delete == "RESTRICT" and fk.parent in gone:
            own = stay[fk.child].select(F.col(fk.column).alias("_fk"))
            blocked = blocked.unionByName(
                _refers(own, "_fk", gone[fk.parent], fk.parent_column, "left_semi").groupBy("_fk")
                .agg(F.count(F.lit(1)).alias("child_rows"))
                .select(F.lit(fk.child).alias("child"), F.lit(fk.column).alias("column"), F.lit(fk.parent).alias("parent"),
                        F.col("_fk").cast("string").alias("parent_key"), "child_rows"))
    blocked = blocked.checkpoint(eager=True)
    if not blocked.isEmpty():
        return Purge(dict(tables), gone, blocked, True)
    for fk in graph:
        if fk.on_delete == "SET NULL" and fk.parent in gone:
            side = broadcast_if_small(gone[fk.parent].select(F.col(fk.parent_column).alias("_parent")).distinct())
            child = stay[fk.child]
            lost = child.join(side, child[fk.column] == side["_parent"], "left")
            stay[fk.child] = lost.withColumn(fk.column, F.when(F.col("_parent").isNull(), F.col(fk.column))).drop("_parent")
    return Purge(stay, gone, blocked, False)


def purge_summary(before: dict[str, DataFrame], after: dict[str, DataFrame], nullable: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, rows_before, rows_deleted, null_references) per table: NULLs afterwards in the columns of ``nullable``."""
    out = None
    for t in before:
        nulls = sum((F.col(c).isNull().cast("long") for c in (nullable or {}).get(t, [])), F.lit(0))
        for side, df in (("b", before[t]), ("a", after[t])):
            row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("nulls")).select(
                F.lit(t).alias("table_name"), F.lit(side).alias("side"), "n", "nulls")
            out = row if out is None else out.unionByName(row)
    n = F.sum(F.when(F.col("side") == "b", F.col("n")))
    return out.groupBy("table_name").agg(
        n.alias("rows_before"), (n - F.sum(F.when(F.col("side") == "a", F.col("n")))).alias("rows_deleted"),
        F.sum(F.when(F.col("side") == "a", F.col("nulls"))).alias("null_references"))

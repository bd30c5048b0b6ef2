"""Integrity checks and delete/update propagation (CON-2..CON-15).

The source database enforces these per row; Parquet does not, so each is a
set-based check that returns rows ``(table_name, rule, column_name, violations)``, or a
transformation applied to a batch before it is written.

Row-level rules on one table (not-null, domain, range, length, decimal fit,
format) are evaluated in a single aggregate: one scan, map-side partial
sums, one output row per rule, never a shuffle of the data itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import rule_pattern
from .joins import BROADCAST_BYTES, broadcast_if_small

# ---------------------------------------------------------------- defaults
def apply_defaults(df: DataFrame, defaults: dict[str, object], schema: T.StructType | None = None,
                   now: Column | None = None) -> DataFrame:
    """Fill NULLs (and missing columns) with declared defaults (CON-2).

    ``"now"`` stands for the current timestamp (or ``now`` if given).
    """
    now = now if now is not None else F.current_timestamp()
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    out = df
    for c, v in defaults.items():
        lit = now if v == "now" else F.lit(v)
        if c in types:
            lit = lit.cast(types[c])
        out = out.withColumn(c, F.coalesce(F.col(c), lit) if c in df.columns else lit)
    return out


# --------------------------------------------------------- one-pass checks
def row_checks(df: DataFrame, table: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Count rows violating each (rule, column, violation-condition) in one pass."""
    aggs = [F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(f"v{i}")
            for i, (_, _, cond) in enumerate(rules)]
    totals = df.agg(*aggs)
    stack = ", ".join(f"'{r}', '{c}', v{i}" for i, (r, c, _) in enumerate(rules))
    return totals.select(F.lit(table).alias("table_name"),
                         F.expr(f"stack({len(rules)}, {stack}) AS (rule, column_name, violations)"))


def not_null_rules(cols: list[str]) -> list[tuple[str, str, Column]]:
    return [("not_null", c, F.col(c).isNull()) for c in cols]


def domain_rules(domains: dict[str, list]) -> list[tuple[str, str, Column]]:
    """Value outside its enumerated domain; NULL is left to the not-null rule."""
    return [("domain", c, F.col(c).isNotNull() & ~F.col(c).isin(list(v))) for c, v in domains.items()]


def range_rules(ranges: dict[str, tuple], lengths: dict[str, int] | None = None,
                decimals: dict[str, tuple[int, int]] | None = None) -> list[tuple[str, str, Column]]:
    """Numeric bounds, maximum text length, and decimal(p, s) fit (CON-8).

    Decimal fit uses ``try_cast``: a value that does not fit becomes NULL
    instead of raising, as an ANSI cast would.
    """
    out = []
    for c, (lo, hi) in ranges.items():
        v = F.col(c).cast("decimal(38,0)") if hi is not None and hi > 2**62 else F.col(c)
        cond = F.lit(False)
        if lo is not None:
            cond = cond | (v < F.lit(lo))
        if hi is not None:
            cond = cond | (v > F.lit(str(hi)).cast("decimal(38,0)") if hi > 2**62 else v > F.lit(hi))
        out.append(("range", c, F.col(c).isNotNull() & cond))
    for c, n in (lengths or {}).items():
        out.append(("length", c, F.col(c).isNotNull() & (F.length(c) > n)))
    for c, (p, s) in (decimals or {}).items():
        out.append(("decimal", c, F.col(c).isNotNull()
                    & F.expr(f"try_cast(`{c}` AS DECIMAL({p},{s}))").isNull()))
    return out


def format_rules(formats: dict[str, str]) -> list[tuple[str, str, Column]]:
    """Value not matching its named format rule or regular expression (CON-15)."""
    return [("format", c, F.col(c).isNotNull() & ~F.col(c).rlike(rule_pattern(r))) for c, r in formats.items()]


def check_not_null(df: DataFrame, cols: list[str], table: str = "") -> DataFrame:
    return row_checks(df, table, not_null_rules(cols))


def check_domain(df: DataFrame, column: str, values: list, table: str = "") -> DataFrame:
    return row_checks(df, table, domain_rules({column: values}))


def check_range(df: DataFrame, ranges: dict[str, tuple], lengths=None, decimals=None, table: str = "") -> DataFrame:
    return row_checks(df, table, range_rules(ranges, lengths, decimals))


def check_format(df: DataFrame, column: str, rule: str, table: str = "") -> DataFrame:
    return row_checks(df, table, format_rules({column: rule}))


def check_list_format(df: DataFrame, column: str, rule: str, min_size: int = 0, table: str = "") -> DataFrame:
    """Every element of an array column matches the rule; list has min_size items."""
    pat = rule_pattern(rule)
    return row_checks(df, table, [
        ("format", column, F.col(column).isNotNull() & ~F.forall(column, lambda x: x.rlike(pat))),
        ("min_size", column, F.col(column).isNotNull() & (F.size(column) < min_size))])


# ------------------------------------------------------------- key checks
# Case-, accent- and trailing-space-insensitive equality of the source's
# lookup columns (unicode_ci collation with PAD SPACE).
LOOKUP_COLLATION = "UNICODE_CI_AI_RTRIM"


def check_unique(df: DataFrame, cols: list[str], table: str = "", collation: str | None = None) -> DataFrame:
    """Primary/unique key check (CON-5).

    ``violations`` = rows beyond the first for each key value; keys with a
    NULL part never collide (SQL unique semantics). With ``collation``,
    string key parts compare under it (e.g. 'A ' equals 'a'). One shuffle on
    the key after map-side partial counts, so a hot key costs one row per task.
    """
    all_set = F.lit(True)
    for c in cols:
        all_set = all_set & F.col(c).isNotNull()
    keyed = df.filter(all_set)
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    keys = [F.collate(F.col(c), collation).alias(c) if collation and c in strings else F.col(c) for c in cols]
    dup = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return dup.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations"),
                   F.count(F.lit(1)).cast("bigint").alias("duplicate_keys")) \
        .select(F.lit(table).alias("table_name"), F.lit("unique").alias("rule"),
                F.lit(",".join(cols)).alias("column_name"), "violations", "duplicate_keys")


def check_fk(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str,
             table: str = "", max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Orphan check (CON-6): child rows whose non-NULL key has no parent row.

    The parent key set is broadcast when it is proven small; otherwise the
    anti join shuffles both key columns (only the key, after pruning).
    """
    keys = broadcast_if_small(parent.select(F.col(parent_col).alias("_k")), max_broadcast_bytes)
    orphans = (child.select(F.col(child_col).alias("_k")).filter(F.col("_k").isNotNull())
               .join(keys, "_k", "left_anti"))
    return orphans.agg(F.count(F.lit(1)).cast("bigint").alias("violations")) \
        .select(F.lit(table).alias("table_name"), F.lit("fk").alias("rule"),
                F.lit(f"{child_col}->{parent_col}").alias("column_name"), "violations")


def check_fks(child: DataFrame, references: list[tuple[str, DataFrame, str]], table: str = "",
              max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The orphan checks of all foreign keys of one table, (column, parent, parent column) each, in one scan of it.

    The child's references are laid out as (number of the key, value) and counted before they are shuffled, so a
    hot value costs one row per task; then one anti join meets the keys of all parents.
    """
    def keyed(n: int, c: Column) -> Column:
        return F.struct(F.lit(n).alias("_fk"), c.cast("string").alias("_k"))

    own = (child.select(F.explode(F.array(*[keyed(n, F.col(c)) for n, (c, _, _) in enumerate(references)])).alias("_x"))
           .select("_x.*").filter(F.col("_k").isNotNull()).groupBy("_fk", "_k").agg(F.count(F.lit(1)).alias("_n")))
    known = None
    for n, (_, parent, pc) in enumerate(references):
        keys = parent.select(F.lit(n).alias("_fk"), F.col(pc).cast("string").alias("_k"))
        known = keys if known is None else known.unionByName(keys)
    orphans = own.join(broadcast_if_small(known, max_broadcast_bytes), ["_fk", "_k"], "left_anti")
    names = child.sparkSession.createDataFrame([(n, f"{c}->{pc}") for n, (c, _, pc) in enumerate(references)], "_fk int, column_name string")
    return (F.broadcast(names).join(orphans.groupBy("_fk").agg(F.sum("_n").alias("_n")), "_fk", "left")
            .select(F.lit(table).alias("table_name"), F.lit("fk").alias("rule"), "column_name",
                    F.coalesce("_n", F.lit(0)).cast("bigint").alias("violations")))


# ------------------------------------------------------- delete / update
def cascade_delete(child: DataFrame, fk: str, deleted_keys: DataFrame, key: str,
                   max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Child rows that survive deleting the given parent keys (CON-9, CASCADE), one level; ``purge`` follows the
    whole graph."""
    keys = broadcast_if_small(deleted_keys.select(F.col(key).alias(fk)).distinct(), max_broadcast_bytes)
    return child.join(keys, fk, "left_anti")


def set_null_on_delete(child: DataFrame, fk: str, deleted_keys: DataFrame, key: str,
                       max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Child foreign keys pointing at deleted parents become NULL (CON-10)."""
    keys = broadcast_if_small(deleted_keys.select(F.col(key).alias("_dk")).distinct()
                              .withColumn("_hit", F.lit(True)), max_broadcast_bytes)
    return (child.join(keys, child[fk] == keys["_dk"], "left")
            .withColumn(fk, F.when(F.col("_hit"), F.lit(None).cast(child.schema[fk].dataType))
                        .otherwise(F.col(fk)))
            .drop("_dk", "_hit"))


def check_restrict(child: DataFrame, fk: str, deleted_keys: DataFrame, key: str) -> DataFrame:
    """Parents whose delete is refused because children still refer to them
    (CON-11): one row per blocked parent key with its number of children."""
    keys = deleted_keys.select(F.col(key).alias(fk)).distinct()
    return (child.select(fk).join(broadcast_if_small(keys), fk, "left_semi")
            .groupBy(fk).agg(F.count(F.lit(1)).cast("bigint").alias("child_rows"))
            .withColumnRenamed(fk, key))


def remap_key(child: DataFrame, fk: str, mapping: DataFrame, old: str = "old_key", new: str = "new_key",
              max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """ON UPDATE CASCADE (CON-12): child keys follow their parent's new key."""
    m = broadcast_if_small(mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new")), max_broadcast_bytes)
    return (child.join(m, child[fk] == m["_old"], "left")
            .withColumn(fk, F.coalesce(F.col("_new").cast(child.schema[fk].dataType), F.col(fk)))
            .drop("_old", "_new"))


# ------------------------------------------------------------- evolution
def evolve(df: DataFrame, added: list[T.StructField]) -> DataFrame:
    """Additive schema change (CON-14): add missing nullable columns."""
    out = df
    for f in added:
        if f.name not in df.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out


def union_evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows written before and after an additive change, read as one table."""
    return old.unionByName(new, allowMissingColumns=True)


# ------------------------------------------------------------ declared report
def integrity_report(tables: dict[str, DataFrame], collated: bool = True) -> DataFrame:
    """Every check the declared schema implies, for the tables given (CON-1..8).

    Per table: one pass for not-null (non-nullable columns), enum domains,
    ranges, text lengths and decimal fit; one key check per primary/unique
    key (lookup columns compared under the source collation); one orphan
    check per foreign key whose parent table is given. Columns a table does
    not have are skipped. Output rows: (table_name, rule, column_name,
    violations).
    """
    from ..schemas import COLLATED_LOOKUPS, ENUMS, FOREIGN_KEYS, LENGTHS, PRIMARY_KEYS, RANGES, SCHEMAS, \
        UNIQUE_KEYS
    parts: list[DataFrame] = []
    for name, df in tables.items():
        schema = SCHEMAS.get(name)
        if schema is None:
            continue
        cols = set(df.columns)
        rules = not_null_rules([f.name for f in schema.fields if not f.nullable and f.name in cols])
        rules += domain_rules({c: v for (t, c), v in ENUMS.items() if t == name and c in cols})
        rules += range_rules({c: r for c, r in RANGES.get(name, {}).items() if c in cols},
                             lengths={c: n for c, n in LENGTHS.get(name, {}).items() if c in cols},
                             decimals={f.name: (f.dataType.precision, f.dataType.scale) for f in schema.fields
                                       if isinstance(f.dataType, T.DecimalType) and f.name in cols})
        if rules:
            parts.append(row_checks(df, name, rules))
        for key in [PRIMARY_KEYS.get(name, [])] + UNIQUE_KEYS.get(name, []):
            if key and set(key) <= cols:
                lookup = collated and set(key) <= set(COLLATED_LOOKUPS.get(name, []))
                parts.append(check_unique(df, key, name, collation=LOOKUP_COLLATION if lookup else None)
                             .select("table_name", "rule", "column_name", "violations"))
    for child in tables:
        own = [(fk.column, tables[fk.parent], fk.parent_column) for fk in FOREIGN_KEYS
               if fk.child == child and fk.parent in tables and fk.column in tables[child].columns]
        if own:
            parts.append(check_fks(tables[child], own, child))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

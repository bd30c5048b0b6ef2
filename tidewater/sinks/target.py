"""Target writes (SNK-1..SNK-5) and the parallel full load (SRC-3, SNK-3).

* Prep modes: ``DO_NOTHING`` appends to what is there, ``DROP_AND_CREATE``
  replaces the table, ``TRUNCATE_BEFORE_LOAD`` empties it first (same as a
  replace for a folder of Parquet files).
* Versioned tables: each change is written to a new ``v<N>`` folder, then
  committed by a marker of its own; readers take the highest committed
  version, so a failed write never leaves a half-changed table and nothing
  is ever deleted in place (single writer assumed).
* Full load: tables chosen by include/exclude LIKE patterns, renamed by one
  function that validation reuses, declared text columns cut to the LOB limit, and up
  to ``max_parallel`` tables written at the same time from driver threads;
  within a table, executors write partitions in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import like_any
from ..functions.lob import LOB_MAX_KB, limit_lob
from ..sources.tables import is_missing, list_tables, read_table, table_path

PREP_MODES = {"DO_NOTHING": "append", "DROP_AND_CREATE": "overwrite", "TRUNCATE_BEFORE_LOAD": "overwrite"}
# ---- fixed values: full-load settings of the source task -------------------
DEFAULT_PREP = "DO_NOTHING"
MAX_PARALLEL_TABLES = 8
# ---------------------------------------------------------------------------


def write_target(df: DataFrame, path: str, prep: str = DEFAULT_PREP) -> None:
    """Write a table with a prep mode (SNK-1)."""
    if prep not in PREP_MODES:
        raise ValueError(f"prep must be one of {sorted(PREP_MODES)}")
    df.write.mode(PREP_MODES[prep]).parquet(path)


# ------------------------------------------------------------- versioned tables
def _commits(root: str) -> str:
    return f"{root.rstrip('/')}/_commits"


def current_version(spark: SparkSession, root: str) -> int | None:
    """Highest committed version, or None before the first commit.

    Each commit adds its own marker folder (written once, never rewritten or
    deleted), which appears only when its write job commits; so a crash can
    never leave a table without a current version.
    """
    try:
        row = spark.read.text(f"{_commits(root)}/*").agg(F.max(F.col("value").cast("long"))).first()
    except AnalysisException as error:
        if is_missing(error):  # no commit yet
            return None
        raise
    return None if row is None or row[0] is None else int(row[0])


def read_current(spark: SparkSession, root: str) -> DataFrame:
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"no committed version under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/v{v}")


def write_version(df: DataFrame, root: str, version: int) -> None:
    """Write ``df`` as version ``version``, then commit it with a marker."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/v{version}")
    spark.createDataFrame([(str(version),)], "v string").coalesce(1) \
        .write.mode("overwrite").text(f"{_commits(root)}/{version}")


# ---------------------------------------------------------------------- audit
def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows (SNK-5, DML-3); several snapshots union into one log."""
    rows.write.mode("append").parquet(path)


# ------------------------------------------------------------------ full load
def prefix_rename(prefix: str) -> Callable[[str], str]:
    """The table-rename rule of the load (SNK-2); reuse it in validation."""
    return lambda t: f"{prefix}{t}"


def select_tables(spark: SparkSession, names: list[str], include: list[str], exclude: list[str]) -> list[str]:
    """Table names matching any include LIKE pattern and no exclude pattern (SRC-3)."""
    if not names:
        return []
    tl = spark.createDataFrame([(n,) for n in names], "name string")
    return sorted(r[0] for r in tl.filter(like_any("name", include) & ~like_any("name", exclude)).collect())


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def full_load(spark: SparkSession, src_root: str, dst_root: str, include: list[str] | None = None,
              exclude: list[str] | None = None, prefix: str = "", prep: str = DEFAULT_PREP,
              max_parallel: int = MAX_PARALLEL_TABLES, lob_max_kb: int = LOB_MAX_KB,
              lob_columns: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """Copy the selected tables; returns (source_table, target_table) pairs.

    Texts are copied whole, but for the columns that ``lob_columns`` declares per
    table: those are cut to ``lob_max_kb``.
    """
    rename = prefix_rename(prefix)
    chosen = select_tables(spark, list_tables(spark, src_root), include or ["%"], exclude or [])

    def load(name: str) -> tuple[str, str]:
        # each table's jobs go to their own scheduler pool (shared fairly when
        # the cluster runs spark.scheduler.mode=FAIR)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"load_{name}")
        df = read_table(spark, src_root, name)
        if cols := (lob_columns or {}).get(name):
            df = limit_lob(df, cols, lob_max_kb)
        write_target(df, table_path(dst_root, rename(name)), prep)
        return name, rename(name)

    with ThreadPoolExecutor(max_workers=max(1, max_parallel)) as pool:
        return list(pool.map(load, chosen))


def load_summary(spark: SparkSession, dst_root: str, loaded: list[tuple[str, str]]) -> DataFrame:
    """Rows and bytes of text now in each loaded target table (one job over all tables)."""
    parts = []
    for src, tgt in loaded:
        df = read_table(spark, dst_root, tgt)
        size = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text_columns(df)), F.lit(0))
        parts.append(df.agg(F.count(F.lit(1)).cast("long").alias("rows"), size.cast("long").alias("text_bytes"))
                     .select(F.lit(src).alias("source_table"), F.lit(tgt).alias("target_table"), "rows", "text_bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------ bucketed tables
BUCKET_COL = "_bucket"


def bucket_of(key: list[str] | str | Column, buckets: int) -> Column:
    """Hash bucket of a key: the table's partition column. A Column is the bucket's number itself."""
    if isinstance(key, Column):
        return key
    key = [key] if isinstance(key, str) else list(key)
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, root: str, key: list[str] | str | Column, buckets: int, spread: int = 1) -> None:
    """Write a keyed table partitioned by hash bucket of its key, as its first committed version. Its schema is
    written beside it, as an empty table (or bucket) has no file to read it from."""
    df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1) \
        .write.mode("overwrite").text(_schema_path(root))
    _write_buckets(df, root, key, buckets, 0, spread)
    _commit_buckets(df.sparkSession, root, 0, {b: 0 for b in range(buckets)})


def _schema_path(root: str) -> str:
    return f"{root.rstrip('/')}/_schema"


def _write_buckets(df: DataFrame, root: str, key: list[str] | str | Column, buckets: int, version: int, spread: int = 1) -> None:
    """``spread``: tasks that may share the writing of one bucket (for keys that hold many rows)."""
    salt = [F.pmod(F.xxhash64(*df.columns), F.lit(spread))] if spread > 1 else []
    (df.withColumn(BUCKET_COL, bucket_of(key, buckets)).repartition(BUCKET_COL, *salt)
     .write.mode("overwrite").partitionBy(BUCKET_COL).parquet(f"{root.rstrip('/')}/b{version}"))


def _commit_buckets(spark: SparkSession, root: str, version: int, at: dict[int, int]) -> None:
    """Commit the map bucket -> version that holds it (a row per bucket)."""
    write_version(spark.createDataFrame(sorted(at.items()), f"{BUCKET_COL} int, version int").coalesce(1), root, version)


def _bucket_map(spark: SparkSession, root: str) -> dict[int, int]:
    return {r[0]: r[1] for r in read_current(spark, root).collect()}


def _read_buckets(spark: SparkSession, root: str, at: dict[int, int]) -> DataFrame:
    """The rows of the given buckets, each from the version that holds it."""
    base, out = root.rstrip("/"), None
    schema = T.StructType.fromJson(json.loads(spark.read.text(_schema_path(root)).first()[0])).add(BUCKET_COL, T.IntegerType())
    for version in sorted(set(at.values())):
        own = [b for b, v in at.items() if v == version]
        part = spark.read.schema(schema).parquet(f"{base}/b{version}").filter(F.col(BUCKET_COL).isin(own)).drop(BUCKET_COL)
        out = part if out is None else out.unionByName(part)
    return out


def read_bucketed(spark: SparkSession, root: str, own: list[int] | None = None) -> DataFrame:
    """The table, or the rows of its buckets ``own`` alone."""
    at = _bucket_map(spark, root)
    return _read_buckets(spark, root, at if own is None else {b: at[b] for b in own or list(at)[:1]})


def merge_into_buckets(spark: SparkSession, root: str, changes: DataFrame, key: list[str] | str | Column, buckets: int,
                       merge: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None,
                       spread: int = 1) -> None:
    """Rewrite only the buckets a batch of changes touches, then commit them together.

    The merged rows of the touched buckets go to a folder of their own; only then a new map from
    buckets to folders is committed. Nothing that a reader or a rerun needs is overwritten: a run that dies before
    the commit leaves the table as it was, and its rerun starts from the same rows. ``version`` (a batch's number from
    1) makes a batch that is already committed a no-op. The driver holds one number per bucket.
    """
    done = current_version(spark, root)
    version = (done or 0) + 1 if version is None else version
    if done is not None and done >= version:
        return
    at = _bucket_map(spark, root)
    touched = sorted(r[0] for r in changes.select(bucket_of(key, buckets).alias(BUCKET_COL)).distinct().collect())
    if touched:
        current = _read_buckets(spark, root, {b: at[b] for b in touched})
        _write_buckets(merge(current, changes), root, key, buckets, version, spread)
    _commit_buckets(spark, root, version, at | {b: version for b in touched})

"""Base-table scans (SRC-1) and table listing for load/validation.

A table is a Parquet dataset at ``{root}/{name}.parquet`` (a file or a
folder). With ``schema`` the read skips inference and fixes types; Catalyst
pushes filters and the column projection of later steps into this scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, root: str, name: str,
               schema: StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(table_path(root, name))


def is_missing(error: Exception) -> bool:
    """True for Spark's errors that say a path is not there or holds no table; not for storage errors."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    return condition in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def try_read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The table, or None when there is none; any other failure is raised."""
    try:
        return read_table(spark, root, name)
    except AnalysisException as error:
        if is_missing(error):
            return None
        raise


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the ``*.parquet`` tables directly under ``root`` (a table is a Parquet file or a folder of them).

    Lists the folder's direct children on the store that holds it (one request, not the tables' files);
    every name counts, also one that begins with _ or a dot. A missing folder raises.
    """
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in store.listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet") and n != ".parquet")

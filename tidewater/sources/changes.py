"""Change-log source (SRC-4): row images with position, operation and times.

Batch: ``read_changes``. Stream: ``stream_changes`` reads new files of the
same folder as they arrive (file source; schema fixed up front). A single
file inside a shared folder can be followed with ``file_name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHANGE_SCHEMA = T.StructType([
    T.StructField("pos", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("key", T.LongType(), False),
    T.StructField("before_key", T.LongType(), True),
    T.StructField("committed_at", T.TimestampType(), True),
    T.StructField("captured_at", T.TimestampType(), True),
])


def read_changes(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def stream_changes(spark: SparkSession, folder: str, schema: T.StructType, file_name: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if file_name is not None:
        reader = reader.option("pathGlobFilter", file_name)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(folder)

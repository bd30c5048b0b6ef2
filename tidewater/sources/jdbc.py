"""Relational source and target over JDBC (SRC-2, SNK-6).

The read is split into ``num_partitions`` range queries on a numeric key
column, so executors pull a large table in parallel. TLS is requested
through the connection URL. Nothing here can be exercised without a
database server; the options are the standard Spark JDBC ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def mysql_url(host: str, port: int, database: str, tls: bool = True, server_tz: str = "UTC") -> str:
    opts = [f"serverTimezone={server_tz}"]
    if tls:
        opts += ["useSSL=true", "requireSSL=true"]
    return f"jdbc:mysql://{host}:{port}/{database}?{'&'.join(opts)}"


def source_options(url: str, table: str, user: str, password: str, partition_column: str | None = None,
                   lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
                   fetch_size: int = 10_000) -> dict[str, str]:
    opts = {"url": url, "dbtable": table, "user": user, "password": password, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                    numPartitions=str(num_partitions))
    return opts


def read_source(spark: SparkSession, url: str, table: str, user: str, password: str,
                partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                num_partitions: int = 8) -> DataFrame:
    """Parallel JDBC read of one table, range-split on ``partition_column``."""
    return spark.read.format("jdbc").options(**source_options(
        url, table, user, password, partition_column, lower, upper, num_partitions)).load()


def write_jdbc(df: DataFrame, url: str, table: str, user: str, password: str, mode: str = "append",
               batch_size: int = 10_000, num_partitions: int | None = None) -> None:
    """Batched JDBC insert; ``num_partitions`` caps concurrent connections."""
    w = df if num_partitions is None else df.coalesce(num_partitions)
    (w.write.format("jdbc").mode(mode)
     .options(url=url, dbtable=table, user=user, password=password, batchsize=str(batch_size))
     .save())

"""Surrogate keys (CON-3): stable, gap-free ids in a given order.

``row_number()`` over a global ORDER BY would put every row in one task.
Instead the rows are range-partitioned on the order columns and sorted
within each partition; the per-partition row counts (one number per
partition) give each partition its starting offset, and the id is offset +
position within the partition. The sorted rows are checkpointed first, so
the counts and the ids see the very same partitions even if an executor is
lost and a task is recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def assign_ids(df: DataFrame, id_col: str, order_by: list[str], start: int | None = None,
               existing_max: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = start, start+1, ... following ``order_by``.

    ``start`` defaults to 1, or to max(existing)+1 when ``existing_max`` (a
    one-row, one-column DataFrame) is given, like AUTO_INCREMENT.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    # position inside the partition: the low 33 bits of the monotonic id
    local = ranged.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    if existing_max is not None:  # one number: the current maximum key
        start = (existing_max.agg(F.max(existing_max.columns[0])).first()[0] or 0) + 1
    offsets = offsets.withColumn("_off", F.col("_off") + F.lit(1 if start is None else int(start)))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (F.col("_off") + F.col("_pos")).cast("long"))
            .drop("_pid", "_mid", "_pos", "_off"))

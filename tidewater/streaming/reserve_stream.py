"""Reservation over a stream of requests (RSV-2).

The reserved stock is the state. Each micro-batch is decided with the batch
operator (``reserve``, hot-key safe) against the current stock, the results
are written under the batch id, and the stock is updated. Requests of a
later batch arrive after those of earlier batches, so the fold continues
exactly where the previous batch stopped.

Two state layouts:

* versioned (small inventories): the whole stock table is committed as a
  new version per batch; a replayed, already committed batch is skipped.
* bucketed (large inventories): the stock is partitioned by key hash and a
  batch reads and rewrites only the buckets its keys fall in. The rewritten
  buckets are committed together under the batch's number; a replayed batch
  starts from the same stock, or is skipped if it was committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.reserve import reserve, reserved_totals
from ..sinks.target import (current_version, merge_into_buckets, read_bucketed, read_current, write_bucketed,
                            write_version)


def reserve_stream(spark: SparkSession, inventory: DataFrame, requests: DataFrame, state_root: str,
                   results_path: str, checkpoint_location: str, key: list[str] | str, order: list[str] | str,
                   qty: str = "qty", request_id: str = "request_id", reserved: str = "qty_reserved",
                   available_now: bool = True, processing_time: str | None = None, buckets: int | None = None):
    key = [key] if isinstance(key, str) else list(key)
    decide = (_bucketed(spark, inventory, state_root, results_path, key, order, qty, request_id, reserved, buckets)
              if buckets else _versioned(spark, inventory, state_root, results_path, key, order, qty, request_id))
    writer = requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time or "10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def _versioned(spark, inventory, state_root, results_path, key, order, qty, request_id):
    if current_version(spark, state_root) is None:
        write_version(inventory, state_root, 0)

    def decide(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        done = current_version(spark, state_root)
        if done is not None and done >= version:
            return
        stock = read_current(spark, state_root)
        out = f"{results_path.rstrip('/')}/batch={batch_id}"
        reserve(stock, batch, key, order, qty=qty, request_id=request_id).write.mode("overwrite").parquet(out)
        results = spark.read.parquet(out)  # written once, read back: no recomputation
        write_version(reserved_totals(stock, results, key, qty=qty), state_root, version)

    return decide


def _bucketed(spark, inventory, state_root, results_path, key, order, qty, request_id, reserved, buckets):
    data = f"{state_root.rstrip('/')}/data"
    marker = f"{state_root.rstrip('/')}/_initialised"
    if current_version(spark, marker) is None:
        write_bucketed(inventory, data, key, buckets)
        write_version(spark.range(0), marker, 0)
    def decide(batch: DataFrame, batch_id: int) -> None:
        if (current_version(spark, data) or 0) > batch_id:
            return  # committed before a restart
        batch.persist()
        out = f"{results_path.rstrip('/')}/batch={batch_id}"

        def update(stock: DataFrame, requests: DataFrame) -> DataFrame:
            reserve(stock, requests, key, order, qty=qty, request_id=request_id).write.mode("overwrite").parquet(out)
            return reserved_totals(stock, spark.read.parquet(out), key, qty=qty, reserved=reserved)

        merge_into_buckets(spark, data, batch, key, buckets, update, batch_id + 1)
        batch.unpersist()

    return decide


def read_results(spark: SparkSession, results_path: str) -> DataFrame:
    return spark.read.parquet(results_path).drop("batch")


def read_stock(spark: SparkSession, state_root: str) -> DataFrame:
    """Current stock of either layout, without bookkeeping columns."""
    if current_version(spark, f"{state_root.rstrip('/')}/_initialised") is not None:
        return read_bucketed(spark, f"{state_root.rstrip('/')}/data")
    return read_current(spark, state_root)

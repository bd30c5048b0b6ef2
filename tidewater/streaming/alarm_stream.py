"""Metric periods over a stream (OBS-1 streaming, OBS-2/3 per micro-batch).

``period_stats_stream`` runs the same plan as the batch ``period_stat``
in *update* mode: each micro-batch emits the periods whose
statistic changed, and ``foreachBatch`` upserts them by (dimensions,
period) into a stats table in buckets of days: a micro-batch rewrites only the buckets of the days it touches. The table is always current (open
periods included) and equals the batch result once the input is consumed,
in whatever order it arrives. A continuous run may set a ``watermark`` to
bound its state; points later than that are then not counted (``keyed_state.alarm_records`` keeps them).
``evaluate_written`` runs the alarm rule over that table (one row per metric
and period, so it stays small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import upsert
from ..operators.monitor import alarm_states, alarm_transitions, period_stat
from ..sinks.target import current_version, merge_into_buckets, read_bucketed, write_bucketed

DAY, DAY_BUCKETS = "_day", 64


def period_stats_stream(metrics: DataFrame, ts: str, value: str, dims: list[str], period_s: int,
                        statistic: str, table_root: str, checkpoint_location: str,
                        watermark: str | None = None, exact_scale: int | None = None,
                        available_now: bool = True, buckets: int = DAY_BUCKETS):
    if watermark and available_now:
        raise ValueError("a bounded run takes no watermark: it must not drop late points")
    spark = metrics.sparkSession
    stats = period_stat(metrics, ts, value, dims, period_s, statistic, exact_scale=exact_scale,
                        watermark=watermark)
    key = [*dims, "period_start"]

    def merge(batch: DataFrame, batch_id: int) -> None:
        by_day = batch.withColumn(DAY, F.to_date("period_start")).persist()
        if current_version(spark, table_root) is None:
            write_bucketed(by_day.filter(F.lit(False)), table_root, DAY, buckets)  # version 0: no periods
        merge_into_buckets(spark, table_root, by_day, DAY, buckets,
                           lambda current, new: upsert(current, new, key, ["value", "samples"]), batch_id + 1)
        by_day.unpersist()

    writer = (stats.writeStream.outputMode("update").foreachBatch(merge)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def read_stats(spark: SparkSession, table_root: str) -> DataFrame:
    return read_bucketed(spark, table_root).drop(DAY)


def evaluate_written(spark: SparkSession, table_root: str, dims: list[str], period_s: int, threshold,
                     comparison: str, evaluation_periods: int, missing: str = "ignore"):
    """(states, transitions) over the periods the stream has written so far."""
    stats = read_stats(spark, table_root)
    states = alarm_states(stats, dims, period_s, threshold, comparison, evaluation_periods, missing)
    return states, alarm_transitions(states, dims, period_s)

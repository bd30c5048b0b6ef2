"""Nothing is dropped, cut or capped without a word."""
import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.operators.joins import planned_bytes, range_join
from tidewater.operators.merge import upsert
from tidewater.operators.monitor import period_stat
from tidewater.operators.reserve import reserve, reserved_totals
from tidewater.operators.tree import hierarchy_paths
from tidewater.plans.reports import search_products
from tidewater.session import scratch_path
from tidewater.sinks import target
from tidewater.sources.tables import list_tables, try_read_table
from tidewater.streaming.alarm_stream import period_stats_stream, read_stats


def test_out_of_order_files_equal_batch(spark):
    root = scratch_path(spark, "late")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "cpu", t0 + dt.timedelta(minutes=7 * i), float(i % 50)) for i in range(400)]
    for part in range(4):  # newest first, one file per trigger
        lo = 300 - 100 * part
        (spark.createDataFrame(rows[lo:lo + 100], "id long, metric string, ts timestamp_ntz, value double").coalesce(1)
         .write.mode("append").parquet(f"{root}/in"))
    schema = spark.read.parquet(f"{root}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    period_stats_stream(stream, "ts", "value", ["metric"], 300, "Maximum", f"{root}/out", f"{root}/ck")
    batch = period_stat(spark.read.parquet(f"{root}/in"), "ts", "value", ["metric"], 300, "Maximum")
    got, want = ([tuple(r) for r in df.orderBy("period_start").collect()] for df in (read_stats(spark, f"{root}/out"), batch))
    assert got == want and sum(r[-1] for r in got) == 400
    with pytest.raises(ValueError):
        period_stats_stream(stream, "ts", "value", ["metric"], 300, "Maximum", f"{root}/o2", f"{root}/c2", watermark="1 minute")


def test_every_table_is_listed_and_loaded_whole(spark):
    root = scratch_path(spark, "load")
    for name in ("_internal", "plain"):
        spark.createDataFrame([(1, "x" * 50_000)], "id int, text string").write.parquet(f"{root}/src/{name}.parquet")
    assert list_tables(spark, f"{root}/src") == ["_internal", "plain"]
    loaded = target.full_load(spark, f"{root}/src", f"{root}/dst")
    assert {(r.rows, r.text_bytes) for r in target.load_summary(spark, f"{root}/dst", loaded).collect()} == {(1, 50_000)}
    cut = target.full_load(spark, f"{root}/src", f"{root}/cut", include=["plain"], lob_columns={"plain": ["text"]})
    assert target.load_summary(spark, f"{root}/cut", cut).first().text_bytes == 32 * 1024
    assert try_read_table(spark, f"{root}/src", "nothing") is None
    with pytest.raises(Exception):
        list_tables(spark, f"{root}/no-such-folder")


def test_deep_tree_and_cycle(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(130)] + [(1000, 1001, "a"), (1001, 1000, "b"), (1002, 1001, "c")]
    out = {r.id: r for r in hierarchy_paths(spark.createDataFrame(rows, "id int, parent_id int, name string")).collect()}
    assert len(out) == len(rows)
    assert (out[129].root, out[129].depth, out[129].cyclic) == (0, 129, False)
    assert all(out[i].cyclic and out[i].root is None for i in (1000, 1001, 1002))


def test_release_without_stock_makes_none(spark):
    inv = spark.createDataFrame([(1, 5, 0)], "k int, qty_on_hand int, qty_reserved int")
    req = spark.createDataFrame([(1, 9, -5), (2, 9, 3), (3, 1, None), (4, 1, 5), (5, 1, 1), (6, None, 0)],
                                "request_id long, k int, qty int")
    for limit in (0, 10):
        out = reserve(inv, req, "k", "request_id", key_limit=limit)
        assert {r.request_id: r.result for r in out.collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0}
        assert reserved_totals(inv, out, "k").collect()[0].qty_reserved == 5


def test_repeated_keys_fail_and_touch_always(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    t = spark.createDataFrame([(1, "a", dt.datetime(2020, 1, 1))], "id int, v string, updated_at timestamp_ntz")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    out = {r.id: r.updated_at.year for r in upsert(t, one, "id", ["v"], touch="updated_at", now=now, touch_always=True).collect()}
    assert out == {1: 2024, 2: 2024}
    assert upsert(t, one, "id", ["v"], touch="updated_at", now=now).filter("id = 1").first().updated_at.year == 2020
    with pytest.raises(PySparkException, match="repeated key"):
        upsert(t, one.union(one), "id", ["v"]).collect()


def test_merge_that_dies_before_its_commit_changes_nothing(spark, monkeypatch):
    root = scratch_path(spark, "dies")
    base = spark.range(100).withColumn("v", F.lit(0))
    target.write_bucketed(base, root, "id", 4)
    changes = spark.createDataFrame([(3,)], "id long")

    def merge(current, batch):
        return current.withColumn("v", F.col("v") + 1)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(target, "_commit_buckets", die)
        with pytest.raises(RuntimeError):
            target.merge_into_buckets(spark, root, changes, "id", 4, merge, 1)
    assert target.read_bucketed(spark, root).agg(F.sum("v"), F.count("*")).first()[:] == (0, 100)
    for _ in range(2):  # the rerun commits, a replay is a no-op
        target.merge_into_buckets(spark, root, changes, "id", 4, merge, 1)
    out = target.read_bucketed(spark, root)
    assert out.count() == 100 and out.filter("id = 3").first().v == 1 and 0 < out.agg(F.sum("v")).first()[0] < 100


def test_range_join_of_many_ranges_and_open_ends(spark):
    d0 = dt.date(2024, 1, 10)
    left = spark.createDataFrame([(i, d0 + dt.timedelta(days=i)) for i in range(0, 400, 7)], "id int, d date")
    ranges = [(k, d0 + dt.timedelta(days=3 * k - 40), None if k % 9 == 0 else d0 + dt.timedelta(days=3 * k + k % 50))
              for k in range(150)]
    right = spark.createDataFrame(ranges, "k int, low date, high date")
    got = {tuple(r) for r in range_join(left, right, F.col("d"), F.col("low"), F.col("high")).select("id", "k").collect()}
    want = {(i, k) for i in range(0, 400, 7) for k, lo, hi in ranges
            if lo <= d0 + dt.timedelta(days=i) and (hi is None or d0 + dt.timedelta(days=i) <= hi)}
    assert got == want and len(want) > 500


def test_search_in_other_scripts(spark):
    p = spark.createDataFrame([(1, "Café noir"), (2, "CAFE crème cafe"), (3, "кофе молотый"), (4, "cafeteria")],
                              "product_id int, product_name string")
    assert {r.product_id: r.hits for r in search_products(p, "café").collect()} == {1: 1, 2: 2}
    assert [r.product_id for r in search_products(p, "Кофе").collect()] == [3]


def test_size_estimate_needs_no_job(spark):
    small, large = spark.range(10), spark.range(10 ** 12)
    assert planned_bytes(small) < 1000 < planned_bytes(large)

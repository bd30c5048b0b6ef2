"""Streaming variants equal their batch counterparts."""
from tidewater.plans.catalog import CUSTOMER_COLS, change_log, change_log_of, events_stream
from tidewater.operators.cdc import apply_changes, live, snapshot_target
from tidewater.session import scratch_path
from tidewater.sources.tables import read_table
from tidewater.streaming.cdc_stream import migrate, read_live

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.select("c_custkey", *CUSTOMER_COLS, "_pos").collect())


def test_migrate_versioned_and_bucketed_equal_batch(spark):
    snapshot = read_table(spark, SF, "customer")
    want = _rows(live(apply_changes(snapshot_target(snapshot), change_log(spark, SF), "c_custkey", CUSTOMER_COLS)))
    for buckets in (None, 4):
        root = scratch_path(spark, "mig-test")
        migrate(spark, snapshot, change_log_of(events_stream(spark, SF)), f"{root}/t", "c_custkey", CUSTOMER_COLS,
                -1, f"{root}/_ck", buckets=buckets)
        assert _rows(read_live(spark, f"{root}/t")) == want, buckets
        # a second run over the same checkpoint finds nothing new and changes nothing
        migrate(spark, snapshot, change_log_of(events_stream(spark, SF)), f"{root}/t", "c_custkey", CUSTOMER_COLS,
                -1, f"{root}/_ck", buckets=buckets)
        assert _rows(read_live(spark, f"{root}/t")) == want, buckets


def test_bucketed_merge_is_idempotent(spark):
    from tidewater.sinks.target import merge_into_buckets, read_bucketed, write_bucketed
    snapshot = read_table(spark, SF, "customer")
    root = scratch_path(spark, "bucket-test")
    write_bucketed(snapshot_target(snapshot.select("c_custkey", *CUSTOMER_COLS)), root, "c_custkey", 8)
    ch = change_log(spark, SF)
    merge = lambda cur, c: apply_changes(cur, c, "c_custkey", CUSTOMER_COLS)
    merge_into_buckets(spark, root, ch, "c_custkey", 8, merge)
    once = _rows(live(read_bucketed(spark, root)))
    merge_into_buckets(spark, root, ch, "c_custkey", 8, merge)
    assert _rows(live(read_bucketed(spark, root))) == once


def test_reserve_stream_layouts_equal_batch(spark):
    from tidewater.operators.reserve import reserve, reserved_totals
    from tidewater.plans.catalog import requests_of, reservation_inputs
    from tidewater.streaming.reserve_stream import read_results, read_stock, reserve_stream
    inventory, requests = reservation_inputs(spark, SF)
    want = sorted(tuple(r) for r in reserve(inventory, requests, "user_id", "request_id").collect())
    want_stock = sorted(tuple(r) for r in reserved_totals(
        inventory, reserve(inventory, requests, "user_id", "request_id"), "user_id").collect())
    for buckets in (None, 4):
        root = scratch_path(spark, "rsv-test")
        stream = requests_of(events_stream(spark, SF))
        reserve_stream(spark, inventory, stream, f"{root}/inv", f"{root}/res", f"{root}/_ck", "user_id",
                       "request_id", buckets=buckets)
        got = sorted(tuple(r) for r in read_results(spark, f"{root}/res")
                     .select("request_id", "user_id", "qty", "result").collect())
        assert got == want, buckets
        stock = sorted(tuple(r) for r in read_stock(spark, f"{root}/inv")
                       .select("user_id", "qty_on_hand", "qty_reserved").collect())
        assert stock == want_stock, buckets


def test_bucketed_reserve_replay_converges(spark):
    """Re-running a batch after its buckets were rewritten gives the same state."""
    from tidewater.plans.catalog import reservation_inputs
    from tidewater.streaming import reserve_stream as RS
    inventory, requests = reservation_inputs(spark, SF)
    root = scratch_path(spark, "rsv-replay")
    decide = RS._bucketed(spark, inventory, f"{root}/inv", f"{root}/res", ["user_id"], "request_id", "qty",
                          "request_id", "qty_reserved", 4)
    decide(requests, 0)
    once = sorted(tuple(r) for r in RS.read_stock(spark, f"{root}/inv").collect())
    res1 = sorted(tuple(r) for r in spark.read.parquet(f"{root}/res").collect())
    decide(requests, 0)  # replay of the same batch
    assert sorted(tuple(r) for r in RS.read_stock(spark, f"{root}/inv").collect()) == once
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/res").collect()) == res1


def test_migrate_tables_holds_no_log_part_in_one_file(spark, tmp_path, monkeypatch):
    """Each part of the change log is written by several tasks and is one micro-batch of all its files."""
    from tidewater import session
    from tidewater.plans.catalog import QUERIES
    monkeypatch.setattr(session, "scratch_path", lambda *_: f"{tmp_path}/scratch")
    spark.range(0, 400, 1, 4).selectExpr(
        "id AS event_id", "id % 9 AS user_id", "'view' AS event_type", "'{\"k\": 99}' AS props",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["migrate_tables"](spark, str(tmp_path)).count()
    assert len(list((tmp_path / "scratch/_checkpoint/commits").glob("[0-9]"))) == 3
    assert all(len(list((tmp_path / f"scratch/log/{n}").glob("*.parquet"))) > 1 for n in range(3))


def test_empty_tables_in_every_layout(spark, tmp_path):
    """Migration from an empty snapshot and reservation against no stock, whole and bucketed, then with nothing at all."""
    from tidewater.plans.catalog import requests_of
    from tidewater.sinks.target import merge_into_buckets, read_bucketed, write_bucketed
    from tidewater.streaming.cdc_stream import MigratedTable, migrate_tables
    from tidewater.streaming.reserve_stream import read_results, read_stock, reserve_stream
    snapshot = read_table(spark, SF, "customer").filter("false")
    want = _rows(live(apply_changes(snapshot_target(snapshot), change_log(spark, SF), "c_custkey", CUSTOMER_COLS)))
    for buckets in (None, 4):
        root = f"{tmp_path}/mig{buckets}"
        migrate(spark, snapshot, change_log_of(events_stream(spark, SF)), f"{root}/t", "c_custkey", CUSTOMER_COLS, -1,
                f"{root}/_ck", buckets=buckets)
        assert _rows(read_live(spark, f"{root}/t")) == want and want
        stock = spark.createDataFrame([], "user_id long, qty_on_hand int, qty_reserved int")
        reserve_stream(spark, stock, requests_of(events_stream(spark, SF)), f"{root}/inv", f"{root}/res", f"{root}/_rk",
                       "user_id", "request_id", buckets=buckets)
        assert read_stock(spark, f"{root}/inv").columns == stock.columns and read_stock(spark, f"{root}/inv").count() == 0
        found = read_results(spark, f"{root}/res")
        assert found.count() == read_table(spark, SF, "events").count() and found.filter("qty > 0 AND result = 0").count() == 0
    # two tables, both empty, from a log for one of them
    log = "table_name string, pos long, op string, before string, after string"
    spark.createDataFrame([("x", 1, "I", None, '{"id": 7, "v": "a"}')], log).write.parquet(f"{tmp_path}/log")
    tables = {t: MigratedTable(spark.createDataFrame([], "id long, v string"), ["id"], ["v"]) for t in ("x", "y")}
    migrate_tables(spark, tables, spark.readStream.schema(log).parquet(f"{tmp_path}/log"), f"{tmp_path}/two", f"{tmp_path}/_ck", buckets=4)
    assert [tuple(r) for r in read_live(spark, f"{tmp_path}/two/x").collect()] == [(7, "a", 1)]
    assert read_live(spark, f"{tmp_path}/two/y").collect() == []
    write_bucketed(spark.createDataFrame([], "id long, v string"), f"{tmp_path}/bare", "id", 4)
    merge_into_buckets(spark, f"{tmp_path}/bare", spark.createDataFrame([], "id long"), "id", 4, lambda cur, ch: cur)
    assert read_bucketed(spark, f"{tmp_path}/bare").columns == ["id", "v"] and read_bucketed(spark, f"{tmp_path}/bare").count() == 0

"""CDC apply, metric alarms, JSON rollups, parity and audit."""
import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidewater.operators import monitor as M
from tidewater.operators.cdc import apply_changes, cdc_latency, live, snapshot_target, split_key_changes
from tidewater.operators.validate import audit_snapshot, count_parity, cutover_gate

CH = "pos long, op string, id long, name string, amount int"


def _target(spark):
    return snapshot_target(spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)],
                                                 "id long, name string, amount int"))


def _rows(df):
    return sorted(tuple(r) for r in live(df).select("id", "name", "amount").collect())


def test_apply_changes_latest_wins_and_deletes(spark):
    ch = spark.createDataFrame([(5, "U", 1, "a2", 11), (7, "U", 1, "a3", 12), (6, "D", 2, None, None),
                                (8, "I", 4, "d", 40), (9, "D", 4, None, None), (10, "I", 4, "d2", 41)], CH)
    out = apply_changes(_target(spark), ch, "id", ["name", "amount"])
    assert _rows(out) == [(1, "a3", 12), (3, "c", 30), (4, "d2", 41)]
    assert out.filter("_deleted").select("id").first().id == 2


def test_micro_batch_split_equals_one_batch_and_replay_is_noop(spark):
    ch = spark.createDataFrame([(5, "U", 1, "a2", 11), (7, "U", 1, "a3", 12), (6, "D", 2, None, None),
                                (8, "I", 4, "d", 40), (9, "U", 2, "late", 0)], CH)
    one = apply_changes(_target(spark), ch, "id", ["name", "amount"])
    first = apply_changes(_target(spark), ch.filter("pos <= 6"), "id", ["name", "amount"])
    split = apply_changes(first, ch.filter("pos > 6"), "id", ["name", "amount"])
    assert _rows(one) == _rows(split)
    replay = apply_changes(split, ch, "id", ["name", "amount"])
    assert sorted(map(tuple, replay.collect())) == sorted(map(tuple, split.collect()))
    # a change older than the delete must not revive the row
    late = spark.createDataFrame([(4, "U", 2, "ghost", 1)], CH)
    assert 2 not in [r[0] for r in _rows(apply_changes(first, late, "id", ["name", "amount"]))]


def test_key_change_becomes_delete_plus_insert(spark):
    ch = spark.createDataFrame([(5, "U", 9, 1, "a9", 19)], "pos long, op string, id long, before_id long, name string, amount int")
    out = apply_changes(_target(spark), split_key_changes(ch, "id", "before_id").drop("before_id"), "id",
                        ["name", "amount"])
    assert _rows(out) == [(2, "b", 20), (3, "c", 30), (9, "a9", 19)]


def test_cdc_latency(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 1, 30, 500000))],
                               "committed_at timestamp, captured_at timestamp")
    assert cdc_latency(df).first().source_latency_s == D("90.500000")


def test_alarm_golden_sequence(spark):
    base = dt.datetime(2024, 1, 1)
    stats = spark.createDataFrame([("x", base + dt.timedelta(minutes=i), float(v))
                                   for i, v in enumerate([50, 70, 80, 90, 30])],
                                  "dim string, period_start timestamp_ntz, value double")
    st = M.alarm_states(stats, ["dim"], 60, 60, "GreaterThanThreshold", 3).orderBy("period_start").collect()
    assert [r.state for r in st] == ["INSUFFICIENT", "INSUFFICIENT", "OK", "ALARM", "OK"]
    tr = M.alarm_transitions(M.alarm_states(stats, ["dim"], 60, 60, "GreaterThanThreshold", 3), ["dim"], 60)
    assert [(r.previous_state, r.state) for r in tr.orderBy("period_start").collect()] == \
        [("OK", "ALARM"), ("ALARM", "OK")]


def test_alarm_gaps(spark):
    base = dt.datetime(2024, 1, 1)
    stats = spark.createDataFrame([("x", base, 90.0), ("x", base + dt.timedelta(minutes=2), 95.0),
                                   ("x", base + dt.timedelta(minutes=3), 99.0)],
                                  "dim string, period_start timestamp_ntz, value double")
    ign = [r.state for r in M.alarm_states(stats, ["dim"], 60, 60, "GreaterThanThreshold", 2)
           .orderBy("period_start").collect()]
    assert ign == ["INSUFFICIENT", "INSUFFICIENT", "INSUFFICIENT", "ALARM"]
    br = [r.state for r in M.alarm_states(stats, ["dim"], 60, 60, "GreaterThanThreshold", 2, missing="breaching")
          .orderBy("period_start").collect()]
    assert br == ["INSUFFICIENT", "ALARM", "ALARM", "ALARM"]


def test_period_stat_exact(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), v) for m, v in [(1, 0.1), (2, 0.2), (3, 0.4), (61, 1.0)]]
    df = spark.createDataFrame(rows, "dim string, ts timestamp_ntz, v double")
    got = {r.period_start: (r.value, r.samples) for r in
           M.period_stat(df, "ts", "v", ["dim"], 3600, "Average", exact_scale=2).collect()}
    assert got[dt.datetime(2024, 1, 1)] == (D("0.233333"), 3)


def test_rule_table_and_event_filter(spark):
    assert len(M.ALARM_RULES) == 10
    assert {r.evaluation_periods for r in M.ALARM_RULES} == {1, 2, 3}
    ev = spark.createDataFrame([("failure", "ri-1"), ("deletion", "ri-2"), ("maintenance", "ri-1")],
                               "category string, source_id string")
    assert M.filter_events(ev, M.EVENT_CATEGORIES, source_ids=["ri-1"], source="source_id").count() == 1


def test_health_rollups(spark):
    tunnels = ('[[{"status":"UP","ip":"1.1.1.1","reason":""},{"status":"DOWN","ip":"1.1.1.2","reason":"x"}],'
               '[{"status":"UP","ip":"2.2.2.1"},{"status":"UP","ip":"2.2.2.2"}]]')
    df = spark.createDataFrame([(tunnels,), ("[]",), ("not json",)], "j string")
    got = [(r.endpoints, r.up, r.ready) for r in M.tunnel_rollup(df, "j", 2).collect()]
    assert got == [(4, 3, True), (0, 0, False), (0, 0, False)]
    peers = ('{"result":{"bgpPeerStatus":[{"name":"p1","state":"ESTABLISHED","status":"UP","advertisedRoutes":["a","b"]},'
             '{"name":"p2","state":"ESTABLISHED","status":"DOWN"},{"name":"p3","state":"IDLE","status":"UP",'
             '"advertisedRoutes":["c"]}]}}')
    pdf = spark.createDataFrame([(peers,), ("{}",)], "j string")
    got = [(r.peers, r.established, r.advertised_routes, r.ready) for r in M.peer_rollup(pdf, "j", 1).collect()]
    assert got == [(3, 1, 3, True), (0, 0, 0, False)]


def test_parity_gate_and_audit(spark):
    ten = spark.range(10)
    src = {"a": ten, "b": ten, "c": ten}
    dst = {"a": ten, "b": spark.range(8), "c": None}
    got = {r.table_name: (r.delta, r.status, r.label) for r in count_parity(spark, src, dst, ["a", "b", "c"]).collect()}
    assert got == {"a": (0, "MATCH", "MATCH"), "b": (-2, "MISMATCH", "-2"), "c": (None, "ERR", "ERR")}
    gate = cutover_gate(count_parity(spark, src, dst, ["a", "b", "c"])).first()
    assert (gate.passed, gate.failed, gate.total, gate.safe_to_cutover) == (1, 2, 3, False)
    same = count_parity(spark, src, src, ["a", "b", "c"])
    assert {r.status for r in same.collect()} == {"MATCH"}
    renamed = count_parity(spark, src, {"mig_a": ten}, ["a"], rename=lambda t: f"mig_{t}").first()
    assert renamed.status == "MATCH" and renamed.target_table == "mig_a"
    audit = audit_snapshot(spark, {"a": ten, "_internal": ten, "xflyway": ten}, F.lit(None).cast("timestamp"))
    assert sorted(r.table_name for r in audit.collect()) == ["a", "xflyway"]


def test_apply_changes_broadcast_and_shuffle_plans_agree(spark):
    ch = spark.createDataFrame([(5, "U", 1, "a2", 11), (6, "D", 2, None, None), (8, "I", 4, "d", 40)], CH)
    a = apply_changes(_target(spark), ch, "id", ["name", "amount"])
    b = apply_changes(_target(spark), ch, "id", ["name", "amount"], max_broadcast_bytes=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_metric_queries_do_not_depend_on_session_time_zone(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    names = ["alarm_states", "alarm_transitions", "cdc_latency", "period_stat", "period_stat_stream"]
    base = {n: sorted(map(tuple, E.queries()[n](spark, sf).collect())) for n in names}
    for tz in ("Asia/Kolkata",):  # +05:30: period slots would shift under any zone arithmetic
        spark.conf.set("spark.sql.session.timeZone", tz)
        try:
            for n in names:
                assert sorted(map(tuple, E.queries()[n](spark, sf).collect())) == base[n], (tz, n)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["I", "U", "D"]), st.integers(1, 6), st.integers(0, 99)),
                min_size=1, max_size=25),
       st.lists(st.integers(0, 25), max_size=3))
def test_property_any_split_equals_one_batch(spark, changes, cuts):
    rows = [(pos, op, k, None if op == "D" else f"v{v}", None if op == "D" else v)
            for pos, (op, k, v) in enumerate(changes)]
    ch = spark.createDataFrame(rows, CH)
    one = _rows(apply_changes(_target(spark), ch, "id", ["name", "amount"]))
    bounds = sorted(set([0, *cuts, len(rows)]))
    cur = _target(spark)
    for lo, hi in zip(bounds, bounds[1:]):
        cur = apply_changes(cur, ch.filter(f"pos >= {lo} AND pos < {hi}"), "id", ["name", "amount"])
    assert _rows(cur) == one


def test_evaluate_rule_and_tombstone_purge(spark):
    from tidewater.operators.cdc import purge_tombstones
    rule = next(r for r in M.ALARM_RULES if r.name == "dms-cdc-latency-high")
    base = dt.datetime(2024, 1, 1)
    pts = spark.createDataFrame(
        [("CDCLatencySource", base + dt.timedelta(seconds=60 * i + s), float(v))
         for i, peak in enumerate([50, 70, 80, 90, 30]) for s, v in ((5, peak - 20), (30, peak))]
        + [("CPUUtilization", base, 99.0)], "metric_name string, ts timestamp_ntz, value double")
    got = [r.state for r in M.evaluate_rule(pts, rule).orderBy("period_start").collect()]
    assert got == ["INSUFFICIENT", "INSUFFICIENT", "OK", "ALARM", "OK"]
    ch = spark.createDataFrame([(5, "D", 2, None, None), (9, "D", 3, None, None)], CH)
    out = apply_changes(_target(spark), ch, "id", ["name", "amount"])
    assert sorted(r.id for r in purge_tombstones(out, 6).collect()) == [1, 3]


@pytest.mark.parametrize("name", ["tunnel_rollup", "peer_rollup"])
def test_rollups_keep_no_list_of_a_users_events(spark, tmp_path, name):
    """One user holds all events: the sums are right and no row holds them all."""
    from tidewater.plans.catalog import QUERIES
    spark.range(3000).selectExpr("id AS event_id", "7L AS user_id", "'view' AS event_type", "'{\"k\": 99}' AS props",
                                 "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    row = out.collect()[0].asDict()
    assert row.get("endpoints", row.get("peers")) == row.get("up", row.get("established")) == 3000 and row["ready"]


def test_applied_times_first_commit_counts(spark, tmp_path):
    """Both layouts record when each change was committed; a replayed batch keeps its time, a replayed change its first."""
    import datetime as dt
    from tidewater.operators.cdc import cdc_latency
    from tidewater.operators.monitor import latency_points
    from tidewater.streaming.cdc_stream import applied_times, migrate, record_applied
    kind = "pos long, op string, id long, v string, committed_at timestamp_ntz, captured_at timestamp_ntz"
    start = dt.datetime(2024, 1, 1)
    parts = [[(1, "I", 1, "a", start, start), (2, "U", 1, "b", start, start + dt.timedelta(seconds=3))],
             [(2, "U", 1, "b", start, start + dt.timedelta(seconds=3)), (3, "D", 1, None, start, start)]]
    for buckets in (None, 4):
        root = f"{tmp_path}/{buckets}"
        for n, rows in enumerate(parts):
            spark.createDataFrame(rows, kind).write.parquet(f"{root}/log/{n}")
            stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{root}/log")
            migrate(spark, spark.createDataFrame([], "id long, v string"), stream, f"{root}/t", "id", ["v"], -1, f"{root}/_ck",
                    buckets=buckets, applied_root=f"{root}/applied", clock=lambda b: start + dt.timedelta(seconds=60 * (b + 1)))
        record_applied(spark.createDataFrame(parts[0], kind), f"{root}/applied", 0, clock=lambda b: start)
        times = {r.pos: r.applied_at for r in applied_times(spark, f"{root}/applied").collect()}
        assert times == {1: start + dt.timedelta(seconds=60), 2: start + dt.timedelta(seconds=60), 3: start + dt.timedelta(seconds=120)}
    log = spark.createDataFrame([r for p in parts for r in p][:2] + [(9, "I", 5, "x", start, start)], kind)
    out = cdc_latency(log.join(applied_times(spark, f"{root}/applied"), "pos", "left"), applied="applied_at")
    assert {r.pos: r.target_latency_s for r in out.collect()} == {1: 60, 2: 60, 9: None}
    assert sorted((r.metric_name, r.value) for r in latency_points(out).collect()) == [
        ("CDCLatencySource", 0.0), ("CDCLatencySource", 0.0), ("CDCLatencySource", 3.0), ("CDCLatencyTarget", 60.0), ("CDCLatencyTarget", 60.0)]


def test_counts_raise_what_is_not_an_unreadable_table(spark, tmp_path):
    """A missing or corrupt file makes a table unreadable; any other failure is not taken for it."""
    import pytest
    from tidewater.operators.validate import UNREADABLE, audit_snapshot, table_counts
    (tmp_path / "bad.parquet").write_bytes(b"this is no table at all, it only looks like one")
    kind = "a int"
    tables = {"good": spark.range(3), "none": None, "bad": spark.read.schema(kind).parquet(f"{tmp_path}/bad.parquet")}
    got = {r.table_name: (r.row_count, r.readable) for r in table_counts(spark, {k: v if k != "bad" else v.filter("a > 0") for k, v in tables.items()}).collect()}
    assert got == {"good": (3, True), "none": (None, False), "bad": (None, False)}
    events = {r.table_name: r.event for r in audit_snapshot(spark, {"good": spark.range(3), "none": None}).collect()}
    assert events == {"good": "post_load_snapshot", "none": "post_load_snapshot" + UNREADABLE}
    with pytest.raises(Exception):
        table_counts(spark, {"fails": spark.range(3).filter("assert_true(id < 1) IS NULL")})

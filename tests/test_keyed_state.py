"""Keyed streaming state equals the batch operators, however points are dealt to micro-batches."""
import datetime as dt
import random

import pytest

from tidewater.operators.monitor import alarm_states, alarm_transitions, period_stat
from tidewater.streaming.keyed_state import alarm_records, append_records, merged_periods, notifications, reserve_keyed

START = dt.datetime(2024, 3, 1)
KIND = "host string, ts timestamp_ntz, value double"


def points(seed_value):
    rng = random.Random(seed_value)
    rows = []
    for minute in range(240):
        for host in ("a", "b", None):
            if rng.random() < (0.25 if host == "b" else 0.8) and not (host == "a" and 60 <= minute < 110):
                for _ in range(rng.randint(1, 3)):
                    rows.append((host, START + dt.timedelta(seconds=60 * minute + rng.randint(0, 59)), rng.choice([10.0, 90.25, 99.5, None])))
    rows.append(("once", START + dt.timedelta(seconds=30), 99.0))
    return rows


def dealt(spark, folder, batches, **kwargs):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(2).write.parquet(f"{folder}/points/{n}")
        stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(f"{folder}/points")
        append_records(alarm_records(stream, "ts", "value", ["host"], 60, **kwargs), f"{folder}/records", f"{folder}/_checkpoint")
    return spark.read.parquet(f"{folder}/records")


@pytest.mark.parametrize("statistic,missing", [("Average", "ignore"), ("Maximum", "breaching")])
def test_out_of_order_batches_equal_batch(spark, tmp_path, statistic, missing):
    rows = points(1)
    rng = random.Random(2)
    # within an hour of each other in any order; the last batch closes everything (three metrics go silent before it)
    batches = [[], [], [], []]
    for r in rows:
        batches[min(3, max(0, int((r[1] - START).total_seconds() // 3600) - rng.randint(0, 1)))].append(r)
    assert all(batches)
    batches.append([("end", START + dt.timedelta(hours=9), 1.0)])
    records = dealt(spark, str(tmp_path), batches, statistic=statistic, threshold=50, comparison="GreaterThanThreshold",
                    evaluation_periods=3, missing=missing, watermark="2 hours")
    assert records.filter("kind = 'late'").count() == 0
    stats = period_stat(spark.createDataFrame(rows, KIND), "ts", "value", ["host"], 60, statistic, exact_scale=2)
    states = alarm_states(stats, ["host"], 60, 50, "GreaterThanThreshold", 3, missing)
    want = {(r.host, r.period_start): r.state for r in states.join(
        stats.select("host", "period_start"), ["host", "period_start"], "left_semi").collect()}
    want |= {(r.host, r.period_start): r.state for r in states.filter("host IS NULL").collect() if r.value is not None}
    got = {(r.host, r.period_start): r.state for r in records.filter("kind = 'period'").collect()}
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None} and len(got) > 300
    # transitions up to each metric's last point, and those that silence brings after it
    last = {h: max(k[1] for k in got if k[0] == h) for h in ("a", "b")}
    told = {tuple(r) for r in notifications(records, ["host"]).filter("host IN ('a', 'b')").collect()}
    batch = {tuple(r) for r in alarm_transitions(states.filter("host IN ('a', 'b')"), ["host"], 60).collect()}
    assert {t for t in told if t[1] <= last[t[0]]} == batch and batch
    assert missing == "ignore" or {t[0] for t in told if t[1] > last[t[0]]} <= {"a", "b"}
    merged = {(r.host, r.period_start): (r.value, r.samples) for r in merged_periods(records, ["host"], statistic).collect()}
    for r in stats.collect():
        value, samples = merged[r.host, r.period_start]
        assert samples == r.samples and (value == r.value or abs(value - r.value) < 1e-3)


def test_late_points_are_kept(spark, tmp_path):
    rows = points(5)
    early = [r for r in rows if r[1] < START + dt.timedelta(hours=3)]
    late = [r for i, r in enumerate(early) if i % 4 == 0]
    batches = [[r for i, r in enumerate(early) if i % 4], [r for r in rows if r not in early] + late,
               [("end", START + dt.timedelta(hours=9), 1.0)]]
    records = dealt(spark, str(tmp_path), batches, statistic="Sum", threshold=100, comparison="GreaterThanThreshold",
                    evaluation_periods=2, watermark="5 minutes")
    n_late = records.filter("kind = 'late'").selectExpr("sum(n)").first()[0]
    assert 0.8 * len(late) < n_late <= len(late)
    merged = merged_periods(records, ["host"], "Sum")
    assert merged.selectExpr("sum(late_samples)").first()[0] == n_late
    stats = period_stat(spark.createDataFrame(rows, KIND), "ts", "value", ["host"], 60, "Sum", exact_scale=2)
    assert (sorted(((str(r.host), r.period_start, r.value, r.samples) for r in merged.collect()), key=str)
            == sorted(((str(r.host), r.period_start, r.value, r.samples) for r in stats.collect()), key=str))


def test_reserve_keyed_edges(spark, tmp_path):
    kind = "request_id long, k long, qty int"
    stock = spark.createDataFrame([(1, 10, 2), (2, 5, 9)], "k long, qty_on_hand int, qty_reserved int")
    batches = [[(2, 1, 5), (1, 1, 4), (3, None, 0), (4, 9, 1), (5, 9, -3), (6, 1, None), (7, 2, -6), (8, 2, -4)],
               [(11, 1, -2), (10, 1, 5), (9, 1, 4), (12, 1, 2)], []]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        append_records(reserve_keyed(stock, stream, "k", "request_id"), f"{tmp_path}/out", f"{tmp_path}/_ck")
    got = {r.request_id: r.result for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # key 1 starts with 8: 4 yes, 5 no; then 4 yes, 5 no, 2 back, 2 yes. Key 2 starts with -4: -6 yes (2 left), -4 yes
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 0, 9: 0, 10: 1, 11: 0, 12: 0}


def test_reserve_keyed_many_keys_few_calls(spark, tmp_path):
    """Keys share states and keep their own stock; ids beyond 2**53 stay exact beside null ones; keys of several columns."""
    big, n = 1 << 60, 400
    kind = "request_id long, k long, s string, qty int"
    stock = spark.createDataFrame([(k, s, 3, 0) for k in range(n) for s in ("a", "b")], "k long, s string, qty_on_hand int, qty_reserved int")
    batches = [[(big + 4 * k + i, k, s, 2) for k in range(n) for i, s in enumerate(("a", "b"))] + [(None, 0, "a", 1), (big + 2, 1, "a", 9)],
               [(big + 4 * n + k, k, "a", 1 + k % 2) for k in range(n)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        append_records(reserve_keyed(stock, stream, ["k", "s"], "request_id", buckets=5), f"{tmp_path}/out", f"{tmp_path}/_ck")
    got = {(r.request_id, r.k, r.s): r.result for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # 3 in stock, 2 taken by all; the null id comes last and takes key (0, a)'s last one
    want = {(r[0], r[1], r[2]): 0 for r in batches[0]} | {(big + 2, 1, "a"): 1}
    assert got == want | {(big + 4 * n + k, k, "a"): int(k % 2 or k == 0) for k in range(n)}
    states = [int(r[0]) for r in spark.read.format("statestore").load(f"{tmp_path}/_ck").selectExpr("size(value.groupState.keys)").collect()]
    assert len(states) == 5 and sum(states) == 2 * n

"""Mergeable distinct counts within their bound; a load that dies goes on."""
import datetime as dt
import random

import pytest

from tidewater.operators.sketches import daily_sketches, error_bound, merged_distinct
from tidewater.sinks.resume import done_parts, load_complete, plan_ranges, read_loaded, resumable_load


def test_sketches_of_days_merge_to_any_range(spark, tmp_path):
    rng = random.Random(1)
    rows = [(dt.datetime(2024, 1, 1 + rng.randrange(20), rng.randrange(24)), rng.choice("ab"), rng.randrange(6000)) for _ in range(30_000)]
    rows += [(None, "a", 1), (dt.datetime(2024, 1, 3), "a", None), (dt.datetime(2024, 1, 3), "c", None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, g string, v long")
    daily_sketches(df, "ts", "v", ["g"]).write.parquet(f"{tmp_path}/s")
    sketches = spark.read.parquet(f"{tmp_path}/s")
    assert sketches.selectExpr("sum(values)").first()[0] == 30_000
    for first, last in ((1, 20), (3, 3), (5, 12)):
        got = {r.g: r.estimate for r in merged_distinct(sketches, ["g"], f"2024-01-{first:02}", f"2024-01-{last:02}").collect()}
        for g in "ab":
            exact = len({v for t, h, v in rows if h == g and t and v is not None and first <= t.day <= last})
            assert abs(got[g] - exact) <= exact * error_bound() + 1
        assert got.get("c", 0) == 0
    assert merged_distinct(sketches.filter("false"), ["g"]).collect() == []


def test_load_resumes(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, 7, 7, 7, *range(500)]), f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(4)
    root, seen = f"{tmp_path}/t", []

    def die_at(at):
        def before(part):
            seen.append(part)
            if len(seen) == at:
                raise RuntimeError("killed")
        return before

    assert not load_complete(spark, root) and read_loaded(spark, root, df.schema).count() == 0
    for at in (2, 4):
        with pytest.raises(RuntimeError):
            resumable_load(df, root, "k", 5, max_parallel=1, before_part=die_at(at))
        assert not load_complete(spark, root)
        assert read_loaded(spark, root, df.schema).count() == sum(done_parts(spark, root).values())
    first = set(done_parts(spark, root))
    spark.createDataFrame([(1, "half")], "k int, v string").write.mode("overwrite").parquet(f"{root}/part=3")   # what a dead task left
    written = resumable_load(df, root, "k", 5)
    assert first and not first & set(written) and load_complete(spark, root) and resumable_load(df, root, "k", 5) == []
    assert sorted(map(tuple, read_loaded(spark, root, df.schema).collect()), key=str) == sorted(rows, key=str)


def test_ranges(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "k long")
    parts = plan_ranges(df, "k", 4).collect()
    assert [r.part for r in parts] == [-1, 0, 1, 2, 3] and all(abs(r.hi - 250 * (r.part + 1)) <= 30 for r in parts[1:4])
    assert [r.part for r in plan_ranges(df.filter("false"), "k", 4).collect()] == [-1, 0]
    with pytest.raises(ValueError):
        plan_ranges(spark.createDataFrame([("a",)], "k string"), "k", 2)

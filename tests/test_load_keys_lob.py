"""LOB cut, surrogate keys, full load and the versioned target."""
import os
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions.lob import limit_lob, utf8_prefix
from tidewater.operators.keys import assign_ids
from tidewater.operators.validate import count_parity
from tidewater.sinks.target import full_load, load_summary, prefix_rename, read_current, select_tables, write_version
from tidewater.sources.tables import read_table


def _cut(s: str, n: int) -> str:
    out = s.encode("utf-8")[:n]
    return out.decode("utf-8", errors="ignore") if len(s.encode("utf-8")) > n else s


def test_lob_cut_on_character_boundary(spark):
    texts = ["abcdef", "abécd", "a€b", "\U0001F600\U0001F600", "", None, "x" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (4, 5, 6):
        got = [r.t for r in df.select(utf8_prefix("t", n).alias("t")).collect()]
        want = [None if t is None else _cut(t, n) for t in texts]
        assert got == want, n


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_lob_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in df.select(utf8_prefix("t", 7).alias("t")).collect()]
    for t, g in zip(texts, got):
        assert len(g.encode("utf-8")) <= 7 and t.startswith(g) and g == _cut(t, 7)


def test_limit_lob_kb(spark):
    df = spark.createDataFrame([("é" * 20000,)], "t string")
    out = limit_lob(df, ["t"], max_kb=32).first().t
    assert len(out.encode("utf-8")) == 32768 and len(out) == 16384


def test_assign_ids(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("v"))
    got = assign_ids(df, "item_id", ["v"], start=10, partitions=7).collect()
    assert sorted(r.item_id for r in got) == list(range(10, 5010))
    assert all(r.item_id == r.v + 10 for r in got)
    existing = spark.createDataFrame([(41,)], "m long")
    got2 = assign_ids(df.limit(3), "id2", ["v"], existing_max=existing).agg(F.min("id2")).first()[0]
    assert got2 == 42


def test_full_load_selection_rename_parity(spark):
    src = "/root/testdata/sf0.001"
    dst = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    names = ["orders", "lineitem", "embeddings", "labels", "_private"]
    assert select_tables(spark, names, ["%"], ["emb%", "labels", "\\_%"]) == ["lineitem", "orders"]
    loaded = full_load(spark, src, dst, include=["orders", "line%", "region"], prefix="mig_",
                       prep="DROP_AND_CREATE")
    assert sorted(loaded) == [("lineitem", "mig_lineitem"), ("orders", "mig_orders"), ("region", "mig_region")]
    summary = {r.source_table: r.rows for r in load_summary(spark, dst, loaded).collect()}
    assert summary["orders"] == read_table(spark, src, "orders").count()
    rename = prefix_rename("mig_")
    source = {t: read_table(spark, src, t) for t in ["orders", "lineitem"]}
    target = {rename(t): read_table(spark, dst, rename(t)) for t in ["orders", "lineitem"]}
    assert {r.status for r in count_parity(spark, source, target, ["orders", "lineitem"], rename).collect()} == {"MATCH"}
    full_load(spark, src, dst, include=["region"], prefix="mig_")  # DO_NOTHING appends
    assert read_table(spark, dst, "mig_region").count() == 2 * read_table(spark, src, "region").count()


def test_versioned_write(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "t")
    write_version(spark.range(3), root, 0)
    write_version(spark.range(5), root, 1)
    assert read_current(spark, root).count() == 5


def test_list_formats_and_expr_helpers(spark):
    from tidewater.functions.expr import endpoint_host, join_csv
    from tidewater.operators.integrity import check_list_format
    df = spark.createDataFrame([(["us-east-1a", "us-east-1b"], "db.example:3306"), (["us-east-1a"], "h:1"),
                                (["bad zone", "us-east-1b"], "x:2")], "azs array<string>, ep string")
    got = {r.rule: r.violations for r in check_list_format(df, "azs", "zone", min_size=2, table="cfg").collect()}
    assert got == {"format": 1, "min_size": 1}
    row = df.select(endpoint_host("ep").alias("h"), join_csv("azs").alias("csv")).first()
    assert row.h == "db.example" and row.csv == "us-east-1a,us-east-1b"


def test_select_changes(spark):
    from tidewater.operators.cdc import select_changes
    ch = spark.createDataFrame([(1, "orders"), (2, "_audit"), (3, "order_items")], "pos long, table_name string")
    out = select_changes(ch, ["order%"], ["\\_%"], prefix="mig_").collect()
    assert sorted(r.table_name for r in out) == ["mig_order_items", "mig_orders"]


def test_jdbc_options_and_audit_append(spark):
    from tidewater.operators.validate import audit_snapshot
    from tidewater.sinks.target import append_audit
    from tidewater.sources.jdbc import mysql_url, source_options
    url = mysql_url("db.internal", 3306, "shop")
    assert url.startswith("jdbc:mysql://db.internal:3306/shop?") and "useSSL=true" in url
    opts = source_options(url, "orders", "u", "p", "order_id", 1, 1000, 8)
    assert (opts["partitionColumn"], opts["numPartitions"], opts["lowerBound"]) == ("order_id", "8", "1")
    assert "partitionColumn" not in source_options(url, "orders", "u", "p")
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "audit")
    ts = F.lit("2024-06-01 00:00:00").cast("timestamp")
    snap = audit_snapshot(spark, {"a": spark.range(3), "b": spark.range(2)}, ts)
    views = audit_snapshot(spark, {"v": spark.range(1)}, ts, event="view_check")
    append_audit(snap.unionByName(views), path)
    append_audit(snap, path)
    got = spark.read.parquet(path)
    assert got.count() == 5 and got.filter("event = 'view_check'").count() == 1

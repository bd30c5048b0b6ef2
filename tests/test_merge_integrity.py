"""Upsert, stamping, integrity checks and delete propagation."""
import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import integrity as I
from tidewater.operators.merge import latest_per_key, mark_migrated, upsert
from tidewater.operators.purge import purge
from tidewater.schemas import DEFAULTS, SCHEMAS, U64, load_order


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def test_upsert_updates_listed_columns_only(seed, spark):
    incoming = spark.createDataFrame([(1, "US East 2", "Canada", "America/Toronto", dt.datetime(2024, 5, 1))],
                                     SCHEMAS["regions"])
    out = {r.region_id: r for r in upsert(seed["regions"], incoming, "region_id",
                                          ["region_name", "timezone"]).collect()}
    assert len(out) == 8
    r1 = out[1]
    assert (r1.region_name, r1.country, r1.timezone) == ("US East 2", "United States", "America/Toronto")


def test_upsert_insert_touch_and_idempotence(seed, spark):
    cust = seed["customers"]
    src = (cust.filter("customer_id in (1, 2)").withColumn("tier", F.lit("platinum"))
           .unionByName(cust.filter("customer_id = 3"))
           .unionByName(cust.filter("customer_id = 1").withColumn("customer_id", F.lit(31).cast("long"))
                        .withColumn("email", F.lit("new@example.com"))))
    once = upsert(cust, src, "customer_id", ["tier"], touch="updated_at", now=now())
    got = {r.customer_id: r for r in once.collect()}
    assert len(got) == 31
    assert got[1].tier == "platinum" and got[1].updated_at == dt.datetime(2024, 6, 1)
    assert got[3].updated_at == dt.datetime(2024, 1, 1)  # unchanged tier: not touched
    assert got[31].email == "new@example.com"
    twice = upsert(once, src, "customer_id", ["tier"], touch="updated_at", now=now())
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_upsert_duplicate_source_keys_last_wins(seed, spark):
    src = spark.createDataFrame([(1, "gold", 1), (1, "silver", 2), (2, "gold", 1)], "customer_id long, tier string, seq int")
    out = {r.customer_id: r.tier for r in upsert(seed["customers"], src, "customer_id", ["tier"],
                                                   order_by="seq", now=now()).collect()}
    assert out[1] == "silver" and out[2] == "gold"
    latest = latest_per_key(src, ["customer_id"], "seq").collect()
    assert {(r.customer_id, r.tier) for r in latest} == {(1, "silver"), (2, "gold")}


def test_mark_migrated_stamps_every_null(seed):
    orders = seed["orders"].withColumn("migrated_at", F.when(F.col("order_id") == 1, F.lit(dt.datetime(2024, 2, 1))))
    got = {r.order_id: r.migrated_at for r in mark_migrated(orders, now()).collect()}
    assert got[1] == dt.datetime(2024, 2, 1)
    assert all(v == dt.datetime(2024, 6, 1) for k, v in got.items() if k != 1)


def test_row_checks(spark):
    df = spark.createDataFrame([(1, "pending", "USD", "a@b.co"), (None, "lost", "EURO", "bad"),
                                (3, None, "USD", None)], "id long, status string, currency string, email string")
    rules = (I.not_null_rules(["id", "status"]) + I.domain_rules({"status": ["pending"]})
             + I.range_rules({"id": (0, 2)}, lengths={"currency": 3}) + I.format_rules({"email": "email"}))
    got = {(r.rule, r.column_name): r.violations for r in I.row_checks(df, "t", rules).collect()}
    assert got == {("not_null", "id"): 1, ("not_null", "status"): 1, ("domain", "status"): 1,
                   ("range", "id"): 1, ("length", "currency"): 1, ("format", "email"): 1}
    big = spark.createDataFrame([(5,), (-1,)], "id long")
    assert I.check_range(big, {"id": (0, U64)}).first().violations == 1


def test_unique_fk_and_propagation(seed, spark):
    dup = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None), (2, 1)], "a long, b long")
    r = I.check_unique(dup, ["a", "b"], "t").first()
    assert (r.violations, r.duplicate_keys) == (1, 1)
    orphans = seed["order_items"].unionByName(
        spark.createDataFrame([(99, 999, 1, 1, None, None, dt.datetime(2024, 1, 1))],
                              seed["order_items"].schema.fromJson({**seed["order_items"].schema.jsonValue(),
                                                                   "fields": [dict(f, nullable=True) for f in
                                                                              seed["order_items"].schema.jsonValue()["fields"]]})))
    assert I.check_fk(orphans, "order_id", seed["orders"], "order_id").first().violations == 1
    deleted = seed["orders"].filter("order_id in (2, 6)")
    kept = I.cascade_delete(seed["order_items"], "order_id", deleted, "order_id")
    assert kept.count() == 9
    assert purge(seed, {"orders": deleted}).doomed["order_items"].count() == 4
    nulled = {r.customer_id: r.region_id for r in
              I.set_null_on_delete(seed["customers"], "region_id", seed["regions"].filter("region_id = 5"),
                                   "region_id").collect()}
    assert nulled[1] is None and nulled[3] == 1
    blocked = {r.customer_id: r.child_rows for r in
               I.check_restrict(seed["orders"], "customer_id", seed["customers"].filter("customer_id in (2, 3)"),
                                "customer_id").collect()}
    assert blocked == {3: 1}
    mapping = spark.createDataFrame([(9, 90)], "old_key int, new_key int")
    moved = {r.category_id: r.parent_id for r in I.remap_key(seed["categories"], "parent_id", mapping).collect()}
    assert moved[9] == 4 and all(v != 9 for v in moved.values())


def test_defaults_and_evolution(spark, seed):
    raw = spark.createDataFrame([(1, "x", None)], "region_id short, region_name string, timezone string")
    out = I.apply_defaults(raw, DEFAULTS["regions"], SCHEMAS["regions"], now=now()).first()
    assert out.timezone == "UTC" and out.created_at == dt.datetime(2024, 6, 1)
    from pyspark.sql import types as T
    old = seed["orders"].drop("deleted_at", "created_by", "migrated_at")
    new = I.evolve(old, [T.StructField("deleted_at", T.TimestampType()), T.StructField("created_by", T.StringType())])
    assert new.columns[-2:] == ["deleted_at", "created_by"]
    both = I.union_evolved(old, seed["orders"])
    assert both.count() == 20 and "migrated_at" in both.columns
    order = load_order()
    assert order.index("regions") < order.index("customers") < order.index("orders") < order.index("order_items")


def test_upsert_broadcast_and_shuffle_plans_agree(seed, spark):
    cust = seed["customers"]
    src = (cust.filter("customer_id <= 5").withColumn("tier", F.lit("gold"))
           .unionByName(cust.filter("customer_id = 1").withColumn("customer_id", F.lit(40).cast("long"))))
    a = upsert(cust, src, "customer_id", ["tier"], touch="updated_at", now=now())
    b = upsert(cust, src, "customer_id", ["tier"], touch="updated_at", now=now(), max_broadcast_bytes=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 31


def test_declared_integrity_report(seed, spark):
    rep = {(r.table_name, r.rule, r.column_name): r.violations for r in I.integrity_report(seed).collect()}
    assert rep and all(v == 0 for v in rep.values())
    assert ("customers", "unique", "email") in rep and ("order_items", "fk", "order_id->order_id") in rep
    bad = dict(seed)
    extra = seed["customers"].filter("customer_id = 1").withColumn("customer_id", F.lit(99).cast("long")) \
        .withColumn("email", F.lit("ARJUN.SHARMA@example.com "))
    bad["customers"] = seed["customers"].unionByName(extra)
    bad["orders"] = seed["orders"].withColumn("status", F.when(F.col("order_id") == 1, "lost").otherwise(F.col("status")))
    rep = {(r.table_name, r.rule, r.column_name): r.violations for r in I.integrity_report(bad).collect()}
    assert rep[("customers", "unique", "email")] == 1   # equal under the lookup collation
    assert rep[("orders", "domain", "status")] == 1
    assert rep[("customers", "unique", "customer_id")] == 0


def test_check_fks_in_one_scan_equal_single_checks(spark):
    child = spark.createDataFrame([(i % 7 if i % 5 else None, i % 3, 1) for i in range(300)], "a int, b long, c int")
    parents = [spark.createDataFrame([(0,), (1,), (2,), (3,)], "id long"), spark.createDataFrame([(1,), (1,)], "id int"),
               spark.createDataFrame([], "id int")]
    refs = [(c, p, "id") for c, p in zip("abc", parents)]
    got = {r.column_name: r.violations for r in I.check_fks(child, refs, "t").collect()}
    assert got == {f"{c}->id": I.check_fk(child, c, p, "id", "t").first().violations for c, p, _ in refs}
    assert got["c->id"] == 300 and {r.violations for r in I.check_fks(child.filter("false"), refs, "t").collect()} == {0}

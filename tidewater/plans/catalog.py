"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry binds a library function to the driver tables (``bindings``)
and normalises the output for comparison with the oracle SQL: exact
decimals for money and means are cast to DOUBLE at the very end, counts
and integer sums to BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import reports
from .bindings import Driver

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def as_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("decimal(18,6)").cast("double") for c in cols})


def as_bigint(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


# ------------------------------------------------------------------ reports
@register("daily_revenue")
def q_daily_revenue(spark, sf_dir):
    d = Driver(spark, sf_dir)
    out = reports.daily_revenue(d.orders)
    return as_double(out, "gross_revenue", "tax_collected", "shipping_revenue", "net_revenue",
                     "avg_order_value")


@register("order_summary")
def q_order_summary(spark, sf_dir):
    d = Driver(spark, sf_dir)
    out = reports.order_summary(d.orders, d.customers, d.regions, d.warehouses, d.items)
    return as_bigint(as_double(out, "total_amount"), "line_count", "total_units")


@register("inventory_health")
def q_inventory_health(spark, sf_dir):
    d = Driver(spark, sf_dir)
    return reports.inventory_health(d.inventory, d.products, d.warehouses)


@register("customer_ltv")
def q_customer_ltv(spark, sf_dir):
    d = Driver(spark, sf_dir)
    out = reports.customer_ltv(d.customers, d.orders)
    return as_bigint(as_double(out, "lifetime_value", "avg_order_value"), "total_orders")


@register("top_products")
def q_top_products(spark, sf_dir):
    d = Driver(spark, sf_dir)
    out = reports.top_products(d.items, d.products, d.categories)
    return as_bigint(as_double(out, "total_revenue", "avg_selling_price"), "units_sold", "order_appearances")


@register("top_products_n")
def q_top_products_n(spark, sf_dir):
    d = Driver(spark, sf_dir)
    out = reports.top_products(d.items, d.products, d.categories, n=20)
    return as_bigint(as_double(out, "total_revenue", "avg_selling_price"), "units_sold", "order_appearances")


@register("regional_sales")
def q_regional_sales(spark, sf_dir):
    d = Driver(spark, sf_dir)
    out = reports.regional_sales(d.orders, d.customers, d.regions)
    return as_bigint(as_double(out, "total_revenue", "avg_order_value"), "active_customers", "total_orders")


@register("orders_by_status")
def q_orders_by_status(spark, sf_dir):
    d = Driver(spark, sf_dir)
    return as_double(reports.orders_by_status(d.orders, "shipped"), "total_amount")


@register("order_history_topn")
def q_order_history_topn(spark, sf_dir):
    d = Driver(spark, sf_dir)
    return as_double(reports.order_history(d.orders, n=3), "total_amount")


@register("reorder_check")
def q_reorder_check(spark, sf_dir):
    d = Driver(spark, sf_dir)
    return reports.reorder_check(d.inventory)


@register("browse_category")
def q_browse_category(spark, sf_dir):
    d = Driver(spark, sf_dir)
    return as_double(reports.browse_category(d.products), "unit_price")


@register("tier_region_counts")
def q_tier_region_counts(spark, sf_dir):
    d = Driver(spark, sf_dir)
    return reports.tier_region_counts(d.customers)


@register("product_sales")
def q_product_sales(spark, sf_dir):
    d = Driver(spark, sf_dir)
    return as_bigint(as_double(reports.product_sales(d.items), "revenue"), "units_sold")


# one customer, warehouse or category, as the procedures take them
ONE = 7


@register("customer_ltv_one")
def q_customer_ltv_one(spark, sf_dir):
    d = Driver(spark, sf_dir)
    out = reports.customer_ltv(d.customers, d.orders, customer_id=ONE)
    return as_bigint(as_double(out, "lifetime_value", "avg_order_value"), "total_orders")


@register("order_history_one")
def q_order_history_one(spark, sf_dir):
    return as_double(reports.order_history(Driver(spark, sf_dir).orders, customer_id=ONE, n=5), "total_amount")


@register("reorder_check_one")
def q_reorder_check_one(spark, sf_dir):
    return reports.reorder_check(Driver(spark, sf_dir).inventory, warehouse_id=ONE)


@register("browse_category_one")
def q_browse_category_one(spark, sf_dir):
    return as_double(reports.browse_category(Driver(spark, sf_dir).products, category_id=21), "unit_price")


# orders are moved into the validity years of the seed codes by a fixed offset
CODE_DAY_OFFSET = 9496  # 1998-01-01 -> 2024-01-01


@register("codes_for_orders")
def q_codes_for_orders(spark, sf_dir):
    from ..sources.seed import seed_df
    d = Driver(spark, sf_dir)
    shifted = d.orders.withColumn("ordered_at", F.col("ordered_at") + F.expr(f"INTERVAL {CODE_DAY_OFFSET} DAYS"))
    out = reports.codes_for_orders(shifted, seed_df(spark, "discount_codes"))
    return as_double(out, "total_amount", "discount_amount")


SEARCH_TEXT = "blue widget with a steel bolt"


@register("search_products")
def q_search_products(spark, sf_dir):
    d = Driver(spark, sf_dir)
    return reports.search_products(d.products, SEARCH_TEXT)


SEARCHES = ["the thing and", "Und der Ächte", "password token", "élle que", "edition", "nothing-like-it"]


@register("search_ranked")
def q_search_ranked(spark, sf_dir):
    """Documents ranked by an inverted index that was built on most of them, then got the others, new texts and deletions."""
    from ..operators.search_index import build_index, search_index, update_index
    from ..session import scratch_path
    root = scratch_path(spark, "search")
    docs = Driver(spark, sf_dir).raw("documents").select("doc_id", "text")
    build_index(docs.filter(F.col("doc_id") % 7 != 3), "doc_id", "text", root, buckets=16)
    changed = docs.filter(F.col("doc_id") % 11 == 5).select("doc_id", F.concat(F.substring("text", 1, 500), F.lit(" second EDITION, edition")).alias("text"))
    update_index(spark, root, docs.filter((F.col("doc_id") % 7 == 3) & (F.col("doc_id") % 11 != 5)).unionByName(changed), "doc_id", "text",
                 docs.filter((F.col("doc_id") % 13 == 4) & (F.col("doc_id") % 11 != 5) & (F.col("doc_id") % 7 != 3)), buckets=16)
    return search_index(spark, root, SEARCHES, "doc_id", 20, buckets=16)


# ---------------------------------------------------------------- integrity
def _integrity():
    from ..operators import integrity
    return integrity


@register("check_unique_lineitem")
def q_check_unique_lineitem(spark, sf_dir):
    d = Driver(spark, sf_dir)
    return _integrity().check_unique(d.raw("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")


FK_CHECKS = [  # (child table, child column, parent table, parent column)
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
]


@register("check_foreign_keys")
def q_check_foreign_keys(spark, sf_dir):
    d = Driver(spark, sf_dir)
    children = dict.fromkeys(ct for ct, *_ in FK_CHECKS)
    parts = [_integrity().check_fks(d.raw(child), [(cc, d.raw(pt), pc) for ct, cc, pt, pc in FK_CHECKS if ct == child], child)
             for child in children]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("check_rules_orders")
def q_check_rules_orders(spark, sf_dir):
    from ..schemas import ORDER_STATUSES, U16, U32, U64
    integ = _integrity()
    d = Driver(spark, sf_dir)
    rules = (integ.not_null_rules(["order_id", "customer_id", "status", "currency", "subtotal",
                                   "total_amount", "ordered_at"])
             + integ.domain_rules({"status": ORDER_STATUSES})
             + integ.range_rules({"order_id": (0, U64), "customer_id": (0, U32), "warehouse_id": (0, U16)},
                                 lengths={"currency": 3}, decimals={"total_amount": (12, 2)}))
    return integ.row_checks(d.orders, "orders", rules)


@register("check_rules_customers")
def q_check_rules_customers(spark, sf_dir):
    from ..schemas import TIERS
    integ = _integrity()
    d = Driver(spark, sf_dir)
    rules = (integ.format_rules({"email": "email", "first_name": "database_name"})
             + integ.domain_rules({"tier": TIERS})
             + integ.range_rules({"region_id": (0, 255)}, lengths={"email": 254, "last_name": 80}))
    return integ.row_checks(d.customers, "customers", rules)


PURGE_BEFORE = "1996-01-01"


@register("cascade_delete_items")
def q_cascade_delete_items(spark, sf_dir):
    d = Driver(spark, sf_dir)
    deleted = d.raw("orders").filter(F.col("o_orderdate") < F.lit(PURGE_BEFORE).cast("timestamp_ntz"))
    kept = _integrity().cascade_delete(d.raw("lineitem"), "l_orderkey", deleted, "o_orderkey")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@register("set_null_on_delete_customers")
def q_set_null_on_delete_customers(spark, sf_dir):
    d = Driver(spark, sf_dir)
    deleted = d.regions.filter(F.col("country") == "AFRICA")
    out = _integrity().set_null_on_delete(d.customers, "region_id", deleted, "region_id")
    return out.select("customer_id", "region_id")


@register("check_restrict_customers")
def q_check_restrict_customers(spark, sf_dir):
    d = Driver(spark, sf_dir)
    deleted = d.customers.filter(F.col("balance") < 0)
    return _integrity().check_restrict(d.orders, "customer_id", deleted, "customer_id")


@register("remap_key_customers")
def q_remap_key_customers(spark, sf_dir):
    d = Driver(spark, sf_dir)
    mapping = d.regions.select(F.col("region_id").alias("old_key"), (F.col("region_id") + 100).alias("new_key"))
    return _integrity().remap_key(d.customers, "region_id", mapping).select("customer_id", "region_id")


def referring_customers(customer):
    """Customers with the one that brought them: in each twenty, 4 and 5 brought each other, and 6 to 8 follow in a chain."""
    at = F.col("c_custkey") % 20
    return customer.withColumn("referrer", F.when(at == 4, F.col("c_custkey") + 1).when(at.between(5, 8), F.col("c_custkey") - 1))


@register("purge_cycle")
def q_purge_cycle(spark, sf_dir):
    """A region goes, and with it nations, customers, those that they brought (in a cycle), orders and lines."""
    from ..operators.purge import purge, purge_summary
    from ..schemas import ForeignKey
    d = Driver(spark, sf_dir)
    tables = {t: d.raw(t) for t in ("region", "nation", "supplier", "orders", "lineitem")}
    tables["customer"] = referring_customers(d.raw("customer"))
    graph = [ForeignKey("nation", "n_regionkey", "region", "r_regionkey", "CASCADE"),
             ForeignKey("customer", "c_nationkey", "nation", "n_nationkey", "CASCADE"),
             ForeignKey("customer", "referrer", "customer", "c_custkey", "CASCADE"),
             ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey", "SET NULL"),
             ForeignKey("orders", "o_custkey", "customer", "c_custkey", "CASCADE"),
             ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey", "CASCADE")]
    keys = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
            "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    done = purge(tables, {"region": tables["region"].filter(F.col("r_name") == "AFRICA")}, graph, keys)
    return purge_summary(tables, done.tables, {"supplier": ["s_nationkey"]})


def declared_tables(d):
    keys = {"regions": ["region_id"], "customers": ["customer_id"], "warehouses": ["warehouse_id"], "products": ["product_id"],
            "inventory": ["product_id", "warehouse_id"], "orders": ["order_id"], "order_items": ["item_id"]}
    tables = {t: getattr(d, t) for t in ("regions", "customers", "warehouses", "products", "inventory", "orders")}
    return tables | {"order_items": d.items}, keys


@register("purge_declared")
def q_purge_declared(spark, sf_dir):
    """Regions, warehouses and old orders go through the declared graph: stock and lines too, references become NULL."""
    from ..operators.purge import purge, purge_summary
    d = Driver(spark, sf_dir)
    tables, keys = declared_tables(d)
    roots = {"regions": d.regions.filter(F.col("country") == "ASIA"), "warehouses": d.warehouses.filter(F.col("warehouse_id") % 7 == 0),
             "orders": d.orders.filter(F.col("ordered_at") < F.lit(PURGE_BEFORE).cast("timestamp_ntz"))}
    done = purge(tables, roots, keys=keys)
    return purge_summary(tables, done.tables, {"customers": ["region_id"], "warehouses": ["region_id"], "orders": ["warehouse_id"]})


@register("purge_refused")
def q_purge_refused(spark, sf_dir):
    """Customers in debt go with some of their orders: the other orders refuse it."""
    from ..operators.purge import purge
    d = Driver(spark, sf_dir)
    tables, keys = declared_tables(d)
    done = purge(tables, {"customers": d.customers.filter(F.col("balance") < 0),
                          "orders": d.orders.filter(F.col("customer_id") % 3 == 0)}, keys=keys)
    return done.blocked.withColumn("refused", F.lit(done.refused))


# -------------------------------------------------------------------- merge
UPSERT_NOW = "2024-06-01 00:00:00"
TARGET_SNAPSHOT = "2024-01-01 00:00:00"


@register("upsert_customers")
def q_upsert_customers(spark, sf_dir):
    from ..operators.merge import upsert
    d = Driver(spark, sf_dir)
    c = d.customers
    target = (c.filter(F.col("tier") != "household")
              .select("customer_id", "email", "tier", "is_active",
                      F.lit(TARGET_SNAPSHOT).cast("timestamp_ntz").alias("updated_at")))
    source = c.select("customer_id", F.upper("email").alias("email"),
                      F.when(F.col("balance") >= 5000, F.lit("platinum")).otherwise(F.col("tier")).alias("tier"),
                      "is_active")
    return upsert(target, source, "customer_id", ["tier"], touch="updated_at", touch_always=True,
                  now=F.lit(UPSERT_NOW).cast("timestamp_ntz"))


@register("upsert_inventory")
def q_upsert_inventory(spark, sf_dir):
    """A delivery over the stock table: known pairs get a new quantity, new ones ids and defaults."""
    from ..operators.keys import assign_ids
    from ..operators.merge import upsert_rows
    from ..schemas import DEFAULTS
    stock = Driver(spark, sf_dir).inventory
    target = assign_ids(stock.filter(F.col("product_id") % 5 != 0), "inventory_id", ["product_id", "warehouse_id"])
    batch = stock.filter(F.col("product_id") % 3 != 0).select(
        "product_id", "warehouse_id", (F.col("qty_on_hand") + 7).alias("qty_on_hand"))
    return upsert_rows(target, batch, ["product_id", "warehouse_id"], ["qty_on_hand"], "inventory_id",
                       DEFAULTS["inventory"])


def any_key_upsert(spark, sf_dir):
    """Customers from elsewhere: known by id, by e-mail in other spelling, or by name and region; some mean two customers
    at once, some are new, and some new ones contradict each other."""
    from ..operators.resolve import upsert_any_key
    c = Driver(spark, sf_dir).customers
    target = c.select("customer_id", "email", "last_name", "region_id", "tier", "is_active",
                      F.lit(TARGET_SNAPSHOT).cast("timestamp_ntz").alias("updated_at"))
    at, none, number = F.col("customer_id") % 10, F.lit(None), F.col("customer_id").cast("string")
    spelled = F.concat(F.upper(F.replace("email", F.lit("e"), F.lit("é"))), F.lit("  "))

    def some(which: int, seq: int, **columns):
        given = {"customer_id": none.cast("long"), "email": none.cast("string"), "last_name": none.cast("string"),
                 "region_id": none.cast("int"), "tier": F.lit("platinum"), **columns}
        return c.filter(at == which).select(*[v.alias(n) for n, v in given.items()], F.lit(seq).alias("seq"))

    new = F.concat(F.lit("new."), number, F.lit("@example.com"))
    batch = [some(0, 1, customer_id=F.col("customer_id")), some(1, 1, email=spelled), some(1, 2, email=F.col("email"), tier=F.lit("gold")),
             some(2, 1, last_name=F.concat("last_name", F.lit(" ")), region_id=F.col("region_id")),
             some(3, 1, email=F.col("email"), customer_id=F.col("customer_id") - 1),
             some(4, 1, email=new), some(4, 2, email=F.upper(new), tier=F.lit("silver")),
             some(5, 1, email=new, last_name=F.lit("x")), some(5, 2, email=new, last_name=F.lit("y")),
             some(6, 1, email=new, customer_id=F.col("customer_id") + 10_000_000)]
    source = batch[0]
    for b in batch[1:]:
        source = source.unionByName(b)
    return upsert_any_key(target, source, "customer_id", [["email"], ["last_name", "region_id"]], ["tier"], {"is_active": True, "updated_at": "now"},
                          "seq", touch="updated_at", now=F.lit(UPSERT_NOW).cast("timestamp_ntz"))


@register("upsert_any_key")
def q_upsert_any_key(spark, sf_dir):
    return any_key_upsert(spark, sf_dir).table


@register("upsert_conflicts")
def q_upsert_conflicts(spark, sf_dir):
    return any_key_upsert(spark, sf_dir).conflicts


@register("mark_migrated")
def q_mark_migrated(spark, sf_dir):
    from ..operators.merge import mark_migrated
    d = Driver(spark, sf_dir)
    o = d.orders.withColumn("migrated_at", F.when(F.col("status") == "delivered", F.col("ordered_at")))
    return mark_migrated(o, F.lit(UPSERT_NOW).cast("timestamp_ntz")).select("order_id", "status", "migrated_at")


@register("evolve_orders")
def q_evolve_orders(spark, sf_dir):
    from ..schemas import ORDERS_EVOLUTION
    return _integrity().evolve(Driver(spark, sf_dir).raw("orders"), ORDERS_EVOLUTION)


REPORT_COLUMNS = {
    "orders": ["order_id", "customer_id", "warehouse_id", "status", "currency", "total_amount", "tax_amount"],
    "customers": ["customer_id", "email", "first_name", "last_name", "tier", "region_id"],
    "regions": ["region_id", "region_name", "country"],
}


@register("integrity_report")
def q_integrity_report(spark, sf_dir):
    """Every check that the declared schema implies for three tables."""
    d = Driver(spark, sf_dir)
    return _integrity().integrity_report({t: getattr(d, t).select(*c) for t, c in REPORT_COLUMNS.items()})


# -------------------------------------------------------------- reservation
RESERVE_STOCK = 1000


def requests_of(ev):
    qty = (F.when(F.col("event_type") == "error", -F.floor("value"))
           .when(F.col("event_id") % 97 == 0, None).otherwise(F.floor("value")).cast("int"))
    return ev.select(F.col("event_id").alias("request_id"), "user_id", qty.alias("qty"))


def reservation_inputs(spark, sf_dir):
    """Requests from the event stream (key = user, arrival = event id,
    qty = whole units of the value, given back by error events and unknown in
    some); every user that signed up holds a stock of RESERVE_STOCK units."""
    ev = Driver(spark, sf_dir).raw("events")
    requests = requests_of(ev)
    inventory = (ev.filter(F.col("event_type") == "signup").select("user_id").distinct()
                 .select("user_id", F.lit(RESERVE_STOCK).alias("qty_on_hand"), F.lit(0).alias("qty_reserved")))
    return inventory, requests


@register("reserve_requests")
def q_reserve_requests(spark, sf_dir):
    from ..operators.reserve import reserve
    inventory, requests = reservation_inputs(spark, sf_dir)
    return reserve(inventory, requests, "user_id", "request_id")


@register("reserve_inventory")
def q_reserve_inventory(spark, sf_dir):
    from ..operators.reserve import reserve, reserved_totals
    inventory, requests = reservation_inputs(spark, sf_dir)
    results = reserve(inventory, requests, "user_id", "request_id")
    return reserved_totals(inventory, results, "user_id")


@register("reserve_hot_keys")
def q_reserve_hot_keys(spark, sf_dir):
    """Few keys that hold all requests, half of which give stock back: every key is hot and scanned in chunks."""
    from ..operators.reserve import reserve
    ev = Driver(spark, sf_dir).raw("events")
    qty = (F.when(F.col("user_id") % 2 == 0, -F.floor("value"))
           .when(F.col("event_id") % 97 == 0, None).otherwise(F.floor("value")).cast("int"))
    requests = ev.select(F.col("event_id").alias("request_id"), "event_type", qty.alias("qty"))
    inventory = (ev.filter(F.col("event_type") != "view").select("event_type").distinct()
                 .select("event_type", F.lit(RESERVE_STOCK).alias("qty_on_hand"), F.lit(0).alias("qty_reserved")))
    return reserve(inventory, requests, "event_type", "request_id", key_limit=1000, chunk_rows=5000)


# ---------------------------------------------------------------------- cdc
CUSTOMER_COLS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def change_log(spark, sf_dir):
    return change_log_of(Driver(spark, sf_dir).raw("events"))


def change_log_of(ev):
    """The event stream read as a change log of the customer table:
    signup -> insert, error -> delete, anything else -> update; the log
    position is the event id; capture happens ``k`` seconds after commit."""
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("pos"), op.alias("op"), F.lit("customer").alias("table_name"),
        F.col("user_id").alias("c_custkey"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("c_name"),
        F.lit(None).cast("int").alias("c_nationkey"),
        F.col("value").alias("c_acctbal"),
        F.upper("event_type").alias("c_mktsegment"),
        F.col("ts").alias("committed_at"),
        F.expr("timestampadd(SECOND, CAST(get_json_object(props, '$.k') AS INT), ts)").alias("captured_at"),
        k.alias("_k"))


@register("apply_changes_customers")
def q_apply_changes_customers(spark, sf_dir):
    from ..operators.cdc import apply_changes, live, snapshot_target
    d = Driver(spark, sf_dir)
    target = snapshot_target(d.raw("customer"))
    out = apply_changes(target, change_log(spark, sf_dir), "c_custkey", CUSTOMER_COLS)
    return live(out)


@register("cdc_latency")
def q_cdc_latency(spark, sf_dir):
    from ..operators.cdc import cdc_latency
    out = cdc_latency(change_log(spark, sf_dir))
    return as_double(out.select("pos", "op", "committed_at", "captured_at", "source_latency_s"),
                     "source_latency_s")


# --------------------------------------------------------------- validation
PARITY_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "partsupp"]


def parity_sides(spark, sf_dir):
    """Source = the driver tables; target = the same tables after a load that
    has not yet received the pending ('P') orders; partsupp exists nowhere."""
    from ..sources.tables import try_read_table
    source = {t: try_read_table(spark, sf_dir, t) for t in PARITY_TABLES}
    target = dict(source)
    target["orders"] = source["orders"].filter(F.col("o_orderstatus") != "P")
    return source, target


@register("count_parity")
def q_count_parity(spark, sf_dir):
    from ..operators.validate import count_parity
    source, target = parity_sides(spark, sf_dir)
    return count_parity(spark, source, target, PARITY_TABLES)


@register("cutover_gate")
def q_cutover_gate(spark, sf_dir):
    from ..operators.validate import count_parity, cutover_gate
    source, target = parity_sides(spark, sf_dir)
    return cutover_gate(count_parity(spark, source, target, PARITY_TABLES))


AUDIT_TIME = "2024-06-01 00:00:00"


@register("audit_snapshot")
def q_audit_snapshot(spark, sf_dir):
    from ..operators.validate import audit_snapshot
    from ..sources.tables import list_tables, read_table
    tables = {t: read_table(spark, sf_dir, t) for t in list_tables(spark, sf_dir)}
    return audit_snapshot(spark, tables, F.lit(AUDIT_TIME).cast("timestamp_ntz"))


AUDIT_VIEWS = {"view_check": ["order_summary", "inventory_health"]}


@register("audit_log")
def q_audit_log(spark, sf_dir):
    """Two appended audits, table counts and view checks, read back with ids."""
    from ..operators.validate import audit_log, audit_snapshot
    from ..session import scratch_path
    from ..sinks.target import append_audit
    from ..sources.tables import read_table
    path = scratch_path(spark, "audit")
    tables = {t: read_table(spark, sf_dir, t) for t in ("orders", "customer", "region")}
    tables["_internal"] = tables["region"]   # internal tables are not audited
    views = {v: QUERIES[v](spark, sf_dir) for names in AUDIT_VIEWS.values() for v in names}
    append_audit(audit_snapshot(spark, tables, F.lit(AUDIT_TIME).cast("timestamp_ntz")), path)
    append_audit(audit_snapshot(spark, views, F.lit(AUDIT_TIME).cast("timestamp_ntz"), event="view_check"), path)
    return audit_log(spark, path)


@register("table_listing")
def q_table_listing(spark, sf_dir):
    """Every table in name order, with its place and exact rows."""
    from ..operators.validate import table_counts
    from ..sources.tables import list_tables, read_table
    names = list_tables(spark, sf_dir)
    place = spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "place long, table_name string")
    counts = table_counts(spark, {n: read_table(spark, sf_dir, n) for n in names})
    return place.join(counts, "table_name").select("place", "table_name", "row_count").orderBy("place")


@register("orders_in_status_order")
def q_orders_in_status_order(spark, sf_dir):
    """Orders per status in the order in which the statuses are declared, not in that of their names."""
    from ..schemas import ORDER_STATUSES
    orders = Driver(spark, sf_dir).orders.filter(F.col("deleted_at").isNull())
    ordinal = F.array_position(F.array(*map(F.lit, ORDER_STATUSES)), F.col("status"))
    return (orders.groupBy("status").agg(F.count(F.lit(1)).alias("orders"))
            .withColumn("ordinal", ordinal).orderBy("ordinal"))


# --------------------------------------------------------------- monitoring
PERIOD_S = 3600
ALARM_THRESHOLD = 150
ALARM_PERIODS = 2


def hourly_max(spark, sf_dir):
    from ..operators.monitor import period_stat
    ev = Driver(spark, sf_dir).raw("events")
    return period_stat(ev, "ts", "value", ["event_type"], PERIOD_S, "Maximum", exact_scale=2)


@register("period_stat")
def q_period_stat(spark, sf_dir):
    from ..operators.monitor import period_stats
    ev = Driver(spark, sf_dir).raw("events")
    out = period_stats(ev, "ts", "value", ["event_type"], PERIOD_S, {"avg_value": "Average", "max_value": "Maximum"},
                       exact_scale=2)
    return as_double(out, "avg_value", "max_value")


@register("alarm_states")
def q_alarm_states(spark, sf_dir):
    from ..operators.monitor import alarm_states
    st = alarm_states(hourly_max(spark, sf_dir), ["event_type"], PERIOD_S, ALARM_THRESHOLD,
                      "GreaterThanThreshold", ALARM_PERIODS)
    return as_double(st, "value")


@register("alarm_states_breaching")
def q_alarm_states_breaching(spark, sf_dir):
    from ..operators.monitor import alarm_states
    st = alarm_states(hourly_max(spark, sf_dir), ["event_type"], PERIOD_S, ALARM_THRESHOLD,
                      "GreaterThanThreshold", ALARM_PERIODS, missing="breaching")
    return as_double(st, "value")


@register("alarm_transitions")
def q_alarm_transitions(spark, sf_dir):
    from ..operators.monitor import alarm_states, alarm_transitions
    st = alarm_states(hourly_max(spark, sf_dir), ["event_type"], PERIOD_S, ALARM_THRESHOLD,
                      "GreaterThanThreshold", ALARM_PERIODS)
    return alarm_transitions(st, ["event_type"], PERIOD_S)


@register("filter_events")
def q_filter_events(spark, sf_dir):
    from ..operators.monitor import filter_events
    ev = Driver(spark, sf_dir).raw("events")
    return filter_events(ev, ["error", "signup"], category="event_type")


HEALTHY_K = 50
REQUIRED_HEALTHY = 2


@register("health_rollup")
def q_health_rollup(spark, sf_dir):
    """Each event's JSON props carry a probe reading k; per type and day:
    probes, healthy probes (k >= 50) and whether the required minimum is met."""
    ev = Driver(spark, sf_dir).raw("events")
    k = F.from_json("props", "k int")["k"]
    return (ev.groupBy("event_type", F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("probes"),
                 F.count(F.when(k >= HEALTHY_K, 1)).alias("healthy"))
            .withColumn("ready", F.col("healthy") >= REQUIRED_HEALTHY))


RULE_SPEED = 60     # an hour of events is a minute of metric points
RULE_SCALE = 20.0   # event values are about this, metric points about their rule's threshold


def rule_points(ev):
    """Metric points of the alarm rules' metrics, dealt from the events."""
    from ..operators.monitor import ALARM_RULES
    threshold = {}
    for r in ALARM_RULES:
        threshold.setdefault(r.metric, r.threshold)
    names = list(threshold)
    at = F.pmod("event_id", F.lit(len(names)))
    name = F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    scale = F.element_at(F.array(*[F.lit(threshold[n] / RULE_SCALE) for n in names]), (at + 1).cast("int"))
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    second = F.floor(F.timestamp_diff("SECOND", start, F.col("ts")) / RULE_SPEED)
    return ev.select(name.alias("metric_name"), F.timestamp_add("SECOND", second, start).alias("ts"),
                     (F.col("value") * scale).alias("value"))


@register("alarm_rules")
def q_alarm_rules(spark, sf_dir):
    """All ten rules over raw points, in one scan: how many periods each spends in each state."""
    from ..operators.monitor import ALARM_RULES, evaluate_rules, state_counts
    return state_counts(evaluate_rules(rule_points(Driver(spark, sf_dir).raw("events")), ALARM_RULES))


def probe(column="props"):
    return F.from_json(column, "k int")["k"]


@register("tunnel_rollup")
def q_tunnel_rollup(spark, sf_dir):
    """Per user: nested tunnel status JSON built from the probes, one document per event, rolled up and summed."""
    from ..operators.monitor import REQUIRED_UP, tunnel_rollup
    ev = Driver(spark, sf_dir).raw("events")
    tunnel = F.struct(F.when(probe() >= HEALTHY_K, "UP").otherwise("DOWN").alias("status"),
                      F.col("event_type").alias("reason"))
    status = ev.select("user_id", F.to_json(F.array(F.array(tunnel))).alias("status"))
    return (tunnel_rollup(status, "status").groupBy("user_id")
            .agg(F.sum("endpoints").cast("bigint").alias("endpoints"), F.sum("up").cast("bigint").alias("up"))
            .withColumn("ready", F.col("up") >= REQUIRED_UP))


@register("peer_rollup")
def q_peer_rollup(spark, sf_dir):
    """Per user: nested routing-peer JSON built from the probes, one document per event, rolled up and summed; some
    peers lack their routes."""
    from ..operators.monitor import REQUIRED_PEERS, peer_rollup
    ev = Driver(spark, sf_dir).raw("events")
    routes = F.when(probe() % 5 != 0, F.transform(F.sequence(F.lit(0), probe() % 3), lambda i: i.cast("string")))
    peer = F.struct(F.col("event_type").alias("name"),
                    F.when(F.col("event_type") != "error", "ESTABLISHED").otherwise("IDLE").alias("state"),
                    F.when(probe() >= HEALTHY_K, "UP").otherwise("DOWN").alias("status"), routes.alias("advertisedRoutes"))
    peers = F.struct(F.array(peer).alias("bgpPeerStatus"))
    status = ev.select("user_id", F.to_json(F.struct(peers.alias("result"))).alias("status"))
    return (peer_rollup(status, "status").groupBy("user_id")
            .agg(F.sum("peers").cast("bigint").alias("peers"), F.sum("established").cast("bigint").alias("established"),
                 F.sum("advertised_routes").alias("advertised_routes"))
            .withColumn("ready", F.col("established") >= REQUIRED_PEERS))


@register("regional_sales_by_currency")
def q_regional_sales_by_currency(spark, sf_dir):
    d = Driver(spark, sf_dir)
    out = reports.regional_sales(d.orders, d.customers, d.regions, by_currency=True)
    return as_bigint(as_double(out, "total_revenue", "avg_order_value"), "active_customers", "total_orders")


@register("customer_ltv_by_currency")
def q_customer_ltv_by_currency(spark, sf_dir):
    d = Driver(spark, sf_dir)
    out = reports.customer_ltv(d.customers, d.orders, by_currency=True)
    return as_bigint(as_double(out, "lifetime_value", "avg_order_value"), "total_orders")


@register("load_parity")
def q_load_parity(spark, sf_dir):
    """Load, then compare both sides through the load's own rename, then the gate's view of each table."""
    from ..operators.validate import count_parity
    from ..session import scratch_path
    from ..sinks.target import full_load, prefix_rename
    from ..sources.tables import try_read_table
    dst = scratch_path(spark, "load-parity")
    names = [s for s, _ in full_load(spark, sf_dir, dst, include=["%"], exclude=LOAD_EXCLUDE, prefix=LOAD_PREFIX)]
    rename = prefix_rename(LOAD_PREFIX)
    source = {t: try_read_table(spark, sf_dir, t) for t in names}
    target = {rename(t): try_read_table(spark, dst, rename(t)) for t in names}
    return count_parity(spark, source, target, names, rename).withColumn(
        "blocks_cutover", F.col("status") != "MATCH")


# ------------------------------------------------------------ load and keys
@register("limit_lob_documents")
def q_limit_lob_documents(spark, sf_dir):
    from ..functions.lob import limit_lob
    docs = limit_lob(Driver(spark, sf_dir).raw("documents").select("doc_id", "text"), ["text"])
    return docs.withColumn("n_bytes", F.octet_length("text").cast("bigint"))


ID_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
            "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register("assign_ids_lineitem")
def q_assign_ids_lineitem(spark, sf_dir):
    from ..operators.keys import assign_ids
    li = Driver(spark, sf_dir).raw("lineitem")
    return assign_ids(li, "item_id", ID_ORDER).select("item_id", "l_orderkey", "l_linenumber", "l_partkey")


LOAD_EXCLUDE = ["emb%", "labels"]
LOAD_PREFIX = "mig_"


@register("full_load_summary")
def q_full_load_summary(spark, sf_dir):
    from ..session import scratch_path
    from ..sinks.target import full_load, load_summary
    dst = scratch_path(spark, "full-load")
    loaded = full_load(spark, sf_dir, dst, include=["%"], exclude=LOAD_EXCLUDE, prefix=LOAD_PREFIX,
                       prep="DROP_AND_CREATE")
    return load_summary(spark, dst, loaded)


# ---------------------------------------------------------------- streaming
def events_stream(spark, sf_dir):
    """The events table followed as a file stream."""
    from ..sources.changes import stream_changes
    schema = Driver(spark, sf_dir).raw("events").schema
    return stream_changes(spark, sf_dir, schema, file_name="events.parquet")


MIGRATE_BUCKETS = 16


@register("migrate_stream")
def q_migrate_stream(spark, sf_dir):
    from ..session import scratch_path
    from ..streaming.cdc_stream import migrate, read_live
    root = scratch_path(spark, "migrate")
    migrate(spark, Driver(spark, sf_dir).raw("customer"), change_log_of(events_stream(spark, sf_dir)),
            f"{root}/customer", "c_custkey", CUSTOMER_COLS, -1, f"{root}/_checkpoint", buckets=MIGRATE_BUCKETS)
    return read_live(spark, f"{root}/customer")


MOVED = 5000   # some customers change their key by this much


def two_table_log(ev):
    """A change log of two tables as JSON row images: customers (key user_id, some change it) and
    stock (key of two columns)."""
    op = (F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U"))
    stock = F.col("event_id") % 3 == 0
    moved = (F.col("event_id") % 50 == 7) & (op == "U") & ~stock
    c_after = F.to_json(F.struct((F.col("user_id") + F.when(moved, MOVED).otherwise(0)).alias("user_id"),
                                 F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"),
                                 F.floor("value").alias("balance")))
    c_before = F.to_json(F.struct("user_id"))
    place = (F.col("event_id") % 2).alias("warehouse_id")
    s_after = F.to_json(F.struct("user_id", place, F.floor("value").alias("qty")))
    s_before = F.to_json(F.struct("user_id", place))
    skipped = F.col("event_id") % 101 == 0   # a table outside the selection
    return ev.select(F.when(skipped, "tmp_x").when(stock, "stock").otherwise("customers").alias("table_name"),
                     F.col("event_id").alias("pos"), op.alias("op"),
                     F.when(op != "I", F.when(stock, s_before).otherwise(c_before)).alias("before"),
                     F.when(op != "D", F.when(stock, s_after).otherwise(c_after)).alias("after"))


@register("migrate_tables")
def q_migrate_tables(spark, sf_dir):
    """Two tables from one log in three micro-batches, with late and replayed changes; live rows of both."""
    from ..session import scratch_path
    from ..streaming.cdc_stream import MigratedTable, migrate_tables, read_live
    root = scratch_path(spark, "migrate-tables")
    ev = Driver(spark, sf_dir).raw("events")
    log = two_table_log(ev)
    part = F.col("pos") % 4
    users = ev.select("user_id").distinct()
    tables = {
        "customers": MigratedTable(users.select("user_id", F.lit("old").alias("name"), F.lit(0).cast("long").alias("balance")),
                                   ["user_id"], ["name", "balance"]),
        "stock": MigratedTable(users.select("user_id", F.lit(0).cast("long").alias("warehouse_id"),
                                            F.lit(100).cast("long").alias("qty")), ["user_id", "warehouse_id"], ["qty"])}
    for n, rows in enumerate((part.isin(0, 3), part == 2, part.isin(0, 1))):   # 0 comes twice, 1 late
        log.filter(rows).write.parquet(f"{root}/log/{n}")
        stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{root}/log")
        migrate_tables(spark, tables, stream, root, f"{root}/_checkpoint", exclude=["tmp%"], prefix=LOAD_PREFIX, buckets=8)
    c = read_live(spark, f"{root}/{LOAD_PREFIX}customers")
    s = read_live(spark, f"{root}/{LOAD_PREFIX}stock")
    return (c.select(F.lit("customers").alias("table_name"), "user_id", F.lit(None).cast("long").alias("warehouse_id"),
                     "name", F.col("balance").alias("amount"), F.col("_pos").alias("pos"))
            .unionByName(s.select(F.lit("stock").alias("table_name"), "user_id", "warehouse_id",
                                  F.lit(None).cast("string").alias("name"), F.col("qty").alias("amount"), F.col("_pos").alias("pos"))))


def migrated_latencies(spark, sf_dir):
    """The change log migrated in three batches, a minute apart, with the latencies of every change."""
    import datetime as dt

    from ..operators.cdc import cdc_latency
    from ..session import scratch_path
    from ..streaming.cdc_stream import applied_times, migrate
    root = scratch_path(spark, "latency")
    log = change_log_of(Driver(spark, sf_dir).raw("events"))
    for n in range(3):
        log.filter(F.col("pos") % 3 == n).write.parquet(f"{root}/log/{n}")
        stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{root}/log")
        migrate(spark, Driver(spark, sf_dir).raw("customer"), stream, f"{root}/customer", "c_custkey", CUSTOMER_COLS, -1,
                f"{root}/_checkpoint", applied_root=f"{root}/applied", clock=lambda b: dt.datetime(2024, 1, 31, 0, b))
    return cdc_latency(log.join(applied_times(spark, f"{root}/applied"), "pos", "left"), applied="applied_at")


@register("target_latency")
def q_target_latency(spark, sf_dir):
    out = migrated_latencies(spark, sf_dir).select("pos", "committed_at", "captured_at", "applied_at", "source_latency_s", "target_latency_s")
    return as_double(out, "source_latency_s", "target_latency_s")


@register("latency_alarms")
def q_latency_alarms(spark, sf_dir):
    """From the log to latencies, periods and alarms."""
    from ..operators.monitor import latency_alarms, latency_points
    return latency_alarms(latency_points(migrated_latencies(spark, sf_dir)))


RESERVE_BUCKETS = 16


@register("reserve_stream")
def q_reserve_stream(spark, sf_dir):
    from ..session import scratch_path
    from ..streaming.reserve_stream import read_results, reserve_stream
    root = scratch_path(spark, "reserve")
    inventory, _ = reservation_inputs(spark, sf_dir)
    requests = requests_of(events_stream(spark, sf_dir))
    reserve_stream(spark, inventory, requests, f"{root}/inventory", f"{root}/results", f"{root}/_checkpoint",
                   "user_id", "request_id", buckets=RESERVE_BUCKETS)
    return read_results(spark, f"{root}/results")


@register("period_stat_stream")
def q_period_stat_stream(spark, sf_dir):
    from ..session import scratch_path
    from ..streaming.alarm_stream import period_stats_stream, read_stats
    root = scratch_path(spark, "periods")
    period_stats_stream(events_stream(spark, sf_dir), "ts", "value", ["event_type"], PERIOD_S, "Maximum",
                        f"{root}/stats", f"{root}/_checkpoint", exact_scale=2)
    out = read_stats(spark, f"{root}/stats")
    return as_double(out.select("event_type", "period_start", F.col("value").alias("max_value"), "samples"),
                     "max_value")


LATE_CUT, LATE_DELAY = "2024-01-16 00:00:00", "6 hours"


def late_alarm_records(spark, sf_dir):
    """Hourly maxima with alarm states kept by a stream that gets the first half of the events, less a fifth, and then the rest:
    the fifth comes behind the watermark."""
    from ..session import scratch_path
    from ..streaming.keyed_state import alarm_records, append_records
    root = scratch_path(spark, "alarm-state")
    ev = Driver(spark, sf_dir).raw("events")
    early = (F.col("ts") < F.lit(LATE_CUT).cast("timestamp_ntz")) & (F.col("event_id") % 5 != 0)
    for n, rows in enumerate((early, ~early)):
        ev.filter(rows).write.parquet(f"{root}/points/{n}")
        points = spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").parquet(f"{root}/points")
        append_records(alarm_records(points, "ts", "value", ["event_type"], PERIOD_S, "Maximum", ALARM_THRESHOLD, "GreaterThanThreshold",
                                     ALARM_PERIODS, watermark=LATE_DELAY), f"{root}/records", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/records")


@register("alarm_stream_states")
def q_alarm_stream_states(spark, sf_dir):
    """State at every closed period with points, as the stream kept it."""
    out = late_alarm_records(spark, sf_dir).filter("kind = 'period'")
    return out.select("event_type", "period_start", F.col("n").alias("samples"), (F.col("high") / 100).cast("double").alias("max_value"),
                      "state", "previous_state")


@register("alarm_stream_late")
def q_alarm_stream_late(spark, sf_dir):
    """Closed periods after the late points were merged into them: nothing is lost."""
    from ..streaming.keyed_state import merged_periods
    out = merged_periods(late_alarm_records(spark, sf_dir), ["event_type"], "Maximum")
    return as_double(out.withColumnRenamed("value", "max_value"), "max_value")


@register("reserve_keyed_stream")
def q_reserve_keyed_stream(spark, sf_dir):
    """Requests in three micro-batches, one after the other, against stock kept as state."""
    from ..session import scratch_path
    from ..streaming.keyed_state import append_records, reserve_keyed
    root = scratch_path(spark, "reserve-state")
    inventory, requests = reservation_inputs(spark, sf_dir)
    last = requests.agg(F.max("request_id")).first()[0] or 0
    third = F.floor(F.col("request_id") * 3 / (last + 1))
    for n in range(3):
        requests.filter(third == n).write.parquet(f"{root}/requests/{n}")
        stream = spark.readStream.schema(requests.schema).option("recursiveFileLookup", "true").parquet(f"{root}/requests")
        append_records(reserve_keyed(inventory, stream, "user_id", "request_id"), f"{root}/results", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/results").select("request_id", "user_id", "qty", "result")


@register("alarm_states_written")
def q_alarm_states_written(spark, sf_dir):
    """The alarm rule over the periods that a stream has written."""
    from ..session import scratch_path
    from ..streaming.alarm_stream import evaluate_written, period_stats_stream
    root = scratch_path(spark, "written")
    period_stats_stream(events_stream(spark, sf_dir), "ts", "value", ["event_type"], PERIOD_S, "Maximum", f"{root}/stats",
                        f"{root}/_checkpoint", exact_scale=2)
    states, _ = evaluate_written(spark, f"{root}/stats", ["event_type"], PERIOD_S, ALARM_THRESHOLD, "GreaterThanThreshold", ALARM_PERIODS)
    return as_double(states, "value")


# ------------------------------------------------------- collation, hierarchy
@register("check_unique_customer_email")
def q_check_unique_customer_email(spark, sf_dir):
    from ..operators.integrity import LOOKUP_COLLATION
    d = Driver(spark, sf_dir)
    return _integrity().check_unique(d.customers, ["email"], "customers", collation=LOOKUP_COLLATION)


@register("region_hierarchy")
def q_region_hierarchy(spark, sf_dir):
    """Regions and nations as one tree: a nation's parent is its region."""
    from ..operators.tree import hierarchy_paths
    d = Driver(spark, sf_dir)
    regions = d.raw("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
                                     F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nations = d.raw("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
                                     F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"),
                                     F.col("n_name").alias("name"))
    return hierarchy_paths(regions.unionByName(nations)).withColumn("depth", F.col("depth").cast("int"))


@register("event_chains")
def q_event_chains(spark, sf_dir):
    """Each event follows its user's event before it: chains as deep as a user is busy. Every tenth user's chain is a ring."""
    from ..operators.tree import hierarchy_paths
    ev = Driver(spark, sf_dir).raw("events")
    last = ev.groupBy("user_id").agg(F.max("event_id").alias("last"))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    nodes = ev.join(last, "user_id").select("event_id", "user_id", "event_type", F.coalesce(before, F.when(F.col("user_id") % 10 == 0, F.col("last")))
                                            .alias("previous_id"))
    out = hierarchy_paths(nodes, "event_id", "previous_id", "event_type", ">")
    return out.select("event_id", "root", F.col("depth").cast("int").alias("depth"), F.md5("path").alias("path_md5"), "cyclic")


SKETCH_RANGES = [("1994-01-01", "1994-12-31"), ("1995-03-15", "1996-07-02"), (None, None)]


@register("distinct_by_sketches")
def q_distinct_by_sketches(spark, sf_dir):
    """Buying customers per currency over ranges of days: from one sketch table, held against the exact counts."""
    from ..operators.sketches import daily_sketches, error_bound, merged_distinct
    from ..session import scratch_path
    orders = Driver(spark, sf_dir).orders.select("ordered_at", "currency", "customer_id")
    path = scratch_path(spark, "sketches")
    daily_sketches(orders, "ordered_at", "customer_id", ["currency"]).write.parquet(path)
    out = None
    for n, (first, last) in enumerate(SKETCH_RANGES):
        day = F.to_date("ordered_at")
        own = orders.filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))) if first else orders
        exact = own.groupBy("currency").agg(F.countDistinct("customer_id").alias("customers"))
        both = exact.join(merged_distinct(spark.read.parquet(path), ["currency"], first, last), "currency").select(
            F.lit(n).alias("range_no"), "currency", "customers",
            (F.abs(F.col("estimate") - F.col("customers")) <= F.col("customers") * error_bound() + 1).alias("within_bound"))
        out = both if out is None else out.unionByName(both)
    return out


@register("resumed_load")
def q_resumed_load(spark, sf_dir):
    """Orders loaded by ranges of their key; the load dies at its fourth range, is started again, and all rows are there."""
    from ..session import scratch_path
    from ..sinks.resume import read_loaded, resumable_load
    root = scratch_path(spark, "resumed")
    orders = Driver(spark, sf_dir).raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus")

    def die(part: int) -> None:
        if part == 2:
            raise InterruptedError(part)

    try:
        resumable_load(orders, root, "o_orderkey", 6, max_parallel=1, before_part=die)
    except InterruptedError:
        resumable_load(orders, root, "o_orderkey", 6)
    return read_loaded(spark, root, orders.schema)


@register("check_formats")
def q_check_formats(spark, sf_dir):
    """Every format rule, and lists with their least size, on values made from suppliers."""
    from ..functions.formats import MIN_ZONES
    integ = _integrity()
    key = F.col("s_suppkey")

    def text(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    k = key.cast("string")
    few = (key % 4).cast("int")
    zones = F.transform(F.sequence(F.lit(1), few + 1), lambda i: text("us-east-", i.cast("string"), F.when(key % 9 == 0, "").otherwise("a")))
    blocks = F.transform(F.sequence(F.lit(0), few), lambda i: text("10.0.", (key * 7 % 300).cast("string"), ".0/", (i + 22 + key % 12).cast("string")))
    df = Driver(spark, sf_dir).raw("supplier").select(
        text("europe-west", (key % 12).cast("string")).alias("source_region"),
        text(F.when(key % 5 == 0, "xx").otherwise("eu"), "-west-", (key % 3).cast("string")).alias("target_region"),
        text(F.when(key % 6 == 0, "P").otherwise("p"), "-", k, F.when(key % 7 == 0, "-").otherwise("")).alias("project_id"),
        text(F.when(key % 8 == 0, "1").otherwise(""), "shop_", k).alias("database_name"),
        text("3.", (key % 8).cast("string"), ".", k).alias("engine_version"),
        text("a.b", F.when(key % 10 == 0, " ").otherwise("@"), "mail.example").alias("email"), zones.alias("zones"), blocks.alias("blocks"))
    named = ["source_region", "target_region", "project_id", "database_name", "engine_version", "email"]
    out = integ.row_checks(df, "suppliers", integ.format_rules({c: c for c in named}))
    for column, rule, least in (("zones", "zone", MIN_ZONES), ("blocks", "cidr", 1)):
        out = out.unionByName(integ.check_list_format(df, column, rule, least, "suppliers"))
    return out


@register("endpoint_hosts")
def q_endpoint_hosts(spark, sf_dir):
    """Per host of the endpoints that events came from: events, and their kinds as one CSV."""
    from ..functions.expr import endpoint_host, join_csv
    ev = Driver(spark, sf_dir).raw("events")
    at = F.concat(F.lit("db-"), (F.col("user_id") % 50).cast("string"), F.when(F.col("event_id") % 3 != 0, F.concat(
        F.lit(":"), (3306 + F.col("event_id") % 4).cast("string"))).otherwise(""))
    return (ev.select(endpoint_host(at.alias("endpoint")).alias("host"), "event_type").groupBy("host")
            .agg(F.count(F.lit(1)).alias("events"), F.sort_array(F.collect_set("event_type")).alias("kinds"))
            .select("host", "events", join_csv("kinds").alias("kinds")))


DOCUMENT_EVENTS = 12   # probes in one status document
BROKEN = 17            # every such document is cut off


def status_documents(ev):
    """Status documents of DOCUMENT_EVENTS probes each, as nested lists of tunnels and as peers; some keys are missing,
    some documents are broken."""
    doc = F.floor(F.col("event_id") / DOCUMENT_EVENTS).alias("doc")
    up = F.when(probe() >= HEALTHY_K, "UP").otherwise("DOWN")
    tunnel = F.struct(F.when(F.col("event_id") % 10 != 0, up).alias("status"), F.col("event_type").alias("reason"))
    routes = F.when(probe() % 5 != 0, F.transform(F.sequence(F.lit(0), probe() % 3), lambda i: i.cast("string")))
    peer = F.struct(F.col("event_type").alias("name"), up.alias("status"), routes.alias("advertisedRoutes"),
                    F.when(F.col("event_type") != "error", "ESTABLISHED").otherwise("IDLE").alias("state"))
    both = ev.groupBy(doc).agg(*[F.collect_list(F.when(F.col("event_id") % 2 == g, tunnel)).alias(f"t{g}") for g in (0, 1)],
                               F.collect_list(peer).alias("p"))  # DOCUMENT_EVENTS at most
    cut = F.when(F.col("doc") % BROKEN == 5, 9).otherwise(1 << 30)
    result = F.when(F.col("doc") % BROKEN == 6, F.to_json(F.struct(F.struct(F.lit(1).alias("other")).alias("result")))).otherwise(
        F.to_json(F.struct(F.struct(F.col("p").alias("bgpPeerStatus")).alias("result"))))
    return both.select("doc", F.substring(F.to_json(F.array("t0", "t1")), F.lit(1), cut).alias("tunnels"),
                       F.substring(result, F.lit(1), cut).alias("peers_json"))


@register("status_documents")
def q_status_documents(spark, sf_dir):
    """Several tunnels and peers per document, rolled up document by document."""
    from ..operators.monitor import peer_rollup, tunnel_rollup
    docs = status_documents(Driver(spark, sf_dir).raw("events"))
    t = tunnel_rollup(docs, "tunnels").withColumnRenamed("ready", "tunnels_ready")
    out = peer_rollup(t, "peers_json").withColumnRenamed("ready", "peers_ready")
    return out.select("doc", "endpoints", "up", "tunnels_ready", "peers", "established", "advertised_routes", "peers_ready")

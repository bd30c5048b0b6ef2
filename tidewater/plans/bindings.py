"""Binding of the driver's TPC-H-like tables to the canonical retail tables.

The reports take canonical column names; this adapter renames driver
columns and derives the few fields the driver tables lack. Every value is a
pure function of a driver row (or of an aggregate Spark computes over the
driver tables), so the work grows with the data. Roles:

  orders      <- orders     (status F/O/P -> delivered/shipped/cancelled,
                             currency <- o_orderpriority, money -> DECIMAL,
                             tax = 9 % of total, subtotal = total - tax)
  customers   <- customer   (tier <- lower(c_mktsegment), region <- nation,
                             active <- non-negative balance)
  regions     <- nation     (country <- region.r_name)
  warehouses  <- supplier
  products    <- part       (category <- brand number)
  categories  <- part brands
  order_items <- lineitem   (unit price = line total / qty, half-up cents)
  inventory   <- lineitem per (part, supplier): on hand = all units,
                 reserved = units of open lines, reorder point = p_size
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import money
from ..sources.tables import read_table

# ---- fixed values of the binding -----------------------------------------
STATUS_OF = {"F": "delivered", "O": "shipped", "P": "cancelled"}
TAX_RATE = "0.09"
WAREHOUSE_SLOTS = 120  # orders spread over warehouse ids 0..119
# ---------------------------------------------------------------------------


SOFT_DELETED = 41   # every such order is soft-deleted


class Driver:
    """Canonical views over one scale-factor folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- orders ---------------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        status = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in STATUS_OF.items()])
        total = money("o_totalprice")
        tax = F.round(total * F.lit(TAX_RATE).cast("decimal(3,2)"), 2).cast("decimal(10,2)")
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            (F.col("o_orderkey") % WAREHOUSE_SLOTS).cast("int").alias("warehouse_id"),
            status.alias("status"),
            F.col("o_orderpriority").alias("currency"),
            (total - tax).cast("decimal(12,2)").alias("subtotal"),
            tax.alias("tax_amount"),
            F.lit(0).cast("decimal(10,2)").alias("shipping_amount"),
            total.alias("total_amount"),
            F.lit(None).cast("string").alias("notes"),
            F.col("o_orderdate").alias("ordered_at"),
            F.col("o_orderdate").alias("updated_at"),
            F.when(F.col("o_orderkey") % SOFT_DELETED == 0, F.col("o_orderdate")).cast("timestamp_ntz").alias("deleted_at"),
            F.lit(None).cast("string").alias("created_by"),
            F.lit(None).cast("timestamp_ntz").alias("migrated_at"))

    # -- customers ------------------------------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        first = F.substring_index("c_name", "#", 1)
        last = F.substring_index("c_name", "#", -1)
        return c.select(
            F.col("c_custkey").alias("customer_id"),
            F.concat(F.lower(first), F.lit("."), last, F.lit("@example.com")).alias("email"),
            first.alias("first_name"), last.alias("last_name"),
            F.lit(None).cast("string").alias("phone"),
            F.col("c_nationkey").alias("region_id"),
            F.lower("c_mktsegment").alias("tier"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            money("c_acctbal").alias("balance"))

    # -- regions / warehouses ----------------------------------------------------
    @cached_property
    def regions(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
                .select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("region_name"),
                        F.col("r_name").alias("country"), F.lit("UTC").alias("timezone")))

    @cached_property
    def warehouses(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").cast("int").alias("warehouse_id"),
            F.col("s_nationkey").alias("region_id"),
            F.col("s_name").alias("warehouse_name"),
            F.lit(None).cast("string").alias("address"),
            F.lit(True).alias("is_active"))

    # -- products / categories ---------------------------------------------------
    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("category_id"),
            F.concat(F.col("p_type"), F.lit("-"), F.col("p_partkey").cast("string")).alias("sku"),
            F.col("p_name").alias("product_name"),
            money("p_retailprice", 10, 2).alias("unit_price"),
            F.lit(True).alias("is_active"),
            F.col("p_size").alias("p_size"))

    @cached_property
    def categories(self) -> DataFrame:
        return (self.raw("part").select("p_brand").distinct()
                .select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("category_id"),
                        F.col("p_brand").alias("category_name")))

    # -- order items / inventory -------------------------------------------------
    @cached_property
    def items(self) -> DataFrame:
        li = self.raw("lineitem")
        line_total = money("l_extendedprice")
        qty = F.col("l_quantity").cast("int")
        unit = F.round(line_total / qty.cast("decimal(5,0)"), 2).cast("decimal(10,2)")
        return li.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("supplier_id"),
            qty.alias("qty"), unit.alias("unit_price"), line_total.alias("line_total"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_linestatus").alias("line_status"))

    @cached_property
    def inventory(self) -> DataFrame:
        stock = (self.items.groupBy(F.col("product_id"), F.col("supplier_id").cast("int").alias("warehouse_id"))
                 .agg(F.sum("qty").cast("int").alias("qty_on_hand"),
                      F.coalesce(F.sum(F.when(F.col("line_status") == "O", F.col("qty"))), F.lit(0))
                      .cast("int").alias("qty_reserved")))
        return (stock.join(self.raw("part").select(F.col("p_partkey").alias("product_id"),
                                                    F.col("p_size").alias("reorder_point")), "product_id")
                .select("product_id", "warehouse_id", "qty_on_hand", "qty_reserved", "reorder_point"))

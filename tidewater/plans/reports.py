"""Named reporting queries (Q1..Q14) over the canonical retail tables.

Each function takes DataFrames with the canonical column names of
``tidewater.schemas`` and returns a lazy DataFrame. Plans are written so that
Catalyst can push filters and projections into the scans, and so that the
big fact tables are aggregated *before* they are joined (eager aggregation):
the one-to-many side shrinks to one row per key before any shuffle join, and
map-side partial aggregation absorbs hot keys.

Key facts the plans rely on (all declared in the schema, checked by
``operators.integrity.check_unique``): ``orders.order_id``,
``customers.customer_id``, ``products.product_id``,
``warehouses.warehouse_id`` and ``regions.region_id`` are primary keys, so
``COUNT(DISTINCT pk)`` equals ``COUNT(pk)`` and grouping by a key plus columns
of its own row equals grouping by the key alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import (day, days_between, exact_avg, first_match, full_name, not_deleted, not_in, plain, ratio,
                              unaccented)
from ..operators.joins import broadcast_if_small, range_join
from ..schemas import EXCLUDED_REVENUE_STATUSES


def _revenue_orders(orders: DataFrame) -> DataFrame:
    """Orders that count as revenue: not cancelled/refunded, not soft-deleted."""
    return orders.filter(not_in("status", EXCLUDED_REVENUE_STATUSES) & not_deleted())


# --------------------------------------------------------------------------- Q1
def order_summary(orders: DataFrame, customers: DataFrame, regions: DataFrame,
                  warehouses: DataFrame, items: DataFrame) -> DataFrame:
    """One row per live order with customer, region, warehouse and line totals.

    Lines are aggregated per order first, so the 11 wide grouping columns of
    the view never enter a shuffle; orders without lines keep line_count 0
    and total_units NULL, exactly as COUNT/SUM over a LEFT JOIN give.
    """
    lines = items.groupBy("order_id").agg(
        F.count("item_id").alias("line_count"), F.sum("qty").alias("total_units"))
    o = orders.filter(not_deleted()).select(
        "order_id", "status", "currency", "total_amount", "ordered_at", "migrated_at",
        "customer_id", "warehouse_id")
    c = customers.select("customer_id", full_name().alias("customer_name"), "email", "tier", "region_id")
    r = broadcast_if_small(regions.select("region_id", "region_name"))
    w = warehouses.select("warehouse_id", "warehouse_name")
    return (o.join(lines, "order_id", "left")
             .join(c, "customer_id", "inner")
             .join(r, "region_id", "left")
             .join(w, "warehouse_id", "left")
             .select("order_id", "status", "currency", "total_amount", "ordered_at", "migrated_at",
                     "customer_id", "customer_name", "email", "tier", "region_name", "warehouse_name",
                     F.coalesce("line_count", F.lit(0)).alias("line_count"), "total_units"))


# --------------------------------------------------------------------------- Q2
def inventory_health(inventory: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Stock-out risk per product and warehouse; active products only."""
    available = F.col("qty_on_hand") - F.col("qty_reserved")
    p = products.filter(F.col("is_active")).select("product_id", "sku", "product_name")
    w = warehouses.select("warehouse_id", "warehouse_name")
    return (inventory.select("product_id", "warehouse_id", "qty_on_hand", "qty_reserved", "reorder_point")
            .join(p, "product_id").join(w, "warehouse_id")
            .select("product_id", "sku", "product_name", "warehouse_id", "warehouse_name",
                    "qty_on_hand", "qty_reserved", available.alias("qty_available"), "reorder_point",
                    first_match([(available <= 0, F.lit("OUT_OF_STOCK")),
                                 (available <= F.col("reorder_point"), F.lit("LOW_STOCK"))],
                                F.lit("OK")).alias("stock_status")))


# --------------------------------------------------------------------------- Q3
def customer_ltv(customers: DataFrame, orders: DataFrame, customer_id=None, by_currency: bool = False) -> DataFrame:
    """Lifetime value per customer; customers without orders keep 0 / NULLs.
    With ``by_currency`` one row per customer and currency.

    The right-side predicates of the reference's LEFT JOIN ... ON are applied
    to orders before the join (never after it), and orders are aggregated per
    customer before the join since the group is exactly one customer.
    """
    o = _revenue_orders(orders)
    c = customers
    if customer_id is not None:
        o = o.filter(F.col("customer_id") == customer_id)
        c = c.filter(F.col("customer_id") == customer_id)
    money = ["currency"] if by_currency else []
    per_customer = o.groupBy("customer_id", *money).agg(
        F.count("order_id").alias("total_orders"),
        F.sum("total_amount").alias("lifetime_value"),
        exact_avg("total_amount").alias("avg_order_value"),
        F.min("ordered_at").alias("first_order_date"),
        F.max("ordered_at").alias("latest_order_date"))
    return (c.select("customer_id", full_name().alias("customer_name"), "tier")
            .join(per_customer, "customer_id", "left")
            .select("customer_id", "customer_name", "tier", *money,
                    F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
                    "lifetime_value", "avg_order_value", "first_order_date", "latest_order_date",
                    days_between("latest_order_date", "first_order_date").alias("days_as_customer")))


# --------------------------------------------------------------------------- Q4
def _distinct(c: str, approx: bool):
    """Exact COUNT(DISTINCT); with ``approx`` a HyperLogLog++ estimate, which
    needs no second shuffle on (group, value) (AGG-3 option)."""
    return F.approx_count_distinct(c) if approx else F.countDistinct(c)


def daily_revenue(orders: DataFrame, approx: bool = False) -> DataFrame:
    """Revenue per order date and currency."""
    return (_revenue_orders(orders)
            .groupBy(day("ordered_at").alias("order_date"), "currency")
            .agg(F.count("order_id").alias("order_count"),
                 _distinct("customer_id", approx).alias("unique_customers"),
                 F.sum("subtotal").alias("gross_revenue"),
                 F.sum("tax_amount").alias("tax_collected"),
                 F.sum("shipping_amount").alias("shipping_revenue"),
                 F.sum("total_amount").alias("net_revenue"),
                 exact_avg("total_amount").alias("avg_order_value")))


# --------------------------------------------------------------------------- Q5
def top_products(items: DataFrame, products: DataFrame, categories: DataFrame,
                 n: int | None = None, approx: bool = False) -> DataFrame:
    """Units, revenue, distinct orders and mean line price per product.

    No status or soft-delete filter, as in the reference view. With ``n`` the
    result is the top n by revenue (ties by product_id), a TakeOrdered plan.
    """
    per_product = items.groupBy("product_id").agg(
        F.sum("qty").alias("units_sold"),
        F.sum("line_total").alias("total_revenue"),
        _distinct("order_id", approx).alias("order_appearances"),
        exact_avg("unit_price").alias("avg_selling_price"))
    p = products.select("product_id", "sku", "product_name", "category_id")
    cat = categories.select("category_id", "category_name")
    out = (per_product.join(p, "product_id").join(cat, "category_id", "left")
           .select("product_id", "sku", "product_name", "category_name", "units_sold",
                   "total_revenue", "order_appearances", "avg_selling_price"))
    if n is not None:
        out = out.orderBy(F.desc("total_revenue"), F.asc("product_id")).limit(n)
    return out


# --------------------------------------------------------------------------- Q6
def regional_sales(orders: DataFrame, customers: DataFrame, regions: DataFrame, by_currency: bool = False) -> DataFrame:
    """Distinct customers, orders, revenue and mean order value per region, and
    with ``by_currency`` per region and currency (amounts of different currencies
    are then never added).

    Orders are first reduced to one row per customer (count, sum), so the
    join to customers moves one row per customer instead of one per order,
    and COUNT(DISTINCT customer_id) becomes a plain count of those rows.
    Customers without a region are dropped (inner join), as in the view.
    """
    money = ["currency"] if by_currency else []
    per_customer = _revenue_orders(orders).groupBy("customer_id", *money).agg(
        F.count("order_id").alias("n_orders"),
        F.sum("total_amount").alias("revenue"),
        F.count("total_amount").alias("n_amounts"))
    r = broadcast_if_small(regions.select("region_id", "region_name", "country"))
    return (per_customer.join(customers.select("customer_id", "region_id"), "customer_id")
            .join(r, "region_id")
            .groupBy("region_name", "country", *money)
            .agg(F.count("customer_id").alias("active_customers"),
                 F.sum("n_orders").alias("total_orders"),
                 F.sum("revenue").alias("total_revenue"),
                 F.sum("n_amounts").alias("_n"))
            .select("region_name", "country", *money, "active_customers", "total_orders", "total_revenue",
                    ratio("total_revenue", "_n").alias("avg_order_value")))


# --------------------------------------------------------------------------- Q7
def orders_by_status(orders: DataFrame, status: str) -> DataFrame:
    """Orders with one status, newest first (status dashboard)."""
    return (orders.filter(F.col("status") == status)
            .select("order_id", "customer_id", "status", "ordered_at", "total_amount")
            .orderBy(F.desc("ordered_at"), F.desc("order_id")))


# --------------------------------------------------------------------------- Q8
def order_history(orders: DataFrame, customer_id=None, n: int = 10) -> DataFrame:
    """Latest ``n`` orders of one customer, or of every customer.

    One customer: filter + TakeOrdered. All customers: row_number per
    customer, which Spark plans with a partial WindowGroupLimit before the
    shuffle, so a customer with very many orders ships only n rows per task.
    """
    cols = ["order_id", "customer_id", "ordered_at", "total_amount"]
    if customer_id is not None:
        return (orders.filter(F.col("customer_id") == customer_id).select(*cols)
                .orderBy(F.desc("ordered_at"), F.desc("order_id")).limit(n)
                .withColumn("recency_rank", F.row_number().over(
                    Window.orderBy(F.desc("ordered_at"), F.desc("order_id")))))
    w = Window.partitionBy("customer_id").orderBy(F.desc("ordered_at"), F.desc("order_id"))
    return (orders.select(*cols).withColumn("recency_rank", F.row_number().over(w))
            .filter(F.col("recency_rank") <= n))


# --------------------------------------------------------------------------- Q9
def reorder_check(inventory: DataFrame, warehouse_id=None) -> DataFrame:
    """Stock rows at or below their reorder point (uses on-hand, not available)."""
    cond = F.col("qty_on_hand") <= F.col("reorder_point")
    if warehouse_id is not None:
        cond = cond & (F.col("warehouse_id") == warehouse_id)
    return inventory.filter(cond).select("warehouse_id", "product_id", "qty_on_hand", "reorder_point")


# -------------------------------------------------------------------------- Q10
def browse_category(products: DataFrame, category_id=None) -> DataFrame:
    """Active products of a category (or all), cheapest first."""
    cond = F.col("is_active")
    if category_id is not None:
        cond = cond & (F.col("category_id") == category_id)
    return (products.filter(cond)
            .select("category_id", "product_id", "sku", "product_name", "unit_price")
            .orderBy("category_id", "unit_price", "product_id"))


# -------------------------------------------------------------------------- Q11
def tier_region_counts(customers: DataFrame) -> DataFrame:
    """Customer counts by tier, region and active flag."""
    return customers.groupBy("tier", "region_id", "is_active").agg(F.count(F.lit(1)).alias("customers"))


# -------------------------------------------------------------------------- Q12
def product_sales(items: DataFrame, by: str = "day") -> DataFrame:
    """Units and revenue per product and day (or month)."""
    if by == "day":
        period = day("created_at")
    elif by == "month":
        period = F.to_date(F.date_trunc("month", "created_at"))
    else:
        raise ValueError("by must be 'day' or 'month'")
    return (items.groupBy("product_id", period.alias("sale_period"))
            .agg(F.sum("qty").alias("units_sold"), F.sum("line_total").alias("revenue"),
                 F.count(F.lit(1)).alias("line_count")))


# -------------------------------------------------------------------------- Q13
def valid_codes(codes: DataFrame, on_day) -> DataFrame:
    """Codes usable on a day: active, in their validity range (open end when
    NULL) and not used up (max_uses NULL = unlimited)."""
    d = F.lit(on_day).cast("date")
    return codes.filter(
        F.col("is_active") & (F.col("valid_from") <= d)
        & (F.col("valid_until").isNull() | (d <= F.col("valid_until")))
        & (F.col("max_uses").isNull() | (F.col("used_count") < F.col("max_uses"))))


def discount_amount(total, kind, value):
    """percent: total * value / 100 rounded half-up to cents; fixed: at most the total."""
    total, kind, value = F.col(total), F.col(kind), F.col(value)
    pct = F.round(total * value * F.lit(0.01).cast("decimal(3,2)"), 2)
    return (F.when(kind == "percent", pct).otherwise(F.least(value, total))).cast("decimal(12,2)")


def codes_for_orders(orders: DataFrame, codes: DataFrame) -> DataFrame:
    """Every (order, code) pair where the code applies to the order.

    A temporal range join: order date within [valid_from, valid_until], code
    active, not used up, order total at least the minimum. The code table is
    small and size-checked, so it is broadcast and orders stream past it.
    """
    usable = codes.filter(F.col("is_active") & (F.col("max_uses").isNull()
                                                | (F.col("used_count") < F.col("max_uses"))))
    o = orders.filter(not_deleted()).select("order_id", "ordered_at", "total_amount",
                                           day("ordered_at").alias("_d"))
    joined = range_join(o, usable.select("code", "discount_type", "discount_value", "min_order_amt",
                                         "valid_from", "valid_until"),
                        F.col("_d"), F.col("valid_from"), F.col("valid_until"),
                        extra=F.col("total_amount") >= F.coalesce(F.col("min_order_amt"), F.lit(0)))
    return joined.select("order_id", "code", "discount_type", "total_amount",
                         discount_amount("total_amount", "discount_type", "discount_value")
                         .alias("discount_amount"))


# -------------------------------------------------------------------------- Q14
def search_products(products: DataFrame, text: str, n: int | None = None,
                    min_token_len: int = 3) -> DataFrame:
    """Full-text style search over product names.

    Names and the query are lower-cased, freed of accents and split on all
    but letters and digits of any script; tokens shorter than ``min_token_len`` are
    ignored. Score: number of distinct query terms matched, then total matching
    tokens. Judged within each row: nothing is shuffled.
    """
    terms = sorted({t for t in _tokens(text) if len(t) >= min_token_len})
    plain_name = unaccented(F.col("product_name"))
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hits = F.filter(F.split(F.lower(plain_name), r"[^\p{L}\p{N}]+"), lambda t: F.array_contains(wanted, t))
    out = (products.select("product_id", "product_name", hits.alias("_hits")).filter(F.size("_hits") > 0)
           .select("product_id", "product_name", F.size(F.array_distinct("_hits")).cast("long").alias("matched_terms"),
                   F.size("_hits").cast("long").alias("hits")))
    if n is not None:
        out = out.orderBy(F.desc("matched_terms"), F.desc("hits"), F.asc("product_id")).limit(n)
    return out


def _tokens(text: str) -> list[str]:
    import re
    return [t for t in re.split(r"[\W_]+", plain(text).lower()) if t]

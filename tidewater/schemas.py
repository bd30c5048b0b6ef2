"""Declared schema of the retail database (CON-1): Spark types, keys, enums,
defaults and the foreign-key graph with its delete/update actions.

Unsigned integer widths are widened one step so every value fits
(TINYINT UNSIGNED -> short, SMALLINT UNSIGNED -> int, INT/BIGINT UNSIGNED ->
long). ``max`` bounds for the range check are kept next to each column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---- fixed values that must equal the source database --------------------
TIERS = ["standard", "silver", "gold", "platinum"]
ORDER_STATUSES = ["pending", "confirmed", "processing", "shipped", "delivered",
                  "cancelled", "refunded"]
DISCOUNT_TYPES = ["percent", "fixed"]
EXCLUDED_REVENUE_STATUSES = ["cancelled", "refunded"]
# ---------------------------------------------------------------------------

U8 = 255
U16 = 65_535
U32 = 4_294_967_295
U64 = 18_446_744_073_709_551_615


def _f(name, dtype, nullable=False):
    return T.StructField(name, dtype, nullable)


LONG, INT, SHORT, STR, BOOL = T.LongType(), T.IntegerType(), T.ShortType(), T.StringType(), T.BooleanType()
TS, DATE = T.TimestampType(), T.DateType()


def DEC(p, s):
    return T.DecimalType(p, s)


SCHEMAS: dict[str, T.StructType] = {
    "regions": T.StructType([
        _f("region_id", SHORT), _f("region_name", STR), _f("country", STR),
        _f("timezone", STR), _f("created_at", TS)]),
    "categories": T.StructType([
        _f("category_id", INT), _f("parent_id", INT, True), _f("category_name", STR),
        _f("slug", STR), _f("depth", SHORT), _f("is_active", BOOL), _f("created_at", TS)]),
    "customers": T.StructType([
        _f("customer_id", LONG), _f("email", STR), _f("first_name", STR), _f("last_name", STR),
        _f("phone", STR, True), _f("region_id", SHORT, True), _f("tier", STR),
        _f("is_active", BOOL), _f("created_at", TS), _f("updated_at", TS)]),
    "products": T.StructType([
        _f("product_id", LONG), _f("category_id", INT, True), _f("sku", STR),
        _f("product_name", STR), _f("description", STR, True), _f("unit_price", DEC(10, 2)),
        _f("cost_price", DEC(10, 2)), _f("weight_kg", DEC(6, 3), True), _f("is_active", BOOL),
        _f("created_at", TS), _f("updated_at", TS)]),
    "warehouses": T.StructType([
        _f("warehouse_id", INT), _f("region_id", SHORT, True), _f("warehouse_name", STR),
        _f("address", STR, True), _f("capacity_sqft", LONG, True), _f("is_active", BOOL),
        _f("created_at", TS)]),
    "inventory": T.StructType([
        _f("inventory_id", LONG), _f("product_id", LONG), _f("warehouse_id", INT),
        _f("qty_on_hand", INT), _f("qty_reserved", INT), _f("reorder_point", INT),
        _f("updated_at", TS)]),
    "orders": T.StructType([
        _f("order_id", LONG), _f("customer_id", LONG), _f("warehouse_id", INT, True),
        _f("status", STR), _f("currency", STR), _f("subtotal", DEC(12, 2)),
        _f("tax_amount", DEC(10, 2)), _f("shipping_amount", DEC(10, 2)),
        _f("total_amount", DEC(12, 2)), _f("notes", STR, True), _f("ordered_at", TS),
        _f("updated_at", TS), _f("deleted_at", TS, True), _f("created_by", STR, True),
        _f("migrated_at", TS, True)]),
    "order_items": T.StructType([
        _f("item_id", LONG), _f("order_id", LONG), _f("product_id", LONG), _f("qty", SHORT),
        _f("unit_price", DEC(10, 2)), _f("line_total", DEC(12, 2)), _f("created_at", TS)]),
    "discount_codes": T.StructType([
        _f("code_id", LONG), _f("code", STR), _f("discount_type", STR),
        _f("discount_value", DEC(8, 2)), _f("min_order_amt", DEC(10, 2), True),
        _f("max_uses", LONG, True), _f("used_count", LONG), _f("valid_from", DATE),
        _f("valid_until", DATE, True), _f("is_active", BOOL), _f("created_at", TS)]),
    "audit_log": T.StructType([
        _f("audit_id", LONG), _f("event", STR), _f("table_name", STR, True),
        _f("row_count", LONG, True), _f("recorded_at", TS)]),
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "regions": ["region_id"], "categories": ["category_id"], "customers": ["customer_id"],
    "products": ["product_id"], "warehouses": ["warehouse_id"], "inventory": ["inventory_id"],
    "orders": ["order_id"], "order_items": ["item_id"], "discount_codes": ["code_id"],
    "audit_log": ["audit_id"],
}

UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "regions": [["region_name"]], "categories": [["slug"]], "customers": [["email"]],
    "products": [["sku"]], "inventory": [["product_id", "warehouse_id"]],
    "discount_codes": [["code"]],
}

# Columns compared case/accent/trailing-space insensitively in the source.
COLLATED_LOOKUPS = {"customers": ["email"], "products": ["sku"], "categories": ["slug"],
                    "discount_codes": ["code"], "regions": ["region_name"]}

ENUMS: dict[tuple[str, str], list[str]] = {
    ("customers", "tier"): TIERS,
    ("orders", "status"): ORDER_STATUSES,
    ("discount_codes", "discount_type"): DISCOUNT_TYPES,
}

# ---- fixed values: declared defaults, ranges, lengths and foreign keys -----
# Column defaults (CON-2). "now" means current timestamp at write.
DEFAULTS: dict[str, dict[str, object]] = {
    "regions": {"timezone": "UTC", "created_at": "now"},
    "categories": {"depth": 0, "is_active": True, "created_at": "now"},
    "customers": {"tier": "standard", "is_active": True, "created_at": "now", "updated_at": "now"},
    "products": {"is_active": True, "created_at": "now", "updated_at": "now"},
    "warehouses": {"is_active": True, "created_at": "now"},
    "inventory": {"qty_on_hand": 0, "qty_reserved": 0, "reorder_point": 10, "updated_at": "now"},
    "orders": {"status": "pending", "currency": "USD", "tax_amount": "0.00",
               "shipping_amount": "0.00", "ordered_at": "now", "updated_at": "now"},
    "order_items": {"qty": 1, "created_at": "now"},
    "discount_codes": {"discount_type": "percent", "min_order_amt": "0.00", "used_count": 0,
                       "is_active": True, "created_at": "now"},
    "audit_log": {"recorded_at": "now"},
}

# Range and length rules (CON-8): (min, max) for numbers, max length for text.
RANGES: dict[str, dict[str, tuple]] = {
    "regions": {"region_id": (0, U8)},
    "categories": {"category_id": (0, U16), "parent_id": (0, U16), "depth": (0, U8)},
    "customers": {"customer_id": (0, U32), "region_id": (0, U8)},
    "products": {"product_id": (0, U32), "category_id": (0, U16)},
    "warehouses": {"warehouse_id": (0, U16), "region_id": (0, U8), "capacity_sqft": (0, U32)},
    "inventory": {"inventory_id": (0, U64), "product_id": (0, U32), "warehouse_id": (0, U16)},
    "orders": {"order_id": (0, U64), "customer_id": (0, U32), "warehouse_id": (0, U16)},
    "order_items": {"item_id": (0, U64), "order_id": (0, U64), "product_id": (0, U32)},
    "discount_codes": {"code_id": (0, U32), "max_uses": (0, U32), "used_count": (0, U32)},
}
LENGTHS: dict[str, dict[str, int]] = {
    "regions": {"region_name": 100, "country": 100, "timezone": 50},
    "categories": {"category_name": 150, "slug": 160},
    "customers": {"email": 254, "first_name": 80, "last_name": 80, "phone": 20},
    "products": {"sku": 64, "product_name": 255},
    "warehouses": {"warehouse_name": 120, "address": 300},
    "orders": {"currency": 3, "created_by": 64},
    "discount_codes": {"code": 32},
    "audit_log": {"event": 60, "table_name": 128},
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str
    on_delete: str = "RESTRICT"  # RESTRICT | CASCADE | SET NULL
    on_update: str = "RESTRICT"  # RESTRICT | CASCADE


FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("categories", "parent_id", "categories", "category_id", "SET NULL", "CASCADE"),
    ForeignKey("customers", "region_id", "regions", "region_id", "SET NULL"),
    ForeignKey("products", "category_id", "categories", "category_id", "SET NULL"),
    ForeignKey("warehouses", "region_id", "regions", "region_id", "SET NULL"),
    ForeignKey("inventory", "product_id", "products", "product_id", "CASCADE"),
    ForeignKey("inventory", "warehouse_id", "warehouses", "warehouse_id", "CASCADE"),
    ForeignKey("orders", "customer_id", "customers", "customer_id", "RESTRICT"),
    ForeignKey("orders", "warehouse_id", "warehouses", "warehouse_id", "SET NULL"),
    ForeignKey("order_items", "order_id", "orders", "order_id", "CASCADE"),
    ForeignKey("order_items", "product_id", "products", "product_id", "RESTRICT"),
]

# ---------------------------------------------------------------------------

# Columns added after the first version of the schema (CON-14).
ORDERS_EVOLUTION = [T.StructField("deleted_at", TS, True),
                    T.StructField("created_by", STR, True),
                    T.StructField("migrated_at", TS, True)]


def load_order(tables: list[str] | None = None) -> list[str]:
    """Tables in parent-before-child order (for load and delete propagation)."""
    names = list(tables or SCHEMAS)
    deps = {t: {fk.parent for fk in FOREIGN_KEYS if fk.child == t and fk.parent != t} for t in names}
    out: list[str] = []
    while deps:
        ready = sorted(t for t, d in deps.items() if not (d & set(deps)))
        if not ready:
            raise ValueError(f"cycle among {sorted(deps)}")
        out.extend(ready)
        for t in ready:
            deps.pop(t)
    return out

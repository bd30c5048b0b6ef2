"""Oracle SQL (DuckDB dialect) for the registered queries.

Each statement recomputes a query from the driver tables independently of
Spark, using the same binding as ``plans.bindings``. Money is exact
DECIMAL; averages use integer arithmetic (DuckDB's AVG on DECIMAL returns a
DOUBLE), rounded half-up to 6 places like Spark's and MySQL's decimal AVG.
Both sides cast money and averages to DOUBLE only at the very end, from the
exact decimal, so the two engines produce the same bits.
"""

from __future__ import annotations

from ..functions.formats import FORMAT_RULES, MIN_ZONES
from ..schemas import ORDER_STATUSES
from ..sources.seed import DISCOUNT_CODES


def avg6(x: str) -> str:
    """Half-up mean to 6 places of a DECIMAL(*,2) expression, as DECIMAL(18,6)."""
    s = f"CAST(SUM({x}) * 100 AS HUGEINT)"
    c = f"COUNT({x})"
    return (f"CAST(CASE WHEN {c} = 0 THEN NULL "
            f"WHEN {s} >= 0 THEN CAST(({s} * 20000 + {c}) // (2 * {c}) AS DECIMAL(38,0)) "
            f"ELSE -CAST(((-{s}) * 20000 + {c}) // (2 * {c}) AS DECIMAL(38,0)) END "
            f"* 0.000001 AS DECIMAL(18,6))")


def ratio6(total: str, count: str) -> str:
    """Half-up total/count to 6 places from a pre-summed DECIMAL(*,2) total."""
    s = f"CAST(({total}) * 100 AS HUGEINT)"
    c = f"({count})"
    return (f"CAST(CASE WHEN {c} = 0 THEN NULL "
            f"WHEN {s} >= 0 THEN CAST(({s} * 20000 + {c}) // (2 * {c}) AS DECIMAL(38,0)) "
            f"ELSE -CAST(((-{s}) * 20000 + {c}) // (2 * {c}) AS DECIMAL(38,0)) END "
            f"* 0.000001 AS DECIMAL(18,6))")


def dbl(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,6)) AS DOUBLE)"


# ---- canonical views over the driver tables (same binding as bindings.py) ----
ORDERS = """
o AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CAST(o_orderkey % 120 AS INTEGER) AS warehouse_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                            WHEN 'P' THEN 'cancelled' END AS status,
         o_orderpriority AS currency,
         CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
         CAST(ROUND(CAST(o_totalprice AS DECIMAL(12,2)) * 0.09, 2) AS DECIMAL(10,2)) AS tax_amount,
         CAST(0 AS DECIMAL(10,2)) AS shipping_amount,
         o_orderdate AS ordered_at,
         CASE WHEN o_orderkey % 41 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS deleted_at,
         CAST(NULL AS TIMESTAMP) AS migrated_at
  FROM orders),
o2 AS (SELECT *, CAST(total_amount - tax_amount AS DECIMAL(12,2)) AS subtotal FROM o)"""

CUSTOMERS = """
c AS (
  SELECT c_custkey AS customer_id,
         split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name,
         lower(split_part(c_name, '#', 1)) || '.' || split_part(c_name, '#', 2) || '@example.com' AS email,
         c_nationkey AS region_id, lower(c_mktsegment) AS tier, c_acctbal >= 0 AS is_active
  FROM customer)"""

REGIONS = """
r AS (
  SELECT n_nationkey AS region_id, n_name AS region_name, r_name AS country
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)"""

WAREHOUSES = """
w AS (SELECT CAST(s_suppkey AS INTEGER) AS warehouse_id, s_name AS warehouse_name, s_nationkey AS region_id FROM supplier)"""

PRODUCTS = """
p AS (
  SELECT p_partkey AS product_id,
         CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS category_id,
         p_type || '-' || CAST(p_partkey AS VARCHAR) AS sku,
         p_name AS product_name, CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price, TRUE AS is_active
  FROM part)"""

CATEGORIES = """
cat AS (
  SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS category_id,
         p_brand AS category_name
  FROM part)"""

ITEMS = """
li AS (
  SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_suppkey AS INTEGER) AS warehouse_id,
         CAST(l_quantity AS INTEGER) AS qty,
         CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS total_cents,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS line_total,
         l_shipdate AS created_at, l_linestatus AS line_status
  FROM lineitem),
oi AS (
  SELECT *, CAST(CAST((2 * total_cents + qty) // (2 * qty) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2)) AS unit_price
  FROM li)"""

INVENTORY = """
inv AS (
  SELECT s.product_id, s.warehouse_id, s.qty_on_hand, s.qty_reserved, pt.p_size AS reorder_point
  FROM (SELECT product_id, warehouse_id, CAST(SUM(qty) AS INTEGER) AS qty_on_hand,
               CAST(COALESCE(SUM(CASE WHEN line_status = 'O' THEN qty END), 0) AS INTEGER) AS qty_reserved
        FROM oi GROUP BY product_id, warehouse_id) s
  JOIN part pt ON pt.p_partkey = s.product_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


REVENUE = "o2.status NOT IN ('cancelled', 'refunded') AND o2.deleted_at IS NULL"

SQL: dict[str, str] = {}

SQL["daily_revenue"] = with_(ORDERS) + f"""
, bought AS (SELECT customer_id, currency, CAST(ordered_at AS DATE) AS order_date, COUNT(*) AS orders,
                    SUM(subtotal) AS subtotal, SUM(tax_amount) AS tax, SUM(shipping_amount) AS shipping,
                    SUM(total_amount) AS total, COUNT(total_amount) AS amounts
             FROM o2 WHERE {REVENUE} GROUP BY ALL)
SELECT order_date, currency, CAST(SUM(orders) AS BIGINT) AS order_count,
       CAST(COUNT(customer_id) AS BIGINT) AS unique_customers,
       {dbl('SUM(subtotal)')} AS gross_revenue, {dbl('SUM(tax)')} AS tax_collected,
       {dbl('SUM(shipping)')} AS shipping_revenue, {dbl('SUM(total)')} AS net_revenue,
       {dbl(ratio6('SUM(total)', 'SUM(amounts)'))} AS avg_order_value
FROM bought GROUP BY order_date, currency"""

SQL["order_summary"] = with_(ORDERS, CUSTOMERS, REGIONS, WAREHOUSES, ITEMS) + f"""
, lines AS (SELECT order_id, COUNT(*) AS n, SUM(qty) AS units FROM oi GROUP BY order_id),
buyer AS (SELECT *, concat_ws(' ', first_name, last_name) AS full_name FROM c)
SELECT head.order_id, head.status, head.currency, {dbl('head.total_amount')} AS total_amount, head.ordered_at,
       head.migrated_at, buyer.customer_id, buyer.full_name AS customer_name, buyer.email, buyer.tier,
       (SELECT region_name FROM r WHERE r.region_id = buyer.region_id) AS region_name,
       (SELECT warehouse_name FROM w WHERE w.warehouse_id = head.warehouse_id) AS warehouse_name,
       CAST(COALESCE(lines.n, 0) AS BIGINT) AS line_count, CAST(lines.units AS BIGINT) AS total_units
FROM (SELECT * FROM o2 WHERE deleted_at IS NULL) AS head
INNER JOIN buyer ON head.customer_id = buyer.customer_id
LEFT JOIN lines ON lines.order_id = head.order_id"""

SQL["inventory_health"] = with_(ITEMS, INVENTORY, PRODUCTS, WAREHOUSES) + """
, level AS (SELECT *, qty_on_hand - qty_reserved AS free FROM inv),
named AS (SELECT product_id, sku, product_name FROM p WHERE is_active)
SELECT product_id, named.sku, named.product_name, warehouse_id, w.warehouse_name, level.qty_on_hand, level.qty_reserved,
       level.free AS qty_available, level.reorder_point,
       CASE WHEN level.free <= 0 THEN 'OUT_OF_STOCK' WHEN level.free <= level.reorder_point THEN 'LOW_STOCK'
            ELSE 'OK' END AS stock_status
FROM level INNER JOIN named USING (product_id) INNER JOIN w USING (warehouse_id)"""

SQL["customer_ltv"] = with_(ORDERS, CUSTOMERS) + f"""
, spent AS (SELECT customer_id, COUNT(*) AS n, SUM(total_amount) AS total, {avg6('total_amount')} AS mean,
                   MIN(ordered_at) AS since, MAX(ordered_at) AS until
            FROM o2 WHERE {REVENUE} GROUP BY customer_id)
SELECT c.customer_id, concat_ws(' ', c.first_name, c.last_name) AS customer_name, c.tier,
       CAST(COALESCE(spent.n, 0) AS BIGINT) AS total_orders, {dbl('spent.total')} AS lifetime_value,
       {dbl('spent.mean')} AS avg_order_value, spent.since AS first_order_date, spent.until AS latest_order_date,
       CAST(CAST(spent.until AS DATE) - CAST(spent.since AS DATE) AS INTEGER) AS days_as_customer
FROM c LEFT JOIN spent ON spent.customer_id = c.customer_id"""

SQL["top_products"] = with_(ITEMS, PRODUCTS, CATEGORIES) + f"""
, sold AS (SELECT product_id, SUM(qty) AS units, SUM(line_total) AS money, {avg6('unit_price')} AS price
           FROM oi GROUP BY product_id),
seen AS (SELECT product_id, COUNT(*) AS n FROM (SELECT DISTINCT product_id, order_id FROM oi) GROUP BY product_id)
SELECT product_id, p.sku, p.product_name,
       (SELECT MIN(category_name) FROM cat WHERE cat.category_id = p.category_id) AS category_name,
       CAST(sold.units AS BIGINT) AS units_sold, {dbl('sold.money')} AS total_revenue,
       CAST(seen.n AS BIGINT) AS order_appearances, {dbl('sold.price')} AS avg_selling_price
FROM sold INNER JOIN seen USING (product_id) INNER JOIN p USING (product_id)"""

SQL["top_products_n"] = f"""
SELECT * FROM ({SQL['top_products']}) t
ORDER BY total_revenue DESC, product_id ASC LIMIT 20"""

SQL["regional_sales"] = with_(ORDERS, CUSTOMERS, REGIONS) + f"""
, sale AS (SELECT o2.order_id, o2.customer_id, o2.total_amount,
                  (SELECT region_id FROM c WHERE c.customer_id = o2.customer_id) AS region_id
           FROM o2 WHERE {REVENUE}),
place AS (SELECT region_id, COUNT(*) AS n, COUNT(DISTINCT customer_id) AS buyers, SUM(total_amount) AS money,
                 {avg6('total_amount')} AS mean FROM sale GROUP BY region_id)
SELECT r.region_name, r.country, CAST(place.buyers AS BIGINT) AS active_customers, CAST(place.n AS BIGINT) AS total_orders,
       {dbl('place.money')} AS total_revenue, {dbl('place.mean')} AS avg_order_value
FROM place INNER JOIN r ON r.region_id = place.region_id"""

SQL["orders_by_status"] = with_(ORDERS) + f"""
SELECT order_id, customer_id, status, ordered_at, {dbl('total_amount')} AS total_amount
FROM o WHERE status = 'shipped'"""

SQL["order_history_topn"] = with_(ORDERS) + f"""
SELECT order_id, customer_id, ordered_at, {dbl('total_amount')} AS total_amount, recency_rank
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY ordered_at DESC, order_id DESC)
                     AS INTEGER) AS recency_rank FROM o) t
WHERE recency_rank <= 3"""

SQL["reorder_check"] = with_(ITEMS, INVENTORY) + """
SELECT warehouse_id, product_id, qty_on_hand, reorder_point FROM inv WHERE qty_on_hand <= reorder_point"""

SQL["browse_category"] = with_(PRODUCTS) + f"""
SELECT category_id, product_id, sku, product_name, {dbl('unit_price')} AS unit_price FROM p WHERE is_active"""

SQL["tier_region_counts"] = with_(CUSTOMERS) + """
SELECT tier, region_id, is_active, CAST(COUNT(*) AS BIGINT) AS customers FROM c GROUP BY tier, region_id, is_active"""

SQL["product_sales"] = with_(ITEMS) + f"""
SELECT product_id, CAST(created_at AS DATE) AS sale_period, CAST(SUM(qty) AS BIGINT) AS units_sold,
       {dbl('SUM(line_total)')} AS revenue, CAST(COUNT(*) AS BIGINT) AS line_count
FROM oi GROUP BY product_id, CAST(created_at AS DATE)"""

def _code_row(code, kind, value, least, uses, since, until) -> str:
    cells = [f"'{code}'", f"'{kind}'", value, least, "NULL" if uses is None else uses, f"DATE '{since}'",
             "NULL" if until is None else f"DATE '{until}'"]
    return f"({', '.join(map(str, cells))})"


CODES = f"""
codes AS (SELECT * FROM (VALUES {', '.join(_code_row(*c) for c in DISCOUNT_CODES)})
    t(code, discount_type, discount_value, min_order_amt, max_uses, valid_from, valid_until))"""

SQL["codes_for_orders"] = with_(ORDERS, CODES) + f"""
SELECT o.order_id, k.code, k.discount_type, {dbl('o.total_amount')} AS total_amount,
       {dbl("CASE WHEN k.discount_type = 'percent' THEN ROUND(o.total_amount * CAST(k.discount_value AS DECIMAL(8,2)) * 0.01, 2) ELSE LEAST(CAST(k.discount_value AS DECIMAL(12,2)), o.total_amount) END")} AS discount_amount
FROM o JOIN codes k
  ON CAST(o.ordered_at + INTERVAL 9496 DAY AS DATE) >= k.valid_from
 AND (k.valid_until IS NULL OR CAST(o.ordered_at + INTERVAL 9496 DAY AS DATE) <= k.valid_until)
 AND o.total_amount >= COALESCE(k.min_order_amt, 0)
 AND (k.max_uses IS NULL OR 0 < k.max_uses)
WHERE o.deleted_at IS NULL"""

SQL["search_ranked"] = """
WITH asked(query) AS (VALUES ('the thing and'), ('Und der Ächte'), ('password token'), ('élle que'), ('edition'), ('nothing-like-it')),
wanted AS (SELECT DISTINCT query, unnest(string_split_regex(lower(strip_accents(query)), '[^\\p{L}\\p{N}]+')) AS term FROM asked),
docs AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN substring(text, 1, 500) || ' second EDITION, edition' ELSE text END AS text
         FROM documents WHERE doc_id % 13 <> 4 OR doc_id % 11 = 5 OR doc_id % 7 = 3),
words AS (SELECT doc_id, unnest(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+')) AS term FROM docs),
postings AS (SELECT doc_id, term, COUNT(*) AS tf FROM words WHERE length(term) >= 3 GROUP BY doc_id, term),
weights AS (SELECT term, power(log10((SELECT COUNT(*) FROM docs)::DOUBLE / COUNT(*)), 2) AS weight FROM postings GROUP BY term),
scored AS (SELECT query, doc_id, round(SUM(tf * weight), 6) AS score, COUNT(*) AS matched_terms
           FROM postings JOIN weights USING (term) JOIN wanted USING (term) GROUP BY query, doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM scored) WHERE place <= 20"""

SQL["search_products"] = """
WITH q(term) AS (VALUES ('blue'), ('widget'), ('with'), ('steel'), ('bolt')),
tok AS (SELECT p_partkey AS product_id, p_name AS product_name,
               unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS term FROM part)
SELECT product_id, product_name, CAST(COUNT(DISTINCT tok.term) AS BIGINT) AS matched_terms,
       CAST(COUNT(*) AS BIGINT) AS hits
FROM tok JOIN q ON q.term = tok.term
WHERE length(tok.term) >= 3
GROUP BY product_id, product_name"""

SQL["check_unique_lineitem"] = """
SELECT 'lineitem' AS table_name, 'unique' AS rule, 'l_orderkey,l_linenumber' AS column_name,
       CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS violations, CAST(COUNT(*) AS BIGINT) AS duplicate_keys
FROM (SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
      GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) d"""

_FK = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
       ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
       ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
       ("nation", "n_regionkey", "region", "r_regionkey")]
SQL["check_foreign_keys"] = "\nUNION ALL\n".join(
    f"SELECT '{ct}' AS table_name, 'fk' AS rule, '{cc}->{pc}' AS column_name, "
    f"CAST(COUNT(*) AS BIGINT) AS violations FROM {ct} x "
    f"WHERE x.{cc} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pt} y WHERE y.{pc} = x.{cc})"
    for ct, cc, pt, pc in _FK)


def _checks(table: str, source: str, rules: list[tuple[str, str, str]]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{r}' AS rule, '{c}' AS column_name, "
        f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM {source}"
        for r, c, cond in rules)


_STATUSES = "'pending','confirmed','processing','shipped','delivered','cancelled','refunded'"
SQL["check_rules_orders"] = with_(ORDERS) + _checks("orders", "o2", [
    ("not_null", "order_id", "order_id IS NULL"), ("not_null", "customer_id", "customer_id IS NULL"),
    ("not_null", "status", "status IS NULL"), ("not_null", "currency", "currency IS NULL"),
    ("not_null", "subtotal", "subtotal IS NULL"), ("not_null", "total_amount", "total_amount IS NULL"),
    ("not_null", "ordered_at", "ordered_at IS NULL"),
    ("domain", "status", f"status IS NOT NULL AND status NOT IN ({_STATUSES})"),
    ("range", "order_id", "order_id IS NOT NULL AND (order_id < 0 OR CAST(order_id AS HUGEINT) > 18446744073709551615)"),
    ("range", "customer_id", "customer_id IS NOT NULL AND (customer_id < 0 OR customer_id > 4294967295)"),
    ("range", "warehouse_id", "warehouse_id IS NOT NULL AND (warehouse_id < 0 OR warehouse_id > 65535)"),
    ("length", "currency", "currency IS NOT NULL AND length(currency) > 3"),
    ("decimal", "total_amount", "total_amount IS NOT NULL AND TRY_CAST(total_amount AS DECIMAL(12,2)) IS NULL"),
])

_EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
_DBNAME = r"^[a-zA-Z][a-zA-Z0-9_]{0,63}$"
SQL["check_rules_customers"] = with_(CUSTOMERS) + _checks("customers", "c", [
    ("format", "email", f"email IS NOT NULL AND NOT regexp_matches(email, '{_EMAIL}')"),
    ("format", "first_name", f"first_name IS NOT NULL AND NOT regexp_matches(first_name, '{_DBNAME}')"),
    ("domain", "tier", "tier IS NOT NULL AND tier NOT IN ('standard','silver','gold','platinum')"),
    ("range", "region_id", "region_id IS NOT NULL AND (region_id < 0 OR region_id > 255)"),
    ("length", "email", "email IS NOT NULL AND length(email) > 254"),
    ("length", "last_name", "last_name IS NOT NULL AND length(last_name) > 80"),
])

SQL["cascade_delete_items"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey
                  AND o.o_orderdate < TIMESTAMP '1996-01-01 00:00:00')"""

SQL["set_null_on_delete_customers"] = with_(CUSTOMERS, REGIONS) + """
SELECT c.customer_id,
       CASE WHEN c.region_id IN (SELECT region_id FROM r WHERE country = 'AFRICA') THEN NULL
            ELSE c.region_id END AS region_id
FROM c"""

SQL["check_restrict_customers"] = with_(ORDERS) + """
SELECT customer_id, CAST(COUNT(*) AS BIGINT) AS child_rows FROM o
WHERE customer_id IN (SELECT c_custkey FROM customer WHERE CAST(c_acctbal AS DECIMAL(12,2)) < 0)
GROUP BY customer_id"""

SQL["remap_key_customers"] = with_(CUSTOMERS) + """
SELECT c.customer_id, COALESCE(m.new_key, c.region_id) AS region_id
FROM c LEFT JOIN (SELECT n_nationkey AS old_key, n_nationkey + 100 AS new_key FROM nation) m
  ON c.region_id = m.old_key"""

SQL["upsert_customers"] = with_(CUSTOMERS) + """,
src AS (SELECT c_custkey AS customer_id, c.email AS email0, upper(c.email) AS email,
               CASE WHEN CAST(c_acctbal AS DECIMAL(12,2)) >= 5000 THEN 'platinum' ELSE c.tier END AS tier,
               c.is_active
        FROM customer JOIN c ON c.customer_id = c_custkey),
tgt AS (SELECT customer_id, email, tier, is_active, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
        FROM c WHERE tier <> 'household')
SELECT COALESCE(t.customer_id, s.customer_id) AS customer_id,
       CASE WHEN t.customer_id IS NOT NULL THEN t.email ELSE s.email END AS email,
       CASE WHEN s.customer_id IS NOT NULL THEN s.tier ELSE t.tier END AS tier,
       CASE WHEN t.customer_id IS NOT NULL THEN t.is_active ELSE s.is_active END AS is_active,
       CASE WHEN t.customer_id IS NOT NULL AND s.customer_id IS NOT NULL
              THEN TIMESTAMP '2024-06-01 00:00:00'
            WHEN s.customer_id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00'
            ELSE t.updated_at END AS updated_at
FROM tgt t FULL OUTER JOIN src s ON t.customer_id = s.customer_id"""

SQL["upsert_inventory"] = with_(ITEMS, INVENTORY) + """
, kept AS (SELECT *, row_number() OVER (ORDER BY product_id, warehouse_id) AS id FROM inv WHERE product_id % 5 <> 0),
added AS (SELECT *, row_number() OVER (ORDER BY product_id, warehouse_id) AS id FROM inv
          WHERE product_id % 5 = 0 AND product_id % 3 <> 0)
SELECT id AS inventory_id, product_id, warehouse_id, qty_reserved, reorder_point,
       CAST(qty_on_hand + CASE WHEN product_id % 3 <> 0 THEN 7 ELSE 0 END AS INTEGER) AS qty_on_hand FROM kept
UNION ALL
SELECT id + (SELECT MAX(id) FROM kept), product_id, warehouse_id, 0, 10, CAST(qty_on_hand + 7 AS INTEGER) FROM added"""

SQL["mark_migrated"] = with_(ORDERS) + """
SELECT order_id, status,
       COALESCE(CASE WHEN status = 'delivered' THEN ordered_at END, TIMESTAMP '2024-06-01 00:00:00') AS migrated_at
FROM o"""

SQL["upsert_any_key"] = with_(CUSTOMERS) + """
, ids AS (SELECT MAX(id) AS most FROM (SELECT customer_id AS id FROM c UNION ALL SELECT customer_id + 10000000 FROM c WHERE customer_id % 10 = 6)),
counted AS (SELECT upper('new.' || customer_id || '@example.com') AS email FROM c WHERE customer_id % 10 = 4)
SELECT customer_id, email, last_name, region_id,
       CASE customer_id % 10 WHEN 0 THEN 'platinum' WHEN 1 THEN 'gold' WHEN 2 THEN 'platinum' ELSE tier END AS tier, is_active,
       CASE WHEN customer_id % 10 <= 2 THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at
FROM c
UNION ALL SELECT customer_id + 10000000, 'new.' || customer_id || '@example.com', NULL, NULL, 'platinum', TRUE, TIMESTAMP '2024-06-01'
FROM c WHERE customer_id % 10 = 6
UNION ALL SELECT most + row_number() OVER (ORDER BY email), email, NULL, NULL, 'silver', TRUE, TIMESTAMP '2024-06-01' FROM counted, ids"""

SQL["upsert_conflicts"] = with_(CUSTOMERS) + """
SELECT customer_id - 1 AS customer_id, email, NULL::VARCHAR AS last_name, NULL::INTEGER AS region_id, 'platinum' AS tier, 1 AS seq,
       'keys of different rows' AS reason FROM c WHERE customer_id % 10 = 3
UNION ALL SELECT NULL, 'new.' || customer_id || '@example.com', n.name, NULL, 'platinum', n.seq, 'new rows share a key'
FROM c, (VALUES ('x', 1), ('y', 2)) n(name, seq) WHERE customer_id % 10 = 5"""

SQL["evolve_orders"] = """
SELECT *, CAST(NULL AS TIMESTAMP) AS deleted_at, CAST(NULL AS VARCHAR) AS created_by,
       CAST(NULL AS TIMESTAMP) AS migrated_at FROM orders"""

def reserve_walk(key: str, qty: str, stock: str) -> str:
    """Requests in order per key (columns ``req``, ``inv`` and the decided ``walk``)."""
    return f"""
WITH RECURSIVE req AS (
  SELECT event_id AS request_id, {key}, CAST({qty} AS INTEGER) AS qty,
         row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS rn
  FROM events),
inv AS ({stock}),
step AS (SELECT q.*, i.{key} IS NOT NULL AS held, COALESCE(i.qty_on_hand - i.qty_reserved, 0) AS a0
         FROM req q LEFT JOIN inv i ON i.{key} = q.{key}),
walk AS (
  SELECT {key}, rn, request_id, qty, CASE WHEN a0 >= qty THEN 0 ELSE 1 END AS result,
         CASE WHEN held AND a0 >= qty THEN a0 - qty ELSE a0 END AS avail
  FROM step WHERE rn = 1
  UNION ALL
  SELECT q.{key}, q.rn, q.request_id, q.qty, CASE WHEN w.avail >= q.qty THEN 0 ELSE 1 END,
         CASE WHEN q.held AND w.avail >= q.qty THEN w.avail - q.qty ELSE w.avail END
  FROM walk w JOIN step q ON q.{key} = w.{key} AND q.rn = w.rn + 1)
"""


SQL["purge_cycle"] = """
WITH RECURSIVE c AS (SELECT *, CASE WHEN c_custkey % 20 = 4 THEN c_custkey + 1
                               WHEN c_custkey % 20 BETWEEN 5 AND 8 THEN c_custkey - 1 END AS referrer FROM customer),
n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'),
gone AS (SELECT c_custkey FROM c WHERE c_nationkey IN (SELECT n_nationkey FROM n)
         UNION SELECT c.c_custkey FROM c JOIN gone ON c.referrer = gone.c_custkey),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT 'region' AS table_name, COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE r_name = 'AFRICA') AS rows_deleted,
       CAST(0 AS BIGINT) AS null_references FROM region
UNION ALL SELECT 'nation', COUNT(*), COUNT(*) FILTER (WHERE n_nationkey IN (SELECT n_nationkey FROM n)), 0 FROM nation
UNION ALL SELECT 'customer', COUNT(*), COUNT(*) FILTER (WHERE c_custkey IN (SELECT c_custkey FROM gone)), 0 FROM customer
UNION ALL SELECT 'supplier', COUNT(*), 0, COUNT(*) FILTER (WHERE s_nationkey IN (SELECT n_nationkey FROM n)) FROM supplier
UNION ALL SELECT 'orders', COUNT(*), COUNT(*) FILTER (WHERE o_orderkey IN (SELECT o_orderkey FROM o)), 0 FROM orders
UNION ALL SELECT 'lineitem', COUNT(*), COUNT(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM o)), 0 FROM lineitem"""

SQL["purge_declared"] = with_(ORDERS, CUSTOMERS, REGIONS, WAREHOUSES, ITEMS, INVENTORY, PRODUCTS) + """
, asia AS (SELECT region_id FROM r WHERE country = 'ASIA'),
old AS (SELECT order_id FROM o2 WHERE ordered_at < TIMESTAMP '1996-01-01')
SELECT 'regions' AS table_name, COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE country = 'ASIA') AS rows_deleted,
       CAST(0 AS BIGINT) AS null_references FROM r
UNION ALL SELECT 'customers', COUNT(*), 0, COUNT(*) FILTER (WHERE region_id IN (SELECT region_id FROM asia)) FROM c
UNION ALL SELECT 'warehouses', COUNT(*), COUNT(*) FILTER (WHERE s_suppkey % 7 = 0),
       COUNT(*) FILTER (WHERE s_suppkey % 7 <> 0 AND s_nationkey IN (SELECT region_id FROM asia)) FROM supplier
UNION ALL SELECT 'products', COUNT(*), 0, 0 FROM p
UNION ALL SELECT 'inventory', COUNT(*), COUNT(*) FILTER (WHERE warehouse_id % 7 = 0), 0 FROM inv
UNION ALL SELECT 'orders', COUNT(*), COUNT(*) FILTER (WHERE order_id IN (SELECT order_id FROM old)),
       COUNT(*) FILTER (WHERE order_id NOT IN (SELECT order_id FROM old)
                        AND order_id % 120 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0)) FROM o2
UNION ALL SELECT 'order_items', COUNT(*), COUNT(*) FILTER (WHERE order_id IN (SELECT order_id FROM old)), 0 FROM oi"""

SQL["purge_refused"] = """
SELECT 'orders' AS child, 'customer_id' AS column, 'customers' AS parent, CAST(o_custkey AS VARCHAR) AS parent_key,
       COUNT(*) AS child_rows, TRUE AS refused
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 AND o_custkey % 3 <> 0 GROUP BY o_custkey"""

RESERVE_WALK = reserve_walk(
    "user_id", "CASE WHEN event_type = 'error' THEN -floor(value) WHEN event_id % 97 = 0 THEN NULL ELSE floor(value) END",
    "SELECT DISTINCT user_id, 1000 AS qty_on_hand, 0 AS qty_reserved FROM events WHERE event_type = 'signup'")

SQL["reserve_hot_keys"] = reserve_walk(
    "event_type", "CASE WHEN user_id % 2 = 0 THEN -floor(value) WHEN event_id % 97 = 0 THEN NULL ELSE floor(value) END",
    "SELECT DISTINCT event_type, 1000 AS qty_on_hand, 0 AS qty_reserved FROM events WHERE event_type <> 'view'") + """
SELECT request_id, event_type, qty, CAST(result AS INTEGER) AS result FROM walk"""

SQL["reserve_requests"] = RESERVE_WALK + """
SELECT request_id, user_id, qty, CAST(result AS INTEGER) AS result FROM walk"""

SQL["reserve_inventory"] = RESERVE_WALK + """
SELECT i.user_id, i.qty_on_hand,
       CAST(i.qty_reserved + COALESCE(t.taken, 0) AS INTEGER) AS qty_reserved
FROM inv i LEFT JOIN (SELECT user_id, SUM(qty) AS taken FROM walk WHERE result = 0 GROUP BY user_id) t
  ON t.user_id = i.user_id"""

CHANGES = """
ch AS (
  SELECT event_id AS pos,
         CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
         user_id AS c_custkey, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS c_name,
         CAST(NULL AS INTEGER) AS c_nationkey, value AS c_acctbal, upper(event_type) AS c_mktsegment,
         ts AS committed_at,
         ts + to_seconds(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS captured_at
  FROM events)"""

SQL["apply_changes_customers"] = with_(CHANGES) + """,
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY pos DESC) AS rn FROM ch) x
         WHERE rn = 1),
t AS (SELECT *, CAST(-1 AS BIGINT) AS _pos FROM customer),
m AS (
  SELECT COALESCE(t.c_custkey, l.c_custkey) AS c_custkey,
         (l.c_custkey IS NOT NULL AND (t.c_custkey IS NULL OR l.pos > t._pos)) AS newer,
         l.op, l.pos, t._pos AS tpos,
         t.c_name AS t_name, t.c_nationkey AS t_nation, t.c_acctbal AS t_bal, t.c_mktsegment AS t_seg,
         l.c_name AS l_name, l.c_nationkey AS l_nation, l.c_acctbal AS l_bal, l.c_mktsegment AS l_seg
  FROM t FULL OUTER JOIN last l ON t.c_custkey = l.c_custkey)
SELECT c_custkey,
       CASE WHEN newer THEN l_name ELSE t_name END AS c_name,
       CASE WHEN newer THEN l_nation ELSE t_nation END AS c_nationkey,
       CASE WHEN newer THEN l_bal ELSE t_bal END AS c_acctbal,
       CASE WHEN newer THEN l_seg ELSE t_seg END AS c_mktsegment,
       CASE WHEN newer THEN pos ELSE tpos END AS _pos
FROM m WHERE NOT (newer AND op = 'D')"""

SQL["cdc_latency"] = with_(CHANGES) + """
SELECT pos, op, committed_at, captured_at,
       CAST(CAST(CAST(epoch_us(captured_at) - epoch_us(committed_at) AS DECIMAL(20,0)) / 1000000 AS DECIMAL(18,6))
            AS DOUBLE) AS source_latency_s
FROM ch"""

_PARITY = [("region", "region"), ("nation", "nation"), ("customer", "customer"), ("supplier", "supplier"),
           ("part", "part"), ("orders", "orders"), ("lineitem", "lineitem")]
PARITY = "parity AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {t}) AS source_rows, "
    + (f"(SELECT COUNT(*) FROM {t} WHERE o_orderstatus <> 'P')" if t == "orders" else f"(SELECT COUNT(*) FROM {t})")
    + " AS target_rows, TRUE AS ok" for t, _ in _PARITY) + \
    "\nUNION ALL\nSELECT 'partsupp', NULL, NULL, FALSE)"

SQL["count_parity"] = "WITH " + PARITY + """
SELECT table_name, CAST(source_rows AS BIGINT) AS source_rows, CAST(target_rows AS BIGINT) AS target_rows,
       CAST(CASE WHEN ok THEN target_rows - source_rows END AS BIGINT) AS delta,
       CASE WHEN NOT ok THEN 'ERR' WHEN source_rows = target_rows THEN 'MATCH' ELSE 'MISMATCH' END AS status,
       CASE WHEN NOT ok THEN 'ERR' WHEN source_rows = target_rows THEN 'MATCH'
            ELSE CAST(target_rows - source_rows AS VARCHAR) END AS label,
       table_name AS target_table
FROM parity"""

SQL["cutover_gate"] = "WITH " + PARITY + """
SELECT CAST(SUM(CASE WHEN ok AND source_rows = target_rows THEN 1 ELSE 0 END) AS BIGINT) AS passed,
       CAST(SUM(CASE WHEN ok AND source_rows = target_rows THEN 0 ELSE 1 END) AS BIGINT) AS failed,
       CAST(COUNT(*) AS BIGINT) AS total,
       SUM(CASE WHEN ok AND source_rows = target_rows THEN 0 ELSE 1 END) = 0 AS safe_to_cutover
FROM parity"""

_ALL = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()
SQL["audit_snapshot"] = "\nUNION ALL\n".join(
    f"SELECT 'post_load_snapshot' AS event, '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count, "
    f"TIMESTAMP '2024-06-01 00:00:00' AS recorded_at FROM {t}" for t in _ALL)

SQL["audit_log"] = f"""
SELECT row_number() OVER (ORDER BY event, table_name) AS audit_id, event, table_name, row_count,
       TIMESTAMP '2024-06-01 00:00:00' AS recorded_at
FROM (SELECT 'post_load_snapshot' AS event, 'orders' AS table_name, COUNT(*) AS row_count FROM orders
      UNION ALL SELECT 'post_load_snapshot', 'customer', COUNT(*) FROM customer
      UNION ALL SELECT 'post_load_snapshot', 'region', COUNT(*) FROM region
      UNION ALL SELECT 'view_check', 'order_summary', COUNT(*) FROM ({SQL['order_summary']}) a
      UNION ALL SELECT 'view_check', 'inventory_health', COUNT(*) FROM ({SQL['inventory_health']}) b) x"""

SQL["table_listing"] = "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS place, '{t}' AS table_name, COUNT(*) AS row_count FROM {t}"
    for i, t in enumerate(sorted(_ALL), 1))

SQL["orders_in_status_order"] = with_(ORDERS) + f"""
SELECT status, COUNT(*) AS orders, list_position({ORDER_STATUSES!r}, status)::BIGINT AS ordinal
FROM o2 WHERE deleted_at IS NULL GROUP BY status"""



def _integrity_report_sql() -> str:
    """One counted condition per declared rule, key and reference of the three tables."""
    from pyspark.sql.types import DecimalType

    from .. import schemas
    columns = {
        "orders": "order_id customer_id warehouse_id status currency total_amount tax_amount".split(),
        "customers": "customer_id email first_name last_name tier region_id".split(),
        "regions": "region_id region_name country".split()}
    source, parts = {"orders": "o2", "customers": "c", "regions": "r"}, []

    def row(table: str, rule: str, column: str, count: str) -> None:
        parts.append(f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, "
                     f"CAST({count} AS BIGINT) AS violations FROM {source[table]} x")

    def bad(condition: str) -> str:
        return f"COUNT(CASE WHEN {condition} THEN 1 END)"

    for table, cols in columns.items():
        for f in schemas.SCHEMAS[table].fields:
            if f.name in cols and not f.nullable:
                row(table, "not_null", f.name, bad(f"x.{f.name} IS NULL"))
            if f.name in cols and isinstance(f.dataType, DecimalType):
                row(table, "decimal", f.name, bad(f"abs(x.{f.name}) >= 1e{f.dataType.precision - f.dataType.scale}"))
        for (t, column), values in schemas.ENUMS.items():
            if t == table and column in cols:
                row(table, "domain", column, bad(f"x.{column} NOT IN ({', '.join(map(repr, values))})"))
        for column, (low, high) in schemas.RANGES.get(table, {}).items():
            if column in cols:
                row(table, "range", column, bad(f"x.{column} NOT BETWEEN {low} AND {high}"))
        for column, most in schemas.LENGTHS.get(table, {}).items():
            if column in cols:
                row(table, "length", column, bad(f"length(x.{column}) > {most}"))
        for key in [schemas.PRIMARY_KEYS[table], *schemas.UNIQUE_KEYS.get(table, [])]:
            if set(key) <= set(cols):
                folded = set(key) <= set(schemas.COLLATED_LOOKUPS.get(table, []))
                value = ", ".join(f"lower(strip_accents(rtrim(x.{k}, ' ')))" if folded else f"x.{k}" for k in key)
                row(table, "unique", ",".join(key), f"COUNT(x.{key[0]}) - COUNT(DISTINCT ({value}))")
    for fk in schemas.FOREIGN_KEYS:
        if fk.child in columns and fk.parent in columns and fk.column in columns[fk.child]:
            row(fk.child, "fk", f"{fk.column}->{fk.parent_column}", bad(
                f"x.{fk.column} NOT IN (SELECT {fk.parent_column} FROM {source[fk.parent]})"))
    return with_(ORDERS, CUSTOMERS, REGIONS) + "\nUNION ALL\n".join(parts)


SQL["integrity_report"] = _integrity_report_sql()

HOURLY = """
hourly AS (
  SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS period_start,
         MAX(CAST(value AS DECIMAL(18,2))) AS max_value, CAST(COUNT(*) AS BIGINT) AS samples,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) * 100 AS HUGEINT) AS s, COUNT(*) AS c
  FROM events GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts))"""

SQL["period_stat"] = with_(HOURLY) + """
SELECT event_type, period_start,
       CAST(CAST(CAST((s * 20000 + c) // (2 * c) AS DECIMAL(38,0)) * 0.000001 AS DECIMAL(18,6)) AS DOUBLE) AS avg_value,
       samples, CAST(max_value AS DOUBLE) AS max_value
FROM hourly"""

ALARM = HOURLY + """,
b AS (SELECT event_type, CAST(epoch(period_start) // 3600 AS BIGINT) AS slot, max_value AS v, max_value > 150 AS breach
      FROM hourly),
bounds AS (SELECT event_type, MIN(slot) AS lo, MAX(slot) AS hi FROM b GROUP BY event_type),
spine AS (SELECT event_type, lo, unnest(generate_series(lo, hi)) AS slot FROM bounds),
w AS (SELECT s.event_type, s.slot, s.lo, COUNT(b.slot) AS n, SUM(CASE WHEN b.breach THEN 1 ELSE 0 END) AS nb
      FROM spine s LEFT JOIN b ON b.event_type = s.event_type AND b.slot BETWEEN s.slot - 1 AND s.slot
      GROUP BY s.event_type, s.slot, s.lo),
st AS (SELECT w.event_type, w.slot, make_timestamp(w.slot * 3600 * 1000000) AS period_start,
              CAST(b.v AS DOUBLE) AS value, w.n, COALESCE(w.nb, 0) AS nb, w.lo,
              CASE WHEN w.n < 2 THEN 'INSUFFICIENT' WHEN COALESCE(w.nb, 0) = 2 THEN 'ALARM' ELSE 'OK' END AS state
       FROM w LEFT JOIN b ON b.event_type = w.event_type AND b.slot = w.slot)"""

SQL["alarm_states"] = with_(ALARM) + "SELECT event_type, period_start, value, state FROM st"

SQL["alarm_states_breaching"] = with_(ALARM) + """
SELECT event_type, period_start, value,
       CASE WHEN LEAST(2, slot - lo + 1) < 2 THEN 'INSUFFICIENT'
            WHEN nb + (LEAST(2, slot - lo + 1) - n) = 2 THEN 'ALARM' ELSE 'OK' END AS state
FROM st"""

SQL["alarm_transitions"] = with_(ALARM) + """
SELECT event_type, period_start, previous_state, state FROM (
  SELECT event_type, period_start, state,
         COALESCE(lag(state) OVER (PARTITION BY event_type ORDER BY slot), 'INSUFFICIENT') AS previous_state
  FROM st) x
WHERE (state = 'ALARM' AND previous_state <> 'ALARM') OR (state = 'OK' AND previous_state = 'ALARM')"""

LATE = """
mark AS (SELECT (epoch_ms(MAX(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-16' AND event_id % 5 <> 0)) - 21600000) // 3600000 - 1 AS first,
                (epoch_ms(MAX(ts)) - 21600000) // 3600000 - 1 AS last FROM events),
pt AS (SELECT event_type, CAST(epoch_ms(ts) // 3600000 AS BIGINT) AS slot, CAST(value AS DECIMAL(18,2)) AS v,
              ts < TIMESTAMP '2024-01-16' AND event_id % 5 = 0 AND epoch_ms(ts) // 3600000 <= mark.first AS late
       FROM events, mark WHERE epoch_ms(ts) // 3600000 <= mark.last)"""

SQL["alarm_stream_late"] = with_(LATE) + """
SELECT event_type, make_timestamp(slot * 3600000000) AS period_start, CAST(MAX(v) AS DOUBLE) AS max_value,
       CAST(COUNT(*) AS BIGINT) AS samples, CAST(COUNT(*) FILTER (WHERE late) AS BIGINT) AS late_samples
FROM pt GROUP BY event_type, slot"""

SQL["alarm_stream_states"] = with_(LATE) + """
, on_time AS (SELECT event_type, slot, COUNT(*) AS n, MAX(v) AS top FROM pt WHERE NOT late GROUP BY event_type, slot),
spine AS (SELECT event_type, unnest(generate_series(MIN(slot), MAX(slot))) AS slot FROM on_time GROUP BY event_type),
w AS (SELECT s.event_type, s.slot, COUNT(t.slot) AS got, COUNT(CASE WHEN t.top > 150 THEN 1 END) AS hit
      FROM spine s LEFT JOIN on_time t ON t.event_type = s.event_type AND t.slot BETWEEN s.slot - 1 AND s.slot GROUP BY ALL),
st AS (SELECT event_type, slot, CASE WHEN got < 2 THEN 'INSUFFICIENT' WHEN hit = 2 THEN 'ALARM' ELSE 'OK' END AS state FROM w),
seen AS (SELECT *, COALESCE(lag(state) OVER (PARTITION BY event_type ORDER BY slot), 'INSUFFICIENT') AS previous_state FROM st)
SELECT event_type, make_timestamp(slot * 3600000000) AS period_start, CAST(n AS BIGINT) AS samples, CAST(top AS DOUBLE) AS max_value,
       state, previous_state
FROM seen JOIN on_time USING (event_type, slot)"""

SQL["reserve_keyed_stream"] = SQL["reserve_requests"]

SQL["filter_events"] = "SELECT * FROM events WHERE event_type IN ('error', 'signup')"

SQL["health_rollup"] = """
SELECT event_type, CAST(ts AS DATE) AS day, CAST(COUNT(*) AS BIGINT) AS probes,
       CAST(COUNT(CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 50 THEN 1 END) AS BIGINT) AS healthy,
       COUNT(CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 50 THEN 1 END) >= 2 AS ready
FROM events GROUP BY event_type, CAST(ts AS DATE)"""



def _rule_sql(rule, names: list[str], threshold: dict[str, float]) -> str:
    """Periods per state of one alarm rule over the dealt metric points."""
    n, size = rule.evaluation_periods, rule.period_s
    agg = {"Average": "AVG", "Maximum": "MAX"}[rule.statistic]
    sign = {"GreaterThanThreshold": ">", "LessThanThreshold": "<"}[rule.comparison]
    return f"""
SELECT '{rule.name}' AS alarm_name, state, CAST(COUNT(*) AS BIGINT) AS periods FROM (
  WITH b AS (
    SELECT CAST(datediff('second', TIMESTAMP '2024-01-01', ts) // 60 AS BIGINT) // {size} AS slot,
           {agg}(value * CAST({threshold[rule.metric] / 20.0!r} AS DOUBLE)) {sign} {rule.threshold} AS breach
    FROM events WHERE event_id % {len(names)} = {names.index(rule.metric)} GROUP BY 1),
  spine AS (SELECT unnest(generate_series((SELECT MIN(slot) FROM b), (SELECT MAX(slot) FROM b))) AS slot)
  SELECT CASE WHEN COUNT(b.slot) < {n} THEN 'INSUFFICIENT'
              WHEN COUNT(CASE WHEN b.breach THEN 1 END) = {n} THEN 'ALARM' ELSE 'OK' END AS state
  FROM spine s LEFT JOIN b ON b.slot BETWEEN s.slot - {n - 1} AND s.slot GROUP BY s.slot) x
GROUP BY state"""


def _alarm_rules_sql() -> str:
    from ..operators.monitor import ALARM_RULES
    threshold: dict[str, float] = {}
    for r in ALARM_RULES:
        threshold.setdefault(r.metric, r.threshold)
    return "\nUNION ALL\n".join(_rule_sql(r, list(threshold), threshold) for r in ALARM_RULES)


SQL["alarm_rules"] = _alarm_rules_sql()

PROBES = "(SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) e"

SQL["tunnel_rollup"] = f"""
SELECT user_id, CAST(COUNT(*) AS BIGINT) AS endpoints, CAST(COUNT(CASE WHEN k >= 50 THEN 1 END) AS BIGINT) AS up,
       COUNT(CASE WHEN k >= 50 THEN 1 END) >= 2 AS ready
FROM {PROBES} GROUP BY user_id"""

SQL["peer_rollup"] = f"""
SELECT user_id, CAST(COUNT(*) AS BIGINT) AS peers,
       CAST(COUNT(CASE WHEN k >= 50 AND event_type <> 'error' THEN 1 END) AS BIGINT) AS established,
       CAST(SUM(CASE WHEN k % 5 = 0 THEN 0 ELSE k % 3 + 1 END) AS BIGINT) AS advertised_routes,
       COUNT(CASE WHEN k >= 50 AND event_type <> 'error' THEN 1 END) >= 4 AS ready
FROM {PROBES} GROUP BY user_id"""

SQL["regional_sales_by_currency"] = with_(ORDERS, CUSTOMERS, REGIONS) + f"""
, sale AS (SELECT o2.*, (SELECT region_id FROM c WHERE c.customer_id = o2.customer_id) AS place FROM o2 WHERE {REVENUE})
SELECT r.region_name, r.country, sale.currency, CAST(COUNT(DISTINCT sale.customer_id) AS BIGINT) AS active_customers,
       CAST(COUNT(*) AS BIGINT) AS total_orders, {dbl('SUM(sale.total_amount)')} AS total_revenue,
       {dbl(avg6('sale.total_amount'))} AS avg_order_value
FROM sale INNER JOIN r ON r.region_id = sale.place GROUP BY ALL"""

SQL["customer_ltv_by_currency"] = with_(ORDERS, CUSTOMERS) + f"""
, spent AS (SELECT customer_id AS k, currency, COUNT(*) AS n, SUM(total_amount) AS total, {avg6('total_amount')} AS mean,
                   MIN(ordered_at) AS since, MAX(ordered_at) AS until
            FROM o2 WHERE {REVENUE} GROUP BY customer_id, currency)
SELECT c.customer_id, c.tier, concat_ws(' ', c.first_name, c.last_name) AS customer_name, spent.currency,
       CAST(COALESCE(spent.n, 0) AS BIGINT) AS total_orders, {dbl('spent.mean')} AS avg_order_value,
       {dbl('spent.total')} AS lifetime_value, spent.since AS first_order_date, spent.until AS latest_order_date,
       CAST(CAST(spent.until AS DATE) - CAST(spent.since AS DATE) AS INTEGER) AS days_as_customer
FROM c LEFT JOIN spent ON spent.k = c.customer_id"""

SQL["limit_lob_documents"] = """
WITH long AS (SELECT doc_id, text FROM documents WHERE strlen(text) > 32768),
chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i
          FROM long),
run AS (SELECT doc_id, ch, i, SUM(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM chars),
cut AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS text FROM run WHERE upto <= 32768 GROUP BY doc_id),
res AS (SELECT doc_id, text FROM documents WHERE strlen(text) <= 32768 OR text IS NULL
        UNION ALL SELECT doc_id, text FROM cut)
SELECT doc_id, text, CAST(strlen(text) AS BIGINT) AS n_bytes FROM res"""

SQL["assign_ids_lineitem"] = """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
                                   l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS item_id,
       l_orderkey, l_linenumber, l_partkey
FROM lineitem"""

# text columns of the loaded tables
_LOADED = {
    "benchmark": "text",
    "conversations": "role text",
    "customer": "c_name c_mktsegment",
    "documents": "text lang source",
    "events": "event_type props",
    "lineitem": "l_returnflag l_linestatus",
    "nation": "n_name",
    "orders": "o_orderstatus o_orderpriority",
    "pages": "url html",
    "part": "p_name p_brand p_type",
    "region": "r_name",
    "supplier": "s_name",
}
SQL["full_load_summary"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS source_table, 'mig_{t}' AS target_table, CAST(COUNT(*) AS BIGINT) AS rows, CAST("
    + (" + ".join(f"COALESCE(SUM(strlen({c})), 0)" for c in cols.split()) or "0") + f" AS BIGINT) AS text_bytes FROM {t}"
    for t, cols in _LOADED.items())

SQL["load_parity"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS source_rows, COUNT(*) AS target_rows, CAST(0 AS BIGINT) AS delta, "
    f"'MATCH' AS status, 'MATCH' AS label, 'mig_{t}' AS target_table, FALSE AS blocks_cutover FROM {t}" for t in _LOADED)

SQL["migrate_stream"] = SQL["apply_changes_customers"]
SQL["migrate_tables"] = """
WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op,
                  CAST(floor(value) AS BIGINT) AS amount FROM events WHERE event_id % 101 <> 0),
ch AS (
  SELECT 'stock' AS t, user_id, event_id % 2 AS w, event_id AS pos, 0 AS r, op, NULL AS name, amount
  FROM e WHERE event_id % 3 = 0
  UNION ALL
  SELECT 'customers', user_id + CASE WHEN event_id % 50 = 7 AND op = 'U' THEN 5000 ELSE 0 END, NULL, event_id, 0, op,
         'n' || event_id, amount FROM e WHERE event_id % 3 <> 0
  UNION ALL
  SELECT 'customers', user_id, NULL, event_id, 1, 'D', NULL, NULL
  FROM e WHERE event_id % 3 <> 0 AND event_id % 50 = 7 AND op = 'U'
  UNION ALL
  SELECT 'customers', user_id, NULL, -1, 0, 'I', 'old', 0 FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT 'stock', user_id, 0, -1, 0, 'I', NULL, 100 FROM (SELECT DISTINCT user_id FROM events)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t, user_id, w ORDER BY pos DESC, r DESC) AS k FROM ch)
SELECT t AS table_name, user_id, CAST(w AS BIGINT) AS warehouse_id, name, amount, pos FROM ranked WHERE k = 1 AND op <> 'D'"""

SQL["reserve_stream"] = SQL["reserve_requests"]
SQL["period_stat_stream"] = with_(HOURLY) + """
SELECT event_type, period_start, CAST(max_value AS DOUBLE) AS max_value, samples FROM hourly"""

SQL["check_unique_customer_email"] = with_(CUSTOMERS) + """
SELECT 'customers' AS table_name, 'unique' AS rule, 'email' AS column_name,
       CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS violations, CAST(COUNT(*) AS BIGINT) AS duplicate_keys
FROM (SELECT COUNT(*) AS n FROM c WHERE email IS NOT NULL
      GROUP BY lower(strip_accents(rtrim(email, ' '))) HAVING COUNT(*) > 1) d"""

SQL["region_hierarchy"] = """
WITH RECURSIVE nodes AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name FROM region
  UNION ALL
  SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), n_name FROM nation),
walk(id, parent_id, root, depth, path) AS (
  SELECT n.id, n.parent_id, n.id, 0, n.name FROM nodes n
  WHERE n.parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM nodes p WHERE p.id = n.parent_id)
  UNION ALL
  SELECT c.id, c.parent_id, w.root, w.depth + 1, w.path || '/' || c.name FROM nodes c JOIN walk w ON c.parent_id = w.id)
SELECT id, parent_id, root, CAST(depth AS INTEGER) AS depth, path, FALSE AS cyclic FROM walk"""

SQL["event_chains"] = """
WITH o AS (SELECT *, row_number() OVER w - 1 AS depth, first_value(event_id) OVER w AS root,
                  string_agg(event_type, '>') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS path
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN root END AS root, CAST(CASE WHEN user_id % 10 <> 0 THEN depth END AS INTEGER) AS depth,
       CASE WHEN user_id % 10 <> 0 THEN md5(path) END AS path_md5, user_id % 10 = 0 AS cyclic FROM o"""

LATENCIES = CHANGES + """,
lat AS (SELECT *, TIMESTAMP '2024-01-31' + to_minutes(pos % 3) AS applied_at FROM ch)"""


def _seconds(later: str) -> str:
    return f"CAST(CAST(epoch_us({later}) - epoch_us(committed_at) AS DECIMAL(20,0)) / 1000000 AS DOUBLE)"


SQL["target_latency"] = with_(LATENCIES) + f"""
SELECT pos, committed_at, captured_at, applied_at, {_seconds('captured_at')} AS source_latency_s,
       {_seconds('applied_at')} AS target_latency_s FROM lat"""

SQL["latency_alarms"] = with_(LATENCIES) + f""",
points AS (SELECT 'dms-cdc-latency-high' AS alarm_name, epoch_ms(captured_at) // 60000 AS slot, {_seconds('captured_at')} AS v FROM lat
           UNION ALL SELECT 'dms-cdc-target-latency-high', epoch_ms(applied_at) // 60000, {_seconds('applied_at')} FROM lat),
b AS (SELECT alarm_name, slot, MAX(v) > 60 AS breach FROM points GROUP BY alarm_name, slot),
spine AS (SELECT alarm_name, unnest(generate_series(MIN(slot), MAX(slot))) AS slot FROM b GROUP BY alarm_name),
w AS (SELECT s.alarm_name, s.slot, COUNT(b.slot) AS got, COUNT(CASE WHEN b.breach THEN 1 END) AS hit
      FROM spine s LEFT JOIN b ON b.alarm_name = s.alarm_name AND b.slot BETWEEN s.slot - 2 AND s.slot GROUP BY ALL),
st AS (SELECT alarm_name, slot, CASE WHEN got < 3 THEN 'INSUFFICIENT' WHEN hit = 3 THEN 'ALARM' ELSE 'OK' END AS state FROM w),
seen AS (SELECT *, COALESCE(lag(state) OVER (PARTITION BY alarm_name ORDER BY slot), 'INSUFFICIENT') AS previous_state FROM st)
SELECT alarm_name, make_timestamp(CAST(slot * 60000000 AS BIGINT)) AS period_start, previous_state, state FROM seen
WHERE (state = 'ALARM' AND previous_state <> 'ALARM') OR (state = 'OK' AND previous_state = 'ALARM')"""

SQL["distinct_by_sketches"] = with_(ORDERS) + """
, ranges(range_no, first, last) AS (VALUES (0, DATE '1994-01-01', DATE '1994-12-31'), (1, DATE '1995-03-15', DATE '1996-07-02'),
                                           (2, DATE '0001-01-01', DATE '9999-12-31'))
SELECT range_no, currency, COUNT(DISTINCT customer_id) AS customers, TRUE AS within_bound
FROM o2 JOIN ranges ON CAST(ordered_at AS DATE) BETWEEN first AND last GROUP BY range_no, currency"""

SQL["resumed_load"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"


def _off(column: str, rule: str) -> str:
    return f"NOT regexp_matches({column}, '{FORMAT_RULES[rule]}')"


_NAMED = ["source_region", "target_region", "project_id", "database_name", "engine_version", "email"]
SQL["check_formats"] = """
WITH v AS (SELECT 'europe-west' || s_suppkey % 12 AS source_region,
    CASE WHEN s_suppkey % 5 = 0 THEN 'xx' ELSE 'eu' END || '-west-' || s_suppkey % 3 AS target_region,
    CASE WHEN s_suppkey % 6 = 0 THEN 'P' ELSE 'p' END || '-' || s_suppkey || CASE WHEN s_suppkey % 7 = 0 THEN '-' ELSE '' END AS project_id,
    CASE WHEN s_suppkey % 8 = 0 THEN '1' ELSE '' END || 'shop_' || s_suppkey AS database_name,
    '3.' || s_suppkey % 8 || '.' || s_suppkey AS engine_version,
    CASE WHEN s_suppkey % 10 = 0 THEN 'a.b mail.example' ELSE 'a.b@mail.example' END AS email,
    list_transform(generate_series(1, s_suppkey % 4 + 1), lambda i: 'us-east-' || i || CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'a' END) AS zones,
    list_transform(generate_series(0, s_suppkey % 4), lambda i: '10.0.' || s_suppkey * 7 % 300 || '.0/' || (i + 22 + s_suppkey % 12)) AS blocks
  FROM supplier)
""" + "\nUNION ALL ".join(
    [f"SELECT 'suppliers' AS table_name, 'format' AS rule, '{c}' AS column_name, COUNT(*) FILTER (WHERE {_off(c, c)}) AS violations FROM v"
     for c in _NAMED]
    + [f"SELECT 'suppliers', 'format', '{c}', COUNT(*) FILTER (WHERE len(list_filter({c}, lambda x: {_off('x', rule)})) > 0) FROM v"
       for c, rule in (("zones", "zone"), ("blocks", "cidr"))]
    + [f"SELECT 'suppliers', 'min_size', '{c}', COUNT(*) FILTER (WHERE len({c}) < {n}) FROM v" for c, n in (("zones", MIN_ZONES), ("blocks", 1))])

SQL["endpoint_hosts"] = """
SELECT 'db-' || user_id % 50 AS host, COUNT(*) AS events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds
FROM events GROUP BY user_id % 50"""

SQL["status_documents"] = """
WITH e AS (SELECT *, event_id // 12 AS doc, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
d AS (SELECT doc, COUNT(*) AS n, COUNT(*) FILTER (WHERE k >= 50 AND event_id % 10 <> 0) AS up,
             COUNT(*) FILTER (WHERE k >= 50 AND event_type <> 'error') AS established,
             COALESCE(SUM(k % 3 + 1) FILTER (WHERE k % 5 <> 0), 0) AS routes FROM e GROUP BY doc),
x AS (SELECT doc, CASE WHEN doc % 17 = 5 THEN 0 ELSE n END AS endpoints, CASE WHEN doc % 17 = 5 THEN 0 ELSE up END AS up,
             CASE WHEN doc % 17 IN (5, 6) THEN 0 ELSE n END AS peers, CASE WHEN doc % 17 IN (5, 6) THEN 0 ELSE established END AS established,
             CASE WHEN doc % 17 IN (5, 6) THEN 0 ELSE routes END AS advertised_routes FROM d)
SELECT doc, endpoints::INTEGER AS endpoints, up::INTEGER AS up, up >= 2 AS tunnels_ready, peers::INTEGER AS peers,
       established::INTEGER AS established, advertised_routes::BIGINT AS advertised_routes, established >= 4 AS peers_ready FROM x"""

SQL["alarm_states_written"] = SQL["alarm_states"]
SQL["customer_ltv_one"] = f"SELECT * FROM ({SQL['customer_ltv']}) WHERE customer_id = 7"
SQL["order_history_one"] = with_(ORDERS) + f"""
SELECT order_id, customer_id, ordered_at, {dbl('total_amount')} AS total_amount,
       CAST(row_number() OVER (ORDER BY ordered_at DESC, order_id DESC) AS INTEGER) AS recency_rank
FROM o WHERE customer_id = 7 ORDER BY recency_rank LIMIT 5"""
SQL["reorder_check_one"] = f"SELECT * FROM ({SQL['reorder_check']}) WHERE warehouse_id = 7"
SQL["browse_category_one"] = f"SELECT * FROM ({SQL['browse_category']}) WHERE category_id = 21"

"""Named queries over the driver tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs a package operator over the
shop tables derived from ``sf_dir``; ``ORACLE[name]`` is the same result in
SQL over the raw driver views.  Every query reads whole tables.  Column names
and types are aligned on both sides (money as decimals of fixed precision,
counts as bigint).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.fixed import DELIVERY_FEE, FREE_DELIVERY_FROM
from shelfwise.plans.oracle import AS_OF, AS_OF_SQL, with_ctes
from shelfwise.session import require_checkpoint_dir
from shelfwise.sources.adapters import shop_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_ctes(oracle)
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str):
    return shop_tables(spark, sf_dir)


SALE = "status IN ('confirmed', 'shipped', 'delivered')"

# ======================================================================= reports
from shelfwise.operators import reports as R  # noqa: E402


@register("sales_report_monthly", f"""
SELECT CAST(date_trunc('month', created_at) AS DATE) AS date, COUNT(*) AS orders,
       CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(20,2)) AS revenue
FROM s_orders
WHERE {SALE} AND created_at >= {AS_OF_SQL} - INTERVAL 12 MONTH
GROUP BY 1""")
def _sales_report_monthly(spark, d):
    return R.sales_report(T(spark, d).orders, "monthly", AS_OF)


@register("sales_report_daily", f"""
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS orders,
       CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(20,2)) AS revenue
FROM s_orders
WHERE {SALE} AND created_at >= {AS_OF_SQL} - INTERVAL 7 DAY
GROUP BY 1""")
def _sales_report_daily(spark, d):
    return R.sales_report(T(spark, d).orders, "daily", AS_OF)


@register("sales_report_proc_monthly", f"""
SELECT CAST(date_trunc('month', created_at) AS DATE) AS date, COUNT(*) AS total_orders,
       CAST(SUM(total_amount) AS DECIMAL(20,2)) AS revenue
FROM s_orders
WHERE {SALE} AND created_at >= {AS_OF_SQL} - INTERVAL 12 MONTH
GROUP BY 1""")
def _sales_report_proc_monthly(spark, d):
    return R.sales_report_proc(T(spark, d).orders, "monthly", AS_OF)


@register("sales_report_proc_daily", f"""
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS total_orders,
       CAST(SUM(total_amount) AS DECIMAL(20,2)) AS revenue
FROM s_orders
WHERE {SALE} AND created_at >= {AS_OF_SQL} - INTERVAL 7 DAY
GROUP BY 1""")
def _sales_report_proc_daily(spark, d):
    return R.sales_report_proc(T(spark, d).orders, "daily", AS_OF)


@register("sales_report_all_time_monthly", f"""
SELECT CAST(date_trunc('month', created_at) AS DATE) AS date, COUNT(*) AS orders,
       CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(20,2)) AS revenue
FROM s_orders
WHERE {SALE} AND created_at >= {AS_OF_SQL} - INTERVAL 120 MONTH
GROUP BY 1""")
def _sales_report_all_time(spark, d):
    # The monthly report over a ten-year window: every sale order in the data.
    return R.sales_report(T(spark, d).orders, "monthly", AS_OF, months=120)


@register("report_totals_monthly", f"""
WITH rep AS (
  SELECT CAST(date_trunc('month', created_at) AS DATE) AS date, COUNT(*) AS orders,
         CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(20,2)) AS revenue
  FROM s_orders
  WHERE {SALE} AND created_at >= {AS_OF_SQL} - INTERVAL 12 MONTH
  GROUP BY 1)
SELECT CAST(COALESCE(SUM(orders), 0) AS BIGINT) AS total_orders,
       CAST(COALESCE(SUM(revenue), 0) AS DECIMAL(20,2)) AS total_revenue,
       CASE WHEN COALESCE(SUM(orders), 0) > 0
            THEN CAST(CAST(COALESCE(SUM(revenue), 0) AS DECIMAL(20,2)) AS DOUBLE)
                 / CAST(COALESCE(SUM(orders), 0) AS BIGINT)
            ELSE CAST(0 AS DOUBLE) END AS avg_order_value
FROM rep""")
def _report_totals_monthly(spark, d):
    return R.report_totals(R.sales_report(T(spark, d).orders, "monthly", AS_OF))


@register("user_count", "SELECT COUNT(*) AS count FROM s_users")
def _user_count(spark, d):
    return R.user_count(T(spark, d).users)


@register("product_count", "SELECT COUNT(*) AS count FROM s_products")
def _product_count(spark, d):
    return R.product_count(T(spark, d).products)


@register("order_kpis", f"""
SELECT COUNT(*) AS count, CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(20,2)) AS total_sales
FROM s_orders WHERE {SALE}""")
def _order_kpis(spark, d):
    return R.order_kpis(T(spark, d).orders)


@register("dashboard", f"""
SELECT (SELECT COUNT(*) FROM s_users) AS total_users,
       (SELECT COUNT(*) FROM s_products) AS total_products,
       (SELECT COUNT(*) FROM s_orders WHERE {SALE}) AS sale_orders,
       (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(20,2)) FROM s_orders
         WHERE {SALE}) AS revenue""")
def _dashboard(spark, d):
    t = T(spark, d)
    return R.dashboard(t.users, t.products, t.orders)


_TOP_SELLING = """
SELECT p.id, p.name, p.category, p.color,
       COUNT(oi.order_id) AS sales_count,
       CAST(COALESCE(SUM(oi.quantity), 0) AS BIGINT) AS total_quantity_sold,
       CAST(COALESCE(SUM(oi.quantity * oi.price), 0) AS DECIMAL(31,2)) AS total_revenue
FROM s_products p
LEFT JOIN s_items oi ON p.id = oi.product_id
LEFT JOIN s_orders o ON oi.order_id = o.id AND o.{sale}
{where}
GROUP BY p.id, p.name, p.category, p.color"""


@register("top_selling", _TOP_SELLING.format(sale=SALE, where=""))
def _top_selling(spark, d):
    t = T(spark, d)
    return R.top_selling(t.products, t.order_items, t.orders)


@register("top_selling_sales_only", f"""
SELECT p.id, p.name, p.category, p.color,
       COUNT(oi.order_id) AS sales_count,
       CAST(COALESCE(SUM(oi.quantity), 0) AS BIGINT) AS total_quantity_sold,
       CAST(COALESCE(SUM(oi.quantity * oi.price), 0) AS DECIMAL(31,2)) AS total_revenue
FROM s_products p
LEFT JOIN (SELECT i.* FROM s_items i JOIN s_orders o ON i.order_id = o.id WHERE o.{SALE}) oi
  ON p.id = oi.product_id
GROUP BY p.id, p.name, p.category, p.color""")
def _top_selling_sales_only(spark, d):
    t = T(spark, d)
    return R.top_selling(t.products, t.order_items, t.orders, sales_only=True)


# ======================================================================= customers
from shelfwise.operators import customers as C  # noqa: E402


@register("customers", """
SELECT u.id, u.name, u.email, CAST(NULL AS VARCHAR) AS phone, COUNT(o.id) AS order_count
FROM s_users u LEFT JOIN s_orders o ON u.id = o.user_id
GROUP BY u.id, u.name, u.email""")
def _customers(spark, d):
    t = T(spark, d)
    return C.customers(t.users, t.orders)


_SUMMARY = """
SELECT u.id AS user_id, u.name, u.email, COUNT(o.id) AS total_orders,
       CAST(COALESCE(SUM(o.total_amount), 0) AS DECIMAL(20,2)) AS total_spent,
       MAX(o.created_at) AS last_order_date
FROM s_users u LEFT JOIN (SELECT * FROM s_orders {where}) o ON u.id = o.user_id
GROUP BY u.id, u.name, u.email"""


@register("customer_order_summary", _SUMMARY.format(where=""))
def _customer_order_summary(spark, d):
    t = T(spark, d)
    return C.customer_order_summary(t.users, t.orders)


@register("customer_order_summary_since_2001",
          _SUMMARY.format(where="WHERE created_at >= TIMESTAMP '2001-01-01 00:00:00'"))
def _customer_order_summary_recent(spark, d):
    # Summary over this year's orders: customers without such orders get 0 / NULL.
    t = T(spark, d)
    recent = t.orders.filter(F.col("created_at") >= F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))
    return C.customer_order_summary(t.users, recent)


@register("public_users", "SELECT id, name, email FROM s_users")
def _public_users(spark, d):
    return C.public_users(T(spark, d).users)


# ======================================================================= catalogue
from shelfwise.operators import catalog as K  # noqa: E402
from shelfwise.operators.search_index import TextIndex  # noqa: E402

_CAT_COLS = "id, name, description, price, stock, category, category_id, color, material"


@register("catalog", f"""
SELECT {_CAT_COLS}, COALESCE(i.urls, '') AS image_list, COALESCE(i.n, 0) AS image_total
FROM s_products p LEFT JOIN (
  SELECT product_id, string_agg(image_url, ',' ORDER BY sort_order, id) AS urls,
         COUNT(*) AS n
  FROM s_images GROUP BY product_id) i ON i.product_id = p.id
WHERE p.stock > 0""")
def _catalog(spark, d):
    t = T(spark, d)
    c = K.catalog(t.products, t.product_images)
    return c.select(*_CAT_COLS.split(", "), F.array_join("images", ",").alias("image_list"),
                    F.size("images").cast("long").alias("image_total"))


@register("image_urls", """
SELECT product_id, image_url,
       CAST(row_number() OVER (PARTITION BY product_id ORDER BY sort_order, id) - 1 AS INTEGER) AS position
FROM s_images""")
def _image_urls(spark, d):
    return K.image_urls(T(spark, d).product_images)


@register("image_counts", """
SELECT p.id, CAST(COALESCE(n, 0) AS INTEGER) AS image_count
FROM s_products p LEFT JOIN (SELECT product_id, COUNT(*) AS n FROM s_images GROUP BY 1) i
  ON i.product_id = p.id""")
def _image_counts(spark, d):
    t = T(spark, d)
    return K.image_counts(t.products, t.product_images).select("id", "image_count")


@register("first_image", """
SELECT product_id, id AS image_id, image_url FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY sort_order, id) AS rn
  FROM s_images) WHERE rn = 1""")
def _first_image(spark, d):
    return K.first_image(T(spark, d).product_images)


@register("number_images", """
SELECT id, product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY id) - 1 AS INTEGER)
         AS position,
       row_number() OVER (PARTITION BY product_id ORDER BY id) = 1 AS is_primary
FROM pages_as_images""".replace("pages_as_images",
                                "(SELECT page_id AS id, page_id % 100 AS product_id FROM pages) x"))
def _number_images(spark, d):
    # Number each product's images from 0 in upload (id) order; first is primary.
    pg = T(spark, d).source("pages").select(F.col("page_id").alias("id"),
                                            (F.col("page_id") % 100).alias("product_id"))
    return K.number_images(pg, order=("id",)).select("id", "product_id", "position", "is_primary")


@register("search_red", """
SELECT id, name, price FROM s_products
WHERE contains(lower(name), 'red') OR COALESCE(contains(lower(description), 'red'), false)""")
def _search_red(spark, d):
    return K.search(T(spark, d).products, "RED").select("id", "name", "price")


_TERMS = ("red", "E", "ST", "economy", "d widge")


@register("search_by_index", "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS term, id, name FROM s_products
WHERE contains(lower(name), '{t.lower()}') OR COALESCE(contains(lower(description), '{t.lower()}'), false)""" for t in _TERMS))
def _search_by_index(spark, d):
    # An index of the whole catalogue, and terms of one character and more looked up in it.
    products = T(spark, d).products
    index = TextIndex(spark, f"{require_checkpoint_dir(spark)}/grams-{uuid.uuid4().hex}", parts=16)
    index.build(products)
    found = [index.search(products, t).select(F.lit(t).alias("term"), "id", "name") for t in _TERMS]
    return reduce(DataFrame.unionByName, found)


@register("search_economy_in_description", """
SELECT id, name, price FROM s_products
WHERE contains(lower(name), 'economy') OR COALESCE(contains(lower(description), 'economy'), false)""")
def _search_economy(spark, d):
    return K.search(T(spark, d).products, "Economy").select("id", "name", "price")


@register("search_empty", "SELECT id, name, price FROM s_products")
def _search_empty(spark, d):
    return K.search(T(spark, d).products, "").select("id", "name", "price")


@register("by_category", "SELECT id, name, category FROM s_products WHERE category = 'PROMO'")
def _by_category(spark, d):
    return K.by_category(T(spark, d).products, "PROMO").select("id", "name", "category")


@register("filter_catalog_page", """
SELECT id, name, price, category FROM s_products
WHERE stock > 0 AND category = 'SMALL'
  AND (contains(lower(name), 'widget') OR COALESCE(contains(lower(description), 'widget'), false))""")
def _filter_catalog_page(spark, d):
    # The page's flow: in-stock catalogue -> search -> category -> sort by price.
    t = T(spark, d)
    in_stock = t.products.filter(F.col("stock") > 0)
    return K.filter_catalog(in_stock, "widget", "SMALL", "price-low").select(
        "id", "name", "price", "category")


@register("head_products", "SELECT id, name, category, category_id, color, price, stock "
                           "FROM s_products ORDER BY id LIMIT 5")
def _head_products(spark, d):
    return K.head(T(spark, d).products, 5).select("id", "name", "category", "category_id",
                                                  "color", "price", "stock")


@register("product_images_of_search", """
SELECT i.product_id, i.id, i.image_url, i.sort_order FROM s_images i
WHERE i.product_id IN (SELECT id FROM s_products
                       WHERE contains(lower(name), 'red')
                          OR COALESCE(contains(lower(description), 'red'), false))""")
def _product_images_of_search(spark, d):
    t = T(spark, d)
    return K.product_images(t.product_images, K.search(t.products, "red")).select(
        "product_id", "id", "image_url", "sort_order")


@register("active_categories", "SELECT id, name FROM s_categories WHERE status = 'active'")
def _active_categories(spark, d):
    return K.active_categories(T(spark, d).categories)


@register("category_list", "SELECT id, name, CAST(NULL AS VARCHAR) AS description FROM s_categories")
def _category_list(spark, d):
    return K.category_list(T(spark, d).categories)


@register("resolve_category", """
SELECT p.id, COALESCE(c.name, p.category) AS category FROM s_products p
LEFT JOIN s_categories c ON c.id = p.category_id""")
def _resolve_category(spark, d):
    t = T(spark, d)
    return K.resolve_category(t.products, t.categories).select("id", "category")


# ======================================================================= orders
from shelfwise.operators import orders as O  # noqa: E402


@register("lookup_users_with_events", """
SELECT id, name, email FROM s_users WHERE id IN (SELECT user_id FROM events)""")
def _lookup(spark, d):
    t = T(spark, d)
    keys = t.events.select(F.col("user_id").alias("id"))
    return O.lookup(t.users, keys, "id").select("id", "name", "email")


@register("by_status_delivered", "SELECT id, user_id, status FROM s_orders WHERE lower(status) = 'delivered'")
def _by_status(spark, d):
    return O.by_status(T(spark, d).orders, "Delivered").select("id", "user_id", "status")


@register("orders_of_inactive_users", """
SELECT id, user_id, total_amount, status, created_at FROM s_orders
WHERE user_id IN (SELECT id FROM s_users WHERE status = 'inactive')""")
def _orders_of(spark, d):
    t = T(spark, d)
    return O.orders_of(t.orders, t.users.filter(F.col("status") == "inactive")).select(
        "id", "user_id", "total_amount", "status", "created_at")


@register("pending_orders", "SELECT id, user_id, total_amount FROM s_orders WHERE status = 'pending'")
def _pending(spark, d):
    return O.pending(T(spark, d).orders).select("id", "user_id", "total_amount")


@register("recent_orders", """
SELECT id, user_id, total_amount, status, created_at FROM s_orders
ORDER BY created_at DESC, id DESC LIMIT 5""")
def _recent_orders(spark, d):
    return O.recent_orders(T(spark, d).orders, 5).select(
        "id", "user_id", "total_amount", "status", "created_at")


@register("admin_orders", """
SELECT o.id, o.user_id, u.name AS customer_name, CAST(NULL AS VARCHAR) AS customer_phone,
       o.total_amount, o.status, o.delivery_address, o.created_at
FROM s_orders o JOIN s_users u ON o.user_id = u.id""")
def _admin_orders(spark, d):
    t = T(spark, d)
    return O.admin_orders(t.orders, t.users)


@register("order_lines", """
SELECT oi.order_id, oi.product_id, p.name AS product_name, oi.quantity, p.price
FROM s_items oi JOIN s_products p ON oi.product_id = p.id""")
def _order_lines(spark, d):
    t = T(spark, d)
    return O.order_lines(t.order_items, t.products)


@register("orders_without_items", """
SELECT id, user_id, status FROM s_orders o
WHERE NOT EXISTS (SELECT 1 FROM s_items i WHERE i.order_id = o.id)""")
def _orders_without_items(spark, d):
    t = T(spark, d)
    _, missing = O.existing(t.orders.withColumnRenamed("id", "order_id"),
                            t.order_items.select(F.col("order_id").alias("id")), "order_id")
    return missing.select(F.col("order_id").alias("id"), "user_id", "status")


@register("items_with_known_product", """
SELECT order_id, product_id, quantity FROM s_items i
WHERE EXISTS (SELECT 1 FROM s_products p WHERE p.id = i.product_id)""")
def _items_known(spark, d):
    t = T(spark, d)
    ok, _ = O.existing(t.order_items, t.products, "product_id")
    return ok.select("order_id", "product_id", "quantity")


@register("numbered_order_lines", """
SELECT i.order_id, i.product_id, p.name AS product_name, i.quantity, p.price,
       CAST(row_number() OVER (PARTITION BY i.order_id ORDER BY i.product_id, i.quantity) - 1 AS INTEGER) AS position
FROM s_items i JOIN s_products p ON p.id = i.product_id""")
def _numbered_order_lines(spark, d):
    t = T(spark, d)
    return O.numbered_lines(t.order_items, t.products)


@register("orders_with_items_of_users", """
SELECT o.id, o.user_id, o.status, COUNT(l.order_id) AS n_lines,
       COALESCE(string_agg(l.name || ' x' || CAST(l.quantity AS VARCHAR), '; ' ORDER BY l.product_id, l.quantity), '') AS line_list
FROM s_orders o JOIN s_users u ON u.id = o.user_id AND u.status = 'inactive'
LEFT JOIN (SELECT i.*, p.name FROM s_items i JOIN s_products p ON p.id = i.product_id) l ON l.order_id = o.id
GROUP BY ALL""")
def _orders_with_items_of_users(spark, d):
    # The order history, with items, of every inactive customer.
    t = T(spark, d)
    owners = t.users.filter(F.col("status") == "inactive").select("id")
    nested = O.orders_with_items_of(t.orders, t.order_items, t.products, owners)
    return nested.select("id", "user_id", "status", F.size("items").cast("long").alias("n_lines"), F.array_join(
        F.transform("items", lambda x: F.concat(x["product_name"], F.lit(" x"), x["quantity"].cast("string"))), "; ")
        .alias("line_list"))


@register("order_text", """
WITH l AS (SELECT i.order_id, i.product_id, i.quantity, p.name, p.price FROM s_items i JOIN s_products p ON p.id = i.product_id),
t AS (SELECT order_id, CAST(SUM(quantity * price) AS DECIMAL(20,2)) AS subtotal,
             string_agg(name || ' (Qty: ' || CAST(quantity AS VARCHAR) || ') - Rs. ' ||
                        CAST(CAST(price * quantity AS DECIMAL(18,2)) AS VARCHAR), chr(10) ORDER BY product_id, quantity) AS order_text
      FROM l GROUP BY 1)
SELECT order_id, order_text, subtotal, CAST(CASE WHEN subtotal >= {free} THEN 0 ELSE {fee} END AS DECIMAL(10,2)) AS delivery,
       CAST(subtotal + CASE WHEN subtotal >= {free} THEN 0 ELSE {fee} END AS DECIMAL(20,2)) AS total
FROM t""".format(free=FREE_DELIVERY_FROM, fee=DELIVERY_FEE))
def _order_text(spark, d):
    # The text of every order: its lines in line order, and its money.
    t = T(spark, d)
    return O.order_text(O.order_lines(t.order_items, t.products))


@register("orders_with_items", """
SELECT o.id, o.customer_name, o.total_amount, o.status, l.product_id, l.product_name,
       l.quantity, l.price
FROM (SELECT o.*, u.name AS customer_name FROM s_orders o JOIN s_users u ON o.user_id = u.id) o
LEFT JOIN (SELECT oi.order_id, oi.product_id, p.name AS product_name, oi.quantity, p.price
           FROM s_items oi JOIN s_products p ON oi.product_id = p.id) l ON l.order_id = o.id""")
def _orders_with_items(spark, d):
    # Checked in exploded form: every nested line back as a row, orders
    # without lines as one row of NULLs.
    t = T(spark, d)
    nested = O.orders_with_items(t.orders, t.order_items, t.products, t.users)
    return nested.select("id", "customer_name", "total_amount", "status",
                         F.explode_outer("items").alias("l")).select(
        "id", "customer_name", "total_amount", "status", "l.product_id", "l.product_name",
        "l.quantity", "l.price")


@register("line_counts", """
SELECT o.id, COUNT(l.order_id) AS line_count FROM s_orders o
LEFT JOIN (SELECT oi.order_id FROM s_items oi JOIN s_products p ON oi.product_id = p.id) l
  ON l.order_id = o.id GROUP BY o.id""")
def _line_counts(spark, d):
    t = T(spark, d)
    return O.line_counts(t.orders, t.order_items, t.products)


@register("order_totals", """
SELECT o.id AS order_id,
       CAST(COALESCE(s.subtotal, 0) AS DECIMAL(31,2)) AS subtotal,
       CAST(CASE WHEN s.subtotal IS NULL THEN 0 WHEN s.subtotal >= 5000 THEN 0 ELSE 250 END
            AS DECIMAL(10,2)) AS delivery,
       CAST(COALESCE(s.subtotal, 0)
            + CASE WHEN s.subtotal IS NULL THEN 0 WHEN s.subtotal >= 5000 THEN 0 ELSE 250 END
            AS DECIMAL(31,2)) AS total
FROM s_orders o LEFT JOIN (
  SELECT order_id, SUM(quantity * price) AS subtotal FROM s_items GROUP BY 1) s
  ON s.order_id = o.id""")
def _order_totals(spark, d):
    t = T(spark, d)
    return O.order_totals(t.order_items, t.orders)


@register("cart_lines", """
SELECT order_id, product_id, CAST(SUM(quantity) AS BIGINT) AS quantity, COUNT(*) AS merged_lines
FROM s_items GROUP BY 1, 2""")
def _cart_lines(spark, d):
    return O.cart_lines(T(spark, d).order_items)


@register("cart_units", """
SELECT order_id, CAST(SUM(quantity) AS BIGINT) AS total_units FROM s_items GROUP BY 1""")
def _cart_units(spark, d):
    return O.cart_units(T(spark, d).order_items)


@register("order_line_text", """
SELECT oi.order_id, oi.product_id,
       p.name || ' (Qty: ' || CAST(oi.quantity AS VARCHAR) || ') - Rs. '
         || CAST(CAST(oi.quantity * oi.price AS DECIMAL(31,2)) AS VARCHAR) AS line_text
FROM s_items oi JOIN s_products p ON oi.product_id = p.id""")
def _order_line_text(spark, d):
    t = T(spark, d)
    items = t.order_items.join(t.products.select(F.col("id").alias("product_id"),
                                                 F.col("name").alias("product_name")), "product_id")
    return O.order_line_text(items).select("order_id", "product_id", "line_text")


# ======================================================================= inventory
from shelfwise.operators import inventory as V  # noqa: E402


@register("stock_ledger", """
SELECT product_id, order_id, quantity,
       CAST(stock - used + quantity AS INTEGER) AS old_stock,
       CAST(stock - used AS INTEGER) AS new_stock,
       'order_placed' AS action, created_at
FROM (
  SELECT oi.product_id, oi.order_id, oi.quantity, p.stock, o.created_at,
         SUM(oi.quantity) OVER (PARTITION BY oi.product_id
                                ORDER BY o.created_at, oi.order_id, oi.product_id, oi.quantity
                                ROWS UNBOUNDED PRECEDING) AS used
  FROM s_items oi JOIN s_orders o ON o.id = oi.order_id JOIN s_products p ON p.id = oi.product_id)""")
def _stock_ledger(spark, d):
    t = T(spark, d)
    return V.stock_ledger(t.products, t.order_items, t.orders)


@register("price_lines", """
SELECT oi.order_id, oi.product_id, oi.quantity, p.price
FROM s_items oi JOIN s_products p ON p.id = oi.product_id""")
def _price_lines(spark, d):
    t = T(spark, d)
    return V.price_lines(t.order_items.select("order_id", "product_id", "quantity"), t.products)


def _admission_frame(res: "V.Admission") -> DataFrame:
    acc = res.accepted.select(
        "order_id", F.lit("accepted").alias("decision"), F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("long").alias("product_id"), F.lit(None).cast("long").alias("available"),
        F.lit(None).cast("long").alias("requested"))
    rej = res.rejected.select("order_id", F.lit("rejected").alias("decision"), "reason",
                              "product_id", "available", "requested")
    return acc.unionByName(rej)


_ADMIT = """
WITH RECURSIVE prods AS (
  SELECT id, stock, row_number() OVER (ORDER BY id) AS i FROM ({products}) p),
pl AS (
  SELECT l.order_id, l.product_id, p.i, SUM(l.quantity)::BIGINT AS total, MAX(l.quantity)::BIGINT AS need
  FROM s_items l LEFT JOIN prods p ON p.id = l.product_id GROUP BY 1, 2, 3),
known AS (SELECT o.id AS order_id, o.created_at FROM s_orders o WHERE o.user_id IN (SELECT id FROM s_users)),
ordered AS (
  SELECT row_number() OVER (ORDER BY created_at, order_id) AS k, * FROM (
    SELECT o.created_at, o.order_id, list(product_id ORDER BY product_id) AS p, list(i ORDER BY product_id) AS i,
           list(total ORDER BY product_id) AS total, list(need ORDER BY product_id) AS need
    FROM known o JOIN pl USING (order_id) GROUP BY 1, 2)),
-- one order a step, with the stock of every product
fold(k, stock, bad, available) AS (
  SELECT 0::BIGINT, (SELECT list(stock::BIGINT ORDER BY i) FROM prods), 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT k, CASE WHEN bad IS NULL THEN list_transform(stock, lambda s, n: s - coalesce(total[list_position(i, n)], 0))
                 ELSE stock END,
         bad, coalesce(stock[i[bad]], 0)
  FROM (SELECT l.*, f.stock, list_filter(range(1, len(l.i) + 1), lambda j:
               l.i[j] IS NULL OR l.need[j] > f.stock[l.i[j]])[1] AS bad
        FROM fold f JOIN ordered l ON l.k = f.k + 1))
SELECT o.order_id, CASE WHEN f.bad IS NULL THEN 'accepted' ELSE 'rejected' END AS decision,
       CASE WHEN f.bad IS NULL THEN NULL WHEN o.i[f.bad] IS NULL THEN 'unknown_product' ELSE 'insufficient_stock' END AS reason,
       o.p[f.bad] AS product_id, CASE WHEN f.bad IS NOT NULL THEN f.available END AS available, o.need[f.bad] AS requested
FROM fold f JOIN ordered o USING (k)
UNION ALL
SELECT order_id, 'accepted', NULL, NULL, NULL, NULL FROM known WHERE order_id NOT IN (SELECT order_id FROM pl)
UNION ALL
SELECT id, 'rejected', 'unknown_user', NULL, NULL, NULL FROM s_orders WHERE user_id NOT IN (SELECT id FROM s_users)"""

_HALF = """SELECT p.id, CAST(COALESCE(trunc(q.n / 2), 0) AS INTEGER) AS stock FROM s_products p
  LEFT JOIN (SELECT product_id, SUM(quantity) AS n FROM s_items GROUP BY 1) q ON q.product_id = p.id"""


def _half_stocked(t) -> DataFrame:
    demand = t.order_items.groupBy(F.col("product_id").alias("id")).agg(
        (F.sum("quantity") / 2).cast("int").alias("stock"))
    return (t.products.drop("stock").join(demand, "id", "left")
            .withColumn("stock", F.coalesce(F.col("stock"), F.lit(0))).select(*t.products.columns))


@register("admit_orders", _ADMIT.format(products="SELECT id, stock FROM s_products"))
def _admit_orders(spark, d):
    # Every order, in placement order, against the catalogue's stock.
    t = T(spark, d)
    return _admission_frame(V.admit_orders(t.products, t.orders, t.order_items, t.users))


@register("admit_orders_half_demand", _ADMIT.format(products=_HALF))
def _admit_orders_half(spark, d):
    # Opening stock = half of each product's total ordered units, so about
    # half the demand can be met and decisions depend on earlier orders.
    t = T(spark, d)
    return _admission_frame(V.admit_orders(_half_stocked(t), t.orders, t.order_items, t.users))


@register("place_orders", f"""
WITH adm AS ({_ADMIT.format(products=_HALF)}),
opening AS ({_HALF}),
ok AS (SELECT l.l_orderkey AS order_id, l.l_partkey AS product_id, CAST(l.l_quantity AS INTEGER) AS quantity, l.l_linenumber AS n,
              o.created_at
       FROM lineitem l JOIN s_orders o ON o.id = l.l_orderkey JOIN adm a ON a.order_id = o.id AND a.decision = 'accepted'),
run AS (SELECT ok.*, p.stock - SUM(quantity) OVER (PARTITION BY product_id ORDER BY ok.created_at, order_id, n, quantity
                                                  ROWS UNBOUNDED PRECEDING) AS left_over
        FROM ok JOIN opening p ON p.id = ok.product_id)
SELECT 'ledger' AS kind, order_id, product_id, quantity, CAST(left_over + quantity AS INTEGER) AS old_stock,
       CAST(left_over AS INTEGER) AS new_stock, CAST(NULL AS DECIMAL(10,2)) AS price FROM run
UNION ALL
SELECT 'item', order_id, product_id, quantity, NULL, NULL, p.price FROM ok JOIN s_products p ON p.id = product_id""")
def _place_orders(spark, d):
    # Every order of the tables sent again as a request, lines in line order,
    # against half of each product's demand: the lines and ledger rows written.
    t = T(spark, d)
    li = t.source("lineitem").select(F.col("l_orderkey").alias("id"), F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity")).alias("line"))
    lines = li.groupBy("id").agg(F.array_sort(F.collect_list("line")).alias("_l")).select("id", F.transform(
        "_l", lambda x: F.struct(x["product_id"].alias("product_id"), x["quantity"].alias("quantity"))).alias("items"))
    requests = t.orders.join(lines, "id").select(F.col("id").alias("order_ref"), "user_id", "items", "total_amount",
                                                 F.lit("pending").alias("status"), "created_at")
    done = V.place_orders(_half_stocked(t), t.users, requests)
    none = lambda kind: F.lit(None).cast(kind)
    return done.ledger.select(F.lit("ledger").alias("kind"), "order_id", "product_id", "quantity", "old_stock", "new_stock",
                              none("decimal(10,2)").alias("price")).unionByName(
        done.items.select(F.lit("item").alias("kind"), "order_id", "product_id", "quantity", none("int").alias("old_stock"),
                          none("int").alias("new_stock"), "price"))


# ======================================================================= quality
from shelfwise.operators import quality as Q  # noqa: E402

_V = 'SELECT {t} AS "table", {r} AS rule, CAST({k} AS VARCHAR) AS key, CAST({d} AS VARCHAR) AS detail'


_SHIPPED = """(SELECT o.*, f.first_shipped FROM s_orders o LEFT JOIN (
  SELECT order_id, MIN(created_at) AS first_shipped FROM s_items GROUP BY 1) f ON f.order_id = o.id) x"""


@register("dq_not_null_orders", " UNION ALL ".join(
    _V.format(t="'orders'", r="'not_null'", k="id", d=f"'{c}'") + f" FROM {_SHIPPED} WHERE {c} IS NULL"
    for c in ("id", "user_id", "total_amount", "delivery_address", "first_shipped")))
def _dq_not_null(spark, d):
    # Orders with the time of their first line, which orders without lines lack.
    t = T(spark, d)
    first = t.order_items.groupBy(F.col("order_id").alias("id")).agg(F.min("created_at").alias("first_shipped"))
    return Q.null_violations(t.orders.join(first, "id", "left"),
                             ["id", "user_id", "total_amount", "delivery_address", "first_shipped"], "orders")


@register("dq_duplicate_order_product", """
SELECT 'order_items' AS "table", 'unique:order_id,product_id' AS rule,
       CAST(order_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR) AS key,
       'rows=' || CAST(COUNT(*) AS VARCHAR) AS detail
FROM s_items GROUP BY order_id, product_id HAVING COUNT(*) > 1""")
def _dq_duplicates(spark, d):
    return Q.duplicate_keys(T(spark, d).order_items, ["order_id", "product_id"], "order_items")


@register("dq_duplicate_emails", """
SELECT 'users' AS "table", 'unique:email' AS rule, lower(email) AS key,
       'rows=' || CAST(COUNT(*) AS VARCHAR) AS detail
FROM (SELECT email FROM s_users UNION ALL SELECT upper(email) FROM s_users WHERE status = 'inactive')
GROUP BY lower(email) HAVING COUNT(*) > 1""")
def _dq_dup_emails(spark, d):
    # Every user, and the inactive ones once more as they registered in capitals.
    u = T(spark, d).users
    again = u.filter(F.col("status") == "inactive").withColumn("email", F.upper("email"))
    return Q.duplicate_keys(u.unionByName(again), ["email"], "users", fold_case=True)


@register("dq_orphan_orders_of_active_users", """
SELECT 'orders' AS "table", 'fk:user_id->users.id' AS rule, CAST(id AS VARCHAR) AS key,
       CAST(user_id AS VARCHAR) AS detail
FROM s_orders WHERE user_id NOT IN (SELECT id FROM s_users WHERE status = 'active')""")
def _dq_orphans(spark, d):
    # Orders whose owner is not among the active users (as if inactive users
    # had been removed): the orphan check finds exactly their orders.
    t = T(spark, d)
    return Q.orphans(t.orders, "user_id", t.users.filter(F.col("status") == "active"), "id",
                     "orders", "users")


@register("dq_orphan_items", """
SELECT 'order_items' AS "table", 'fk:order_id->orders.id' AS rule,
       CAST(order_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR) AS key,
       CAST(order_id AS VARCHAR) AS detail
FROM s_items WHERE order_id NOT IN (SELECT id FROM s_orders WHERE status <> 'cancelled')""")
def _dq_orphan_items(spark, d):
    t = T(spark, d)
    # cancelled orders are archived: their lines refer to nothing
    return Q.orphans(t.order_items, "order_id", t.orders.filter(F.col("status") != "cancelled"), "id", "order_items", "orders",
                     key=["order_id", "product_id"])


@register("dq_order_status_domain", """
SELECT 'orders' AS "table", 'domain:status' AS rule, CAST(id AS VARCHAR) AS key, status AS detail
FROM (SELECT id, CASE WHEN status = 'confirmed' THEN 'Accepted' ELSE status END AS status FROM s_orders)
WHERE status NOT IN ('pending', 'confirmed', 'shipped', 'delivered', 'cancelled')""")
def _dq_domain(spark, d):
    # Another system's word for one of the states.
    o = T(spark, d).orders.withColumn("status", F.when(F.col("status") == "confirmed", "Accepted").otherwise(F.col("status")))
    return Q.out_of_domain(o, "status", "orders")


@register("dq_category_domain_strict", """
SELECT 'products' AS "table", 'domain:category' AS rule, CAST(id AS VARCHAR) AS key,
       category AS detail
FROM s_products WHERE category NOT IN ('ECONOMY', 'STANDARD', 'SMALL')""")
def _dq_category_domain(spark, d):
    # A domain rule that real rows break: categories outside a short list.
    return Q.out_of_domain(T(spark, d).products, "category", "products",
                           values=("ECONOMY", "STANDARD", "SMALL"))


@register("dq_product_rules", """
WITH broken AS (
  SELECT id, CASE WHEN id % 7 = 0 THEN '  ' ELSE name END AS name,
         CASE WHEN id % 5 = 0 THEN NULL ELSE description END AS description,
         CASE WHEN id % 11 = 0 THEN '' ELSE category END AS category,
         CASE WHEN id % 13 = 0 THEN 0 ELSE price END AS price, stock - 3 AS stock FROM s_products)
SELECT 'products' AS "table", rule, CAST(id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail
FROM (
  SELECT id, 'name_missing' AS rule FROM broken WHERE name IS NULL OR trim(name) = ''
  UNION ALL SELECT id, 'description_missing' FROM broken
    WHERE description IS NULL OR trim(description) = ''
  UNION ALL SELECT id, 'category_missing' FROM broken WHERE category IS NULL OR trim(category) = ''
  UNION ALL SELECT id, 'price_missing_or_zero' FROM broken WHERE price IS NULL OR price = 0
  UNION ALL SELECT id, 'stock_negative' FROM broken WHERE stock < 0)""")
def _dq_product_rules(spark, d):
    # The catalogue after a bad import: rows that break each rule, and rows that keep it.
    p = T(spark, d).products
    every = lambda n: F.col("id") % n == 0
    return Q.product_violations(
        p.withColumn("name", F.when(every(7), "  ").otherwise(F.col("name")))
        .withColumn("description", F.when(~every(5), F.col("description")))
        .withColumn("category", F.when(every(11), "").otherwise(F.col("category")))
        .withColumn("price", F.when(every(13), F.lit(0)).otherwise(F.col("price")).cast(p.schema["price"].dataType))
        .withColumn("stock", F.col("stock") - 3))


@register("dq_zero_stock_as_negative", """
SELECT 'products' AS "table", 'stock_negative' AS rule, CAST(id AS VARCHAR) AS key,
       CAST(NULL AS VARCHAR) AS detail
FROM s_products WHERE stock - 1 < 0""")
def _dq_zero_stock(spark, d):
    # The product rules after selling one unit of everything: the products
    # that had stock 0 go negative and are flagged.
    p = T(spark, d).products.withColumn("stock", F.col("stock") - 1)
    return Q.product_violations(p)


@register("dq_line_quantity", """
SELECT 'order_items' AS "table", 'quantity_not_positive' AS rule,
       CAST(order_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR) AS key,
       CAST(quantity AS VARCHAR) AS detail
FROM (SELECT order_id, product_id, quantity - 5 AS quantity FROM s_items) WHERE quantity <= 0""")
def _dq_lines(spark, d):
    # Lines after five units of each were returned.
    return Q.line_violations(T(spark, d).order_items.withColumn("quantity", F.col("quantity") - 5))


@register("dq_bad_emails_in_urls", r"""
SELECT 'pages' AS "table", 'email_shape' AS rule, CAST(page_id AS VARCHAR) AS key, url AS detail
FROM pages WHERE url IS NULL OR NOT regexp_matches(url, '^[^\s@]+@[^\s@]+\.[^\s@]+$')""")
def _dq_emails(spark, d):
    # The e-mail shape rule over a text column that holds no e-mail addresses.
    pg = T(spark, d).source("pages").select("page_id", "url")
    return Q.bad_emails(pg, "pages", col="url", key="page_id")


@register("dq_bad_user_emails", r"""
SELECT 'users' AS "table", 'email_shape' AS rule, CAST(id AS VARCHAR) AS key, email AS detail
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN replace(email, '@', ' at ') ELSE email END AS email FROM s_users)
WHERE email IS NULL OR NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$')""")
def _dq_user_emails(spark, d):
    u = T(spark, d).users
    return Q.bad_emails(u.withColumn("email", F.when(F.col("id") % 3 == 0, F.replace("email", F.lit("@"), F.lit(" at ")))
                                     .otherwise(F.col("email"))), "users")


@register("dq_image_url_width", """
SELECT 'products' AS "table", 'width:image_url>500' AS rule, CAST(id AS VARCHAR) AS key,
       CAST(NULL AS VARCHAR) AS detail
FROM (SELECT page_id AS id, url AS image_url FROM pages) WHERE length(image_url) > 500
UNION ALL
SELECT 'products', 'width:name>255', CAST(id AS VARCHAR), CAST(NULL AS VARCHAR)
FROM (SELECT page_id AS id, html AS name FROM pages) WHERE length(name) > 255""")
def _dq_widths(spark, d):
    # Page URLs as product image URLs and page bodies as product names:
    # the long bodies break the 255-character name width.
    pg = T(spark, d).source("pages").select(F.col("page_id").alias("id"),
                                            F.col("url").alias("image_url"),
                                            F.col("html").alias("name"))
    return Q.width_violations(pg, "products")


# ======================================================================= maintenance
from shelfwise.operators import maintenance as M  # noqa: E402

_LAST = """
SELECT order_id, status, admin_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, status DESC, admin_id DESC) AS rn
  FROM s_changes) WHERE rn = 1"""


@register("latest_changes", _LAST)
def _latest_changes(spark, d):
    return M.latest_changes(T(spark, d).status_changes, "order_id", "ts", ("status", "admin_id"))


@register("apply_status_changes_orders", f"""
SELECT o.id, COALESCE(c.status, o.status) AS status,
       CASE WHEN c.order_id IS NULL THEN o.created_at ELSE c.ts END AS updated_at
FROM s_orders o LEFT JOIN ({_LAST}) c ON c.order_id = o.id""")
def _apply_status_orders(spark, d):
    from shelfwise.streaming.events import apply_status_changes
    t = T(spark, d)
    updated, _ = apply_status_changes(t.orders, t.status_changes)
    return updated.select("id", "status", "updated_at")


@register("apply_status_changes_log", """
SELECT admin_id, 'Order ' || CAST(order_id AS VARCHAR) || ' status updated' AS action,
       'New status: ' || status AS details, ts AS created_at
FROM s_changes""")
def _apply_status_log(spark, d):
    from shelfwise.streaming.events import apply_status_changes
    t = T(spark, d)
    _, log = apply_status_changes(t.orders, t.status_changes)
    return log.select("admin_id", "action", "details", "created_at")


@register("upsert_users_by_email", """
WITH active AS (SELECT * FROM s_users WHERE status = 'active'),
     feed AS (SELECT lower(email) AS k, upper(name) AS name, email, 1 AS ts FROM s_users
              UNION ALL SELECT lower(email), name || ' II', upper(email), 2 FROM s_users WHERE id % 2 = 0),
     last AS (SELECT k, arg_max(name, ts) AS name, arg_max(email, ts) AS email FROM feed GROUP BY k)
SELECT a.id, COALESCE(l.name, a.name) AS name, a.email, 'active' AS status, TIMESTAMP '2001-08-01 12:00:00' AS updated_at
FROM active a LEFT JOIN last l ON l.k = lower(a.email)
UNION ALL
SELECT (SELECT MAX(id) FROM active) + row_number() OVER (ORDER BY l.email) AS id, l.name, l.email, 'active',
       TIMESTAMP '2001-08-01 12:00:00'
FROM last l WHERE l.k NOT IN (SELECT lower(email) FROM active)""")
def _upsert_users(spark, d):
    # The active users receive the full customer feed, in which every second
    # customer comes a second time, later and in capitals: the later row counts,
    # known e-mails are updated, the rest inserted with new ids and defaults.
    t = T(spark, d)
    active = t.users.filter(F.col("status") == "active")
    feed = t.users.select("email", F.upper("name").alias("name"), F.lit(1).alias("ts")).unionByName(
        t.users.filter(F.col("id") % 2 == 0).select(F.upper("email").alias("email"),
                                                    F.concat("name", F.lit(" II")).alias("name"), F.lit(2).alias("ts")))
    out = M.upsert(active, feed, "email", ["name"], order_by=["email"], fold_case=True, defaults="users", as_of=AS_OF)
    return out.select("id", "name", "email", "status", "updated_at")


@register("delete_cascade_keys", """
WITH gone AS (SELECT id FROM s_users WHERE status = 'inactive')
SELECT 'users' AS "table", id AS key FROM s_users WHERE id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'orders', id FROM s_orders WHERE user_id NOT IN (SELECT id FROM gone)""")
def _delete_cascade_keys(spark, d):
    # The rows that a delete of the inactive users leaves, by key.
    t = T(spark, d)
    out = M.delete_cascade({"users": t.users, "orders": t.orders}, "users",
                           t.users.filter(F.col("status") == "inactive"))
    return out["users"].select(F.lit("users").alias("table"), F.col("id").alias("key")).unionByName(
        out["orders"].select(F.lit("orders").alias("table"), F.col("id").alias("key")))


@register("delete_admins_set_null", """
SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_no,
       CASE WHEN s_acctbal >= 0 THEN l_suppkey END AS admin_id
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def _delete_admins(spark, d):
    # Ledger rows name the admin (supplier) who made them; admins in debt are
    # deleted, and the ledger keeps its rows without the name.
    t = T(spark, d)
    admins = t.source("supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    ledger = t.source("lineitem").join(admins.select(F.col("id").alias("l_suppkey")), "l_suppkey", "left_semi").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").cast("long").alias("line_no"), F.col("l_suppkey").alias("admin_id"))
    keys = [("inventory_logs", "admin_id", "admins", "id", "SET NULL")]
    out = M.delete_cascade({"admins": admins, "inventory_logs": ledger}, "admins",
                           admins.filter(F.col("s_acctbal") < 0), foreign_keys=keys)
    return out["inventory_logs"]


@register("assign_ids_new_products", """
SELECT (SELECT MAX(p_partkey) FROM part) + row_number() OVER (ORDER BY p_type, p_brand) AS id,
       p_type, p_brand
FROM (SELECT DISTINCT p_type, p_brand FROM part)""")
def _assign_ids(spark, d):
    # One new product per (type, brand) pair, keyed after the current maximum.
    t = T(spark, d)
    rows = t.source("part").select("p_type", "p_brand").distinct()
    return M.assign_ids(t.products, rows, ["p_type", "p_brand"])


@register("rekey_categories", """
SELECT p.id, p.category_id + 100 AS category_id FROM s_products p""")
def _rekey(spark, d):
    # Category keys moved up by 100 (ON UPDATE CASCADE to products).
    t = T(spark, d)
    changes = t.categories.select(F.col("id").alias("old_id"), (F.col("id") + 100).alias("new_id"))
    return M.rekey(changes, t.products, "category_id").select("id", "category_id")


@register("delete_inactive_users_cascade", """
SELECT 'users' AS "table", COUNT(*) AS remaining FROM s_users WHERE status <> 'inactive'
UNION ALL
SELECT 'orders', COUNT(*) FROM s_orders
  WHERE user_id NOT IN (SELECT id FROM s_users WHERE status = 'inactive')
UNION ALL
SELECT 'order_items', COUNT(*) FROM s_items
  WHERE order_id IN (SELECT id FROM s_orders
                     WHERE user_id NOT IN (SELECT id FROM s_users WHERE status = 'inactive'))
UNION ALL
SELECT 'products', COUNT(*) FROM s_products""")
def _delete_cascade(spark, d):
    # Delete inactive users: their orders and those orders' lines go too.
    t = T(spark, d)
    tables = {"users": t.users, "orders": t.orders, "order_items": t.order_items,
              "products": t.products}
    out = M.delete_cascade(tables, "users", t.users.filter(F.col("status") == "inactive"))
    parts = [out[n].agg(F.count(F.lit(1)).alias("remaining")).select(
        F.lit(n).alias("table"), "remaining") for n in ("users", "orders", "order_items", "products")]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@register("conform_users", """
SELECT id, name, email, false AS is_verified, CAST(NULL AS VARCHAR) AS reset_token,
       CAST(0 AS INTEGER) AS login_count
FROM s_users""")
def _conform_users(spark, d):
    # Migration: add is_verified / reset_token / login_count if missing, drop phone.
    from shelfwise.sources.tables import conform
    u = T(spark, d).users.select("id", "name", "email", "is_verified")
    out = conform(u, add={"is_verified": ("boolean", False), "reset_token": ("string", None),
                          "login_count": ("int", 0)}, drop=["phone"])
    return conform(out, add={"login_count": ("int", 5)}, drop=["phone"])


@register("versioned_users", """
SELECT id, name, email, CASE id % 3 WHEN 0 THEN false ELSE status = 'active' END AS is_verified,
       CASE id % 3 WHEN 2 THEN CAST(length(name) AS INTEGER) ELSE 0 END AS login_count, status
FROM s_users""")
def _versioned_users(spark, d):
    # Users whose files were written in three versions of the table, a third in each; the
    # last version drops a column and adds another, and both migrations are applied twice.
    from shelfwise.sources.migrations import Migration, VersionedTable
    u = T(spark, d).users
    part = lambda k: u.filter(F.pmod("id", F.lit(3)) == k)     # noqa: E731
    verified, phone = (F.col("status") == "active").alias("is_verified"), F.col("name").alias("phone")
    old = u.select("id", "name", "email", "status", phone)
    table = VersionedTable(spark, f"{require_checkpoint_dir(spark)}/versioned-{uuid.uuid4().hex}")
    table.create(old.schema)
    table.append(part(0).select("id", "name", "email", "status", phone))
    second = Migration(2, add={"is_verified": ("boolean", False)})
    third = Migration(3, add={"login_count": ("int", 0)}, drop=("phone",))
    table.migrate([second])
    table.append(part(1).select("id", "name", "email", "status", phone, verified))
    table.migrate([second, third])
    table.append(part(2).select("id", "name", "email", "status", verified, F.length("name").alias("login_count")))
    return table.read()


@register("typed_read_orders", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders""")
def _typed_read(spark, d):
    from shelfwise.sources.tables import read_table
    return read_table(spark, d, "orders", source=True).select("o_orderkey", "o_custkey", "o_totalprice")


@register("new_users_from_feed", """
WITH feed AS (SELECT id, name, email FROM s_users UNION ALL SELECT id + 1000000, name, email FROM s_users)
SELECT id, name, email FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS rn FROM feed
                             WHERE email NOT IN (SELECT email FROM s_users WHERE status = 'active'))
WHERE rn = 1""")
def _new_users(spark, d):
    # Every customer registers twice: active users' e-mails are taken, and of
    # the others the earlier registration wins.
    from shelfwise.operators.customers import new_users
    u = T(spark, d).users
    once = u.select("id", "name", "email")
    feed = once.unionByName(once.withColumn("id", F.col("id") + 1_000_000))
    return new_users(feed, u.filter(F.col("status") == "active"), order_by=("id",))


@register("page_file_names", """
SELECT page_id, lower(list_extract(string_split(url, '.'), -1)) AS extension,
       sha256(CAST(page_id AS VARCHAR) || '/' || url || '/' || sha256(html)) AS token,
       CASE WHEN html IS NULL OR html = '' THEN 0 ELSE len(string_split(html, ' ')) END AS n_parts
FROM pages""")
def _page_file_names(spark, d):
    # Stored names of the pages (SC-13, SC-20) and their parts (SC-12).
    from shelfwise.functions.expressions import file_extension, name_token, split_list
    pages = T(spark, d).source("pages")
    return pages.select("page_id", file_extension("url").alias("extension"),
                        name_token(F.col("page_id"), F.col("url"), F.sha2("html", 256)).alias("token"),
                        F.size(split_list("html", " ")).cast("long").alias("n_parts"))


@register("dq_page_images", """
WITH p AS (SELECT page_id, split_part(url, '/', 3) AS upload, url, strlen(html) AS length FROM pages),
n AS (SELECT upload FROM p GROUP BY 1 HAVING COUNT(*) > 5)
SELECT 'product_images' AS "table", rule, key, CAST(NULL AS VARCHAR) AS detail FROM (
  SELECT 'extension' AS rule, CAST(page_id AS VARCHAR) AS key FROM p
    WHERE lower(list_extract(string_split(url, '.'), -1)) NOT IN ('jpg', 'jpeg', 'png', 'webp')
  UNION ALL SELECT 'content_type', CAST(page_id AS VARCHAR) FROM p
  UNION ALL SELECT 'too_large', CAST(page_id AS VARCHAR) FROM p WHERE length > 5242880
  UNION ALL SELECT 'too_many_in_upload', CAST(page_id AS VARCHAR) FROM p WHERE upload IN (SELECT upload FROM n))""")
def _dq_page_images(spark, d):
    # DQ-8 over the pages as if they had been uploaded as images, one upload a host.
    pages = T(spark, d).source("pages")
    return Q.image_violations(pages.select(
        F.col("page_id").cast("string").alias("path"), F.split_part("url", F.lit("/"), F.lit(3)).alias("upload"),
        F.col("url").alias("file_name"), F.octet_length("html").cast("long").alias("length"),
        F.col("html").cast("binary").alias("content")))


# ======================================================================= events
from shelfwise.sources.bucketed import join_bucketed, lookup_table, write_bucketed  # noqa: E402
from shelfwise.sources.committed import CommittedTable, ConstraintViolation  # noqa: E402
from shelfwise.sources.keyed import KeyedTable  # noqa: E402
from shelfwise.streaming import events as E  # noqa: E402
from shelfwise.streaming import limits as L  # noqa: E402
from shelfwise.streaming import sales as S  # noqa: E402


@register("over_limit_daily", """
SELECT date_trunc('day', ts) AS window_start, user_id, COUNT(*) AS n
FROM events GROUP BY 1, 2 HAVING COUNT(*) > 5""")
def _over_limit_daily(spark, d):
    return E.over_limit(T(spark, d).events, "user_id", 5, "1 day")


@register("over_limit_per_minute", """
SELECT date_trunc('minute', ts) AS window_start, user_id, COUNT(*) AS n
FROM events GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def _over_limit_minute(spark, d):
    return E.over_limit(T(spark, d).events, "user_id", 1, "1 minute")


_MOVING = """
SELECT ts, {keys}, calls, n FROM (
  SELECT ts, {keys}, calls, CAST(SUM(calls) OVER (PARTITION BY {keys} ORDER BY ts
    RANGE BETWEEN INTERVAL {before} PRECEDING AND CURRENT ROW) AS BIGINT) AS n
  FROM (SELECT {keys}, ts, COUNT(*) AS calls FROM events WHERE ts IS NOT NULL GROUP BY ALL))
WHERE {over}"""


@register("over_moving_limit_daily", _MOVING.format(keys="user_id", before="86399999999 MICROSECONDS", over="n > 5"))
def _over_moving_limit(spark, d):
    return L.over_moving_limit(T(spark, d).events, "user_id", 5, "1 day")


@register("over_moving_route_limits", _MOVING.format(
    keys="user_id, event_type", before="43199999999 MICROSECONDS",
    over="n > CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 1 END"))
def _over_moving_route_limits(spark, d):
    # The event type is the route: a limit for each of three routes, the others unlimited.
    return L.over_moving_limit(T(spark, d).events, "user_id", {"click": 2, "view": 3, "purchase": 1}, "12 hours", route="event_type")


@register("cart_state", """
WITH ev AS (
  SELECT user_id, ts, event_id,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS delta,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS clr
  FROM events),
c AS (SELECT *, SUM(clr) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS UNBOUNDED PRECEDING) AS seg FROM ev),
s AS (SELECT user_id, seg, delta, SUM(delta) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id
                                                   ROWS UNBOUNDED PRECEDING) AS run FROM c),
v AS (SELECT user_id, seg, SUM(delta) - LEAST(MIN(run), 0) AS v FROM s GROUP BY 1, 2)
SELECT user_id, CAST(arg_max(v, seg) AS BIGINT) AS cart_items FROM v GROUP BY 1""")
def _cart_state(spark, d):
    return E.cart_state(T(spark, d).events)


@register("daily_sales", f"""
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS orders,
       CAST(SUM(total_amount) AS DECIMAL(20,2)) AS revenue
FROM s_orders WHERE {SALE} GROUP BY 1""")
def _daily_sales(spark, d):
    return E.daily_sales(T(spark, d).orders)


_STEPS = """WITH steps AS (
  SELECT id AS order_id, created_at, total_amount, status, 0 AS step, created_at AS ts, CAST(NULL AS BIGINT) AS admin_id FROM s_orders
  UNION ALL
  SELECT c.order_id, o.created_at, o.total_amount, c.status, 1, c.ts, c.admin_id FROM s_changes c JOIN s_orders o ON o.id = c.order_id),
turns AS (
  SELECT *, CAST({sale} AS INTEGER) - COALESCE(LAG(CAST({sale} AS INTEGER)) OVER (
    PARTITION BY order_id ORDER BY step, ts, status, admin_id NULLS FIRST), 0) AS turn FROM steps)""".format(sale=f"({SALE})")


@register("sales_changelog", f"""{_STEPS}
SELECT CAST(ts AS DATE) AS effective, CAST(created_at AS DATE) AS date, CAST(SUM(turn) AS BIGINT) AS orders,
       CAST(SUM(turn * total_amount) AS DECIMAL(20,2)) AS revenue, COUNT(*) AS turns
FROM turns WHERE turn <> 0 GROUP BY 1, 2""")
def _sales_changelog(spark, d):
    # What each day's status changes add to and take from the sales of each day.
    t = T(spark, d)
    return S.sales_changes(t.orders, t.status_changes).groupBy("effective", "date").agg(
        F.sum("orders").cast("long").alias("orders"), F.sum("revenue").cast("decimal(20,2)").alias("revenue"),
        F.count(F.lit(1)).alias("turns"))


@register("sales_after_changes", f"""
WITH last AS (SELECT * FROM s_changes QUALIFY row_number() OVER (
  PARTITION BY order_id ORDER BY ts DESC, status DESC, admin_id DESC) = 1),
now AS (SELECT o.created_at, o.total_amount, COALESCE(l.status, o.status) AS status FROM s_orders o LEFT JOIN last l ON l.order_id = o.id)
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS orders, CAST(SUM(total_amount) AS DECIMAL(20,2)) AS revenue
FROM now WHERE {SALE} GROUP BY 1""")
def _sales_after_changes(spark, d):
    # The report after all changes, as the sum of what started and stopped to count.
    t = T(spark, d)
    return S.sales_now(S.sales_changes(t.orders, t.status_changes))


@register("commit_orders_by_year", """
WITH years AS (SELECT year(created_at) AS year, COUNT(*) AS orders, CAST(SUM(total_amount) AS DECIMAL(20,2)) AS revenue,
                      CAST(MAX(total_amount) AS DOUBLE) AS dearest FROM s_orders GROUP BY 1)
SELECT year, orders, revenue FROM years WHERE dearest <= (SELECT AVG(dearest) FROM years)""")
def _commit_orders_by_year(spark, d):
    # Each year's orders as a batch of a table that takes none dearer than a limit, the
    # average of the years' dearest: a batch with one is refused as a whole, and every
    # batch is sent twice.
    t = T(spark, d)
    dearest = {r.year: r.m for r in t.orders.groupBy(F.year("created_at").alias("year")).agg(
        F.max("total_amount").cast("double").alias("m")).collect()}
    limit = sum(dearest.values()) / max(1, len(dearest))
    table = CommittedTable(spark, f"{require_checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}", "orders",
                           rules={"dear": F.col("total_amount") > limit}, references={"user_id": t.users.select("id")})
    for year in sorted(dearest) * 2:
        try:
            table.append(t.orders.filter(F.year("created_at") == year), f"year-{year}")
        except ConstraintViolation as e:
            assert set(e.counts) == {"dear"}
    return table.read().groupBy(F.year("created_at").alias("year")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_amount").cast("decimal(20,2)").alias("revenue"))


@register("keyed_users_after_changes", """
WITH blocked AS (SELECT user_id FROM events GROUP BY user_id, date_trunc('day', ts) HAVING COUNT(*) > 5),
changed AS (SELECT id, name, CASE WHEN id IN (SELECT user_id FROM blocked) THEN 'blocked' ELSE status END AS status FROM s_users),
kept AS (SELECT * FROM changed WHERE status <> 'inactive' OR id IN (SELECT user_id FROM s_orders))
SELECT * FROM kept WHERE id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT s_suppkey, s_name, 'active' FROM supplier""")
def _keyed_users(spark, d):
    # A keyed table of users: those over the limit are blocked, inactive ones without an
    # order deleted, and the suppliers written over the users of their numbers.
    t = T(spark, d)
    table = KeyedTable(spark, f"{require_checkpoint_dir(spark)}/users-{uuid.uuid4().hex}", "id", partitions=16)
    table.create(t.users.select("id", "name", "status"))
    table.update(E.over_limit(t.events, "user_id", 5, "1 day").select(F.col("user_id").alias("id"), F.lit("blocked").alias("status")),
                 ["status"], updated_at=None)
    idle = table.read().filter("status = 'inactive'").join(t.orders.select(F.col("user_id").alias("id")), "id", "left_anti")
    table.delete(idle.select("id"))
    table.upsert(t.source("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("active").alias("status")))
    return table.read()


def _bucketed(spark, df, key) -> str:
    name = f"shelf_{uuid.uuid4().hex}"
    write_bucketed(df, name, key, 16, f"{require_checkpoint_dir(spark)}/{name}")
    return name


@register("bucketed_admin_orders", """
SELECT o.id, o.user_id, u.name AS customer_name, o.total_amount, o.status, o.created_at FROM s_orders o JOIN s_users u ON o.user_id = u.id""")
def _bucketed_admin_orders(spark, d):
    # JN-1 over orders and users in equally many buckets of the user.
    t = T(spark, d)
    orders = _bucketed(spark, t.orders.select("id", "user_id", "total_amount", "status", "created_at"), "user_id")
    users = _bucketed(spark, t.users.select(F.col("id").alias("user_id"), F.col("name").alias("customer_name")), "user_id")
    return join_bucketed(spark, orders, users, "user_id")


@register("bucketed_orders_of_users", """
SELECT id, user_id, total_amount, status FROM s_orders WHERE user_id IN (
  SELECT user_id FROM events GROUP BY user_id, date_trunc('day', ts) HAVING COUNT(*) > 5)""")
def _bucketed_orders_of(spark, d):
    # FLT-9 over orders in buckets of the user: those of the users over the limit.
    t = T(spark, d)
    orders = _bucketed(spark, t.orders.select("id", "user_id", "total_amount", "status"), "user_id")
    return lookup_table(spark, orders, "user_id", E.over_limit(t.events, "user_id", 5, "1 day"))


@register("block_over_limit_users", """
SELECT u.id, CASE WHEN b.user_id IS NULL THEN u.status ELSE 'blocked' END AS status,
       b.ts AS updated_at
FROM s_users u LEFT JOIN (
  SELECT user_id, MAX(w) AS ts FROM (
    SELECT user_id, date_trunc('day', ts) AS w FROM events GROUP BY 1, 2 HAVING COUNT(*) > 5)
  GROUP BY user_id) b ON b.user_id = u.id""")
def _block_over_limit_users(spark, d):
    # Users over 5 calls a day are blocked (ST-1 -> status change).
    t = T(spark, d)
    users, _ = E.block_over_limit(t.users, t.events, 5, "1 day")
    return users.select("id", "status", "updated_at")


@register("block_over_limit_log", """
SELECT CAST(NULL AS BIGINT) AS admin_id,
       'Customer ' || CAST(user_id AS VARCHAR) || ' deactivated' AS action,
       'Status: blocked' AS details, w AS created_at
FROM (SELECT user_id, date_trunc('day', ts) AS w FROM events GROUP BY 1, 2 HAVING COUNT(*) > 5)""")
def _block_over_limit_log(spark, d):
    t = T(spark, d)
    _, log = E.block_over_limit(t.users, t.events, 5, "1 day")
    return log.select("admin_id", "action", "details", "created_at")


@register("over_route_limits_hourly", """
WITH lim(event_type, lim) AS (VALUES ('view', 0), ('click', 1), ('error', 1), ('signup', 1),
                                     ('purchase', 1))
SELECT date_trunc('hour', e.ts) AS window_start, e.user_id, e.event_type, COUNT(*) AS n
FROM events e JOIN lim USING (event_type)
GROUP BY 1, 2, 3, lim.lim HAVING COUNT(*) > lim.lim""")
def _over_route_limits(spark, d):
    # Limits of one an hour (views: none at all), which some users exceed.
    ev = T(spark, d).events
    limits = {"view": 0, "click": 1, "error": 1, "signup": 1, "purchase": 1}
    return E.over_route_limits(ev, limits, "user_id", "event_type", "1 hour")


@register("over_route_limits_daily", """
WITH lim(event_type, lim) AS (VALUES ('view', 5), ('click', 10), ('error', 3), ('signup', 5),
                                     ('purchase', 5))
SELECT date_trunc('day', e.ts) AS window_start, e.user_id, e.event_type, COUNT(*) AS n
FROM events e JOIN lim USING (event_type)
GROUP BY 1, 2, 3, lim.lim HAVING COUNT(*) > lim.lim""")
def _over_route_limits_daily(spark, d):
    ev = T(spark, d).events
    limits = {"view": 5, "click": 10, "error": 3, "signup": 5, "purchase": 5}
    return E.over_route_limits(ev, limits, "user_id", "event_type", "1 day")


@register("order_lines_salted", """
SELECT oi.order_id, oi.product_id, p.name AS product_name, oi.quantity, p.price
FROM s_items oi JOIN s_products p ON oi.product_id = p.id""")
def _order_lines_salted(spark, d):
    # JN-2 with hot products salted explicitly (the fallback to AQE's split).
    t = T(spark, d)
    return O.order_lines(t.order_items, t.products, skew_salts=16)


@register("cart_lines_state", """
WITH ev AS (
  SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS product_id, ts, event_id, event_type
  FROM events),
ur AS (SELECT user_id, ts AS r_ts, event_id AS r_id FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
         FROM ev WHERE event_type = 'purchase') WHERE rn = 1),
d AS (SELECT e.user_id, e.product_id, e.ts, e.event_id,
             CASE e.event_type WHEN 'click' THEN 1 ELSE -1 END AS delta
      FROM ev e LEFT JOIN ur ON ur.user_id = e.user_id
      WHERE e.event_type IN ('click', 'error') AND e.product_id IS NOT NULL
        AND (ur.user_id IS NULL OR e.ts > ur.r_ts OR (e.ts = ur.r_ts AND e.event_id > ur.r_id))),
r AS (SELECT user_id, product_id, delta,
             SUM(delta) OVER (PARTITION BY user_id, product_id ORDER BY ts, event_id
                              ROWS UNBOUNDED PRECEDING) AS run FROM d),
q AS (SELECT user_id, product_id, CAST(SUM(delta) - LEAST(MIN(run), 0) AS BIGINT) AS quantity
      FROM r GROUP BY 1, 2)
SELECT * FROM q WHERE quantity > 0""")
def _cart_lines_state(spark, d):
    # Cart lines per (user, product), the product taken from each event's
    # properties ("k"): click adds one, error takes one away, purchase clears.
    ev = T(spark, d).events
    product = F.get_json_object("props", "$.k").cast("long")
    return E.cart_lines_state(ev, product)

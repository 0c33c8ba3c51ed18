"""Hand-worked results on the shop's seed rows (FIXTURES section 2)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shelfwise.operators import catalog as K
from shelfwise.operators import customers as C
from shelfwise.operators import orders as O
from shelfwise.operators import reports as R
from shelfwise.sources.tables import seed_categories, seed_products


def ids(df):
    return [r.id for r in df.collect()]


def _images(spark):
    return spark.createDataFrame([], "id long, product_id long, image_url string, "
                                     "is_primary boolean, sort_order int, created_at timestamp_ntz")


def test_catalog_has_empty_image_arrays(spark):
    cat = K.catalog(seed_products(spark), _images(spark)).collect()
    assert len(cat) == 10
    assert all(r.images == [] for r in cat)


def test_search_and_sort(spark):
    p = seed_products(spark)
    assert sorted(ids(K.search(p, "TROLLEY"))) == [7, 8]
    assert len(ids(K.search(p, ""))) == 10
    assert ids(K.sort_catalog(p, "price-low")) == [9, 10, 2, 1, 3, 7, 8, 4, 6, 5]
    assert ids(K.sort_catalog(p, "price-high")) == [5, 6, 4, 8, 7, 3, 1, 2, 10, 9]
    assert ids(K.sort_catalog(p, "newest")) == list(range(10, 0, -1))
    assert ids(K.head(p, 5)) == [1, 2, 3, 4, 5]
    assert sorted(ids(K.by_category(p, "Trolley School Bags"))) == [7, 8]
    assert len(ids(K.by_category(p, ""))) == 10


def test_search_null_description(spark):
    p = seed_products(spark).withColumn(
        "description", F.when(F.col("id") == 7, F.lit(None)).otherwise(F.col("description")))
    assert sorted(ids(K.search(p, "trolley"))) == [7, 8]
    assert sorted(ids(K.search(p, "easy-roll"))) == []


def test_order_totals_rules(spark):
    lines = spark.createDataFrame(
        [(1, 9, 1, Decimal("350.00")), (1, 10, 1, Decimal("500.00")),
         (2, 3, 2, Decimal("2500.00"))],
        "order_id long, product_id long, quantity int, price decimal(10,2)")
    orders = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r.order_id: (r.subtotal, r.delivery, r.total)
           for r in O.order_totals(lines, orders).collect()}
    assert got[1] == (Decimal("850.00"), Decimal("250.00"), Decimal("1100.00"))
    assert got[2] == (Decimal("5000.00"), Decimal("0.00"), Decimal("5000.00"))
    assert got[3] == (Decimal("0.00"), Decimal("0.00"), Decimal("0.00"))


def test_best_sellers_count_cancelled(spark):
    p = seed_products(spark)
    items = spark.createDataFrame([(1, 1, 1, Decimal("1500.00"))],
                                  "order_id long, product_id long, quantity int, price decimal(10,2)")
    orders = spark.createDataFrame([(1, "cancelled")], "id long, status string")
    top = {r.id: r for r in R.top_selling(p, items, orders).collect()}
    assert (top[1].sales_count, top[1].total_quantity_sold, top[1].total_revenue) == (
        1, 1, Decimal("1500.00"))
    assert top[2].sales_count == 0 and top[2].total_revenue == 0
    only = {r.id: r for r in R.top_selling(p, items, orders, sales_only=True).collect()}
    assert only[1].sales_count == 0


def test_customer_without_orders(spark):
    users = spark.createDataFrame([(1, "A", "a@x.io")], "id long, name string, email string")
    orders = spark.createDataFrame([], "id long, user_id long, total_amount decimal(10,2), "
                                       "created_at timestamp_ntz")
    r = C.customer_order_summary(users, orders).collect()[0]
    assert (r.total_orders, r.total_spent, r.last_order_date) == (0, Decimal("0.00"), None)
    assert C.customers(users, orders).collect()[0].order_count == 0


def test_report_empty_and_windows(spark):
    schema = "id long, status string, total_amount decimal(10,2), created_at timestamp_ntz"
    empty = spark.createDataFrame([], schema)
    tot = R.report_totals(R.sales_report(empty, "daily", "2024-03-31 10:00:00")).collect()[0]
    assert (tot.total_orders, tot.total_revenue, tot.avg_order_value) == (0, 0, 0.0)
    rows = [(1, "confirmed", Decimal("10.00"), dt.datetime(2024, 3, 24, 10, 0, 0)),
            (2, "confirmed", Decimal("20.00"), dt.datetime(2024, 3, 24, 9, 59, 59)),
            (3, "shipped", Decimal("30.00"), dt.datetime(2023, 3, 31, 10, 0, 0)),
            (4, "delivered", Decimal("40.00"), dt.datetime(2023, 3, 31, 9, 0, 0)),
            (5, "pending", Decimal("50.00"), dt.datetime(2024, 3, 30, 9, 0, 0))]
    o = spark.createDataFrame(rows, schema)
    daily = R.sales_report(o, "daily", "2024-03-31 10:00:00").collect()
    assert [(r.date, r.orders) for r in daily] == [(dt.date(2024, 3, 24), 1)]
    monthly = R.sales_report(o, "monthly", "2024-03-31 10:00:00").collect()
    assert [(r.date, r.orders) for r in monthly] == [
        (dt.date(2024, 3, 1), 2), (dt.date(2023, 3, 1), 1)]
    # unknown period: endpoint gives daily, procedure gives nothing
    assert len(R.sales_report(o, "weekly", "2024-03-31 10:00:00").collect()) == 1
    assert R.sales_report_proc(o, "weekly", "2024-03-31 10:00:00").count() == 0
    # month-end clamp: 31 Mar 2024 - 1 month keeps 29 Feb 10:00
    from shelfwise.functions import since
    edge = spark.createDataFrame([(dt.datetime(2024, 2, 29, 10, 0),), (dt.datetime(2024, 2, 29, 9, 0),)],
                                 "created_at timestamp_ntz")
    assert edge.filter(since("created_at", "2024-03-31 10:00:00", months=1)).count() == 1


def test_categories_seed(spark):
    cats = K.active_categories(seed_categories(spark)).collect()
    assert [c.name for c in cats][0] == "College & University Bags"
    assert len(cats) == 5


def test_nested_orders_newest_first(spark):
    p = seed_products(spark)
    orders = spark.createDataFrame([(1, 7, "pending", dt.datetime(2024, 1, 1)), (2, 8, "pending", dt.datetime(2024, 1, 2)),
                                    (3, 7, "pending", dt.datetime(2024, 1, 2)), (4, 7, "pending", dt.datetime(2023, 5, 1))],
                                   "id long, user_id long, status string, created_at timestamp_ntz")
    items = spark.createDataFrame([(1, pid, 1) for pid in range(1, 8)] + [(4, 2, 5), (4, 2, 3), (4, 99, 1)],
                                  "order_id long, product_id long, quantity int")
    nested = O.orders_with_items(orders, items, p).collect()
    assert [r.id for r in nested] == [3, 2, 1, 4]
    flat = {r.id: [(i.product_id, i.quantity) for i in r["items"]] for r in nested}
    assert flat == {1: [(k, 1) for k in range(1, 8)], 2: [], 3: [], 4: [(2, 3), (2, 5)]}
    assert {r.id: r.line_count for r in O.line_counts(orders, items, p).collect()} == {1: 7, 2: 0, 3: 0, 4: 2}
    own = O.orders_with_items_of(orders, items, p, spark.createDataFrame([(7,), (7,)], "id long")).collect()
    assert [(r.id, len(r["items"])) for r in own] == [(3, 0), (1, 7), (4, 2)]


def test_reports_without_rows(spark):
    none = spark.createDataFrame([], "id long, created_at timestamp_ntz, total_amount decimal(10,2), status string")
    assert R.sales_report_proc(none, "weekly", "2024-03-31 10:00:00").count() == 0
    total = R.report_totals(R.sales_report(none, "daily", "2024-03-31 10:00:00")).collect()[0]
    assert (total.total_orders, total.total_revenue, total.avg_order_value) == (0, 0, 0)


def test_image_positions_and_nesting(spark):
    imgs = spark.createDataFrame(
        [(i, 1, f"u{i}", False, 10 - i, None) for i in range(7)] + [(100, 2, "only", True, 0, None)],
        "id long, product_id long, image_url string, is_primary boolean, sort_order int, "
        "created_at timestamp_ntz")
    rows = sorted((r.product_id, r.position, r.image_url) for r in K.image_urls(imgs).collect())
    assert rows == [(1, k, f"u{6 - k}") for k in range(7)] + [(2, 0, "only")]
    nested = {r.product_id: r.images for r in K.nest_images(K.image_urls(imgs)).collect()}
    assert nested == {1: [f"u{6 - k}" for k in range(7)], 2: ["only"]}


def test_order_text(spark):
    lines = spark.createDataFrame([(1, 2, "Bag", 2, 350), (1, 1, "Cup", 1, 100), (2, 1, "Cup", 40, 100)],
                                  "order_id long, product_id long, product_name string, quantity int, price int")
    got = {r.order_id: (r.order_text, r.subtotal, r.total - r.delivery) for r in O.order_text(
        lines.withColumn("price", F.col("price").cast("decimal(10,2)"))).collect()}
    assert got[1][0] == "Cup (Qty: 1) - Rs. 100.00\nBag (Qty: 2) - Rs. 700.00"
    assert got[1][1:] == (800, 800) and got[2][1] == 4000


def test_public_views_hide_credentials(spark):
    from shelfwise.operators.customers import public_admins, public_users
    rows = spark.createDataFrame([(1, "A", "a@x", "secret", "root", "active")],
                                 "id long, name string, email string, password string, role string, status string")
    assert public_admins(rows).collect() == [(1, "A", "a@x", "root")]
    assert public_users(rows).collect() == [(1, "A", "a@x")]

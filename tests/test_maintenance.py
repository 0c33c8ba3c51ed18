import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import maintenance as M
from shelfwise.sources.tables import conform, seed_products, with_defaults


def test_apply_updates_keeps_null_update(spark):
    t = spark.createDataFrame([(1, "a", "x", None), (2, "b", "y", None)],
                              "id long, status string, notes string, updated_at timestamp_ntz")
    ch = spark.createDataFrame([(1, None)], "id long, status string")
    out = {r.id: r for r in M.apply_updates(t, ch, "id", ["status"], "2024-01-01 00:00:00").collect()}
    assert out[1].status is None and out[1].updated_at == dt.datetime(2024, 1, 1)
    assert out[2].status == "b" and out[2].updated_at is None


def test_upsert_twice_equals_once(spark):
    t = spark.createDataFrame([(1, "a@x.io", "A", "p1"), (5, "b@x.io", "B", "p2")],
                              "id long, email string, name string, password string")
    rows = spark.createDataFrame([("b@x.io", "B2", "p3"), ("c@x.io", "C", "p4")],
                                 "email string, name string, password string")
    once = M.upsert(t, rows, "email", ["name", "password"])
    twice = M.upsert(once, rows, "email", ["name", "password"])
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    assert (6, "c@x.io", "C", "p4") in a and (5, "b@x.io", "B2", "p3") in a


def test_delete_cascade_then_no_orphans(spark):
    from shelfwise.operators.quality import orphans
    users = spark.createDataFrame([(1,), (2,)], "id long")
    orders = spark.createDataFrame([(10, 1), (11, 2)], "id long, user_id long")
    items = spark.createDataFrame([(10, 5), (11, 6)], "order_id long, product_id long")
    products = spark.createDataFrame([(5, 1), (6, 1)], "id long, category_id long")
    cats = spark.createDataFrame([(1,)], "id long")
    logs = spark.createDataFrame([(100, 5, 7)], "id long, product_id long, admin_id long")
    admins = spark.createDataFrame([(7,)], "id long")
    tables = {"users": users, "orders": orders, "order_items": items, "products": products,
              "categories": cats, "inventory_logs": logs, "admins": admins}
    out = M.delete_cascade(tables, "users", spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in out["orders"].collect()] == [11]
    assert [r.order_id for r in out["order_items"].collect()] == [11]
    assert orphans(out["order_items"], "order_id", out["orders"], "id", "order_items",
                   "orders", key="order_id").count() == 0
    # SET NULL: deleting the admin clears the log's admin_id
    out2 = M.delete_cascade(tables, "admins", spark.createDataFrame([(7,)], "id long"))
    assert out2["inventory_logs"].collect()[0].admin_id is None
    # RESTRICT: a category still used by products cannot be deleted
    with pytest.raises(M.RestrictViolation):
        M.delete_cascade(tables, "categories", spark.createDataFrame([(1,)], "id long"))
    # CASCADE through products removes the logs and the lines
    out3 = M.delete_cascade(tables, "products", spark.createDataFrame([(5,)], "id long"))
    assert out3["inventory_logs"].count() == 0
    assert [r.product_id for r in out3["order_items"].collect()] == [6]


def test_assign_ids_and_latest(spark):
    t = seed_products(spark)
    rows = spark.createDataFrame([("z",), ("a",), ("m",)], "name string")
    got = [(r.id, r.name) for r in M.assign_ids(t, rows, ["name"]).orderBy("id").collect()]
    assert got == [(11, "a"), (12, "m"), (13, "z")]
    ch = spark.createDataFrame([(1, 1, "shipped"), (1, 2, "delivered"), (2, 1, "cancelled")],
                               "order_id long, ts long, status string")
    last = {r.order_id: r.status for r in M.latest_changes(ch, "order_id", "ts").collect()}
    assert last == {1: "delivered", 2: "cancelled"}


def test_conform_idempotent_and_defaults(spark):
    df = spark.createDataFrame([(1, "x", "555")], "id long, name string, phone string")
    once = conform(df, add={"is_verified": ("boolean", False)}, drop=["phone"])
    twice = conform(once, add={"is_verified": ("boolean", True)}, drop=["phone"])
    assert once.columns == twice.columns == ["id", "name", "is_verified"]
    assert twice.collect()[0].is_verified is False
    filled = with_defaults(spark.createDataFrame([(1, 2, 3, None)],
                                                 "id long, user_id long, total_amount int, status string"),
                           "orders").collect()[0]
    assert filled.status == "pending" and filled.payment_method == "cash_on_delivery"


def test_rekey(spark):
    p = seed_products(spark)
    ch = spark.createDataFrame([(4, 40)], "old_id long, new_id long")
    got = {r.id: r.category_id for r in M.rekey(ch, p, "category_id").collect()}
    assert got[7] == 40 and got[8] == 40 and got[1] == 1


def test_apply_updates_takes_the_last_of_repeated_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, status string")
    ch = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2)], "id long, status string, ts int")
    assert sorted(map(tuple, M.apply_updates(t, ch, "id", ["status"], updated_at=None).collect())) == [(1, "y"), (2, "b")]


def test_upsert_as_the_database_does_it(spark):
    import datetime as dt
    t = spark.createDataFrame(
        [(1, "Ann", "a@x", "blocked", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))],
        "id long, name string, email string, status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    feed = spark.createDataFrame([("A@X", "first", 1), ("a@x", "last", 2), ("b@x", "new", 1), ("B@x", "newer", 2), (None, "?", 1)],
                                 "email string, name string, ts int")
    now = dt.datetime(2024, 1, 1)
    once = M.upsert(t, feed, "email", ["name"], fold_case=True, defaults="users", as_of="2024-01-01 00:00:00")
    rows = sorted(map(tuple, once.collect()))
    assert rows == [(1, "last", "a@x", "blocked", dt.datetime(2020, 1, 1), now), (2, "newer", "B@x", "active", now, now)]
    again = M.upsert(once, feed, "email", ["name"], fold_case=True, defaults="users", as_of="2024-01-01 00:00:00")
    assert sorted(map(tuple, again.collect())) == rows

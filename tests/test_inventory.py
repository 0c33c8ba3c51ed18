import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwise.operators.inventory import admit_orders, stock_ledger
from shelfwise.sources.tables import seed_products

from .conftest import SF001


def sequential(stock, orders, items):
    """The shop's order loop: per order, every line against the stock before
    this order; all or nothing."""
    stock = dict(stock)
    lines = defaultdict(list)
    for oid, pid, q in items:
        lines[oid].append((pid, q))
    accepted, rejected = set(), {}
    for _, oid in sorted((ts, oid) for oid, ts in orders):
        ok = True
        for pid, q in lines[oid]:
            if pid not in stock or stock[pid] < q:
                ok = False
                break
        if ok:
            for pid, q in lines[oid]:
                stock[pid] -= q
            accepted.add(oid)
        else:
            rejected[oid] = True
    return accepted, set(rejected), stock


def _frames(spark, stock, orders, items):
    p = spark.createDataFrame([(k, v) for k, v in stock.items()], "id long, stock int")
    o = spark.createDataFrame([(oid, 1, ts) for oid, ts in orders], "id long, user_id long, created_at long")
    i = spark.createDataFrame(items, "order_id long, product_id long, quantity int")
    return p, o, i


def test_fixture_cases(spark):
    seed = seed_products(spark).select("id", "stock")
    # 20 x 8 then 1 x 8: first accepted, second rejected (available 0, requested 1)
    o = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)],
                              "id long, user_id long, created_at long")
    i = spark.createDataFrame([(1, 8, 20), (2, 8, 1),
                               (3, 9, 1), (3, 8, 21),      # rejected as a whole
                               (4, 9, 3)], "order_id long, product_id long, quantity int")
    res = admit_orders(seed, o, i)
    assert sorted(r.order_id for r in res.accepted.collect()) == [1, 4]
    rej = {r.order_id: r for r in res.rejected.collect()}
    assert set(rej) == {2, 3}
    assert (rej[2].available, rej[2].requested) == (0, 1)
    closing = {r.product_id: r.stock for r in res.closing_stock.collect()}
    assert closing[8] == 0 and closing[9] == 147


def test_two_lines_same_product_checked_per_line(spark):
    seed = seed_products(spark).select("id", "stock")
    o = spark.createDataFrame([(1, 1, 1)], "id long, user_id long, created_at long")
    i = spark.createDataFrame([(1, 8, 15), (1, 8, 15)], "order_id long, product_id long, quantity int")
    res = admit_orders(seed, o, i)
    assert [r.order_id for r in res.accepted.collect()] == [1]
    closing = {r.product_id: r.stock for r in res.closing_stock.collect()}
    assert closing[8] == -10


def test_random_against_sequential(spark):
    rnd = random.Random(11)
    stock = {p: rnd.randint(0, 30) for p in range(12)}
    orders = [(oid, rnd.randint(0, 50)) for oid in range(300)]
    items = []
    for oid, _ in orders:
        for _ in range(rnd.randint(1, 3)):
            # product 0 is hot: in about a third of all lines
            pid = 0 if rnd.random() < 0.33 else rnd.randint(1, 12)   # 12 is unknown
            items.append((oid, pid, rnd.randint(1, 6)))
    exp_acc, exp_rej, exp_stock = sequential(stock, orders, items)
    p, o, i = _frames(spark, stock, orders, items)
    res = admit_orders(p, o, i)
    got_acc = {r.order_id for r in res.accepted.collect()}
    got_rej = {r.order_id for r in res.rejected.collect()}
    assert got_acc == exp_acc
    assert got_rej == exp_rej
    assert {r.product_id: r.stock for r in res.closing_stock.collect()} == exp_stock
    assert res.rounds >= 1


def test_ledger_fixture(spark):
    seed = seed_products(spark).select("id", "stock")
    o = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id long, user_id long, created_at long")
    i = spark.createDataFrame([(1, 9, 3), (2, 9, 2)], "order_id long, product_id long, quantity int")
    led = stock_ledger(seed, i, o).orderBy("order_id").collect()
    assert [(r.old_stock, r.new_stock, r.action) for r in led] == [
        (150, 147, "order_placed"), (147, 145, "order_placed")]


def test_place_orders_end_to_end(spark):
    import datetime as dt
    from decimal import Decimal

    from shelfwise.operators.inventory import place_orders
    from shelfwise.schemas import NEW_ORDERS

    seed = seed_products(spark)
    users = spark.createDataFrame([(1,), (2,)], "id long")
    d = lambda h: dt.datetime(2024, 1, 1, h)
    req = spark.createDataFrame([
        (101, 1, [(8, 20)], Decimal("60000.00"), "pending", d(1)),
        (102, 2, [(8, 1)], Decimal("3000.00"), "pending", d(2)),          # no stock left
        (103, 1, [(9, 3), (10, 1)], Decimal("1550.00"), "pending", d(3)),
        (104, 1, [(9, 2)], Decimal("700.00"), None, d(4)),
        (105, 9, [(9, 1)], Decimal("350.00"), "pending", d(5)),           # unknown user
    ], NEW_ORDERS)
    existing = spark.createDataFrame([(500,)], "id long")
    res = place_orders(seed, users, req, existing)
    orders = {r.id: r for r in res.orders.collect()}
    assert sorted(orders) == [501, 502, 503]
    assert orders[503].status == "pending" and orders[501].payment_method == "cash_on_delivery"
    items = sorted((r.order_id, r.product_id, r.quantity, r.price) for r in res.items.collect())
    assert items[0] == (501, 8, 20, Decimal("3000.00"))
    ledger = sorted((r.product_id, r.old_stock, r.new_stock) for r in res.ledger.collect()
                    if r.product_id == 9)
    assert ledger == [(9, 147, 145), (9, 150, 147)]
    stock = {r.id: r.stock for r in res.products.collect()}
    assert stock[8] == 0 and stock[9] == 145 and stock[10] == 99
    rej = {r.order_ref: (r.reason, r.available, r.requested) for r in res.rejected.collect()}
    assert rej == {102: ("insufficient_stock", 0, 1), 105: ("unknown_user", None, None)}


def test_first_failing_line_in_item_order(spark):
    seed = seed_products(spark).select("id", "stock")
    o = spark.createDataFrame([(1, 1, 1)], "id long, user_id long, created_at long")
    # both lines fail (stock 100 and 50); the first in item order is product 10
    i = spark.createDataFrame([(1, 10, 200, 0), (1, 3, 1000, 1)],
                              "order_id long, product_id long, quantity int, line_no int")
    by_pos = admit_orders(seed, o, i, line_order="line_no").rejected.collect()[0]
    assert (by_pos.product_id, by_pos.available, by_pos.requested) == (10, 100, 200)
    by_id = admit_orders(seed, o, i.drop("line_no")).rejected.collect()[0]
    assert (by_id.product_id, by_id.available, by_id.requested) == (3, 50, 1000)


def test_first_failing_line_whatever_fails(spark):
    """Line 0 lacks stock, line 1 names an unknown product, and the other way round."""
    seed = seed_products(spark).select("id", "stock")
    o = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id long, user_id long, created_at long")
    i = spark.createDataFrame([(1, 10, 500, 0), (1, 5, 1, 1), (1, 999, 1, 2), (2, 999, 4, 0), (2, 10, 500, 1)],
                              "order_id long, product_id long, quantity int, line_no int")
    got = {r.order_id: (r.reason, r.product_id, r.available, r.requested)
           for r in admit_orders(seed, o, i, line_order="line_no").rejected.collect()}
    assert got == {1: ("insufficient_stock", 10, 100, 500), 2: ("unknown_product", 999, 0, 4)}


def test_a_hot_product_in_many_blocks(spark, monkeypatch):
    """The product on a third of all lines is cut into blocks; the verdicts stay."""
    from shelfwise.operators import inventory, scan
    cuts = []

    def small(df, keys, order, counted=None, rows=None):
        cuts.append(scan.splitters(df, keys, order, counted, rows=40))
        return cuts[-1]

    monkeypatch.setattr(inventory, "splitters", small)
    rnd = random.Random(12)
    stock = {p: rnd.randint(5, 200) for p in range(12)}
    orders = [(oid, rnd.randint(0, 40)) for oid in range(1500)]
    items = [(oid, 0 if rnd.random() < 0.33 else rnd.randint(1, 11), rnd.randint(1, 6)) for oid, _ in orders for _ in range(rnd.randint(1, 4))]
    exp_acc, exp_rej, exp_stock = sequential(stock, orders, items)
    res = admit_orders(*_frames(spark, stock, orders, items))
    assert {r.order_id for r in res.accepted.collect()} == exp_acc
    assert {r.order_id for r in res.rejected.collect()} == exp_rej
    assert {r.product_id: r.stock for r in res.closing_stock.collect()} == exp_stock
    assert cuts[0].table.selectExpr("max(size(_splits))").first()[0] >= 10


def test_rounds_may_be_limited(spark):
    stock = {0: 10, 1: 10}
    orders = [(i, i) for i in range(40)]
    items = [(i, i % 2, 3) for i in range(40)] + [(i, (i + 1) % 2, 2) for i in range(40)]
    res = admit_orders(*_frames(spark, stock, orders, items))
    assert {r.order_id for r in res.accepted.collect()} == sequential(stock, orders, items)[0]
    with pytest.raises(RuntimeError, match="did not finish in 1 rounds"):
        admit_orders(*_frames(spark, stock, orders, items), max_rounds=1)


def test_rounds_one_by_one(spark, monkeypatch):
    """Many undecided pairs: a table for each round, each pair decided in one; results stay."""
    from shelfwise.operators import inventory
    made = []

    def keep(df, name):
        made.append((name, written(df, name)))
        return made[-1][1]

    written = inventory.written
    monkeypatch.setattr(inventory, "written", keep)
    monkeypatch.setattr(inventory, "FEW", 60)
    rnd = random.Random(5)
    stock = {p: rnd.randint(0, 60) for p in range(10)}
    orders = [(oid, rnd.randint(0, 40)) for oid in range(400)]
    items = [(oid, rnd.randint(0, 10), rnd.randint(1, 5)) for oid, _ in orders[:390] for _ in range(rnd.randint(1, 3))]
    exp_acc, exp_rej, exp_stock = sequential(stock, orders, items)
    res = admit_orders(*_frames(spark, stock, orders, items))
    assert sorted(r.order_id for r in res.accepted.collect()) == sorted(exp_acc)
    assert sorted(r.order_id for r in res.rejected.collect()) == sorted(exp_rej)
    assert {r.product_id: r.stock for r in res.closing_stock.collect()} == exp_stock
    tables = [t for name, t in made if name == "admission-round"]
    assert sum(t.filter("_v <> 'U'").count() for t in tables) == len({(o, p) for o, p, _ in items})
    # what a round decided is not in the next round's table
    assert tables[0].filter("_v = 'R'").join(tables[1], "order_id", "left_semi").count() == 0


def test_placement_reads_the_requests_once(spark):
    from shelfwise.operators.inventory import place_orders

    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(60).selectExpr(
        "id AS order_ref", "1L AS user_id", "array(struct(8L + id % 2 AS product_id, 2 AS quantity)) AS items",
        "CAST(1 AS DECIMAL(10,2)) AS total_amount", "'pending' AS status", "timestamp_ntz'2024-01-01 00:00:00' AS created_at")
    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    done = place_orders(seed_products(spark), spark.createDataFrame([(1,)], "id long"),
                        rows.mapInArrow(count, rows.schema))
    placed = done.orders.count()
    assert placed + done.rejected.count() == 60 and done.items.count() == done.ledger.count() == placed > 0
    assert seen.value == 60

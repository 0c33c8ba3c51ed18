import random

from shelfwise.operators.joins import hot_keys, salted_join
from shelfwise.operators.orders import order_lines
from shelfwise.sources.adapters import shop_tables

from .conftest import SF001


def test_salted_join_equals_plain_join(spark):
    rnd = random.Random(3)
    big = spark.createDataFrame(
        [(0 if rnd.random() < 0.4 else rnd.choice([None, *range(1, 51)]), i) for i in range(4000)], "k long, v long")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(0, 40)], "k long, name string")
    assert [r.k for r in hot_keys(big, "k", max_hot=10).collect()] == [0]
    for how in ("inner", "left"):
        a = sorted(map(tuple, salted_join(big, small, "k", how, salts=8, max_hot=10).collect()),
                   key=str)
        b = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
        assert a == b


def test_order_lines_salted(spark):
    t = shop_tables(spark, SF001)
    a = sorted(map(tuple, order_lines(t.order_items, t.products, skew_salts=4).collect()))
    b = sorted(map(tuple, order_lines(t.order_items, t.products).collect()))
    assert a == b

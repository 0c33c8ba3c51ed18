"""The registered admission query against the shop's sequential order loop
on the real sf0.01 tables (and on the skewed copy), row for row."""

from collections import defaultdict

import duckdb
from shelfwise.plans.registry import QUERIES

from .conftest import SF01


def sequential_decisions(base, half_demand=True):
    con = duckdb.connect()
    orders = con.sql(f"SELECT o_orderkey, o_custkey, o_orderdate FROM '{base}/orders.parquet'").fetchall()
    users = {r[0] for r in con.sql(f"SELECT c_custkey FROM '{base}/customer.parquet'").fetchall()}
    items = con.sql(f"SELECT l_orderkey, l_partkey, CAST(l_quantity AS INTEGER) "
                    f"FROM '{base}/lineitem.parquet'").fetchall()
    parts = dict(con.sql(f"SELECT p_partkey, p_size % 10 FROM '{base}/part.parquet'").fetchall())
    if half_demand:
        demand = defaultdict(int)
        for _, p, q in items:
            demand[p] += q
        stock = {p: int(demand.get(p, 0) / 2) for p in parts}      # cast(sum/2 as int)
    else:
        stock = dict(parts)                                        # the catalogue's stock
    need, total = defaultdict(dict), defaultdict(dict)
    for o, p, q in items:
        need[o][p] = max(need[o].get(p, 0), q)
        total[o][p] = total[o].get(p, 0) + q
    out = {}
    for o, u, ts in sorted(orders, key=lambda r: (r[2], r[0])):
        if u not in users:
            out[o] = ("rejected", "unknown_user", None, None, None)
            continue
        unknown = sorted(p for p in need[o] if p not in stock)
        if unknown:
            out[o] = ("rejected", "unknown_product", unknown[0], 0, need[o][unknown[0]])
            continue
        failing = sorted(p for p in need[o] if need[o][p] > stock[p])
        if failing:
            p = failing[0]
            out[o] = ("rejected", "insufficient_stock", p, stock[p], need[o][p])
        else:
            for p, t in total[o].items():
                stock[p] -= t
            out[o] = ("accepted", None, None, None, None)
    return out


def test_admission_equals_sequential_loop(spark):
    got = {r.order_id: (r.decision, r.reason, r.product_id, r.available, r.requested)
           for r in QUERIES["admit_orders_half_demand"](spark, SF01).collect()}
    assert got == sequential_decisions(SF01)


def test_admission_on_skewed_tables(spark, skewed_base):
    got = {r.order_id: (r.decision, r.reason, r.product_id, r.available, r.requested)
           for r in QUERIES["admit_orders_half_demand"](spark, skewed_base).collect()}
    assert got == sequential_decisions(skewed_base)


def test_admission_with_catalogue_stock(spark):
    got = {r.order_id: (r.decision, r.reason, r.product_id, r.available, r.requested)
           for r in QUERIES["admit_orders"](spark, SF01).collect()}
    assert got == sequential_decisions(SF01, half_demand=False)

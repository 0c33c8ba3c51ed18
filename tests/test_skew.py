"""Hot keys end to end: a copy of the sf0.01 tables where a third of all
order lines belong to one product, a third of all orders to one customer and
a third of all events to one user; registered queries still equal their
oracles."""

import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise.plans.registry import ORACLE, QUERIES

from .compare import compare
from .conftest import SF01

TABLES = ("customer", "part", "orders", "lineitem", "events", "pages")
SKEW_QUERIES = ["stock_ledger", "top_selling", "orders_with_items", "order_lines",
                "customer_order_summary", "cart_state", "over_limit_daily", "over_moving_limit_daily", "latest_changes",
                "apply_status_changes_orders", "admin_orders", "order_totals", "order_lines_salted", "cart_lines_state",
                "lookup_users_with_events", "orders_without_items", "numbered_order_lines", "line_counts"]


@pytest.fixture(scope="module")
def skewed(spark, skewed_base):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_base}/{t}.parquet')")
    return skewed_base, con


def make_skewed_copy(spark):
    base = tempfile.mkdtemp(prefix="sw-skew-")
    hot = lambda c, key: F.when(F.pmod(F.xxhash64(c), F.lit(3)) == 0, F.lit(key)).otherwise(F.col(c))
    for t in TABLES:
        df = spark.read.parquet(f"{SF01}/{t}.parquet")
        if t == "lineitem":
            df = df.withColumn("l_partkey", hot("l_partkey", 7).cast("long"))
        elif t == "orders":
            df = df.withColumn("o_custkey", hot("o_custkey", 11).cast("long"))
        elif t == "events":
            df = df.withColumn("user_id", hot("event_id", 5).cast("long"))
        df.write.parquet(os.path.join(base, f"{t}.parquet"))
    return base


@pytest.mark.parametrize("name", SKEW_QUERIES)
def test_hot_keys(spark, skewed, name):
    base, con = skewed
    share = con.sql("SELECT avg((l_partkey = 7)::INT) FROM lineitem").fetchall()[0][0]
    assert share > 0.3
    problems = compare(QUERIES[name](spark, base), con, ORACLE[name])
    assert not problems, problems

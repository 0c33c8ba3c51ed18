"""Physical-plan checks: predicates reach the Parquet scan, columns are pruned,
and facts are aggregated before the dimension join."""

import os
import tempfile

from shelfwise.operators import reports as R
from shelfwise.sources.adapters import shop_tables, write_shop_tables
from shelfwise.sources.tables import read_table, with_defaults

from .conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_orders_push_status_and_time(spark):
    base = tempfile.mkdtemp(prefix="sw-plan-")
    orders = with_defaults(shop_tables(spark, SF001).orders, "orders")
    orders.write.parquet(os.path.join(base, "orders.parquet"))
    stored = read_table(spark, base, "orders")
    plan = _plan(R.sales_report(stored, "monthly", "2001-08-01 12:00:00"))
    assert "PushedFilters" in plan
    assert "In(status" in plan
    assert "GreaterThanOrEqual(created_at" in plan
    # only the three columns the report uses are read
    assert "ReadSchema: struct<total_amount:decimal(10,2),status:string,created_at:timestamp_ntz>" in plan


def test_top_selling_aggregates_before_join(spark):
    t = shop_tables(spark, SF001)
    plan = _plan(R.top_selling(t.products, t.order_items, t.orders))
    # the line table is reduced by a partial aggregate, and orders is not read at all
    assert "HashAggregate" in plan and "partial_sum" in plan
    assert "o_orderstatus" not in plan


def test_stored_tables_equal_derivation_and_prune_months(spark):
    base = tempfile.mkdtemp(prefix="sw-shop-")
    derived = shop_tables(spark, SF001)
    write_shop_tables(derived, base, ("orders", "products"))
    orders = spark.read.parquet(f"{base}/orders.parquet")
    for period in ("daily", "monthly"):
        a = R.sales_report(orders, period, "2001-08-01 12:00:00").collect()
        b = R.sales_report(derived.orders, period, "2001-08-01 12:00:00").collect()
        assert sorted(a) == sorted(b)
    products = spark.read.parquet(f"{base}/products.parquet")
    assert sorted(map(tuple, products.collect()), key=str) == sorted(map(tuple, derived.products.collect()), key=str)
    plan = _plan(R.sales_report(orders.filter("created_month >= date'2001-07-01'"), "daily", "2001-08-01 12:00:00"))
    assert "PartitionFilters: [isnotnull(created_month" in plan


def test_the_daily_report_pushes_its_time_to_the_given_table(spark):
    plan = _plan(R.sales_report(shop_tables(spark, SF001).orders, "daily", "2001-08-01 12:00:00"))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_orderkey" not in plan.split("ReadSchema")[1]


def _jobs_of_building(spark, names):
    from shelfwise.plans.registry import QUERIES
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    for name in names:
        QUERIES[name](spark, SF001)
    return len(set(tracker.getJobIdsForGroup(None)) - before)


def test_a_query_is_only_a_plan_until_it_is_asked(spark):
    """No job runs and nothing is written while these queries are built."""
    assert _jobs_of_building(spark, ("orders_with_items", "order_totals", "customer_order_summary", "sales_report_monthly")) == 0


def test_building_a_running_sum_counts_its_keys_only(spark):
    """A running sum is built on the row counts of its keys; without a hot key nothing is
    sampled or written."""
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = sorted(os.listdir(folder))
    assert _jobs_of_building(spark, ("stock_ledger", "cart_state")) <= 6
    assert sorted(os.listdir(folder)) == before

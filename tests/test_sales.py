"""ST-3 with ST-4: the change log adds up to the report after all changes."""

import datetime as dt
import os
import random
import tempfile
from decimal import Decimal

import pytest

from shelfwise.plans.registry import ORACLE, QUERIES
from shelfwise.schemas import STATUS_CHANGES
from shelfwise.streaming import events as E
from shelfwise.streaming import jobs
from shelfwise.streaming import sales as S

from .compare import compare
from .conftest import SF01

ORDERS = "id long, created_at timestamp_ntz, total_amount decimal(10,2), status string"
STATUSES = ["pending", "confirmed", "shipped", "delivered", "cancelled"]


@pytest.mark.parametrize("name", ["sales_changelog", "sales_after_changes", "commit_orders_by_year"])
def test_queries(spark, duck, name):
    got = QUERIES[name](spark, SF01)
    assert not compare(got, duck, ORACLE[name]) and got.count() > 0


def feed(seed, orders=120, changes=400):
    rnd = random.Random(seed)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(24 * 20))      # noqa: E731
    placed = [(i, day(), Decimal(rnd.randrange(100, 99999)) / 100, rnd.choice(STATUSES)) for i in range(orders)]
    # a third of the changes is of one order; some are of orders that never come; ties in time
    changed = [(0 if rnd.random() < 0.33 else rnd.randrange(orders + 5), rnd.choice(STATUSES), rnd.choice([None, 1, 2]), day())
               for _ in range(changes)]
    return placed, changed


def expected(spark, placed, changed):
    orders = spark.createDataFrame([(i, t, a, s, t) for i, t, a, s in placed], ORDERS + ", updated_at timestamp_ntz")
    updated, _ = E.apply_status_changes(orders, spark.createDataFrame(changed, STATUS_CHANGES))
    return sorted(map(tuple, E.daily_sales(updated).collect()))


def test_batch_log_equals_the_report_of_updated_orders(spark):
    placed, changed = feed(1)
    log = S.sales_changes(spark.createDataFrame(placed, ORDERS), spark.createDataFrame(changed, STATUS_CHANGES))
    assert sorted(map(tuple, S.sales_now(log).collect())) == expected(spark, placed, changed)
    # an order starts and stops in turn
    steps = {}
    for r in log.orderBy("order_id", "effective").collect():
        steps[r.order_id] = steps.get(r.order_id, 0) + r.orders
    assert set(steps.values()) <= {0, 1}


def _files(spark, folder, parts, schema):
    for i, rows in enumerate(parts):
        d = os.path.join(folder, f"p{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(d)
        for f in os.listdir(d):
            os.utime(os.path.join(d, f), (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))


def test_stream_equals_batch_after_late_orders_and_changes(spark):
    """Orders after their changes, changes out of order, replayed orders; a batch written again."""
    placed, changed = feed(2)
    tmp = tempfile.mkdtemp(prefix="sw-sales-")
    rnd = random.Random(3)
    some = lambda rows, n: [[r for k, r in enumerate(rows) if k % n == i] for i in range(n)]
    rnd.shuffle(changed)
    _files(spark, f"{tmp}/orders", some(rnd.sample(placed, len(placed)), 4) + [placed[:10]], ORDERS)
    _files(spark, f"{tmp}/changes", some(changed, 3), STATUS_CHANGES)

    def run():
        q = jobs.start_running_sales(spark, f"{tmp}/orders", f"{tmp}/changes", f"{tmp}/log", f"{tmp}/ckpt",
                                     schema=spark.createDataFrame([], ORDERS).schema, max_files_per_trigger=1, trigger={"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None

    run()
    log = S.sales_log(spark, f"{tmp}/log")
    assert sorted(map(tuple, S.sales_now(log.read()).collect())) == expected(spark, placed, changed)
    assert log.commits().count() >= 3 and log.read().filter("orders < 0").count() > 0
    # a micro-batch that is written once more changes nothing
    S.sales_log_writer(log)(spark.createDataFrame([(19000, 5, 5)], S._DELTA), 0)
    assert sorted(map(tuple, S.sales_now(log.read()).collect())) == expected(spark, placed, changed)
    # the job goes on from its checkpoint: a change of every order, back to pending
    last = [(i, "pending", 1, dt.datetime(2025, 1, 1)) for i in range(120)]
    spark.createDataFrame(last, STATUS_CHANGES).coalesce(1).write.parquet(f"{tmp}/changes/p9")
    run()
    assert S.sales_now(log.read()).count() == 0


def test_no_rows(spark):
    none = S.sales_changes(spark.createDataFrame([], ORDERS), spark.createDataFrame([], STATUS_CHANGES))
    assert S.sales_now(none).collect() == []

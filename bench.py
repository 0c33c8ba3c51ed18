"""Benchmark: run the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERIES`` (comma list; default the headline set, ``all``
for every registered query).  Each query is executed completely with the
``noop`` sink (no collect), after one untimed warm-up query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sales_report_monthly", "sales_report_daily", "dashboard", "top_selling",
    "top_selling_sales_only", "customer_order_summary", "customers", "catalog",
    "orders_with_items", "order_totals", "stock_ledger", "admit_orders_half_demand",
    "cart_state", "over_limit_daily", "apply_status_changes_orders",
    "dq_duplicate_order_product", "upsert_users_by_email", "delete_inactive_users_cascade",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from shelfwise.plans.registry import QUERIES
    from shelfwise.session import ensure_checkpoint_dir, get_session

    wanted = os.environ.get("BENCH_QUERIES", "")
    names = sorted(QUERIES) if wanted == "all" else (
        [n for n in wanted.split(",") if n] or HEADLINE)
    unknown = [n for n in names if n not in QUERIES]
    if unknown:
        sys.exit(f"unknown queries in BENCH_QUERIES: {unknown}")

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=cpus,
                        app_name="shelfwise-bench",
                        extra={"spark.driver.memory": "16g"})
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="shelfwise-bench-ckpt-"))

    # A warm-up query (JVM, Python workers); every query reads the given tables.
    QUERIES["order_kpis"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 64, 1, cpus).mapInPandas(lambda it: it, "id long") \
        .write.format("noop").mode("overwrite").save()   # Python workers

    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

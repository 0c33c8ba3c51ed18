import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from shelfwise.schemas import SOURCE_SCHEMAS
from shelfwise.sources.adapters import shop_tables
from shelfwise.streaming import events as E

from .conftest import SF001


def _run(df, mode, name, tmp, trigger_files=None):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(tmp, "ckpt-" + name))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return q


def _event_files(spark, tmp, n_files=4):
    """Split the sf0.001 events by time into several files (in time order)."""
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = os.path.join(tmp, "events")
    bounds = ev.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()[0]
    step = (bounds.b - bounds.a) / n_files
    for i in range(n_files):
        d = os.path.join(src, f"part{i}")
        lo = bounds.a + step * i
        hi = bounds.a + step * (i + 1) if i < n_files - 1 else bounds.b + dt.timedelta(seconds=1)
        (ev.filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).coalesce(1)
         .write.parquet(d))
        for f in os.listdir(d):
            os.utime(os.path.join(d, f), (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    return src, ev


def _stream(spark, src, schema, files_per_trigger=1):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", "true").parquet(src))


def test_over_limit_stream_equals_batch(spark):
    tmp = tempfile.mkdtemp(prefix="sw-st1-")
    src, ev = _event_files(spark, tmp)
    stream = _stream(spark, src, SOURCE_SCHEMAS["events"])
    out = E.over_limit_stream(stream, "user_id", 2, "1 day", watermark="3650 days")
    q = _run(out, "update", "st1", tmp)
    got = spark.sql("SELECT window_start, user_id, max(n) AS n FROM st1 GROUP BY 1, 2")
    exp = E.over_limit(ev, "user_id", 2, "1 day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
    assert q.lastProgress is not None


def test_watermark_drops_late_rows(spark):
    # Spark only promises to drop a late row once its window's state has
    # been finalised and evicted; the late row here arrives after that.
    tmp = tempfile.mkdtemp(prefix="sw-late-")
    schema = SOURCE_SCHEMAS["events"]
    src = os.path.join(tmp, "ev")
    batches = [
        [(1, dt.datetime(2024, 1, 10, 0, 0, 1), 1, "click", 0.0, None),
         (2, dt.datetime(2024, 1, 10, 0, 0, 2), 1, "click", 0.0, None)],
        [(3, dt.datetime(2024, 1, 12, 0, 0, 0), 1, "click", 0.0, None)],
        [(4, dt.datetime(2024, 1, 12, 0, 30, 0), 1, "click", 0.0, None)],
        [(5, dt.datetime(2024, 1, 10, 0, 0, 3), 1, "click", 0.0, None)],   # late
        [(6, dt.datetime(2024, 1, 14, 0, 0, 0), 1, "click", 0.0, None)],
    ]
    for i, rows in enumerate(batches):
        d = os.path.join(src, f"p{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(d)
        for f in os.listdir(d):   # the file source reads files in modification-time order
            os.utime(os.path.join(d, f), (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    stream = _stream(spark, src, schema)
    out = E.over_limit_stream(stream, "user_id", 0, "1 minute", watermark="1 hour")
    q = _run(out, "append", "late", tmp)
    got = [(r.window_start, r.n) for r in spark.sql("SELECT * FROM late").collect()]
    first_minute = [n for w, n in got if w == dt.datetime(2024, 1, 10, 0, 0)]
    assert first_minute == [2]          # emitted once; the late third row is not in it
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0)
                  for p in q.recentProgress if p["stateOperators"])
    assert dropped >= 1


def test_cart_state_stream_equals_batch(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    tmp = tempfile.mkdtemp(prefix="sw-st2-")
    src, ev = _event_files(spark, tmp, n_files=3)
    stream = _stream(spark, src, SOURCE_SCHEMAS["events"])
    _run(E.cart_state_stream(stream), "update", "st2", tmp)
    got = {r.user_id: r.cart_items for r in spark.sql(
        "SELECT user_id, max_by(cart_items, _order) AS cart_items FROM "
        "(SELECT *, monotonically_increasing_id() AS _order FROM st2) GROUP BY user_id").collect()}
    exp = {r.user_id: r.cart_items for r in E.cart_state(ev).collect()}
    assert got == exp


def test_cart_fold_matches_loop(spark):
    from shelfwise.streaming.cart_processor import fold
    import numpy as np
    import random
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randint(0, 30)
        d = [rnd.choice([1, -1, 0]) for _ in range(n)]
        c = [1 if rnd.random() < 0.1 else 0 for _ in range(n)]
        d = [0 if ci else di for di, ci in zip(d, c)]
        start = rnd.randint(0, 4)
        x = start
        for di, ci in zip(d, c):
            x = 0 if ci else max(x + di, 0)
        assert fold(start, np.array(d, dtype=np.int64), np.array(c, dtype=np.int64)) == x


def test_stream_sales_equals_batch(spark):
    tmp = tempfile.mkdtemp(prefix="sw-st3-")
    orders = shop_tables(spark, SF001).orders
    src = os.path.join(tmp, "orders")
    orders.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(src)
    _run(E.stream_sales(stream, watermark="36500 days"), "update", "st3", tmp)
    got = spark.sql("SELECT date, max(orders) AS orders, max_by(revenue, orders) AS revenue "
                    "FROM st3 GROUP BY date")
    exp = E.daily_sales(orders)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_status_changes_foreach_batch_replay_safe(spark):
    tmp = tempfile.mkdtemp(prefix="sw-st4-")
    changes = shop_tables(spark, SF001).status_changes
    src = os.path.join(tmp, "changes")
    changes.repartition(2).write.parquet(src)
    log_path = os.path.join(tmp, "log")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(src)
    state_path = os.path.join(tmp, "state")
    writer = E.status_change_batch_writer(log_path, state_path)
    q = (stream.writeStream.foreachBatch(writer)
         .option("checkpointLocation", os.path.join(tmp, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    rows = lambda df: sorted(map(tuple, df.select("admin_id", "action", "details", "created_at").collect()), key=str)
    want = rows(E.activity_log(changes))
    assert rows(spark.read.parquet(log_path)) == want
    # the orders that the stream leaves are those of the batch form
    orders = shop_tables(spark, SF001).orders
    now = lambda: sorted(map(tuple, E.orders_now(orders, state_path).select("id", "status", "updated_at").collect()))
    batch = sorted(map(tuple, E.apply_status_changes(orders, changes)[0].select("id", "status", "updated_at").collect()))
    assert now() == batch
    # a replayed batch replaces its own output
    last = max(int(x.split("=")[1]) for x in os.listdir(log_path) if x.startswith("batch="))
    again = spark.read.parquet(os.path.join(src, sorted(x for x in os.listdir(src) if x.endswith(".parquet"))[0]))
    n = again.count()
    writer(again, last)
    assert spark.read.parquet(f"{log_path}/batch={last}").count() == n


def test_two_events_within_a_millisecond(spark):
    """Add, then clear, 300 microseconds apart, with ids the other way round."""
    import datetime as dt

    tmp = tempfile.mkdtemp(prefix="sw-us-")
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0, 100)
    ev = spark.createDataFrame([(1, t0 + dt.timedelta(microseconds=300), 5, "purchase", 1.0, "{}"), (2, t0, 5, "click", 1.0, "{}"),
                                (3, t0 + dt.timedelta(seconds=1), 6, "click", 1.0, "{}")],
                               "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    ev.coalesce(1).write.parquet(os.path.join(tmp, "ev"))
    from shelfwise.streaming import jobs
    q = jobs.start_cart_state(spark, os.path.join(tmp, "ev"), f"{tmp}/cart", f"{tmp}/ck", watermark="0 seconds",
                              schema=ev.schema, trigger={"availableNow": True})
    q.awaitTermination(300)
    want = {r.user_id: r.cart_items for r in E.cart_state(ev).collect()}
    got = {r.user_id: r.cart_items for r in jobs.latest(spark, f"{tmp}/cart", "user_id").collect()}
    assert got == want and want[5] == 0


def test_stream_jobs_to_sinks(spark):
    from shelfwise.streaming import jobs

    tmp = tempfile.mkdtemp(prefix="sw-jobs-")
    src, ev = _event_files(spark, tmp, n_files=3)
    q = jobs.start_cart_state(spark, src, f"{tmp}/cart", f"{tmp}/ck-cart", watermark="0 seconds",
                              max_files_per_trigger=1, trigger={"availableNow": True})
    q.awaitTermination(300)
    got = {r.user_id: r.cart_items for r in jobs.latest(spark, f"{tmp}/cart", "user_id").collect()}
    assert got == {r.user_id: r.cart_items for r in E.cart_state(ev).collect()}

    product = F.get_json_object("props", "$.k").cast("long")
    q = jobs.start_cart_lines(spark, src, f"{tmp}/lines", f"{tmp}/ck-lines", product=product,
                              watermark="0 seconds", max_files_per_trigger=1,
                              trigger={"availableNow": True})
    q.awaitTermination(300)
    lines = {(r.user_id, r.product_id): r.quantity for r in
             jobs.latest(spark, f"{tmp}/lines", ["user_id", "product_id"]).collect() if r.quantity > 0}
    assert lines == {(r.user_id, r.product_id): r.quantity
                     for r in E.cart_lines_state(ev, product).collect()}

    q = jobs.start_over_limit(spark, src, f"{tmp}/limit", f"{tmp}/ck-limit", limit=1,
                              window="1 minute", watermark="1 minute",
                              max_files_per_trigger=1, trigger={"availableNow": True})
    q.awaitTermination(300)
    written = spark.read.parquet(f"{tmp}/limit")
    batch = E.over_limit(ev, "user_id", 1, "1 minute")
    # finished windows only, each written once, and equal to the batch rows
    assert written.count() == written.distinct().count()
    assert written.join(batch, ["window_start", "user_id", "n"], "left_anti").count() == 0

    orders = shop_tables(spark, SF001).orders
    osrc = f"{tmp}/orders"
    orders.repartition(2).write.parquet(osrc)
    q = jobs.start_stream_sales(spark, osrc, f"{tmp}/sales", f"{tmp}/ck-sales",
                                schema=orders.schema, watermark="36500 days",
                                max_files_per_trigger=1, trigger={"availableNow": True})
    q.awaitTermination(300)
    got = sorted(map(tuple, jobs.latest(spark, f"{tmp}/sales", "date").collect()))
    assert got == sorted(map(tuple, E.daily_sales(orders).collect()))


def test_cart_stream_ordered_handles_out_of_order(spark):
    import random
    tmp = tempfile.mkdtemp(prefix="sw-st2o-")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    rows = sorted(ev.collect(), key=lambda r: (r.ts, r.event_id))
    # four files in time order, but each row may arrive one file early or late
    rnd = random.Random(4)
    n = len(rows)
    parts = [[] for _ in range(4)]
    for i, r in enumerate(rows):
        b = min(3, max(0, i * 4 // n + rnd.choice([-1, 0, 0, 1])))
        parts[b].append(r)
    src = os.path.join(tmp, "events")
    span = rows[-1].ts - rows[0].ts
    for i, p in enumerate(parts):
        d = os.path.join(src, f"p{i}")
        spark.createDataFrame(p, ev.schema).coalesce(1).write.parquet(d)
        for f in os.listdir(d):
            os.utime(os.path.join(d, f), (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    delay_s = int(span.total_seconds() // 2) + 1          # covers one file of disorder
    stream = _stream(spark, src, SOURCE_SCHEMAS["events"])
    out = E.cart_state_stream_ordered(stream, watermark=f"{delay_s} seconds")
    _run(out, "update", "st2o", tmp)
    got = {r.user_id: r.cart_items for r in spark.sql(
        "SELECT user_id, max_by(cart_items, _o) AS cart_items FROM "
        "(SELECT *, monotonically_increasing_id() AS _o FROM st2o) GROUP BY user_id").collect()}
    # finalised = events at or before the last watermark (max ts - delay)
    import datetime as _dt
    cutoff = rows[-1].ts - _dt.timedelta(seconds=delay_s)
    final = ev.filter(F.col("ts") <= F.lit(cutoff))
    exp = {r.user_id: r.cart_items for r in E.cart_state(final).collect()}
    assert {k: v for k, v in got.items() if k in exp} == exp


def test_cart_lines_state_matches_loop(spark):
    import random
    rnd = random.Random(8)
    rows = []
    for i in range(1500):
        user = 0 if rnd.random() < 0.4 else rnd.randint(1, 6)        # user 0 is hot
        kind = rnd.choice(["click", "click", "click", "error", "error", "remove", "purchase", "view"])
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 5000)),
                     user, kind, rnd.randint(0, 4)))
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, "
                                     "event_type string, product_id long")
    cart = {}
    for eid, ts, user, kind, prod in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "purchase":
            cart = {k: v for k, v in cart.items() if k[0] != user}
        elif kind == "remove":
            cart.pop((user, prod), None)
        elif kind == "click":
            cart[(user, prod)] = cart.get((user, prod), 0) + 1
        elif kind == "error":
            q = cart.get((user, prod), 0) - 1
            if q <= 0:
                cart.pop((user, prod), None)
            else:
                cart[(user, prod)] = q
    got = {(r.user_id, r.product_id): r.quantity for r in
           E.cart_lines_state(ev, "product_id", remove_line="remove").collect()}
    assert got == cart


def test_cart_lines_stream_equals_batch(spark):
    tmp = tempfile.mkdtemp(prefix="sw-lines-")
    src, ev = _event_files(spark, tmp, n_files=3)
    product = F.get_json_object("props", "$.k").cast("long")
    stream = _stream(spark, src, SOURCE_SCHEMAS["events"])
    _run(E.cart_lines_stream(stream, product, watermark="0 seconds"), "update", "lines", tmp)
    got = {(r.user_id, r.product_id): r.quantity for r in spark.sql(
        "SELECT user_id, product_id, max_by(quantity, _o) AS quantity FROM "
        "(SELECT *, monotonically_increasing_id() AS _o FROM lines) "
        "GROUP BY user_id, product_id").collect() if r.quantity > 0}
    exp = {(r.user_id, r.product_id): r.quantity for r in E.cart_lines_state(ev, product).collect()}
    assert got == exp


def test_stream_sales_drops_late_orders(spark):
    from decimal import Decimal
    tmp = tempfile.mkdtemp(prefix="sw-st3late-")
    schema = ("id long, user_id long, total_amount decimal(10,2), status string, "
              "created_at timestamp_ntz")
    d = lambda day, h=12: dt.datetime(2024, 1, day, h)
    batches = [
        [(1, 1, Decimal("10.00"), "confirmed", d(1)), (2, 1, Decimal("5.00"), "shipped", d(1, 13))],
        [(3, 1, Decimal("7.00"), "delivered", d(3))],          # moves the watermark past day 1
        [(4, 1, Decimal("1.00"), "delivered", d(3, 13))],
        [(5, 1, Decimal("99.00"), "confirmed", d(1, 14))],     # late for day 1: dropped
        [(6, 1, Decimal("2.00"), "confirmed", d(5))],
    ]
    src = os.path.join(tmp, "orders")
    for i, rows in enumerate(batches):
        p = os.path.join(src, f"p{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(p)
        for f in os.listdir(p):
            os.utime(os.path.join(p, f), (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    stream = _stream(spark, src, spark.createDataFrame([], schema).schema)
    _run(E.stream_sales(stream, watermark="1 day"), "update", "late_sales", tmp)
    latest = {r.date: (r.orders, r.revenue) for r in spark.sql(
        "SELECT date, max_by(orders, _o) AS orders, max_by(revenue, _o) AS revenue FROM "
        "(SELECT *, monotonically_increasing_id() AS _o FROM late_sales) GROUP BY date").collect()}
    assert latest[dt.date(2024, 1, 1)] == (2, Decimal("15.00"))
    assert latest[dt.date(2024, 1, 3)] == (2, Decimal("8.00"))

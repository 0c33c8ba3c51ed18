"""Event operators (ST-1..ST-4): each has a batch form (the oracle) and a
Structured Streaming form.

* ST-1 ``over_limit``: callers over a request limit per tumbling window.
* ST-2 ``cart_state``: cart size per user from add / remove / clear events,
  never below zero.
* ST-3 ``stream_sales``: running daily sales from an order stream.
* ST-4 ``apply_status_changes``: last-write-wins status changes plus one
  activity-log row per change; the stream form writes each micro-batch by
  its batch id, so a replayed batch overwrites instead of duplicating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed import (CUSTOMER_STATUS_ACTION, CUSTOMER_STATUS_DETAILS,  # noqa: F401
                             ORDER_STATUS_ACTION, ORDER_STATUS_DETAILS, ROUTE_LIMITS)
from shelfwise.functions.expressions import is_sale
from shelfwise.operators.maintenance import apply_updates, latest_changes
from shelfwise.operators.scan import running_sum
from shelfwise.schemas import MONEY_SUM

# Event types of the cart fold (FIXTURES section 3): add one, remove one, clear.
CART_ADD, CART_REMOVE, CART_CLEAR = "click", "error", "purchase"


MAX_ROUTES = 10_000


# ---------------------------------------------------------------- ST-1
def over_limit(events: DataFrame, key: str = "user_id", limit: int = 5,
               window: str = "1 minute", ts: str = "ts", route: str | None = None) -> DataFrame:
    """ST-1: ``(window_start, key[, route], n)`` for every key that made more
    than ``limit`` calls in a tumbling window.  Works unchanged on a stream
    after ``withWatermark`` (see :func:`over_limit_stream`)."""
    groups = [F.window(F.col(ts), window).alias("w"), F.col(key)]
    if route:
        groups.append(F.col(route))
    counted = events.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    cols = [F.col("w.start").alias("window_start"), key] + ([route] if route else []) + ["n"]
    return counted.filter(F.col("n") > limit).select(*cols)


def over_route_limits(events: DataFrame, limits: dict[str, int], key: str = "user_id",
                      route: str = "route", window: str = "1 minute", ts: str = "ts") -> DataFrame:
    """ST-1 with a limit per route (the shop allows 5 registrations, 10
    log-ins, 3 password requests, ... per minute).  The limits table has one
    row per route, at most ``MAX_ROUTES``, so it is broadcast; routes without
    a limit are not checked."""
    if len(limits) > MAX_ROUTES:
        raise ValueError(f"at most {MAX_ROUTES} routes")
    spark = events.sparkSession
    lim = spark.createDataFrame([(r, int(n)) for r, n in limits.items()],
                                f"{route} string, _limit int")
    counted = (events.join(F.broadcast(lim), route, "inner")
               .groupBy(F.window(F.col(ts), window).alias("w"), F.col(key), F.col(route), "_limit")
               .agg(F.count(F.lit(1)).alias("n")))
    return counted.filter(F.col("n") > F.col("_limit")).select(
        F.col("w.start").alias("window_start"), key, route, "n")


def over_limit_stream(stream: DataFrame, key: str = "user_id", limit: int = 5,
                      window: str = "1 minute", ts: str = "ts",
                      watermark: str = "10 minutes", route: str | None = None) -> DataFrame:
    """ST-1 as a stream: events later than the watermark are dropped; in
    append mode each window is emitted once, when it closes.

    Watermarks need a ``timestamp`` event time; a ``timestamp_ntz`` column is
    read as wall-clock time in the session zone (UTC) and the window start is
    given back as ``timestamp_ntz``, as in the batch form."""
    timed = _event_time(stream, ts).withWatermark(ts, watermark)
    out = over_limit(timed, key, limit, window, ts, route)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    from pyspark.sql import types as T
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


# ---------------------------------------------------------------- ST-2
def cart_deltas(events: DataFrame, add=CART_ADD, remove=CART_REMOVE, clear=CART_CLEAR) -> DataFrame:
    et = F.col("event_type")
    return events.select(
        "user_id", "ts", "event_id",
        F.when(et == add, 1).when(et == remove, -1).otherwise(0).cast("long").alias("delta"),
        (et == clear).cast("long").alias("clear"))


def cart_state(events: DataFrame, **types) -> DataFrame:
    """ST-2 (batch): items in each user's cart after all events, in
    ``(ts, event_id)`` order, where add = +1, remove = -1 (never below 0) and
    clear empties the cart.

    The clamped fold ``x = max(x + d, 0)`` equals ``S - min(0, min prefix S)``
    within each run of events between clears (S = running sum of ``d``).  So
    one skew-safe scan gives the running sums ``R`` and clear counts ``C``
    per user, and the rest are mergeable aggregates per ``(user, C)``: no
    user's events are ever gathered in one place.
    """
    d = cart_deltas(events, **types)
    run = running_sum(d, ["user_id"], ["ts", "event_id"], ["delta", "clear"], ["R", "C"], counted=events)
    order = F.struct("ts", "event_id")
    seg = run.groupBy("user_id", "C").agg(
        F.sum("delta").alias("D"),
        F.min("R").alias("minR"),
        F.min_by(F.col("R") - F.col("delta"), order).alias("base"))
    value = F.col("D") - F.least(F.col("minR") - F.col("base"), F.lit(0))
    return (seg.select("user_id", "C", value.alias("v"))
            .groupBy("user_id").agg(F.max_by("v", "C").cast("long").alias("cart_items")))


def cart_lines_state(events: DataFrame, product="product_id", add=CART_ADD,
                     remove=CART_REMOVE, clear=CART_CLEAR,
                     remove_line: str | None = None) -> DataFrame:
    """ST-2 per cart line: ``(user_id, product, quantity)`` after all events.

    ``add`` adds one of the product, ``remove`` takes one away (a line at zero
    is removed, and cannot go below zero), ``remove_line`` drops the line,
    ``clear`` empties the user's whole cart.  ``product`` is a column name or
    a Column (e.g. parsed from the event's properties).

    Only the events after a line's last reset count, the later of the user's last
    clear and the line's last removal: those with no reset behind them, by running
    sums from the newest event back.  From there the clamped fold is
    ``S - min(0, min prefix S)``.  All sums are :func:`running_sum`, so neither a
    hot user nor a hot product is gathered in one task.
    """
    from pyspark.sql import Column

    prod = product if isinstance(product, Column) else F.col(product)
    et = F.col("event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = events.select("user_id", prod.alias("_product"), "ts", "event_id", "event_type",
                       (-micros).alias("_back"), (-F.col("event_id")).alias("_id"), (et == clear).cast("long").alias("_clear"))
    ev = running_sum(ev, ["user_id"], ["_back", "_id"], ["_clear"], ["_resets"], counted=events)
    kinds = [add, remove] + ([remove_line] if remove_line else [])
    after = ev.filter(F.col("_product").isNotNull() & et.isin(*kinds) & (F.col("_resets") == 0))
    pairs = events.select("user_id", prod.alias("_product"))
    if remove_line:
        after = running_sum(after.withColumn("_drop", (et == remove_line).cast("long")), ["user_id", "_product"],
                            ["_back", "_id"], ["_drop"], ["_drops"], counted=pairs).filter(F.col("_drops") == 0)
    d = after.select("user_id", "_product", "ts", "event_id",
                     F.when(et == add, 1).when(et == remove, -1).otherwise(0).cast("long").alias("delta"))
    run = running_sum(d, ["user_id", "_product"], ["ts", "event_id"], ["delta"], ["R"], counted=pairs)
    seg = run.groupBy("user_id", "_product").agg(F.sum("delta").alias("D"), F.min("R").alias("minR"))
    qty = (F.col("D") - F.least(F.col("minR"), F.lit(0))).cast("long")
    name = product if isinstance(product, str) else "product_id"
    return seg.select("user_id", F.col("_product").alias(name), qty.alias("quantity")) \
        .filter(F.col("quantity") > 0)


def cart_lines_stream(stream: DataFrame, product="product_id", watermark: str = "10 minutes",
                      add=CART_ADD, remove=CART_REMOVE, clear=CART_CLEAR,
                      remove_line: str | None = None) -> DataFrame:
    """ST-2 per cart line as an event-time exact stream (keyed by user, map
    state per product): emits changed lines, a removed line with quantity 0.
    The latest row per (user, product) with quantity > 0 equals
    :func:`cart_lines_state` over the events the watermark has passed."""
    from pyspark.sql import Column

    from shelfwise.streaming.cart_processor import (ADD, CLEAR, LINES_OUTPUT_SCHEMA, REMOVE,
                                                    REMOVE_LINE, OrderedCartLinesProcessor)

    prod = product if isinstance(product, Column) else F.col(product)
    et = F.col("event_type")
    kind = (F.when(et == add, ADD).when(et == remove, REMOVE).when(et == clear, CLEAR))
    if remove_line:
        kind = kind.when(et == remove_line, REMOVE_LINE)
    timed = _event_time(stream, "ts").withWatermark("ts", watermark)
    ev = (timed.select("user_id", "ts", "event_id", prod.cast("long").alias("product_id"),
                       kind.cast("int").alias("kind"))
          .filter(F.col("kind").isNotNull()
                  & (F.col("product_id").isNotNull() | (F.col("kind") == CLEAR))))
    return ev.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=OrderedCartLinesProcessor(), outputStructType=LINES_OUTPUT_SCHEMA,
        outputMode="Update", timeMode="EventTime")


def cart_state_stream_ordered(stream: DataFrame, watermark: str = "10 minutes",
                              **types) -> DataFrame:
    """ST-2 as an event-time exact stream: events are buffered in list state
    until the watermark passes them and then folded in order (timers finish
    the fold without new input), so events that arrive out of order within
    the watermark delay give the batch result.  Needs a ``timestamp`` event
    time (``timestamp_ntz`` is read in the session zone)."""
    from shelfwise.streaming.cart_processor import OUTPUT_SCHEMA, OrderedCartProcessor

    timed = _event_time(stream, "ts").withWatermark("ts", watermark)
    d = cart_deltas(timed, **types)
    return d.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=OrderedCartProcessor(), outputStructType=OUTPUT_SCHEMA,
        outputMode="Update", timeMode="EventTime")


def cart_state_stream(stream: DataFrame, **types) -> DataFrame:
    """ST-2 as a stream: one value state per user, updated with the clamped
    fold in event order within each micro-batch (``transformWithStateInPandas``
    keyed by user).  Batches must arrive in time order per user (feed the
    source in time order); the batch form is exact for any order."""
    from shelfwise.streaming.cart_processor import CartProcessor, OUTPUT_SCHEMA

    d = cart_deltas(stream, **types)
    return d.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=CartProcessor(), outputStructType=OUTPUT_SCHEMA,
        outputMode="Update", timeMode="None")


# ---------------------------------------------------------------- ST-3
def daily_sales(orders: DataFrame) -> DataFrame:
    """ST-3 (batch): sale orders and revenue per calendar day, all time."""
    return (orders.filter(is_sale())
            .groupBy(F.window("created_at", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.sum("total_amount").cast(MONEY_SUM).alias("revenue"))
            .select(F.to_date(F.col("w.start")).alias("date"), "orders", "revenue"))


def stream_sales(orders_stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """ST-3 as a stream: the same daily windows with a watermark; in update
    mode each trigger emits the days that changed."""
    return daily_sales(_event_time(orders_stream, "created_at").withWatermark("created_at", watermark))


# ---------------------------------------------------------------- ST-4
def activity_log(changes: DataFrame) -> DataFrame:
    """One activity row per status change, worded as the shop words it."""
    return changes.select(
        F.col("admin_id"),
        F.format_string(ORDER_STATUS_ACTION, F.col("order_id").cast("string")).alias("action"),
        F.format_string(ORDER_STATUS_DETAILS, F.col("status")).alias("details"),
        F.lit(None).cast("string").alias("ip_address"),
        F.col("ts").alias("created_at"))


def apply_status_changes(orders: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST-4 (batch): orders with the last change per order applied
    (``status``, ``updated_at = ts`` of that change) and the activity log."""
    last = latest_changes(changes.select("order_id", "ts", "status", "admin_id"),
                          "order_id", "ts", tiebreak=("status", "admin_id"))
    updated = apply_updates(orders, last.withColumnRenamed("order_id", "id"), "id",
                            ["status"], as_of="ts")
    return updated, activity_log(changes)


def apply_user_status_changes(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customer status changes (``user_id, status, admin_id, ts``): the last
    change per user is applied and each change writes one activity row,
    worded as the shop words it."""
    last = latest_changes(changes.select("user_id", "ts", "status", "admin_id"),
                          "user_id", "ts", tiebreak=("status", "admin_id"))
    updated = apply_updates(users, last.withColumnRenamed("user_id", "id"), "id",
                            ["status"], as_of="ts")
    log = changes.select(
        F.col("admin_id"),
        F.format_string(CUSTOMER_STATUS_ACTION, F.col("user_id").cast("string")).alias("action"),
        F.format_string(CUSTOMER_STATUS_DETAILS, F.col("status")).alias("details"),
        F.lit(None).cast("string").alias("ip_address"),
        F.col("ts").alias("created_at"))
    return updated, log


def block_over_limit(users: DataFrame, events: DataFrame, limit: int = 5,
                     window: str = "1 day", admin_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ST-1 feeding the customer status change: every user over the limit
    in a window is set to ``blocked`` (one change per offending window)."""
    hits = over_limit(events, "user_id", limit, window)
    changes = hits.select("user_id", F.lit("blocked").alias("status"),
                          F.lit(admin_id).cast("long").alias("admin_id"),
                          F.col("window_start").alias("ts"))
    return apply_user_status_changes(users, changes)


def status_change_batch_writer(log_path: str, state_path: str | None = None):
    """ST-4 as a stream: a ``foreachBatch`` function that writes each
    micro-batch's activity rows to ``log_path/batch=<id>`` with overwrite, so a
    replayed batch (after a failure) replaces its own output.

    With ``state_path`` each batch also writes a new version of the last change
    per order, ``state_path/v=<id>``: that of the version before with the batch
    folded in.  :func:`orders_now` applies the newest version to the orders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        activity_log(batch).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        if state_path is not None:
            changes = batch.select("order_id", "ts", "status", "admin_id")
            if batch_id > 0:
                earlier = batch.sparkSession.read.schema(changes.schema).parquet(f"{state_path}/v={batch_id - 1}")
                changes = changes.unionByName(earlier)
            last = latest_changes(changes, "order_id", "ts", tiebreak=("status", "admin_id"))
            last.write.mode("overwrite").parquet(f"{state_path}/v={batch_id}")

    return write


def orders_now(orders: DataFrame, state_path: str) -> DataFrame:
    """ST-4: ``orders`` with the newest version of the last changes applied."""
    versions = orders.sparkSession.read.parquet(state_path)
    newest = versions.agg(F.max("v")).first()[0]
    return apply_status_changes(orders, versions.filter(F.col("v") == newest))[0]

"""ST-3 with ST-4: sales by day that follow the orders' status.

An order counts on the day it was placed while its status is one of the sale
statuses.  Its status is that of its last change by ``(ts, status, admin_id)``, or
the one it was placed with.  Each time it starts or stops to count, one row
``(date, orders, revenue)`` of +1 or -1 order goes to a change log; the sum of the
log is the report, after any mix of late orders, late changes and replays.

Batch and stream keep the same rule.  The stream holds one small state per order
(a change may come before its order), so no order, day or customer is gathered in
one place, and each micro-batch's log rows are committed once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfwise.fixed import SALE_STATUSES
from shelfwise.functions.expressions import is_sale
from shelfwise.operators.scan import row_number_within
from shelfwise.schemas import MONEY_SUM
from shelfwise.sources.committed import CommittedTable

LOG_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("orders", T.LongType()),
                           T.StructField("revenue", MONEY_SUM)])


def sales_changes(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Batch: every start and stop of an order as a sale, ``(order_id, effective, date,
    orders, revenue)``; ``effective`` is the day of the change, or that of the order."""
    placed = orders.select(F.col("id").alias("order_id"), "created_at", "total_amount", "status",
                           F.lit(0).alias("step"), F.col("created_at").alias("ts"), F.lit(None).cast("long").alias("admin_id"))
    known = orders.select(F.col("id").alias("order_id"), "created_at", "total_amount")
    later = changes.select("order_id", "status", "ts", "admin_id").join(known, "order_id") \
        .select("order_id", "created_at", "total_amount", "status", F.lit(1).alias("step"), "ts", "admin_id")
    steps = row_number_within(placed.unionByName(later), ["order_id"], ["step", "ts", "status", "admin_id"], "n",
                              counted=changes).withColumn("sale", is_sale().cast("long"))
    before = steps.select("order_id", (F.col("n") + 1).alias("n"), F.col("sale").alias("was"))
    turn = F.coalesce("sale", F.lit(0)) - F.coalesce("was", F.lit(0))
    return steps.join(before, ["order_id", "n"], "left").withColumn("turn", turn).filter("turn != 0").select(
        "order_id", F.to_date("ts").alias("effective"), F.to_date("created_at").alias("date"), F.col("turn").cast("long").alias("orders"),
        (F.col("turn") * F.coalesce("total_amount", F.lit(0))).cast(MONEY_SUM).alias("revenue"))


def sales_now(log: DataFrame) -> DataFrame:
    """The report that a change log adds up to: ``date, orders, revenue``."""
    return log.groupBy("date").agg(F.sum("orders").cast("long").alias("orders"), F.sum("revenue").cast(MONEY_SUM).alias("revenue")) \
        .filter("orders != 0")


_STATE = T.StructType([
    T.StructField("day", T.IntegerType()), T.StructField("cents", T.LongType()), T.StructField("placed", T.BooleanType()),
    T.StructField("placed_sale", T.BooleanType()), T.StructField("changed", T.BooleanType()), T.StructField("ts_us", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("admin", T.LongType()), T.StructField("counted", T.BooleanType())])
_DELTA = T.StructType([T.StructField("day", T.IntegerType()), T.StructField("orders", T.LongType()), T.StructField("cents", T.LongType())])
_NO_ADMIN = -(1 << 63)          # a change without one comes before any other of its time and status


class SaleProcessor(StatefulProcessor):
    """State of one order: where it stands and whether it is counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order = handle.getValueState("order", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        day, cents, placed, placed_sale, changed, ts, status, admin, counted = \
            self.order.get() if self.order.exists() else (0, 0, False, False, False, 0, "", _NO_ADMIN, False)
        for batch in rows:
            for is_order, d, c, s, t, a in zip(batch["is_order"], batch["day"], batch["cents"], batch["status"], batch["ts_us"], batch["admin"]):
                if is_order:
                    if not placed:                  # a replayed order changes nothing
                        day, cents, placed, placed_sale = int(d), int(c), True, s in SALE_STATUSES
                elif not changed or (int(t), s, int(a)) > (ts, status, admin):
                    changed, ts, status, admin = True, int(t), s, int(a)
        sale = placed and (status in SALE_STATUSES if changed else placed_sale)
        turn = int(sale) - int(counted)
        self.order.update((day, cents, placed, placed_sale, changed, ts, status, admin, sale))
        yield pd.DataFrame({"day": [day] if turn else [], "orders": [turn] if turn else [], "cents": [turn * cents] if turn else []}) \
            .astype({"day": "int32", "orders": "int64", "cents": "int64"})

    def close(self) -> None:
        pass


def stream_sales_changes(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Streams of orders and of status changes: the log's rows of each micro-batch
    (``day`` in days since 1970, ``cents``; see :func:`log_rows`)."""
    none = lambda kind: F.lit(0).cast(kind)         # noqa: E731
    placed = orders.select(
        F.col("id").alias("order_id"), F.lit(True).alias("is_order"), F.unix_date(F.to_date("created_at")).alias("day"),
        F.coalesce((F.col("total_amount") * 100).cast("long"), F.lit(0)).alias("cents"), F.coalesce("status", F.lit("")).alias("status"),
        none("long").alias("ts_us"), none("long").alias("admin"))
    changed = changes.select(
        "order_id", F.lit(False).alias("is_order"), none("int").alias("day"), none("long").alias("cents"), "status",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.coalesce(F.col("admin_id").cast("long"), F.lit(_NO_ADMIN)).alias("admin"))
    return placed.unionByName(changed).groupBy("order_id").transformWithStateInPandas(
        statefulProcessor=SaleProcessor(), outputStructType=_DELTA, outputMode="Update", timeMode="None")


def log_rows(deltas: DataFrame) -> DataFrame:
    """One row for each day that a micro-batch changes, in the log's schema."""
    return deltas.groupBy("day").agg(F.sum("orders").alias("orders"), F.sum("cents").alias("cents")).select(
        F.date_from_unix_date("day").alias("date"), F.col("orders").cast("long").alias("orders"),
        (F.col("cents").cast("decimal(20,0)") / 100).cast(MONEY_SUM).alias("revenue")).filter("orders != 0 OR revenue != 0")


def sales_log(spark, path: str) -> CommittedTable:
    return CommittedTable(spark, path, schema=LOG_SCHEMA)


def sales_log_writer(log: CommittedTable):
    """For ``foreachBatch`` over :func:`stream_sales_changes`: a batch that is written
    again, after a failure, changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        log.append(log_rows(batch), f"sales-{batch_id}")
    return write

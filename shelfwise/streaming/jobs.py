"""Runnable Structured Streaming jobs: file source -> stream operator -> sink.

* Append-mode jobs (finished windows) write to the Parquet file sink, which is
  exactly-once through its checkpoint.
* Update-mode jobs (running values) write each micro-batch's changed rows to
  ``<sink>/batch=<id>`` with overwrite, so a replayed batch replaces its own
  output; :func:`latest` reads the newest value per key.

Every job needs a ``checkpoint`` location on shared storage and takes the
usual trigger keywords (``availableNow=True``, ``processingTime='1 minute'``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfwise.schemas import SOURCE_SCHEMAS, STATUS_CHANGES
from shelfwise.streaming import events as E
from shelfwise.streaming import limits as L
from shelfwise.streaming import sales as S


def _source(spark: SparkSession, path: str, schema: T.StructType,
            max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _batches_writer(sink: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    return write


def _start_update(out: DataFrame, sink: str, checkpoint: str, name: str,
                  trigger: dict | None) -> StreamingQuery:
    w = (out.writeStream.outputMode("update").foreachBatch(_batches_writer(sink))
         .option("checkpointLocation", checkpoint).queryName(name))
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def latest(spark: SparkSession, sink: str, key: str | list[str]) -> DataFrame:
    """The newest row per key written by an update-mode job (``max_by`` over
    the batch id: mergeable, no per-key gathering)."""
    keys = [key] if isinstance(key, str) else list(key)
    df = spark.read.parquet(sink)
    rest = [c for c in df.columns if c not in keys + ["batch"]]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r"))
            .select(*keys, "_r.*"))


def start_over_limit(spark: SparkSession, source: str, sink: str, checkpoint: str, *,
                     key: str = "user_id", limit: int = 5, window: str = "1 minute",
                     watermark: str = "10 minutes", schema: T.StructType | None = None,
                     max_files_per_trigger: int | None = None,
                     trigger: dict | None = None) -> StreamingQuery:
    """ST-1: finished windows with more than ``limit`` calls per key, appended
    to a Parquet table."""
    stream = _source(spark, source, schema or SOURCE_SCHEMAS["events"], max_files_per_trigger)
    out = E.over_limit_stream(stream, key, limit, window, watermark=watermark)
    w = (out.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).queryName("over_limit"))
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def start_over_moving_limit(spark: SparkSession, source: str, sink: str, checkpoint: str, *,
                            key: str = "user_id", limit: int | dict[str, int] = 5, window: str = "1 minute",
                            route: str | None = None, watermark: str = "10 minutes", schema: T.StructType | None = None,
                            max_files_per_trigger: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """ST-1 with moving windows: moments over the limit that the watermark has
    passed, appended to a Parquet table, each once."""
    stream = _source(spark, source, schema or SOURCE_SCHEMAS["events"], max_files_per_trigger)
    out = L.over_moving_limit_stream(stream, key, limit, window, route=route, watermark=watermark)
    w = (out.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).queryName("over_moving_limit"))
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def start_cart_state(spark: SparkSession, source: str, sink: str, checkpoint: str, *,
                     watermark: str = "10 minutes", schema: T.StructType | None = None,
                     max_files_per_trigger: int | None = None,
                     trigger: dict | None = None) -> StreamingQuery:
    """ST-2: cart size per user in event-time order: events out of order by
    less than ``watermark`` give the batch result (read with
    ``latest(spark, sink, 'user_id')``)."""
    stream = _source(spark, source, schema or SOURCE_SCHEMAS["events"], max_files_per_trigger)
    return _start_update(E.cart_state_stream_ordered(stream, watermark), sink, checkpoint,
                         "cart_state", trigger)


def start_cart_lines(spark: SparkSession, source: str, sink: str, checkpoint: str, *,
                     product="product_id", watermark: str = "10 minutes",
                     schema: T.StructType | None = None, max_files_per_trigger: int | None = None,
                     trigger: dict | None = None) -> StreamingQuery:
    """ST-2 per cart line: changed lines per micro-batch, a removed line with
    quantity 0 (read with ``latest(spark, sink, ['user_id', 'product_id'])``
    and keep quantity > 0)."""
    stream = _source(spark, source, schema or SOURCE_SCHEMAS["events"], max_files_per_trigger)
    return _start_update(E.cart_lines_stream(stream, product, watermark), sink, checkpoint,
                         "cart_lines", trigger)


def start_stream_sales(spark: SparkSession, source: str, sink: str, checkpoint: str, *,
                       schema: T.StructType, watermark: str = "2 days",
                       max_files_per_trigger: int | None = None,
                       trigger: dict | None = None) -> StreamingQuery:
    """ST-3: running daily sales from an order stream with the shop schema
    (read with ``latest(spark, sink, 'date')``)."""
    stream = _source(spark, source, schema, max_files_per_trigger)
    return _start_update(E.stream_sales(stream, watermark), sink, checkpoint, "daily_sales",
                         trigger)


def start_running_sales(spark: SparkSession, orders: str, changes: str, sink: str, checkpoint: str, *,
                        schema: T.StructType, changes_schema: T.StructType | None = None,
                        max_files_per_trigger: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """ST-3 with ST-4: daily sales that follow status changes, as a change log
    committed once per micro-batch (read with ``sales_now(sales_log(spark, sink).read())``)."""
    deltas = S.stream_sales_changes(_source(spark, orders, schema, max_files_per_trigger),
                                    _source(spark, changes, changes_schema or STATUS_CHANGES, max_files_per_trigger))
    w = (deltas.writeStream.outputMode("update").foreachBatch(S.sales_log_writer(S.sales_log(spark, sink)))
         .option("checkpointLocation", checkpoint).queryName("running_sales"))
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def start_status_changes(spark: SparkSession, source: str, log_sink: str, checkpoint: str, *,
                         state: str | None = None, schema: T.StructType | None = None,
                         max_files_per_trigger: int | None = None,
                         trigger: dict | None = None) -> StreamingQuery:
    """ST-4: one activity row per status change, written per micro-batch by
    batch id (replay-safe); with ``state`` also the last change per order, by
    version (read with ``events.orders_now``)."""
    stream = _source(spark, source, schema or STATUS_CHANGES, max_files_per_trigger)
    w = (stream.writeStream.foreachBatch(E.status_change_batch_writer(log_sink, state))
         .option("checkpointLocation", checkpoint).queryName("status_changes"))
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()

"""ST-1 with moving windows: calls over a limit at the moment they are made.

A call at time ``t`` is over the limit when its key made more than ``limit`` calls in
``(t - window, t]``, itself and the calls of the same moment included.  The result has
one row for each key and moment that is over, with the number of ``calls`` at that
moment and the number ``n`` in its window.

Batch: a call counts +1 at ``t`` and -1 at ``t + window``, so ``n`` is one running sum
over the moments of a key.  Calls and expiries of one moment are added up before the
shuffle, and :func:`running_sum` cuts a hot key at splitters.

Stream: each key keeps the calls of its last window and those that the watermark has
not passed, as a map from moment to calls.  When the watermark passes a moment its row
is emitted, once; what no later window reaches is deleted, and an event-time timer does
both where no further call comes.  Calls behind the watermark are dropped.

Defined cases: a null key is a key of its own; a call without time is in no window; a
route without a limit is not checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfwise.operators.scan import ROWS, running_sum
from shelfwise.streaming.events import MAX_ROUTES


def window_micros(window: str) -> int:
    """A length of time such as ``1 minute`` in microseconds."""
    micros = pd.Timedelta(window) // pd.Timedelta(microseconds=1)
    if micros <= 0:
        raise ValueError(f"a window must be longer than {window!r}")
    return int(micros)


def _calls(events: DataFrame, key: str, limit: int | dict[str, int], ts: str, route: str | None) -> DataFrame:
    """``_k`` (key and route), ``_at`` (microseconds) and ``_limit`` of each call."""
    at = F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")
    names = [key] + ([route] if route else [])
    if not isinstance(limit, dict):
        return events.filter(F.col(ts).isNotNull()).select(*names, ts, at, F.lit(int(limit)).cast("long").alias("_limit"))
    if route is None:
        raise ValueError("limits by route need the route's column")
    if len(limit) > MAX_ROUTES:
        raise ValueError(f"at most {MAX_ROUTES} routes")
    limits = events.sparkSession.createDataFrame([(r, int(n)) for r, n in limit.items()], f"`{route}` string, _limit long")
    return events.filter(F.col(ts).isNotNull()).select(*names, ts, at).join(F.broadcast(limits), route)


def _moment(kind: T.DataType):
    return F.timestamp_micros("_at").cast("timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp")


def over_moving_limit(events: DataFrame, key: str = "user_id", limit: int | dict[str, int] = 5, window: str = "1 minute",
                      ts: str = "ts", route: str | None = None) -> DataFrame:
    """``(ts, key[, route], calls, n)`` of every moment over the limit; ``limit`` may be
    a number, or a number for each route."""
    width = window_micros(window)
    names = [key] + ([route] if route else [])
    calls = _calls(events, key, limit, ts, route)
    marks = calls.select(*names, "_limit", F.explode(F.array(
        F.struct(F.col("_at").alias("at"), F.lit(1).alias("calls"), F.lit(1).alias("turn")),
        F.struct((F.col("_at") + width).alias("at"), F.lit(0).alias("calls"), F.lit(-1).alias("turn")))).alias("m"))
    moments = marks.groupBy(*names, "_limit", F.col("m.at").alias("_at")).agg(
        F.sum("m.calls").alias("calls"), F.sum("m.turn").alias("_turn"))
    # a call makes two moments at most
    run = running_sum(moments, names, ["_at"], ["_turn"], ["n"], counted=events.select(*names), rows=ROWS // 2)
    return run.filter("calls > 0 AND n > _limit").select(_moment(events.schema[ts].dataType).alias(ts), *names, "calls", "n")


_MOMENT = T.StructType([T.StructField("at", T.LongType())])
_CALLS = T.StructType([T.StructField("calls", T.LongType())])


class MovingLimitProcessor(StatefulProcessor):
    """Calls by moment of one key: those of the last window, and those that wait."""

    def __init__(self, names: list[str], width: int):
        self.names, self.width = names, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", _MOMENT, _CALLS)
        self.done = handle.getValueState("done", _MOMENT)
        self.limit = handle.getValueState("limit", T.StructType([T.StructField("n", T.LongType())]))

    def _advance(self, key, passed: int) -> pd.DataFrame:
        """Emit the moments up to ``passed``, and forget those that no later window has."""
        done = self.done.get()[0] if self.done.exists() else None
        limit = self.limit.get()[0]
        kept = sorted((k[0], v[0]) for k, v in self.ring.iterator())
        at, calls = np.array([k for k, _ in kept], np.int64), np.array([v for _, v in kept], np.int64)
        total = np.append(0, np.cumsum(calls))
        n = total[1:] - total[np.searchsorted(at, at - self.width, side="right")]
        now = (at <= passed) & (n > limit)
        if done is not None:
            now &= at > done
        # a later call comes after ``passed``: that is as far back as its window goes
        stays = at > passed + 1 - self.width
        for gone in at[~stays].tolist():
            self.ring.removeKey((gone,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if stays.any():
            self.done.update((passed,))
            waits = at[at > passed]
            self.handle.registerTimer(-(-int(waits[0] if len(waits) else at[-1] + self.width) // 1000))
        else:
            for state in (self.ring, self.done, self.limit):
                state.clear()
        out = {name: pd.Series([key[i]] * int(now.sum()), dtype=object) for i, name in enumerate(self.names)}
        return pd.DataFrame({"_at": at[now], **out, "calls": calls[now], "n": n[now]})

    def handleInputRows(self, key, rows, timerValues):
        new: dict[int, int] = {}
        for batch in rows:
            for at, n in batch["moment_us"].value_counts().items():
                new[int(at)] = new.get(int(at), 0) + int(n)
            self.limit.update((int(batch["moment_limit"].iloc[0]),))
        for at, n in new.items():
            before = self.ring.getValue((at,))[0] if self.ring.containsKey((at,)) else 0
            self.ring.updateValue((at,), (before + n,))
        yield self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def over_moving_limit_stream(stream: DataFrame, key: str = "user_id", limit: int | dict[str, int] = 5, window: str = "1 minute",
                             ts: str = "ts", route: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """:func:`over_moving_limit` of a stream, for append mode: the rows of the moments
    that the watermark has passed.  A ``timestamp_ntz`` is read in the session's zone."""
    kind = stream.schema[ts].dataType
    names = [key] + ([route] if route else [])
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    out = T.StructType([T.StructField("_at", T.LongType()), *[T.StructField(c, stream.schema[c].dataType) for c in names],
                        T.StructField("calls", T.LongType()), T.StructField("n", T.LongType())])
    # pandas rows lose names that begin with an underscore
    calls = _calls(timed, key, limit, ts, route).withColumnsRenamed({"_at": "moment_us", "_limit": "moment_limit"})
    rows = calls.groupBy(*names).transformWithStateInPandas(
        statefulProcessor=MovingLimitProcessor(names, window_micros(window)), outputStructType=out,
        outputMode="Append", timeMode="EventTime")
    return rows.select(_moment(kind).alias(ts), *names, "calls", "n")

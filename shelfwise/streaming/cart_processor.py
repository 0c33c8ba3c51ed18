"""ST-2 stream state: one value per user, the clamped cart fold.

Within a micro-batch the fold is vectorised with the reflection identity
``x_n = S_n - min(-x_0, min_j S_j)`` per run of events between clears
(``x_0`` is the stored value for the first run, 0 after a clear).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT_SCHEMA = T.StructType([T.StructField("user_id", T.LongType()),
                              T.StructField("cart_items", T.LongType())])
_STATE_SCHEMA = T.StructType([T.StructField("items", T.LongType())])


def fold(start: int, delta: np.ndarray, clear: np.ndarray) -> int:
    """Cart size after applying ``delta`` / ``clear`` (in order) to ``start``."""
    if len(delta) == 0:
        return int(start)
    clears = np.flatnonzero(clear)
    if len(clears):
        start = 0
        delta = delta[clears[-1]:]   # the clear itself has delta 0
    s = np.cumsum(delta)
    return int(s[-1] - min(-start, int(s.min())))


def _micros(ts: pd.Series) -> list[int]:
    """Event times in microseconds, the precision that the batch form orders by."""
    return pd.to_datetime(ts, utc=True).astype("datetime64[us, UTC]").astype("int64").tolist()


class CartProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cart = handle.getValueState("cart", _STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])
        start = self.cart.get()[0] if self.cart.exists() else 0
        value = fold(start, batch["delta"].to_numpy(np.int64), batch["clear"].to_numpy(np.int64))
        self.cart.update((value,))
        yield pd.DataFrame({"user_id": [key[0]], "cart_items": [value]})

    def close(self) -> None:
        pass


_PENDING_SCHEMA = T.StructType([T.StructField("ts_us", T.LongType()),
                                T.StructField("event_id", T.LongType()),
                                T.StructField("delta", T.LongType()),
                                T.StructField("clear", T.LongType())])


_OLDEST_SCHEMA = T.StructType([T.StructField("ts_us", T.LongType())])


def _waiting(p, watermark_ms: int, new_rows):
    """All waiting events, or None while the watermark has reached none of them:
    then the new ones are only appended, and the list is not read."""
    oldest = p.oldest.get()[0] if p.oldest.exists() else None
    new_rows = list(new_rows)
    first = min([e[0] for e in new_rows] + ([] if oldest is None else [oldest]), default=None)
    if first is not None and first // 1000 > watermark_ms:
        if new_rows:
            p.pending.appendList(new_rows)
        if first != oldest:
            _set_timer(p, first)
        return None
    return (list(p.pending.get()) if p.pending.exists() else []) + new_rows


def _keep(p, rest) -> None:
    """Store the events that still wait."""
    if rest:
        p.pending.put(rest)
        _set_timer(p, min(e[0] for e in rest))
    else:
        _set_timer(p, None)
        p.pending.clear()


def _set_timer(p, ts_us) -> None:
    for t in p.handle.listTimers():
        p.handle.deleteTimer(t)
    if ts_us is None:
        p.oldest.clear()
    else:
        p.oldest.update((ts_us,))
        p.handle.registerTimer(ts_us // 1000)


class OrderedCartProcessor(StatefulProcessor):
    """Event-time exact cart fold: events wait in list state until the
    watermark passes them, then are folded in ``(ts, event_id)`` order; an
    event-time timer at the earliest waiting event finishes the fold when no
    further input comes.  Out-of-order arrival within the watermark delay
    gives the same result as the batch form over the finalised events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cart = handle.getValueState("cart", _STATE_SCHEMA)
        self.pending = handle.getListState("pending", _PENDING_SCHEMA)
        self.oldest = handle.getValueState("oldest", _OLDEST_SCHEMA)

    def _advance(self, key, watermark_ms: int, new_rows=()):
        waiting = _waiting(self, watermark_ms, new_rows)
        if waiting is None:
            value = self.cart.get()[0] if self.cart.exists() else 0
            return pd.DataFrame({"user_id": [key[0]], "cart_items": [value]})
        ready = sorted((e for e in waiting if e[0] // 1000 <= watermark_ms), key=lambda e: (e[0], e[1]))
        rest = [e for e in waiting if e[0] // 1000 > watermark_ms]
        value = self.cart.get()[0] if self.cart.exists() else 0
        if ready:
            value = fold(value, np.array([e[2] for e in ready], dtype=np.int64),
                         np.array([e[3] for e in ready], dtype=np.int64))
            self.cart.update((value,))
        _keep(self, rest)
        return pd.DataFrame({"user_id": [key[0]], "cart_items": [value]})

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True)
        ts_us = _micros(batch["ts"])
        new = [(int(t), int(e), int(d), int(c)) for t, e, d, c in
               zip(ts_us, batch["event_id"], batch["delta"], batch["clear"])]
        yield self._advance(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


LINES_OUTPUT_SCHEMA = T.StructType([T.StructField("user_id", T.LongType()),
                                    T.StructField("product_id", T.LongType()),
                                    T.StructField("quantity", T.LongType())])
_LINE_EVENT_SCHEMA = T.StructType([T.StructField("ts_us", T.LongType()),
                                   T.StructField("event_id", T.LongType()),
                                   T.StructField("product_id", T.LongType()),
                                   T.StructField("kind", T.IntegerType())])
# event kinds in the buffered list
ADD, REMOVE, CLEAR, REMOVE_LINE = 1, -1, 2, 3


class OrderedCartLinesProcessor(StatefulProcessor):
    """Cart lines per user (map state product -> quantity), folded in
    event-time order once the watermark passes each event.  A user's clear
    empties all lines; a line at zero is removed.  Each update emits the
    user's changed lines, a removed line with quantity 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "product_id long", "quantity long")
        self.pending = handle.getListState("pending", _LINE_EVENT_SCHEMA)
        self.oldest = handle.getValueState("oldest", _OLDEST_SCHEMA)

    def _advance(self, key, watermark_ms: int, new_rows=()):
        waiting = _waiting(self, watermark_ms, new_rows)
        if waiting is None:
            return pd.DataFrame({"user_id": [], "product_id": [], "quantity": []}).astype("int64")
        ready = sorted((e for e in waiting if e[0] // 1000 <= watermark_ms), key=lambda e: (e[0], e[1]))
        rest = [e for e in waiting if e[0] // 1000 > watermark_ms]
        current = {k[0]: v[0] for k, v in self.lines.iterator()} if self.lines.exists() else {}
        before = dict(current)
        for _, _, product, kind in ready:
            if kind == CLEAR:
                current.clear()
            elif kind == REMOVE_LINE:
                current.pop(product, None)
            elif kind == ADD:
                current[product] = current.get(product, 0) + 1
            elif kind == REMOVE and product in current:
                if current[product] <= 1:
                    del current[product]
                else:
                    current[product] -= 1
        for p in before:
            if p not in current:
                self.lines.removeKey((p,))
        for p, q in current.items():
            if before.get(p) != q:
                self.lines.updateValue((p,), (q,))
        _keep(self, rest)
        changed = [(p, current.get(p, 0)) for p in set(before) | set(current)
                   if before.get(p) != current.get(p)]
        return pd.DataFrame({"user_id": [key[0]] * len(changed),
                             "product_id": [p for p, _ in changed],
                             "quantity": [q for _, q in changed]},
                            columns=["user_id", "product_id", "quantity"]).astype("int64")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True)
        ts_us = _micros(batch["ts"])
        prods = batch["product_id"].tolist()
        new = [(int(t), int(e), None if pd.isna(p) else int(p), int(k)) for t, e, p, k in
               zip(ts_us, batch["event_id"], prods, batch["kind"])]
        yield self._advance(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

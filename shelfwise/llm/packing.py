"""Packing into windows of tokens by non-negative least squares.

1. Documents are encoded and cut: whole windows go to sequences of their own,
   the rest of each document (1 to window - 1 tokens) is to be combined.
2. The histogram of the rests (at most window - 1 bins, whatever the corpus)
   goes to the driver.  Shallow combinations of two or three lengths that fill
   the window exactly are enumerated; repeat counts x >= 0 minimise
   ||A x - histogram||^2 (multiplicative updates, which keep x non-negative);
   the counts are rounded down and held within the histogram.
3. Each rest gets its number among the rests of its length and with it a place
   in a repeat of a combination.
4. What the combinations leave over is packed greedily: laid end to end and cut
   where a window is full, so only the very last sequence has padding.

Numbers and sums over all documents are made in two steps (within a group of at
most ``GROUP`` rows, then over the groups' totals), so a length that a third of
the documents share is never one task's work.

Defined cases: a null or empty text is the end id alone; rows that repeat a
doc_id are packed one by one; a null doc_id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import id_out, stored, texts
from shelfwise.llm.tokens import encoded

GROUP = 4096
TRIPLES = 60_000        # combinations of three lengths that are tried, the commonest lengths first

_IDS = pa.schema([("r", pa.int64()), ("d", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _encode(tokenizer: str, end: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches):
        for batch in batches:
            r, d = batch.column(0), batch.column(1)
            for row, ids, cut in encoded(batch.column(2), tokenizer, end):
                n = len(cut) - 1
                data = ids.astype(kind).tobytes()
                yield pa.record_batch([
                    r.slice(row, n), d.slice(row, n), pa.array(np.diff(cut)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cut * kind.itemsize).astype(np.int32).tobytes()),
                                                           pa.py_buffer(data)])], schema=_IDS)
    return run


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window, of lengths in use."""
    have = histogram > 0
    a = np.arange(1, window // 2 + 1)
    pairs = a[have[a] & have[window - a]]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)]
    common = np.argsort(-histogram, kind="stable")
    common = common[histogram[common] > 0]
    made = 0
    for i, x in enumerate(common):
        y = common[i:]
        z = window - x - y
        ok = z > 0
        y, z = y[ok], z[ok]
        ok = have[z]
        y, z = y[ok], z[ok]
        if len(y):
            out.append(np.stack([np.full(len(y), x), y, z], axis=1))
            made += len(y)
        if made >= TRIPLES:
            break
    rows = np.sort(np.concatenate(out), axis=1)[:, ::-1]
    return np.unique(rows, axis=0)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Rounded non-negative least squares, held within the histogram."""
    if not len(combos):
        return np.empty(0, dtype=np.int64)
    h = histogram.astype(float)
    h[0] = 0
    flat = combos.T
    used = np.bincount(combos.reshape(-1), minlength=len(h))
    x = (h / np.maximum(used, 1))[combos[:, 0]] / 2 + 1e-9
    aim = h[flat[0]] + h[flat[1]] + h[flat[2]]
    for _ in range(rounds):
        made = sum(np.bincount(f, weights=x, minlength=len(h)) for f in flat)
        made[0] = 0
        x *= aim / np.maximum(made[flat[0]] + made[flat[1]] + made[flat[2]], 1e-12)
    counts = np.zeros(len(combos), dtype=np.int64)
    left = histogram.astype(np.int64).copy()
    for p in np.argsort(-x, kind="stable"):
        if x[p] < 1:
            break
        need: dict[int, int] = {}
        for length in combos[p]:
            if length:
                need[int(length)] = need.get(int(length), 0) + 1
        k = min(int(x[p]), *(int(left[m]) // c for m, c in need.items()))
        if k > 0:
            counts[p] = k
            for m, c in need.items():
                left[m] -= c * k
    return counts


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple], int]:
    """Slots (length, first number, end number, first sequence, offset) and the
    number of sequences they fill."""
    combos = combinations(histogram, window)
    counts = repeat_counts(combos, histogram)
    taken = np.zeros(len(histogram), dtype=np.int64)
    slots, made = [], 0
    for p in np.flatnonzero(counts):
        offset = 0
        for length in (int(x) for x in combos[p] if x):
            slots.append((length, int(taken[length]), int(taken[length] + counts[p]), made, offset))
            taken[length] += counts[p]
            offset += length
        made += int(counts[p])
    return slots, made


def _before(df: DataFrame, value, keys: list[str]) -> DataFrame:
    """Add ``before``: sum of ``value`` over earlier rows (by r) with equal keys,
    in two steps."""
    df = df.withColumn("_v", value).withColumn("_g", F.expr(f"r div {GROUP}"))
    inside = Window.partitionBy("_g", *keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    groups = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_g", *keys).agg(F.sum("_v").alias("_t"))
    totals = totals.select("_g", *keys, F.coalesce(F.sum("_t").over(groups), F.lit(0)).alias("_o"))
    return (df.withColumn("_l", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
            .join(totals, ["_g", *keys]).withColumn("before", F.col("_l") + F.col("_o"))
            .drop("_v", "_g", "_l", "_o"))


_PIECES = pa.schema([("d", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pieces(window: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches):
        for batch in batches:
            rows = []
            for d, n, data, full, rest in zip(*(batch.column(i) for i in range(5))):
                d, n, full = d.as_py(), n.as_py(), full.as_py()
                ids = np.frombuffer(data.as_buffer(), kind).astype("<u4")
                cuts = [(k * window, window, full + k, 0) for k in range(n // window)]
                cuts += [(p["start"], p["length"], p["sequence_id"], p["offset"]) for p in rest.as_py() or []]
                rows += [(d, s, m, zlib.crc32(ids[s:s + m].tobytes()), n, q, o) for s, m, q, o in cuts]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)
    return run


def pack(docs: DataFrame, tokenizer: str, vocabulary: int, end: int, window: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    spark, wide = docs.sparkSession, max(vocabulary, end + 1) > 1 << 16
    rows = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("r"), "d", "text")
    ids = stored(rows.mapInArrow(_encode(tokenizer, end, wide), "r long, d long, n long, ids binary"), "ids")
    sizes = ids.select("r", "n", F.expr(f"n div {window}").alias("full"), F.expr(f"n % {window}").alias("rest"))

    histogram = np.zeros(window, dtype=np.int64)
    whole = 0
    for row in sizes.groupBy("rest").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f")).collect():
        histogram[row.rest] = row.c if row.rest else 0
        whole += row.f
    slots, made = plan(histogram, window)
    by_length = spark.createDataFrame(slots, "rest long, lo long, hi long, seq long, offset long").groupBy("rest").agg(
        F.collect_list(F.struct("lo", "hi", "seq", "offset")).alias("slots"))

    numbered = _before(sizes, F.col("full"), []).withColumnRenamed("before", "first_full")
    numbered = _before(numbered, F.lit(1), ["rest"]).withColumnRenamed("before", "number")
    placed = (numbered.join(F.broadcast(by_length), "rest", "left")      # at most window - 1 rows
              .withColumn("slot", F.get(F.filter("slots", lambda s: (F.col("number") >= s["lo"])
                                                  & (F.col("number") < s["hi"])), F.lit(0)))
              .withColumn("n_in_slot", F.col("number") - F.col("slot.lo"))
              .drop("slots", "number"))
    placed = stored(placed, "placed")
    left = _before(placed.filter("slot IS NULL AND rest > 0").select("r", "rest"), F.col("rest"), [])
    left = left.select("r", F.col("before").alias("at"))

    base = whole + made
    start, rest = F.col("full") * window, F.col("rest")
    seq, off = F.lit(base) + F.expr(f"at div {window}"), F.expr(f"at % {window}")
    head = F.least(rest, F.lit(window) - off)
    piece = lambda s, m, q, o: F.struct(s.cast("long").alias("start"), m.cast("long").alias("length"),
                                        q.cast("long").alias("sequence_id"), o.cast("long").alias("offset"))
    zero = F.lit(0)
    parts = (F.when(rest == 0, F.array().cast("array<struct<start:long,length:long,sequence_id:long,offset:long>>"))
             .when(F.col("slot").isNotNull(), F.array(piece(start, rest, F.lit(whole) + F.col("slot.seq") + F.col("n_in_slot"),
                                                            F.col("slot.offset"))))
             .when(rest <= head, F.array(piece(start, rest, seq, off)))
             .otherwise(F.array(piece(start, head, seq, off), piece(start + head, rest - head, seq + 1, zero))))
    places = placed.join(left, "r", "left").select("r", F.col("first_full"), parts.alias("rests"))
    out = (ids.join(places, "r").select("d", "n", "ids", "first_full", "rests")
           .mapInArrow(_pieces(window, wide), "d long, start long, length long, ids_crc32 long, doc_tokens long, "
                                              "sequence_id long, offset long"))
    return out.select(id_out().alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

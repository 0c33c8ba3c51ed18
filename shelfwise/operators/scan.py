"""Running sums within a key, with a hot key's rows spread over tasks
(the shared core of WN-1, WN-3, WN-4, WN-5, ST-2).

``Window.partitionBy(key).orderBy(...)`` alone sends every row of a key to one
task.  Here a key with more rows than a bucket should hold is cut at splitters:
places in the order of *all* its order columns, taken from a sample of its rows
and written as one small table.  A row's bucket is the number of its key's splitters
that it has passed (a binary search in the row's own expression).  One window over
``(key, bucket)`` sums inside a bucket, with one exchange; the totals of the hot
keys' buckets, a few thousand rows at most, are summed in order and added by a
broadcast join.  A key of one bucket takes part in the window alone.

The number of rows of each key is counted when a running sum is built (one small
job, over the key columns of ``counted``); the splitters are sampled only where a
key has more than one bucket.  Everything is native, and the rule is one at every
size: a bucket holds about ``rows`` rows, or a ``MOST_BUCKETS``th of all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.session import require_checkpoint_dir

ROWS = 250_000          # of a bucket
MOST_BUCKETS = 4096     # about; splitters are fewer than twice as many
SAMPLES = 32            # sampled rows for each splitter
_STEPS = 14             # of a binary search: 2^13 splitters


def _names(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def _key(keys: list[str]) -> Column:
    # A struct is never NULL itself and compares its NULL fields as equal.
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0)


def _place(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


@dataclass
class Splitters:
    """Of each hot key (``_key``): its ``_splits``, ascending places in the order."""

    table: DataFrame
    keys: list[str]
    order: list[str]

    def passed(self) -> Column:
        """Number of splitters that a row has passed, by binary search."""
        splits, place = F.col("_splits"), _place(self.order)

        def step(state: Column, _: Column) -> Column:
            middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
            right = splits[middle] <= place
            found = state["lo"] >= state["hi"]
            return F.struct(F.when(found | ~right, state["lo"]).otherwise(middle + 1).alias("lo"),
                            F.when(found | right, state["hi"]).otherwise(middle).alias("hi"))

        first = F.struct(F.lit(0).alias("lo"), F.size(splits).alias("hi"))
        return F.when(splits.isNull(), 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), first, step)["lo"])

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_key``, ``_hot`` and ``_bucket``."""
        # fewer than 2 * MOST_BUCKETS places in all
        return df.withColumn("_key", _key(self.keys)).join(F.broadcast(self.table), "_key", "left") \
            .withColumn("_bucket", self.passed()).withColumn("_hot", F.col("_splits").isNotNull()).drop("_splits")


def splitters(df: DataFrame, keys, order, counted: DataFrame | None = None, rows: int = ROWS) -> Splitters | None:
    """Splitters of the keys with more than one bucket; None where no key has.

    ``counted``: a table with the columns ``keys`` that has at least the rows of
    ``df`` for each key, where that is cheaper to count."""
    keys, order = _names(keys), _names(order)
    per_key = (df if counted is None else counted).groupBy(_key(keys).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    total = per_key.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    size = max(rows, (total["all"] or 0) // MOST_BUCKETS)
    if (total["most"] or 0) <= size:
        return None
    hot = per_key.filter(F.col("n") > size).select("_key")          # MOST_BUCKETS at most
    every = max(1, size // SAMPLES)
    sample = df.select(_key(keys).alias("_key"), _place(order).alias("_place")) \
        .filter(F.pmod(F.xxhash64("_place"), F.lit(every)) == 0).join(F.broadcast(hot), "_key", "left_semi")
    found = sample.groupBy("_key").agg(F.sort_array(F.collect_set("_place")).alias("_all")).select(
        "_key", F.filter("_all", lambda x, i: i % SAMPLES == SAMPLES - 1).alias("_splits")).filter(F.size("_splits") > 0)
    # Written once: every use of it, and every task that is run again, cuts at the same places.
    spark = df.sparkSession
    path = f"{require_checkpoint_dir(spark).rstrip('/')}/splitters-{uuid.uuid4().hex}"
    found.coalesce(1).write.parquet(path)
    return Splitters(spark.read.schema(found.schema).parquet(path), keys, order)


def running_sum(df: DataFrame, keys, order, values, outs=None, *, inclusive: bool = True,
                counted: DataFrame | None = None, rows: int = ROWS, cut: Splitters | None | bool = True) -> DataFrame:
    """Add running sums of ``values`` within ``keys`` in ``order``.

    ``order`` must make the order within a key total (append a unique tie-break
    column), otherwise results are not repeatable.  ``values`` are integral or
    floating columns; a NULL value adds nothing, a NULL key is one key, a NULL
    order value comes first, and a sum beyond a long fails.  ``outs`` names the
    new columns (default ``<value>_run``).  ``inclusive=False`` gives the sum of
    the rows strictly before each row.  Without ``keys`` the whole table is one
    key.  ``counted`` and ``rows``: see :func:`splitters`; ``cut`` takes the
    result of an earlier call for the same keys and order.
    """
    keys, order, values = _names(keys), _names(order), _names(values)
    outs = _names(outs) or [f"{v}_run" for v in values]
    floating = {v for v in values if isinstance(df.schema[v].dataType, (T.DoubleType, T.FloatType))}
    kind = {v: "double" if v in floating else "long" for v in values}
    if cut is True:
        cut = splitters(df, keys, order, counted, rows)
    value = {v: F.col(v).cast(kind[v]) for v in values}

    def inside(part: list[str]) -> list[Column]:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return [F.coalesce(F.sum(value[v]).over(w), F.lit(0)) for v in values]

    if not cut:
        return df.select("*", *[c.cast(kind[v]).alias(o) for c, v, o in zip(inside(keys), values, outs)])
    placed = cut.placed(df)
    local = placed.select("*", *[c.alias(f"_l{i}") for i, c in enumerate(inside(["_key", "_bucket"]))])
    return add_before(local, [F.sum(value[v]) for v in values], placed).select(
        *df.columns, *[(F.col(f"_l{i}") + F.col(f"_o{i}")).cast(kind[v]).alias(o) for i, (v, o) in enumerate(zip(values, outs))])


def add_before(rows: DataFrame, sums: list[Column], placed: DataFrame | None = None) -> DataFrame:
    """Add ``_o0``, ``_o1``, ...: the ``sums`` over the buckets of a row's key before its
    own, 0 where there is none.  ``placed``: the rows to sum over, if not ``rows``."""
    totals = (rows if placed is None else placed).filter("_hot").groupBy("_key", "_bucket") \
        .agg(*[s.alias(f"_t{i}") for i, s in enumerate(sums)])
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_key", "_bucket", *[F.sum(f"_t{i}").over(earlier).alias(f"_o{i}") for i in range(len(sums))])
    # a row for each bucket of a hot key: fewer than 2 * MOST_BUCKETS and the hot keys
    return rows.join(F.broadcast(before), ["_key", "_bucket"], "left") \
        .withColumns({f"_o{i}": F.coalesce(f"_o{i}", F.lit(0)) for i in range(len(sums))})


def row_number_within(df: DataFrame, keys, order, out: str = "rn", counted: DataFrame | None = None) -> DataFrame:
    """1-based position of each row within its key."""
    one = "_scan_one"
    return running_sum(df.withColumn(one, F.lit(1)), keys, order, [one], [out], counted=counted).drop(one)

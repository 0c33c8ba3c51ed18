"""Jaccard self-join of word shingles with adaptive multi-match prefixes.

A document's set is its distinct ``size``-word shingles.  All sets are ordered
by one rule: shingles that many documents share last (rarest of them first),
the others by hash.  If two sets have a Jaccard similarity of 3/4 or more, then
their prefixes of ``n - ceil(3n/4) + l`` shingles share at least l, for every l.

1. Equal sets are one class (128-bit hash of the set); one member stands for it.
2. Frequent shingles are counted from every text: a task passes on those that
   it met at least twice.  The order takes the ``HOT`` most frequent ones (2 MB);
   any others only come earlier than they might, which costs time, not results.
3. Prefixes of the longest kind (l = DEPTH) go to their shingles' partitions;
   a shingle with one document there is of no use and goes.  Of two sets the
   smaller must share 6/7 of itself, so its prefix need only be
   ``n - ceil(6n/7) + l`` long in a pair.
4. Each document's candidate cost at l = 1..DEPTH is estimated from the lengths
   of its prefix shingles' lists, and the cheapest l is its own.  A pair becomes
   a candidate when it shares min(l, l') prefix shingles or more.
5. Round one compares each document only with the list member most of whose
   prefix is shared (the likely original); links found join components.  Round
   two takes, list by list, all pairs of *different* components, so no pair
   between dissimilar groups is lost, and a group of thousands of near copies
   is never expanded into its pairs.  A pair also goes if the places of its
   shared shingles leave too few that could still be shared.
6. Candidates are verified on the two whole texts: 100 |A n B| >= 75 |A u B|.

Defined cases: a null text or one without words has the empty set and is linked
with nothing; a text of fewer than ``size`` words has one shingle, the whole
sequence.  A doc_id is one node: several rows of it are linked through it.  A
null doc_id is a node that orders first and comes out null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import drop, id_out, stored, texts
from shelfwise.llm.graph import components
from shelfwise.llm.words import Block, blocks, mix, ngram_hashes

HOT = 1 << 18
HOT_FROM = 16           # documents from which a shingle may count as frequent
DEPTH = 4               # largest l
STAR = 0.3              # share of its prefix that a text must share with a likely original in round one
VERIFY = 24             # cost of a verification in list entries read

_U = np.uint64


def sets_of(b: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets."""
    h = b.hashes()
    at = b.window_starts(size)
    doc = np.searchsorted(b.first, at, side="right") - 1
    value = ngram_hashes(h, size)[at] if len(at) else np.empty(0, _U)
    n = np.diff(b.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = [mix(ngram_hashes(h[b.first[k]:b.first[k + 1]], int(n[k])) + _U(n[k])) for k in short]
        value, doc = np.concatenate([value, *whole]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    cut = np.searchsorted(doc, np.arange(b.n_docs + 1))
    for i, j in zip(cut[:-1], cut[1:]):
        value[i:j].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(b.n_docs + 1))


def need(n):
    """Shingles that a set of n must share with any set it is linked with."""
    return (3 * n + 3) // 4


def _sets(size: int):
    schema = pa.schema([("d", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1), lower=True):
                value, cut = sets_of(b, size)
                sums = []
                for salt in (0x1234567, 0x7654321):
                    total = np.zeros(len(value) + 1, dtype=_U)
                    np.cumsum(mix(value + _U(salt)), out=total[1:])
                    sums.append(pa.array((total[cut[1:]] - total[cut[:-1]]).view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(b.row, b.n_docs), pa.array(np.diff(cut)), *sums], schema=schema)
    return run


def _frequent(size: int):
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    def run(batches):
        for batch in batches:
            parts = [sets_of(b, size)[0] for b in blocks(batch.column(1), lower=True)]
            if not parts:
                continue
            value, count = np.unique(np.concatenate(parts), return_counts=True)
            keep = count > 1
            yield pa.record_batch([pa.array(value[keep].view(np.int64)), pa.array(count[keep])], schema=schema)
    return run


def _prefixes(size: int, hot):
    """Rows (h, d, n, pos) of each text's longest prefix; of equal sets in a
    batch the one with the smallest id alone."""
    schema = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])

    def run(batches):
        common, rank = hot.value                # hashes ascending, and their place by frequency
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")      # of equal sets the smallest id comes first
            ids, column, seen = ids[order], batch.column(1).take(pa.array(order)), set()
            for b in blocks(column, lower=True):
                value, cut = sets_of(b, size)
                n = np.diff(cut)
                doc = np.repeat(np.arange(b.n_docs), n)
                late = np.zeros(len(value), dtype=np.int64)
                if len(common) and len(value):
                    spot = np.minimum(np.searchsorted(common, value), len(common) - 1)
                    late = np.where(common[spot] == value, rank[spot] + 1, 0)
                order = np.argsort(doc * (len(common) + 1) + late, kind="stable")    # by hash where late is equal
                pos = np.arange(len(value)) - cut[doc]
                keep = pos < (n - need(n) + np.minimum(DEPTH, need(n)))[doc]
                total = np.zeros(len(value) + 1, dtype=_U)
                np.cumsum(mix(value + _U(0x1234567)), out=total[1:])
                same = (total[cut[1:]] - total[cut[:-1]]).tolist()
                fresh = np.zeros(b.n_docs, dtype=bool)
                for k, key in enumerate(zip(same, n.tolist(), ids[b.row:b.row + b.n_docs].tolist())):
                    if key[:2] not in seen:
                        seen.add(key[:2])
                        fresh[k] = True
                keep &= fresh[doc]
                value, doc, pos = value[order][keep], doc[keep], pos[keep]
                yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(ids[b.row + doc].astype(np.int64)),
                                       pa.array(n[doc]), pa.array(pos)], schema=schema)
    return run


def _linked(size: int):
    """x, y of the pairs (x, y, text, other) whose sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            both = [[], []]
            for side in (0, 1):
                for b in blocks(batch.column(2 + side), lower=True):
                    value, cut = sets_of(b, size)
                    both[side] += [value[i:j] for i, j in zip(cut[:-1], cut[1:])]
            for k, (p, q) in enumerate(zip(*both)):
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep[k] = shared > 0 and 100 * shared >= 75 * (len(p) + len(q) - shared)
            found = np.flatnonzero(keep)
            yield pa.record_batch([batch.column(0).take(pa.array(found)), batch.column(1).take(pa.array(found))], schema=schema)
    return run


def _verified(pairs: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """Linked pairs among ``pairs`` (x, y)."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("x").alias("d")).unionByName(pairs.select(F.col("y").alias("d"))).distinct()
    base = stored(base.join(ids, "d", "left_semi"), "texts")
    one = base.select(F.col("d").alias("x"), "text")
    two = base.select(F.col("d").alias("y"), F.col("text").alias("other"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "text", "other").mapInArrow(_linked(size), "a long, b long")


def _shared(prefixes: DataFrame) -> DataFrame:
    """Rows whose shingle others have too, with ``df``, their number.  Counted in each
    task first and written (``counts``), so that the join can split the rows of a hot shingle."""
    counts = stored(prefixes.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    out = prefixes.join(counts, "h")
    out.counts = counts
    return out


def components_of(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    base = texts(docs, id_col, text_col)
    sets = stored(base.mapInArrow(_sets(size), "d long, n long, s1 long, s2 long"), "sets")

    # written, so that the join reads both sides from shuffles and a large class can be split
    classes = stored(sets.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("d").alias("rep")), "classes")
    copies = (sets.filter("n > 0").join(classes, ["s1", "s2", "n"]).filter("d <> rep")
              .select(F.col("d").alias("a"), F.col("rep").alias("b")))
    reps = classes.select(F.col("rep").alias("d")).distinct()

    counted = base.mapInArrow(_frequent(size), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = counted.filter(F.col("c") >= HOT_FROM).orderBy(F.desc("c"), "h").limit(HOT).toPandas()
    h = top["h"].to_numpy(np.int64).view(_U)
    order = np.argsort(h)
    hot = spark.sparkContext.broadcast((h[order], (len(h) - np.arange(len(h)))[order]))

    prefixes = base.mapInArrow(_prefixes(size, hot), "h long, d long, n long, pos long")
    # Made twice rather than written: most of their shingles are found once and go.  The smallest
    # member of a class is in both whatever its batch, so a shingle of two classes is counted.
    shared = _shared(prefixes)
    live = stored(shared.join(reps, "d", "left_semi"), "prefixes")
    drop(shared.counts)

    at = lambda k: F.col("n") - F.expr("(3 * n + 3) div 4") + k  # noqa: E731   length of the l-prefix
    costs = live.groupBy("d", "n").agg(
        F.count(F.lit(1)).alias("shared"),
        *[F.sum(F.when(F.col("pos") < at(k), F.col("df"))).alias(f"c{k}") for k in range(1, DEPTH + 1)])
    price = lambda k: F.coalesce(F.col(f"c{k}"), F.lit(0)) * (1 + VERIFY / (k * k))
    cheapest = F.array_min(F.array(*[F.struct(price(k).alias("p"), F.lit(k).alias("k")) for k in range(1, DEPTH + 1)]))["k"]
    lists = stored(
        live.join(costs.select("d", "n", F.least(cheapest, F.expr("(3 * n + 3) div 4")).alias("l"),
                               F.round(F.col("shared") / at(DEPTH), 3).alias("central")), ["d", "n"])
        .filter(F.col("pos") < at(F.col("l"))).select("h", "d", "n", "l", "central", "pos"), "lists")
    drop(live)
    alike = "4 * least(n, m) >= 3 * greatest(n, m)"
    centre = lists.groupBy("h").agg(F.max_by(F.struct("d", "n"), F.struct("central", -F.col("d"))).alias("p"))
    stars = (lists.join(centre.select("h", F.col("p.d").alias("x"), F.col("p.n").alias("m")), "h")
             .filter(f"d <> x AND {alike}").groupBy("d", "x", "n").agg(F.count(F.lit(1)).alias("c"))
             .filter(F.col("c") >= STAR * at(0)).groupBy("d").agg(F.max_by("x", F.struct("c", -F.col("x"))).alias("x")))
    first = stored(_verified(stars.select("x", F.col("d").alias("y")), base, size), "links")
    group = stored(components(copies.unionByName(first)), "groups")

    # rank: how many shingles before this one could be shared with anyone; mask: which, in 64 bits
    before = Window.partitionBy("d").orderBy("pos", "h").rowsBetween(Window.unboundedPreceding, -1)
    bit = F.expr("shiftleft(1L, cast(pmod(h, 64) AS int))")
    lists = lists.withColumn("rank", F.count(F.lit(1)).over(before)).withColumn(
        "mask", F.coalesce(F.bit_or(bit).over(before), F.lit(0)))
    placed = lists.join(group.withColumnRenamed("node", "d"), "d", "left") \
        .withColumn("g", F.coalesce("component", "d")).drop("component", "central", "df")
    placed = stored(placed, "placed")
    per = placed.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"))
    mode = per.groupBy("h").agg(F.max_by("g", F.struct("c", "g")).alias("mode"), F.count(F.lit(1)).alias("groups")) \
        .filter("groups > 1").drop("groups")
    mixed = placed.join(mode, "h")
    strangers = mixed.filter("g <> mode").select("h", F.col("d").alias("x"), F.col("n").alias("m"), F.col("l").alias("k"),
                                                 F.col("g").alias("f"), F.col("pos").alias("at"), F.col("rank").alias("r"), F.col("mask").alias("s"))
    # what the places before this one and after it leave; shingles under one bit count as often as either has them
    reach = """7 * (bit_count(mask & s) + least(rank - bit_count(mask), r - bit_count(s)) + least(n - pos, m - at))
               >= 3 * (n + m)"""
    # the smaller set of a pair must share 6/7 of itself, so a shorter prefix of it will do
    early = """CASE WHEN struct(n, d) < struct(m, x) THEN pos < n - (6 * n + 6) div 7 + l
                    ELSE at < m - (6 * m + 6) div 7 + k END"""
    pairs = (strangers.join(mixed, "h").filter(f"g <> f AND (g = mode OR x < d) AND {alike} AND {reach} AND {early}")
             .withColumn("swap", F.col("x") > F.col("d"))
             .select(F.least("x", "d").alias("x"), F.greatest("x", "d").alias("y"), F.least("k", "l").alias("l"),
                     *[F.when(F.col("swap"), F.col(p)).otherwise(F.col(q)).alias(o)
                       for p, q, o in (("n", "m", "nx"), ("m", "n", "ny"), ("pos", "at", "px"), ("at", "pos", "py"))])
             .groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("c"), F.min("l").alias("l"), F.max("px").alias("px"),
                                                F.max("py").alias("py"))
             # shared shingles that are not counted stand behind the last counted one in both sets
             .filter("c >= l AND 7 * (c + least(nx - px, ny - py) - 1) >= 3 * (nx + ny)"))
    second = _verified(pairs.select("x", "y"), base, size)
    final = components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))
    return (sets.join(final.withColumnRenamed("node", "d"), "d", "left")
            .select(id_out().alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "d").alias("d"))
            .select("doc_id", "n_shingles", id_out().alias("component_id")))

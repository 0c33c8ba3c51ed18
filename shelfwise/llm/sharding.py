"""Sharding by balanced label propagation.

Every document starts on a shard by its hash.  Then Spark joins bring each linked
document the shards of its neighbours; half of the documents, by hash, ask for
the shard on which most of their neighbours are, and in the next round the other
half.  It ends when both halves moved no document, or when ``PATIENCE`` such
pairs of rounds gained no link; ``MOST`` rounds without that are an error.  Between two shards as many go as come; beyond that, as many are
let in (by hash) as the shard's quota leaves room for.  Linked documents may fill
a shard up to its even share, since the others can stand anywhere.

Rounds leave the shards uneven, so at the end each shard over its even share
gives up documents, those without links first and then those in hash order, to
the shards under theirs: the counts of rows are then at most one apart.

Equal texts are linked through the smallest row of their group (a star), so a
group has as many links as rows and not as many as pairs.  The one row with very
many links is aggregated before the shuffle and joined as a single row.  Numbers
within a shard are made in two steps (within a hash bucket, then over the
buckets' counts), so that no task holds a shard.

Defined cases: a null text is empty (size 1); empty texts are equal texts.  Rows
that repeat a doc_id are rows like any other; a null doc_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

PATIENCE = 2
MOST = 1000             # only a safety stop
FINE = 1 << 20          # steps of the share of documents that are let in
BUCKET_ROWS = 4096


def _hash(*what) -> Column:
    return F.xxhash64(*[F.lit(w) if isinstance(w, (int, str)) else w for w in what])


def admitted(flow: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """Share of the documents that ask to go from s to t that may go: as many as
    ask to go back, and of the others what room t has left."""
    swaps = {k: min(n, flow.get((k[1], k[0]), 0)) for k, n in flow.items()}
    more: dict[int, int] = {}
    for k, n in flow.items():
        more[k[1]] = more.get(k[1], 0) + n - swaps[k]
    out = {}
    for (s, t), n in flow.items():
        free = min(1.0, max(0, room[t]) / more[t]) if more[t] else 0.0
        out[s, t] = (swaps[s, t] + free * (n - swaps[s, t])) / n
    return out


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, rounds: int | None = None) -> DataFrame:
    """Labels (row, shard, linked) of ``nodes`` (row) for ``edges`` (a, b), settled or after ``rounds``."""
    links = stored(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"),
                   F.col("a").alias("b"))).distinct(), "links")
    linked = links.select(F.col("a").alias("row")).distinct().withColumn("linked", F.lit(1))
    labels = stored(nodes.select("row").join(linked, "row", "left")
                    .select("row", F.coalesce("linked", F.lit(0)).alias("linked"),
                            F.pmod(_hash(F.col("row"), "start"), F.lit(shards)).cast("int").alias("shard")), "labels")
    total = labels.count()
    quota = total // shards
    moves, best, since = 1, -1, 0
    for k in range(MOST if rounds is None else rounds):
        counts = {r.shard: r.c for r in labels.filter("linked = 1").groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
        seen = links.join(labels.select(F.col("row").alias("b"), "shard"), "b").groupBy("a", "shard").agg(
            F.count(F.lit(1)).alias("c"))
        wish = seen.groupBy("a").agg(F.max_by("shard", F.struct("c", -F.col("shard"))).alias("wish"), F.max("c").alias("gain"))
        here = seen.select("a", F.col("shard").alias("own"), F.col("c").alias("stay"))
        if k % 2 == 0:          # both halves have been asked
            if not moves:
                break
            kept = labels.select(F.col("row").alias("a"), "shard").join(seen, ["a", "shard"]).agg(F.sum("c")).first()[0] or 0
            best, since = (kept, 0) if kept > best else (best, since + 1)
            if since >= PATIENCE and rounds is None:
                break
            moves = 0
        asks = (labels.filter("linked = 1").select(F.col("row").alias("a"), F.col("shard").alias("own")).join(wish, "a")
                .filter("wish <> own").join(here, ["a", "own"], "left").filter("gain > coalesce(stay, 0)")
                .filter(F.pmod(_hash(F.col("a"), k // 2, "turn"), F.lit(2)) == k % 2).select("a", "own", "wish"))
        asks = stored(asks, "asks")
        flow = {(r.own, r.wish): r.c for r in asks.groupBy("own", "wish").agg(F.count(F.lit(1)).alias("c")).collect()}
        if not flow:
            continue
        shares = [(s, t, int(FINE * x)) for (s, t), x in admitted(flow, [quota - counts.get(s, 0) for s in range(shards)]).items()]
        table = labels.sparkSession.createDataFrame(shares, "own int, wish int, share int")      # shards squared at most
        moved = (asks.join(F.broadcast(table), ["own", "wish"])
                 .filter(F.pmod(_hash(F.col("a"), k, "let in"), F.lit(FINE)) < F.col("share")).select(F.col("a").alias("row"), "wish"))
        moved = stored(moved, "moved")
        moves += moved.count()
        labels = stored(labels.join(moved, "row", "left").select("row", "linked", F.coalesce("wish", "shard").alias("shard")),
                        "labels")
    else:
        if rounds is None:
            raise RuntimeError(f"labels have not settled in {MOST} rounds")
    return labels


def _numbered(df: DataFrame, bucket: Column, out: str) -> DataFrame:
    """Add ``out``: the row's number within its shard, in order of bucket and row."""
    df = df.withColumn("_b", bucket)
    counts = df.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("shard", "_b").orderBy("row")
    return (df.withColumn("_n", F.row_number().over(inside) - 1).join(counts, ["shard", "_b"])
            .withColumn(out, (F.col("_n") + F.col("_o")).cast("long")).drop("_b", "_n", "_o"))


def even_out(labels: DataFrame, shards: int) -> DataFrame:
    """Labels with row counts at most one apart, and a gapless ``slot``."""
    counts = {r.shard: r.c for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    have = [counts.get(s, 0) for s in range(shards)]
    total = sum(have)
    extra = set(sorted(range(shards), key=lambda s: (-have[s], s))[:total % shards])
    goal = [total // shards + (s in extra) for s in range(shards)]
    buckets = max(1, total // shards // BUCKET_ROWS)
    by_hash = F.pmod(_hash(F.col("row"), "order"), F.lit(buckets))
    ranked = _numbered(labels, F.col("linked") * buckets + by_hash, "number")
    first, to = F.lit(None).cast("long"), F.lit(None).cast("int")
    start = 0                                   # number of the first row that each shard gives up
    for s in range(shards):
        if have[s] > goal[s]:
            first = F.when((F.col("shard") == s) & (F.col("number") < have[s] - goal[s]), F.col("number") + start).otherwise(first)
            start += have[s] - goal[s]
    ranked = ranked.withColumn("_given", first)
    start = 0
    for s in range(shards):
        if have[s] < goal[s]:
            gets = goal[s] - have[s]
            to = F.when((F.col("_given") >= start) & (F.col("_given") < start + gets), F.lit(s)).otherwise(to)
            start += gets
    placed = stored(ranked.select("row", "linked", F.coalesce(to, F.col("shard")).alias("shard")), "placed")
    return _numbered(placed, by_hash, "slot")


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot, linked."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                              (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                              F.unhex(F.md5(text)).alias("key")), "rows")
    # written, so that the join reads both sides from shuffles and a large group can be split
    groups = stored(rows.groupBy("key", "size").agg(F.min("row").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1"),
                    "groups")
    edges = rows.join(groups, ["key", "size"]).select(F.col("row").alias("a"), "b")
    placed = even_out(propagate(rows, edges, shards, rounds), shards)
    return rows.drop("key").join(placed, "row").drop("row")

"""Connected components by Spark joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for columns a, b of edges.

    Each round replaces the edges by stars around smaller nodes and writes them;
    when a round changes nothing, every node points at its component.  A node
    with very many edges is aggregated before the shuffle; the least neighbours
    are written, so that the joins read both sides from shuffles and Spark can
    split such a node's edges over tasks.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = stored(both.filter("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "edges")
        down = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (large.join(down, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m")))
                                              .alias("e"))
                 .select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        now = stored(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""op5: the law, the numbers and the links kept together."""

import collections
import zlib

from pyspark.sql import functions as F

from shelfwise.llm import sharding as S
from shelfwise.llm.queries import QUERIES
from tests.conftest import SF01


def check(rows, shards):
    own = collections.defaultdict(list)
    for r in rows:
        own[r.shard].append(r.slot)
    sizes = [len(own[s]) for s in range(shards)]
    assert set(own) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in own.values())


def test_whole_table(spark, duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    rows = QUERIES["op5_label_propagation_sharding"](spark, SF01).collect()
    check(rows, 16)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
               and r.law == "rows" and r.grown_shard is None for r in rows)
    at = collections.defaultdict(collections.Counter)
    for r in rows:
        at[texts[r.doc_id]][r.shard] += 1
    groups = [c for c in at.values() if sum(c.values()) > 1]
    assert sum(max(c.values()) for c in groups) > 0.9 * sum(sum(c.values()) for c in groups)


def test_a_group_of_a_third_of_the_rows_and_edges(spark):
    rows = [(i, "same text") for i in range(200)] + [(200 + i, f"text {i // 2}") for i in range(400)]
    rows += [(None, None), (None, None), (5, "same text"), (7, ""), (8, "long " * 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS shard", "2 AS key")
    got = S.shard_documents(df, 8).collect()
    assert len(got) == len(rows)
    check(got, 8)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)


def test_links_pull_documents_together_within_quota(spark):
    """Chains of ten documents: fewer cut edges than at the start, quotas kept."""
    nodes = spark.range(640).withColumnRenamed("id", "row")
    edges = nodes.filter("row % 10 <> 9").select(F.col("row").alias("a"), (F.col("row") + 1).alias("b"))
    cut = lambda labels: edges.join(labels.selectExpr("row AS a", "shard AS s"), "a").join(
        labels.selectExpr("row AS b", "shard AS t"), "b").filter("s <> t").count()
    before = cut(S.propagate(nodes, edges, 8, rounds=0))
    after = S.even_out(S.propagate(nodes, edges, 8, rounds=12), 8)
    check(after.collect(), 8)
    assert cut(after) < 0.6 * before


def test_empty_table(spark):
    assert S.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_propagation_runs_until_groups_are_whole(spark):
    """With free room and the production setting no row is left away from its group."""
    nodes = spark.range(1200).withColumnRenamed("id", "row")
    edges = nodes.filter("row < 300 AND row % 5 <> 0").select(F.col("row").alias("a"), (F.col("row") - F.col("row") % 5).alias("b"))
    at = collections.defaultdict(set)
    for r in S.propagate(nodes, edges, 4).filter("linked = 1").collect():
        at[r.row // 5].add(r.shard)
    assert len(at) == 60 and all(len(x) == 1 for x in at.values())

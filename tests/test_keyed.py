"""SNK-2/3/4 on a part of a table, and look-ups and joins over buckets."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from shelfwise.plans.registry import ORACLE, QUERIES
from shelfwise.sources import bucketed as B
from shelfwise.sources.keyed import ConcurrentChange, KeyedTable, delete_from

from .compare import compare
from .conftest import SF01


@pytest.mark.parametrize("name", ["keyed_users_after_changes", "bucketed_admin_orders", "bucketed_orders_of_users"])
def test_queries(spark, duck, name):
    got = QUERIES[name](spark, SF01)
    assert not compare(got, duck, ORACLE[name]) and got.count() > 0


@pytest.fixture
def table(spark):
    t = KeyedTable(spark, tempfile.mkdtemp(prefix="sw-keyed-"), "id", partitions=8)
    t.create(spark.range(500).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("new").alias("status")))
    return t


def files(table):
    return {os.path.join(r, f): os.path.getmtime(os.path.join(r, f)) for r, _, names in os.walk(table.path) for f in names
            if f.endswith(".parquet")}


def rows(table, **kw):
    return sorted(map(tuple, table.read(**kw).collect()), key=str)


def test_only_partitions_of_changed_keys_are_read_and_written(spark, table):
    before, old = files(table), rows(table)
    keys = spark.createDataFrame([(3, "sold"), (4, None), (9999, "sold")], "id long, status string")
    parts = table.parts_of(keys)
    touched = table.update(keys, ["status"])
    assert touched == parts and 0 < len(parts) < 8
    new = {f for f in files(table) if f not in before}
    assert {int(f.split("_part=")[1].split("/")[0]) for f in new} <= set(parts)
    assert all(files(table)[f] == t for f, t in before.items())
    want = sorted([(i, n, {3: "sold", 4: None}.get(i, s)) for i, n, s in old], key=str)
    assert rows(table) == want and rows(table, version=1) == old
    read = table.lookup(keys).inputFiles()
    assert {int(f.split("_part%3D" if "%3D" in f else "_part=")[1].split("/")[0]) for f in read} <= set(parts)


def test_upsert_delete_and_cascade(spark, table):
    new = spark.createDataFrame([(5, "five", 1), (5, "fünf", 2), (700, "more", 1), (None, "none", 1)], "id long, name string, ts int")
    table.upsert(new)
    got = {r.id: (r.name, r.status) for r in table.read().collect()}
    assert got[5] == ("fünf", None) and got[700] == ("more", None) and len(got) == 501 and None not in got
    child = KeyedTable(spark, tempfile.mkdtemp(prefix="sw-keyed-"), "user_id", partitions=4)
    child.create(spark.range(1000).select((F.col("id") % 500).alias("user_id"), F.col("id").alias("line")))
    done = delete_from(table, spark.createDataFrame([(5,), (6,)], "id long"), [(child, "user_id")])
    assert set(done) == {table.path, child.path}
    assert child.read().count() == 996 and child.read().filter("user_id IN (5, 6)").count() == 0
    assert {5, 6}.isdisjoint(r.id for r in table.read().collect())
    # a key that is nowhere changes nothing that is read
    assert table.delete(spark.createDataFrame([], "id long")) == []


def test_a_partition_may_become_empty_and_old_folders_go(spark):
    t = KeyedTable(spark, tempfile.mkdtemp(prefix="sw-keyed-"), "id", partitions=4)
    t.create(spark.createDataFrame([(1, "a"), (None, "b")], "id long, name string"))
    t.delete(spark.createDataFrame([(1,)], "id long"))
    assert [tuple(r) for r in t.read().collect()] == [(None, "b")]
    assert t.clean() == 1 and t.read().count() == 1
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, tempfile.mkdtemp(), "id").read()


def test_of_two_changes_to_one_version_the_second_fails(spark, table):
    one = spark.createDataFrame([(1, "x")], "id long, status string")

    class Late(KeyedTable):
        def _write(self, rows, parts):
            table.update(one, ["status"])
            return super()._write(rows, parts)

    late = Late(spark, table.path, "id", partitions=8)
    with pytest.raises(ConcurrentChange):
        late.update(spark.createDataFrame([(1, "y")], "id long, status string"), ["status"])
    assert {r.status for r in table.read().filter("id = 1").collect()} == {"x"} and table.version() == 2


def test_buckets_are_pruned_and_joined_without_an_exchange(spark):
    def saved(df, key):
        name = f"t_{uuid.uuid4().hex}"
        B.write_bucketed(df, name, key, 8, os.path.join(tempfile.mkdtemp(prefix="sw-bucket-"), "t"))
        return name

    left = saved(spark.range(2000).select((F.col("id") % 100).alias("k"), "id"), "k")
    right = saved(spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "k")
    # the plan names the buckets that it reads where it is told to scan by bucket
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        found = B.lookup_keys(spark, left, "k", [7])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 8" in plan and found.count() == 20
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert B.lookup_keys(spark, left, "k", []).count() == 0
    with pytest.raises(ValueError):
        B.lookup_keys(spark, left, "k", list(range(B.MOST_KEYS + 1)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = B.join_bucketed(spark, left, right, "k")
        assert joined.filter("v <> 2 * k").count() == 0 and joined.count() == 2000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        some = B.lookup_table(spark, left, "k", spark.range(100, 120).unionByName(spark.range(3)).withColumnRenamed("id", "k"))
        assert some.count() == 60
        assert some._jdf.queryExecution().executedPlan().toString().split("FileScan")[0].count("Exchange hashpartitioning(k") <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

"""SRC-4 by version: files of several schemas read like a table rewritten whole."""

import glob
import os
import tempfile

import pytest

from shelfwise.plans.registry import ORACLE, QUERIES
from shelfwise.sources.migrations import Migration, MigrationConflict, VersionedTable
from shelfwise.sources.tables import conform

from .compare import compare
from .conftest import SF01

STEPS = [Migration(2, add={"verified": ("boolean", False), "token": ("string", None)}),
         Migration(3, add={"logins": ("int", 0), "name": ("string", "x")}, drop=("phone", "absent")),
         Migration(4, add={"phone": ("string", "none")})]


def files(path):
    return sorted((f, os.path.getmtime(f)) for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f))


@pytest.fixture
def table(spark):
    path = tempfile.mkdtemp(prefix="sw-migrations-")
    t = VersionedTable(spark, path)
    first = spark.createDataFrame([(1, "a", "1"), (2, None, None)], "id long, name string, phone string")
    t.create(first.schema)
    t.append(first)
    t.migrate(STEPS[:1])
    t.append(spark.createDataFrame([(3, "c", "3", True, "t")], "id long, name string, phone string, verified boolean, token string"))
    t.migrate(STEPS)
    t.append(spark.createDataFrame([(4, "d", False, None, 7, "44")],
                                   "id long, name string, verified boolean, token string, logins int, phone string"))
    return t


def test_reads_as_if_rewritten(spark, table):
    whole = spark.createDataFrame([(1, "a", "1"), (2, None, None)], "id long, name string, phone string")
    whole = conform(whole, add=STEPS[0].add)
    whole = whole.unionByName(spark.createDataFrame([(3, "c", "3", True, "t")], whole.schema))
    for m in STEPS[1:]:
        whole = conform(conform(whole, drop=m.drop), add=m.add)
    whole = whole.unionByName(spark.createDataFrame([(4, "d", False, None, 7, "44")], whole.schema))
    got = table.read()
    assert got.columns == whole.columns and [f.dataType for f in got.schema] == [f.dataType for f in whole.schema]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    # the phone that version 3 dropped does not come back
    assert [r.phone for r in got.orderBy("id").collect()] == ["none", "none", "none", "44"]


def test_twice_changes_nothing(table):
    before = files(table.path)
    assert table.migrate(STEPS) == [] and table.version() == 4
    table.create(table.schema(1))
    assert files(table.path) == before


def test_conflicts(spark, table):
    with pytest.raises(MigrationConflict):
        table.migrate([Migration(3, drop=("token",))])
    with pytest.raises(MigrationConflict):
        table.migrate([Migration(6)])
    with pytest.raises(MigrationConflict):
        table.create(table.schema())
    with pytest.raises(ValueError):
        table.append(spark.range(1))
    assert table.version() == 4 and table.read().count() == 4
    # an old writer may still append in its own version
    table.append(spark.createDataFrame([(5, "e", "5")], "id long, name string, phone string"), version=1)
    assert table.read().filter("id = 5").first().asDict() == {
        "id": 5, "name": "e", "verified": False, "token": None, "logins": 0, "phone": "none"}


def test_filters_and_columns_reach_each_version(table):
    plan = table.read().filter("id > 3").select("id", "logins")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThan(id,3)") == 3 and plan.count("ReadSchema: struct<id:bigint>") == 2
    assert "ReadSchema: struct<id:bigint,logins:int>" in plan


def test_empty_table(spark):
    t = VersionedTable(spark, tempfile.mkdtemp(prefix="sw-migrations-"))
    with pytest.raises(FileNotFoundError):
        t.schema()
    t.create(spark.range(0).schema)
    t.migrate([Migration(2, add={"a": ("int", 1)})])
    assert t.read().columns == ["id", "a"] and t.read().count() == 0


def test_query(spark, duck):
    got = QUERIES["versioned_users"](spark, SF01)
    assert not compare(got, duck, ORACLE["versioned_users"]) and got.count() > 0

"""SNK-1: batches are committed wholly, once, or not at all."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.sources.committed import Commit, CommittedTable, ConstraintViolation


def order(i, **changes):
    row = {"id": i, "user_id": 1, "total_amount": Decimal("10.00"), "status": "pending", "delivery_address": "x", "payment_method": "card",
           "notes": None, "created_at": dt.datetime(2024, 1, 1), "updated_at": None}
    return {**row, **changes}


@pytest.fixture
def table(spark):
    return CommittedTable(spark, tempfile.mkdtemp(prefix="sw-commit-"), "orders", references={"user_id": spark.createDataFrame([(1,), (2,)], "id long")})


ORDER = ("id long, user_id long, total_amount decimal(10,2), status string, delivery_address string, payment_method string, "
         "notes string, created_at timestamp_ntz, updated_at timestamp_ntz")


def frame(spark, table, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in table.schema.fields) for r in rows], ORDER)


def state(table):
    folders = sorted(os.path.join(r, f) for r, _, names in os.walk(table.path) for f in names if f.endswith((".parquet", ".json")))
    return folders, sorted(map(tuple, table.read().collect()))


def test_a_replayed_batch_changes_nothing(spark, table):
    first = table.append(frame(spark, table, [order(1), order(2)]), "a")
    before = state(table)
    again = table.append(frame(spark, table, [order(7)]), "a")
    assert (first.rows, first.replayed, again.rows, again.replayed, again.folder) == (2, False, 2, True, first.folder)
    assert state(table) == before and len(before[1]) == 2


@pytest.mark.parametrize("rows,rule", [
    ([order(5), order(6, status="lost")], "domain:status"),
    ([order(5), order(6, delivery_address=None)], "not_null:delivery_address"),
    ([order(5, payment_method="p" * 51)], "width:payment_method"),
    ([order(5), order(5, user_id=2)], "unique:id"),
    ([order(5), order(2)], "unique:id"),                # there already
    ([order(5), order(6, user_id=3)], "references:user_id"),
])
def test_a_batch_that_breaks_a_rule_leaves_the_table(spark, table, rows, rule):
    table.append(frame(spark, table, [order(1), order(2)]), "a")
    before = state(table)
    with pytest.raises(ConstraintViolation) as e:
        table.append(frame(spark, table, rows), "b")
    assert e.value.counts == {rule: 1}
    assert state(table) == before
    # the batch may be sent again, mended
    table.append(frame(spark, table, [order(5)]), "b")
    assert table.read().count() == 3


def test_a_batch_that_fails_while_it_is_written(spark, table):
    table.append(frame(spark, table, [order(1)]), "a")
    before = state(table)
    bad = frame(spark, table, [order(i) for i in range(2, 60)]).repartition(4).withColumn(
        "total_amount", F.when(F.col("id") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("total_amount")))
    with pytest.raises(Exception, match="lost"):
        table.append(bad, "b")
    assert state(table)[1] == before[1] and [r.batch_id for r in table.commits().collect()] == ["a"]
    assert table.clean() <= 1
    assert state(table) == before


def test_of_two_attempts_the_first_to_commit_counts(spark, table, monkeypatch):
    """The other attempt commits after this one has looked, and before it commits."""
    real = table._key_counts

    def overtaken(staged):
        monkeypatch.setattr(table, "_key_counts", real)
        table.append(frame(spark, table, [order(1), order(2)]), "a")
        return {}

    monkeypatch.setattr(table, "_key_counts", overtaken)
    late = table.append(frame(spark, table, [order(3)]), "a")
    assert late.replayed and late.rows == 2 and sorted(r.id for r in table.read().collect()) == [1, 2]
    assert table.clean() == 0


def test_an_empty_table_and_an_empty_batch(spark, table):
    assert table.read().count() == 0 and table.commits().count() == 0 and table.read().schema == table.schema
    assert table.append(frame(spark, table, [order(1)]).limit(0), "none") == Commit("none", table.commits().first().folder, 0)
    assert table.read().count() == 0
    plain = CommittedTable(spark, tempfile.mkdtemp(prefix="sw-commit-"), schema="k long, v string", rules={"odd": F.col("k") % 2 == 1},
                           unique=(("k", "v"),))
    plain.append(spark.createDataFrame([(2, "a"), (2, "b"), (None, None)], "k long, v string"), "x/y z")
    with pytest.raises(ConstraintViolation, match="odd"):
        plain.append(spark.createDataFrame([(3, "a")], "k long, v string"), 2)
    assert plain.read().count() == 3 and plain.commits().first().batch_id == "x/y z"

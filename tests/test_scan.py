import datetime
import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators.scan import row_number_within, running_sum, splitters


def _rows(n=5000, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # key 0 is hot: about a third of all rows
        k = 0 if rnd.random() < 0.34 else rnd.randint(1, 40)
        out.append((k, rnd.randint(0, 1000), i, rnd.randint(-5, 9), rnd.random()))
    return out


def test_running_sum_matches_window(spark):
    df = spark.createDataFrame(_rows(), "k long, t long, i long, q long, x double")
    got = running_sum(df, ["k"], ["t", "i"], ["q", "x"], ["q_run", "x_run"])
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("k", "t", "i", F.sum("q").over(w).alias("q_exp"),
                    F.sum("x").over(w).alias("x_exp"))
    j = got.join(exp, ["k", "t", "i"])
    assert j.count() == 5000
    bad = j.filter((F.col("q_run") != F.col("q_exp"))
                   | (F.abs(F.col("x_run") - F.col("x_exp")) > 1e-6)).count()
    assert bad == 0


def test_exclusive_and_global(spark):
    df = spark.createDataFrame(_rows(800, 3), "k long, t long, i long, q long, x double")
    got = running_sum(df, [], ["i"], ["q"], ["before"], inclusive=False)
    rows = sorted(got.select("i", "q", "before").collect())
    acc = 0
    for i, q, before in rows:
        assert before == acc
        acc += q
    rn = row_number_within(df, ["k"], ["t", "i"], "rn")
    w = Window.partitionBy("k").orderBy("t", "i")
    exp = df.select("k", "t", "i", F.row_number().over(w).alias("rn_exp"))
    assert rn.join(exp, ["k", "t", "i"]).filter("rn != rn_exp").count() == 0
    assert "_scan_one" not in rn.columns


@pytest.mark.parametrize("kind,make", [
    ("long", lambda i: (i * 7919) % 60_000 - 30_000),
    ("timestamp_ntz", lambda i: datetime.datetime(2001, 1, 1) + datetime.timedelta(minutes=(i * 97) % 5000)),
    ("date", lambda i: datetime.date(2001, 1, 1) + datetime.timedelta(days=i % 40)),
    ("string", lambda i: "abcdefgh"[i % 8] * (i % 5)),
    ("double", lambda i: (i * 31) % 17 / 4),
])
def test_every_kind_of_order_column_over_many_buckets(spark, kind, make):
    rows = [(i % 3, None if i % 50 == 0 else make(i), i, i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, f"k long, t {kind}, i long, q long")
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("i", F.sum("q").over(w).alias("r")).collect()
    got = running_sum(df, ["k"], ["t", "i"], ["q"], ["r"]).select("i", "r").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_nulls_large_keys_and_overflow(spark):
    big = (1 << 53) + 1
    rows = [(None if i % 5 == 0 else big + i % 3, i, None if i % 4 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long, q long")
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "i", F.coalesce(F.sum("q").over(w), F.lit(0)).alias("r")).collect()
    got = running_sum(df, ["k"], ["i"], ["q"], ["r"]).select("k", "i", "r").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    top = spark.createDataFrame([(1, 1, (1 << 63) - 1), (1, 2, 1)], "k long, i long, q long")
    with pytest.raises(Exception, match="OVERFLOW"):
        running_sum(top, ["k"], ["i"], ["q"], ["r"]).collect()


def test_a_hot_key_is_spread_over_its_buckets(spark):
    """The rows of the largest group that a task sorts, for one key with all rows and
    one value in the first order column."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.lit("same").alias("t"), F.col("id").alias("i"), F.lit(1).alias("q"))
    cut = splitters(df, ["k"], ["t", "i"], rows=10_000)
    sizes = [r["count"] for r in cut.placed(df).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 14 and max(sizes) <= 20_000
    got = running_sum(df, ["k"], ["t", "i"], ["q"], ["r"], cut=cut)
    assert got.filter("r != i + 1").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ExistingRDD" not in plan
    # the rows are exchanged once; the rest are totals of buckets
    assert plan.count("hashpartitioning(_key") + plan.count("hashpartitioning(k#") <= 3


@pytest.mark.parametrize("keys", [["k"], []])
def test_buckets_change_no_sum(spark, keys):
    """Hot and small keys, NULL keys and places, at many bucket sizes."""
    rows = [(None if i % 9 == 0 else 0 if i % 3 else i % 11, None if i % 7 == 0 else i % 40, i, i % 5 - 2, i / 8) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, t long, i long, q long, x double")
    w = Window.partitionBy(*keys).orderBy("t", "i")
    want = sorted(map(tuple, df.select("i", F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"),
                                       F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b")).collect()))
    for size in (7, 100, 2999, 3000):
        one = running_sum(df, keys, ["t", "i"], ["q"], ["a"], rows=size)
        both = running_sum(one, keys, ["t", "i"], ["x"], ["b"], inclusive=False, rows=size, counted=df)
        assert sorted(map(tuple, both.select("i", "a", "b").collect())) == want
    assert splitters(df, keys, ["t", "i"], rows=3000) is None


def test_the_number_of_splitters_is_bounded(spark, monkeypatch):
    from shelfwise.operators import scan
    monkeypatch.setattr(scan, "MOST_BUCKETS", 8)
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.lit(1).alias("q"))
    cut = splitters(df, ["k"], ["i"], rows=10)
    assert cut.table.selectExpr("sum(size(_splits))").first()[0] <= 16
    assert running_sum(df, ["k"], ["i"], ["q"], ["r"], rows=10).filter("r != floor(i / 3) + 1").count() == 0

import datetime as dt
from decimal import Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfwise.functions import (delivery_fee, file_extension, first_element, line_text,
                                 month_label, name_token, split_list)


def test_scalar_helpers(spark):
    df = spark.createDataFrame(
        [("a,b", "Photo.Final.JPG", dt.datetime(2024, 2, 29, 23, 0), 2, Decimal("350.00")),
         ("", "x.png", dt.datetime(2024, 3, 1), 1, Decimal("5000.00")),
         (None, "noext", dt.datetime(2024, 3, 1), 3, Decimal("1.50"))],
        "s string, f string, ts timestamp_ntz, q int, p decimal(10,2)")
    rows = df.select(split_list("s").alias("l"), file_extension("f").alias("e"),
                     month_label("ts").alias("m"), first_element(split_list("s")).alias("h"),
                     delivery_fee(F.col("p")).alias("fee"),
                     line_text(F.lit("Bag"), "q", "p").alias("t"),
                     name_token("f", "q").alias("n")).collect()
    assert [r.l for r in rows] == [["a", "b"], [], []]
    assert [r.e for r in rows] == ["jpg", "png", "noext"]
    assert [r.m for r in rows] == ["2024-02", "2024-03", "2024-03"]
    assert [r.h for r in rows] == ["a", None, None]
    assert [r.fee for r in rows] == [250, 0, 250]
    assert rows[0].t == "Bag (Qty: 2) - Rs. 700.00"
    assert len(rows[0].n) == 64 and rows[0].n != rows[1].n


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5)), min_size=1, max_size=60))
def test_running_sum_property(spark, rows):
    from shelfwise.operators.scan import running_sum
    data = [(k, i, q) for i, (k, q) in enumerate(rows)]
    df = spark.createDataFrame(data, "k long, i long, q long")
    got = {r.i: r.r for r in running_sum(df, ["k"], ["i"], ["q"], ["r"]).collect()}
    acc = {}
    for k, i, q in data:
        acc[k] = acc.get(k, 0) + q
        assert got[i] == acc[k]


def test_cli_list_and_run(spark, tmp_path, capsys):
    from shelfwise.__main__ import main
    assert main(["list"]) == 0
    assert "sales_report_monthly" in capsys.readouterr().out
    out = str(tmp_path / "rep")
    assert main(["run", "sales_report_monthly", "--source", "/root/testdata/sf0.001",
                 "--out", out]) == 0
    assert spark.read.parquet(out).count() > 0
    assert main(["run", "no_such_query", "--source", "/root/testdata/sf0.001"]) == 2

"""The driver contract in __spark_entry__."""

import __spark_entry__ as E


def test_entry_runs_on_smallest_scale(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["date", "orders", "revenue"]


def test_queries_and_oracles_line_up(spark, duck):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80 and all(callable(f) for f in q.values())
    # column names agree between Spark and SQL for a sample (all are compared in test_oracle)
    for name in ("sales_report_monthly", "top_selling", "cart_state", "stock_ledger"):
        spark_cols = sorted(q[name](spark, "/root/testdata/sf0.01").columns)
        sql_cols = sorted(duck.sql(o[name]).columns)
        assert spark_cols == sql_cols, name

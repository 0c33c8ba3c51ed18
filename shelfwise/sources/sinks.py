"""SNK-1: append rows to a table, with a schema check.

Writes go through Spark's file commit protocol: a failed or retried task leaves
no partial output, so an append is all-or-nothing per job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise.schemas import SCHEMAS
from shelfwise.sources.tables import with_defaults


def check_schema(df: DataFrame, table: str) -> None:
    expected = [(f.name, f.dataType) for f in SCHEMAS[table].fields]
    got = [(f.name, f.dataType) for f in df.schema.fields]
    if got != expected:
        raise ValueError(f"schema of rows for {table!r} does not match: {got} != {expected}")


def append(df: DataFrame, path: str, table: str | None = None) -> None:
    """Append ``df`` under ``path`` (Parquet).  With ``table`` the rows are given
    the table's defaults and column order first, then checked."""
    if table is not None:
        df = with_defaults(df, table)
        check_schema(df, table)
    df.write.mode("append").parquet(path)

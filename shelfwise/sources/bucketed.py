"""FLT-5, FLT-9, JN-1 and JN-2 over tables in buckets: the shop's indexes on keys
and references, as Spark keeps them.

A table is written once in ``buckets`` by hash of a key, sorted by it within a
bucket.  A look-up of a few keys reads their buckets only, and two tables in equally
many buckets of the same key join bucket by bucket, without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_KEYS = 1000        # of a look-up whose keys stand in the plan; more are joined


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> None:
    """Save ``df`` as table ``name``, one file for each bucket, in the folder ``path``."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path) \
        .mode("errorifexists").format("parquet").saveAsTable(name)


def lookup_keys(spark: SparkSession, name: str, key: str, values: list) -> DataFrame:
    """Rows of a short list of keys: buckets without one of them are not read."""
    if len(values) > MOST_KEYS:
        raise ValueError(f"{len(values)} keys: use lookup_table")
    table = spark.table(name)
    return table.filter(F.col(key).isin(values)) if values else table.limit(0)


def lookup_table(spark: SparkSession, name: str, key: str, keys: DataFrame) -> DataFrame:
    """Rows of a table of keys (column ``key``, any number of them)."""
    return spark.table(name).join(keys.select(key).distinct(), key, "left_semi")


def join_bucketed(spark: SparkSession, left: str, right: str, key: str, how: str = "inner") -> DataFrame:
    """Join of two tables in buckets of ``key``."""
    return spark.table(left).join(spark.table(right), key, how)

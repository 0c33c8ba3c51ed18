"""Typed table reads (SRC-1), seed rows (SRC-2), image files (SRC-3) and
idempotent schema migration (SRC-4)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.fixed import SEED_CATEGORIES, SEED_PRODUCTS
from shelfwise.schemas import DEFAULTS, SCHEMAS, SOURCE_SCHEMAS


def _path(base: str, name: str) -> str:
    base = base.rstrip("/")
    return f"{base}/{name}.parquet" if not name.endswith(".parquet") else f"{base}/{name}"


def read_table(spark: SparkSession, base: str, name: str, source: bool = False) -> DataFrame:
    """SRC-1: read a named table with its declared schema (no inference).

    Shop tables (``users``, ``orders``, ...) use :data:`SCHEMAS`; with
    ``source=True`` the driver's tables (``part``, ``orders``, ``lineitem``,
    ...) use :data:`SOURCE_SCHEMAS`.  Filters and projections applied later
    reach the Parquet scan.
    """
    schema = (SOURCE_SCHEMAS if source else SCHEMAS).get(name)
    if schema is None:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.schema(schema).parquet(_path(base, name))


def read_jdbc(spark: SparkSession, url: str, name: str, *, partition_column: str,
              lower_bound: int, upper_bound: int, num_partitions: int = 10,
              properties: dict | None = None) -> DataFrame:
    """SRC-1, database form: a parallel JDBC read split on a numeric key.

    ``num_partitions`` plays the role of the shop's connection pool (10).
    Needs a JDBC driver on the classpath; the result is cast to the declared
    schema.
    """
    df = spark.read.jdbc(url, name, column=partition_column, lowerBound=lower_bound,
                         upperBound=upper_bound, numPartitions=num_partitions,
                         properties=properties or {})
    schema = SCHEMAS[name]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields
                       if f.name in df.columns])


def seed_categories(spark: SparkSession) -> DataFrame:
    """SRC-2: the five seed categories, keys 1-5 in insertion order."""
    rows = [(i + 1, n, d, "active", None) for i, (n, d) in enumerate(SEED_CATEGORIES)]
    return spark.createDataFrame(rows, SCHEMAS["categories"])


def seed_products(spark: SparkSession) -> DataFrame:
    """SRC-2: the ten seed products, keys 1-10 in insertion order."""
    rows = [(i + 1, n, d, c, cid, Decimal(p), s, None, col, m, sz, 0, "active", None, None)
            for i, (n, d, c, cid, p, s, col, m, sz) in enumerate(SEED_PRODUCTS)]
    return spark.createDataFrame(rows, SCHEMAS["products"])


def read_images(spark: SparkSession, path: str, glob: str | None = None,
                recursive: bool = True) -> DataFrame:
    """SRC-3: image files as rows ``(path, file_name, modificationTime, length, content)``.

    The ``binaryFile`` source splits files across tasks; ``upload`` is the
    parent folder (one folder per upload), used by DQ-8's per-upload count.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    parts = F.split(F.col("path"), "/")
    return df.select(
        "path",
        F.element_at(parts, -1).alias("file_name"),
        F.element_at(parts, -2).alias("upload"),
        "modificationTime", "length", "content")


def conform(df: DataFrame, add: dict[str, tuple[T.DataType | str, object]] | None = None,
            drop: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """SRC-4: idempotent schema migration.

    ``add`` maps a column name to ``(type, default)``; a column that already
    exists is left as it is ("already done").  ``drop`` removes columns when
    present and is a no-op otherwise.  Running it twice equals running it once.
    """
    out = df
    existing = {c.lower() for c in df.columns}
    for name, (dtype, default) in (add or {}).items():
        if name.lower() in existing:
            continue
        lit: Column = F.lit(default) if default is not None else F.lit(None)
        out = out.withColumn(name, lit.cast(dtype))
    present = [c for c in drop if c.lower() in {x.lower() for x in out.columns}]
    return out.drop(*present) if present else out


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """SC-18: fill omitted or NULL defaulted columns with the declared default and
    order/cast the columns to the table schema."""
    schema = SCHEMAS[table]
    defaults = DEFAULTS.get(table, {})
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        elif f.name in defaults:
            c = F.lit(defaults[f.name]).cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)

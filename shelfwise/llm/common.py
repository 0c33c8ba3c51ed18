"""What the operators share: input columns, written tables, list columns."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import drop_path, require_checkpoint_dir

#: Stands for a null id inside an operator (its negative is a long, too), so that joins and ties have one rule.
NULL_ID = -(1 << 63) + 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``d`` (id, null as NULL_ID) and ``text``; other columns go."""
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("d"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with as many underscores before it as make it no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_out(col: str = "d") -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{require_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


_open_steps: list[list[str]] = []


@contextmanager
def steps():
    """Collects the folders of the tables that :func:`stored` writes meanwhile."""
    made: list[str] = []
    _open_steps.append(made)
    try:
        yield made
    finally:
        _open_steps.remove(made)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs no more than the tasks it ran."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    for made in _open_steps:
        made.append(path)
    free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` made and that no later step reads."""
    for t in tables:
        drop_path(t.sparkSession, t.written_path)


def drop_unread(docs: DataFrame, made: list[str]) -> None:
    """Delete the folders ``made`` but for those that ``docs`` reads."""
    if made:
        read_by = docs.inputFiles()
        for path in list(made):
            if not any(f"/{path.rstrip('/').rsplit('/', 1)[-1]}/" in f for f in read_by):
                drop_path(docs.sparkSession, path)
                made.remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished steps when the driver's garbage
    is collected, which may be hours away: have it collected now.  The listener bus
    keeps its last event, with the plan that has just ended, until another comes: a
    query of one row sends some."""
    spark.range(0, 1, 1, 1).collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, on whichever machine runs this."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    offsets = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return column.flatten().to_numpy(zero_copy_only=False), offsets


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))

"""Session settings and the checkpoint directory contract."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in the package relies on.  Shuffle partition counts are
# left to the cluster (AQE coalesces small ones); local runs pass their own.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE turns a sort-merge join into a broadcast join only when the
    # measured (not estimated) shuffle size of one side is under this.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Streaming state in RocksDB (needed by transformWithState; keeps large
    # keyed state off the JVM heap).
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Remove reliable-checkpoint files once nothing references them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shelfwise", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory the cluster names.

    Reads ``spark.checkpoint.dir`` (or the directory already set on the
    SparkContext).  The library never invents a machine-local folder: if
    nothing is configured it raises, and callers such as tests set one first
    with :func:`ensure_checkpoint_dir`.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the directory
        if conf_dir:
            return conf_dir
        raise RuntimeError("spark.checkpoint.dir is not set on the server session") from None
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; configure a shared (cluster-visible) "
        "checkpoint directory for this session")


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the configured checkpoint directory; set ``fallback`` only if unset and
    only where the master is local: on a cluster a folder of the driver's machine
    is seen by no executor, so that raises."""
    try:
        return require_checkpoint_dir(spark)
    except RuntimeError:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise
        os.makedirs(fallback, exist_ok=True)
        spark.sparkContext.setCheckpointDir(fallback)
        return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below the shared checkpoint folder: lineage ends
    here, each row is computed once, and a lost executor costs the tasks it ran.
    ``written_path`` of the result names the folder for :func:`drop_written`."""
    spark = df.sparkSession
    path = f"{require_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written(df: DataFrame) -> None:
    """Delete a table that :func:`written` made and that nothing reads any more."""
    drop_path(df.sparkSession, df.written_path)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, which need not have it on their
    path.  Once per application; Spark hands the file to every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfwise_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="shelfwise-"), "shelfwise.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)
    sc._shelfwise_shipped = True

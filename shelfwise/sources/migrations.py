"""SRC-4 by version: a table whose files keep the schema that they were written with.

The rows of version ``n`` lie in ``<path>/data/version=<n>``.  A migration adds columns
with defaults and drops columns; it is one file ``<path>/versions/<n>.json`` and rewrites
no data.  A read takes each version's files by that version's schema (so filters and
column selection reach them), applies the migrations that came after, in order, and
unites the versions: the table reads as if it had been rewritten whole each time.

A migration that is there already is not applied again; one of the same number and other
content raises :class:`MigrationConflict`, as does a gap in the numbers.  Adding a column
that exists and dropping one that does not change nothing, as in :func:`conform`.  A
column that was dropped and is added later starts from its default in every older row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfwise.sources.tables import conform


class MigrationConflict(RuntimeError):
    pass


@dataclass(frozen=True)
class Migration:
    """Version ``version`` of a table: columns added as name to (type in DDL, default), and dropped."""

    version: int
    add: dict[str, tuple[str, object]] = field(default_factory=dict)
    drop: tuple[str, ...] = ()

    def content(self) -> str:
        return json.dumps({"version": self.version, "add": {k: list(v) for k, v in self.add.items()}, "drop": list(self.drop)})

    @staticmethod
    def of(content: str) -> Migration:
        m = json.loads(content)
        return Migration(m["version"], {k: tuple(v) for k, v in m["add"].items()}, tuple(m["drop"]))

    def applied(self, df: DataFrame) -> DataFrame:
        return conform(conform(df, drop=self.drop), add=self.add)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write_once(self, name: str, content: str) -> bool:
        """Write a file of the versions' folder; False where there is one."""
        path, fs = self._file("versions", name)
        if fs.exists(path):
            return False
        part, _ = self._file("versions", f".{uuid.uuid4().hex}.tmp")
        out = fs.create(part, True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(part, path, sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))    # never over another
        except Py4JJavaError:
            fs.delete(part, False)
            if not fs.exists(path):
                raise
            return False
        return True

    def _content(self, name: str) -> str | None:
        path, fs = self._file("versions", name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, schema: T.StructType) -> None:
        """Version 1; nothing where it has this schema already."""
        if not self._write_once("1.json", schema.json()) and self._content("1.json") != schema.json():
            raise MigrationConflict(f"{self.path} was created with another schema")

    def migrations(self) -> list[Migration]:
        """Those that were applied, in order."""
        out: list[Migration] = []
        while (content := self._content(f"{len(out) + 2}.json")) is not None:
            out.append(Migration.of(content))
        return out

    def version(self) -> int:
        return len(self.migrations()) + 1

    def migrate(self, migrations: list[Migration]) -> list[int]:
        """Apply those that are not there yet; their numbers."""
        done = []
        for m in sorted(migrations, key=lambda m: m.version):
            if m.version > self.version() + 1 or m.version < 2:
                raise MigrationConflict(f"version {m.version} cannot follow version {self.version()}")
            if self._write_once(f"{m.version}.json", m.content()):
                done.append(m.version)
            elif self._content(f"{m.version}.json") != m.content():
                raise MigrationConflict(f"version {m.version} is another migration")
        return done

    def _empty(self, version: int) -> DataFrame:
        first = self._content("1.json")
        if first is None:
            raise FileNotFoundError(f"no table at {self.path}")
        empty = self.spark.createDataFrame([], T.StructType.fromJson(json.loads(first)))
        return reduce(lambda df, m: m.applied(df), self.migrations()[:version - 1], empty)

    def schema(self, version: int | None = None) -> T.StructType:
        """Of a version, or of the newest one; every column may be null."""
        found = self._empty(version or self.version()).schema
        return T.StructType([T.StructField(f.name, f.dataType) for f in found])

    def append(self, rows: DataFrame, version: int | None = None) -> None:
        """Add rows in the schema of ``version`` (a writer that has not moved on may
        name an older one); other columns than its own are refused."""
        version = version or self.version()
        schema = self.schema(version)
        if sorted(rows.columns) != sorted(schema.names):
            raise ValueError(f"version {version} has the columns {schema.names}, not {rows.columns}")
        rows.select(*[rows[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema]) \
            .write.mode("append").parquet(f"{self.path}/data/version={version}")

    def read(self) -> DataFrame:
        """All rows in the newest schema."""
        later = self.migrations()
        schema = self.schema()
        parts = []
        for version in range(1, len(later) + 2):
            path, fs = self._file("data", f"version={version}")
            if fs.exists(path):
                own = self.spark.read.schema(self.schema(version)).parquet(path.toString())
                parts.append(reduce(lambda df, m: m.applied(df), later[version - 1:], own).select(*[f"`{c}`" for c in schema.names]))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

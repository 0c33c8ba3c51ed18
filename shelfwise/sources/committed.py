"""SNK-1 with constraints: batches that are written wholly, once, or not at all.

A committed table is a folder with ``data/`` (Parquet files of each attempt to
write a batch) and ``commits/`` (one small JSON file for each batch that counts).
A batch goes through four steps:

1. a batch whose commit file is there has been written: nothing happens;
2. its rows are staged in a folder of their own, and the job that writes them
   counts the rows that break a rule (``DataFrame.observe``);
3. unique keys are checked within the staged rows and against the committed ones
   (of which Parquet statistics leave those in the staged range), references
   against their parents;
4. without a violation the commit file is renamed into place, which fails if
   another attempt has been faster; otherwise the staged folder goes and
   :class:`ConstraintViolation` tells the counts.

Readers see the folders that commits name, so an attempt that died, was refused or
came second is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.schemas import DOMAINS, SCHEMAS, UNIQUE_KEYS, WIDTHS, not_null_columns
from shelfwise.sources.sinks import check_schema
from shelfwise.sources.tables import with_defaults


class ConstraintViolation(ValueError):
    """``counts``: rows (for keys: key values) that break each rule."""

    def __init__(self, batch_id: str, counts: dict[str, int]):
        self.counts = counts
        super().__init__(f"batch {batch_id!r} breaks {counts}")


@dataclass(frozen=True)
class Commit:
    batch_id: str
    folder: str
    rows: int
    replayed: bool = False


def table_rules(table: str) -> dict[str, Column]:
    """The declared row rules of a shop table, as conditions that a bad row meets."""
    rules = {f"not_null:{c}": F.col(c).isNull() for c in not_null_columns(table)}
    rules |= {f"domain:{c}": ~F.col(c).isin(*values) for (t, c), values in DOMAINS.items() if t == table}
    return rules | {f"width:{c}": F.length(c) > n for c, n in WIDTHS.get(table, {}).items()}


class CommittedTable:
    """``table`` names a shop table: its schema, defaults, row rules and unique keys hold.
    Otherwise ``schema`` is given.  ``rules`` adds conditions that a bad row meets,
    ``unique`` tuples of key columns, and ``references`` maps a column to the
    parent's keys, a DataFrame of one column."""

    def __init__(self, spark: SparkSession, path: str, table: str | None = None, schema: T.StructType | str | None = None,
                 rules: Mapping[str, Column] | None = None, unique: tuple[tuple[str, ...], ...] = (),
                 references: Mapping[str, DataFrame] | None = None):
        self.spark, self.path, self.table = spark, path.rstrip("/"), table
        given = SCHEMAS[table] if table else schema
        self.schema = T.StructType.fromDDL(given) if isinstance(given, str) else given
        self.rules = {**(table_rules(table) if table else {}), **(rules or {})}
        self.unique = (UNIQUE_KEYS.get(table, ()) if table else ()) + tuple(unique)
        self.references = dict(references or {})
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # --- files (any Hadoop file system) ---

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _commit_file(self, batch_id: str) -> str:
        return f"{quote(batch_id, safe='')}.json"

    def _recorded(self, batch_id: str) -> Commit | None:
        file = self._path("commits", self._commit_file(batch_id))
        if not self._fs().exists(file):
            return None
        stream = self._fs().open(file)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Commit(found["batch_id"], found["folder"], found["rows"], replayed=True)

    def _record(self, commit: Commit) -> Commit:
        fs, part = self._fs(), self._path("commits", f".{uuid.uuid4().hex}.tmp")
        out = fs.create(part, True)
        try:
            out.write(bytearray(json.dumps({"batch_id": commit.batch_id, "folder": commit.folder, "rows": commit.rows}).encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(part, self._path("commits", self._commit_file(commit.batch_id)), never_over)
        except Exception:
            fs.delete(part, False)
            first = self._recorded(commit.batch_id)
            if first is None:
                raise
            return first
        return commit

    def _drop(self, folder: str) -> None:
        self._fs().delete(self._path(folder), True)

    # --- checks ---

    def _key_counts(self, staged: DataFrame) -> dict[str, int]:
        found = {}
        for key in self.unique:
            keys = staged.select(*key).na.drop()
            twice = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            span = keys.agg(F.min(key[0]).alias("least"), F.max(key[0]).alias("most")).first()
            if span["least"] is None:
                continue
            near = self.read().select(*key).filter(F.col(key[0]).between(F.lit(span["least"]), F.lit(span["most"])))
            again = keys.distinct().join(near.distinct(), list(key), "left_semi")
            bad = twice.select(*key).unionByName(again).distinct().count()
            found["unique:" + ",".join(key)] = bad
        for column, parent in self.references.items():
            keys = parent.select(F.col(parent.columns[0]).alias(column))
            found[f"references:{column}"] = staged.filter(F.col(column).isNotNull()).join(keys, column, "left_anti").count()
        return {k: n for k, n in found.items() if n}

    # --- writing and reading ---

    def append(self, rows: DataFrame, batch_id: str | int) -> Commit:
        """Write a batch once; a replay gives the first commit and changes nothing."""
        batch_id = str(batch_id)
        done = self._recorded(batch_id)
        if done is not None:
            return done
        if self.table is not None:
            rows = with_defaults(rows, self.table)
            check_schema(rows, self.table)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        folder = f"data/{quote(batch_id, safe='')}/{uuid.uuid4().hex}"
        seen = Observation()
        counts = [F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(self.rules.values())]
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.parquet(f"{self.path}/{folder}")
        broken = {name: seen.get[f"r{i}"] for i, name in enumerate(self.rules) if seen.get[f"r{i}"]}
        if not broken:
            broken = self._key_counts(self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}"))
        if broken:
            self._drop(folder)
            raise ConstraintViolation(batch_id, broken)
        commit = self._record(Commit(batch_id, folder, seen.get["rows"]))
        if commit.replayed:             # another attempt at this batch was faster
            self._drop(folder)
        return commit

    def commits(self) -> DataFrame:
        """``batch_id, folder, rows`` of each committed batch."""
        schema = "batch_id string, folder string, rows long"
        if not self._fs().exists(self._path("commits")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/commits")

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        folders = sorted(r.folder for r in self.commits().select("folder").collect())
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def clean(self) -> int:
        """Delete staged folders that no commit names (while nothing is being written)."""
        kept = {r.folder for r in self.commits().select("folder").collect()}
        gone = 0
        if self._fs().exists(self._path("data")):
            for batch in self._fs().listStatus(self._path("data")):
                for attempt in self._fs().listStatus(batch.getPath()):
                    folder = "/".join(("data", batch.getPath().getName(), attempt.getPath().getName()))
                    if folder not in kept:
                        self._drop(folder)
                        gone += 1
        return gone

    def batch_writer(self, prefix: str = "batch"):
        """For ``foreachBatch``: each micro-batch is committed once under its id."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, f"{prefix}-{batch_id}")
        return write

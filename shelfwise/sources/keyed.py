"""SNK-2, SNK-3 and SNK-4 on a part of a table.

A keyed table lies in ``partitions`` folders by hash of its key, and a manifest per
version says which folder holds each partition.  A change reads the partitions that
its keys fall in, writes those anew into a folder of its own, and makes the next
version: the old manifest with those partitions replaced.  The others are neither
read nor written, readers see one version wholly, and an attempt that fails leaves
files that no manifest names.  Of two changes to one version the second to finish
raises :class:`ConcurrentChange` and may be tried again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.maintenance import apply_updates


class ConcurrentChange(RuntimeError):
    pass


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, partitions: int = 64):
        self.spark, self.path, self.key, self.partitions = spark, path.rstrip("/"), key, partitions
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # --- manifests ---

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def version(self) -> int:
        """The newest version; 0 where the table has not been made."""
        folder = self._path("versions")
        if not self._fs().exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            raise FileNotFoundError(f"no table at {self.path}")
        stream = self._fs().open(self._path("versions", f"{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        fs, part = self._fs(), self._path("versions", f".{uuid.uuid4().hex}.tmp")
        out = fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(part, self._path("versions", f"{version}.json"), never_over)
        except Exception as e:
            fs.delete(part, False)
            raise ConcurrentChange(f"version {version} of {self.path} was made by another change") from e

    # --- partitions ---

    def part_of(self, column: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(column or self.key)), F.lit(self.partitions)).cast("int")

    def _write(self, rows: DataFrame, parts: list[int]) -> dict[str, str]:
        """Folders of ``parts``, written from ``rows`` (an empty one has none)."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_part", self.part_of()).repartition("_part").sortWithinPartitions("_part", self.key) \
            .write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        there = {s.getPath().getName() for s in self._fs().listStatus(self._path(folder))}
        return {str(p): f"{folder}/_part={p}" for p in parts if f"_part={p}" in there}

    def create(self, rows: DataFrame) -> int:
        schema = rows.schema.json()
        self._commit(1, {"schema": schema, "folders": self._write(rows, list(range(self.partitions)))})
        return 1

    def read(self, parts: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some partitions of it, as of a version (default: the newest)."""
        from pyspark.sql.types import StructType
        manifest = self._manifest(version)
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f for p, f in sorted(manifest["folders"].items()) if parts is None or int(p) in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def parts_of(self, keys: DataFrame) -> list[int]:
        """The partitions that a table's keys fall in: ``partitions`` numbers at most."""
        return sorted(r.p for r in keys.select(self.part_of().alias("p")).distinct().collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of a set of keys, from their partitions alone."""
        wanted = keys.select(self.key).distinct()
        return self.read(self.parts_of(wanted)).join(wanted, self.key, "left_semi")

    def _change(self, keys: DataFrame, new_rows) -> list[int]:
        """Replace the partitions of ``keys`` by ``new_rows`` of them; their numbers."""
        version = self.version()
        manifest, parts = self._manifest(version), self.parts_of(keys)
        if not parts:
            return []
        written = self._write(new_rows(self.read(parts, version)), parts)
        folders = {p: f for p, f in manifest["folders"].items() if int(p) not in parts}
        self._commit(version + 1, {**manifest, "folders": {**folders, **written}})
        return parts

    # --- changes ---

    def update(self, changes: DataFrame, cols: list[str], **stamp) -> list[int]:
        """SNK-2 (:func:`~shelfwise.operators.maintenance.apply_updates`) on the partitions of the changed keys."""
        return self._change(changes, lambda rows: apply_updates(rows, changes, self.key, cols, **stamp))

    def upsert(self, rows: DataFrame) -> list[int]:
        """SNK-3 for rows that bring their key: a row replaces that of its key or is added;
        of several rows of one key the last by ``ts`` (if there) and values counts.  Rows
        without a key are left out."""
        named = [c for c in rows.columns if c not in ("ts", self.key)]
        order = F.struct(*[F.col(c) for c in (["ts"] if "ts" in rows.columns else []) + named])
        one = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*named), order).alias("_r")) \
            .select(self.key, "_r.*")
        return self._change(one, lambda old: old.join(one.select(self.key), self.key, "left_anti")
                            .unionByName(one, allowMissingColumns=True).select(*old.columns))

    def delete(self, keys: DataFrame) -> list[int]:
        """SNK-4 on one table: rows of these keys go."""
        return self._change(keys, lambda rows: rows.join(keys.select(self.key).distinct(), self.key, "left_anti").select(*rows.columns))

    def clean(self, keep: int = 1) -> int:
        """Delete folders that none of the newest ``keep`` versions names (while nothing is read or written)."""
        newest = self.version()
        named = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self._manifest(v)["folders"].values()}
        gone = 0
        for write in self._fs().listStatus(self._path("data")):
            for part in self._fs().listStatus(write.getPath()):
                name = part.getPath().getName()
                if name.startswith("_part=") and f"data/{write.getPath().getName()}/{name}" not in named:
                    gone += bool(self._fs().delete(part.getPath(), True))
        return gone


def delete_from(parent: KeyedTable, keys: DataFrame, children: list[tuple[KeyedTable, str]] = ()) -> dict[str, list[int]]:
    """SNK-4 with CASCADE: delete ``keys`` from ``parent`` and the rows that refer to them
    from each child, a table kept by that reference: ``(child, fk)`` with ``child.key == fk``."""
    touched = {}
    for child, fk in children:
        if child.key != fk:
            raise ValueError(f"{child.path} is kept by {child.key}, not by {fk}")
        touched[child.path] = child.delete(keys.select(F.col(parent.key).alias(fk)))
    touched[parent.path] = parent.delete(keys)
    return touched

"""State tables (config versions, file index, publish log) as numbered snapshots of Parquet data.

A snapshot is a small file that lists the data folders of one version. Data
are written first, to a folder of their own; then the next snapshot is put in
place only if no other writer has put it there (compare and set). Of two
writers that start from the same version one fails with ``ConcurrentUpdate``
and leaves the table as it was; readers always see one whole version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseries.operators.index import merge_index


class ConcurrentUpdate(RuntimeError):
    """Another writer committed the next version first."""


class StateTable:
    """A table below ``root`` with versions 0 (empty), 1, 2, ..."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _snapshot(self, version: int) -> str:
        return f"{self.root}/_snapshots/{version:020d}.json"

    def version(self) -> int:
        """The newest committed version."""
        folder = self._path(f"{self.root}/_snapshots")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:20]) for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=0)

    def _folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        stream = self._fs.open(self._path(self._snapshot(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["folders"]

    def read(self, version: int | None = None) -> DataFrame:
        folders = self._folders(self.version() if version is None else version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def append(self, rows: DataFrame, expected: int) -> int:
        """Commit version ``expected`` + 1: that version's rows and these. Returns the new version."""
        return self._commit(rows, expected, self._folders(expected))

    def replace(self, rows: DataFrame, expected: int) -> int:
        """Commit version ``expected`` + 1: these rows only (also compacts a table of many appends)."""
        return self._commit(rows, expected, [])

    def _commit(self, rows: DataFrame, expected: int, kept: list[str]) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        names = [f.name for f in self.schema.fields]
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).toDF(*names).write.parquet(f"{self.root}/{folder}")
        return self._put(expected, [*kept, folder])

    def _put(self, expected: int, folders: list[str]) -> int:
        jvm = self.spark.sparkContext._jvm
        target = self._path(self._snapshot(expected + 1))
        if self.version() != expected:
            raise ConcurrentUpdate(f"{self.root}: version {expected} is no longer the newest")
        temp = self._path(f"{self.root}/_snapshots/_{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(temp, target, no_options)  # fails if the target exists
        except Exception as exc:
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in str(exc):
                raise ConcurrentUpdate(f"{self.root}: version {expected + 1} was committed by another writer") from None
            raise
        return expected + 1


def record_versions(table: StateTable, changes: DataFrame, expected: int) -> int:
    """Append new config versions; ``version_id`` from the creation time and hash."""
    return table.append(changes.withColumn("version_id", F.xxhash64("dataset_id", "hash", "created_at")), expected)


def update_index(table: StateTable, updates: DataFrame, expected: int) -> int:
    """Merge refreshed entries into the file index of version ``expected``."""
    return table.replace(merge_index(table.read(expected), updates), expected)

"""Tables that are changed by key while others read them.

A version is a folder of Parquet files that is never changed.  The manifest is a
folder of small files, one for each version, that name its folder; a version
exists from the moment at which its file is renamed into the manifest.  That
rename fails if another writer was faster, so two writers never make one version.
A reader is bound to the version it opened.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer committed the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}"

    def versions(self) -> list[int]:
        """The versions of the manifest, in order."""
        at = self._path(f"{self.path}/manifest")
        if not self._fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit())

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._path(self._name(version)))
        try:
            return f"{self.path}/{stream.readUTF()}"
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the last."""
        known = self.versions()
        if not known:
            raise ValueError(f"{self.path} has no version")
        return self.spark.read.parquet(self._folder(known[-1] if version is None else version))

    def _commit(self, rows: DataFrame, version: int) -> int:
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        made = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        stream.writeUTF(folder)
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            # fails if the file is there already
            context.rename(self._fs.makeQualified(made), self._fs.makeQualified(self._path(self._name(version))), none)
        except Py4JJavaError as e:
            self._fs.delete(made, False)
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise Conflict(f"version {version} of {self.path} is another writer's") from e
        return version

    def replace(self, rows: DataFrame, base: int | None = None) -> int:
        """Commits ``rows`` as the version behind ``base``, by default the last."""
        known = self.versions()
        at = base if base is not None else (known[-1] if known else 0)
        return self._commit(rows, at + 1)

    def upsert(self, rows: DataFrame, key: str, tries: int = 3) -> int:
        """Puts rows in by key: in place of those with their key, or new; of one key the largest row counts.

        If another writer was faster, its version is taken as the base of
        another try.  A first upsert makes the table.
        """
        own = rows.groupBy(key).agg(F.max(F.struct(*[c for c in rows.columns if c != key])).alias("r")).select(key, "r.*").select(*rows.columns)
        for left in range(tries - 1, -1, -1):
            known = self.versions()
            base = known[-1] if known else 0
            whole = self.read(base).join(own.select(key), key, "left_anti").unionByName(own, allowMissingColumns=True) if known else own
            try:
                return self._commit(whole, base + 1)
            except Conflict:
                if not left:
                    raise
        raise ValueError("at least one try")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last versions, and folders that no version names; not while a writer is at work.  Gives the number of folders deleted."""
        known = self.versions()
        for version in known[:-keep]:
            self._fs.delete(self._path(self._name(version)), False)
        named = {self._folder(v).rsplit("/", 1)[1] for v in known[-keep:]}
        at, gone = self._path(f"{self.path}/data"), 0
        for f in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)
                gone += 1
        return gone

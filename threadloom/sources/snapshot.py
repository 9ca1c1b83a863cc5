"""Versioned snapshots of several tables, each published by a pointer file of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 17


class Snapshots:
    """A folder with ``v=N`` folders, one table each below, and a pointer file ``_published/N`` for each complete one.

    Readers see the highest published version.  Writers fill a new folder and then create its pointer by one
    rename that no reader can see half done, so a reader sees all tables of a snapshot or none of them; a writer
    that dies leaves a folder nobody reads, and the earlier pointer stands.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def current(self) -> int | None:
        found = [n for n in self._names(f"{self.root}/_published") if n.isdigit()]
        if not found:
            return None
        latest = max(map(int, found))
        stream = self._fs.open(self._path(f"{self.root}/_published/{latest}"))
        schema = int(stream.readLine())
        stream.close()
        if schema > SCHEMA_VERSION:
            raise ValueError(f"snapshot has schema {schema}, newer than {SCHEMA_VERSION}")
        return latest

    def read(self, table: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"no snapshot in {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={version}/{table}")

    def write(self, tables: dict[str, DataFrame], carry: bool = False) -> int:
        """Publishes a new version of the tables; with ``carry``, the present version's other tables go along."""
        before = self.current()
        version = max([before or 0, *(int(n[2:]) for n in self._names(self.root) if n.startswith("v=") and n[2:].isdigit())]) + 1
        if carry and before is not None:
            tables = {**{n: self.read(n) for n in self._names(f"{self.root}/v={before}") if n not in tables}, **tables}
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.root}/v={version}/{name}")
        fresh, final = self._path(f"{self.root}/v={version}/_pointer"), self._path(f"{self.root}/_published/{version}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(fresh, True)
        out.write(bytearray(f"{SCHEMA_VERSION}\n".encode()))
        out.close()
        if not self._fs.rename(fresh, final):
            raise OSError("the snapshot could not be published")
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last ``keep`` published snapshots."""
        gone = sorted(int(n) for n in self._names(f"{self.root}/_published") if n.isdigit())[: -keep or None]
        for version in gone:
            self._fs.delete(self._path(f"{self.root}/_published/{version}"), False)
            self._fs.delete(self._path(f"{self.root}/v={version}"), True)

"""Vectors by content: a text is embedded once, however many rows hold it and however often they are indexed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.chunking import embed
from threadloom.sources.shared import spread


class VectorStore:
    """(hash, embedding) below ``path``, in folders by the first digits of the text's hash.

    Rows are right whoever writes them, as the hash says what they are of: two writers may both embed a
    text, and a run that fails half-way leaves rows that the next one finds.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, digits: int = 1):
        self.spark, self.path, self.dim, self.digits = spark, path.rstrip("/"), dim, digits

    @staticmethod
    def hash(text: Column) -> Column:
        return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)

    def _folder(self, c: Column) -> Column:
        return F.substring(c, 1, self.digits)

    def stored(self) -> DataFrame:
        """(hash, embedding, folder) of all texts so far, one row each."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        schema = "hash string, embedding array<float>, batch string, folder string"
        found = files.exists(root) and [s for s in files.listStatus(root) if s.getPath().getName().startswith("batch=")]
        rows = self.spark.read.schema(schema).parquet(self.path) if found else self.spark.createDataFrame([], schema)
        return rows.drop("batch").dropDuplicates(["folder", "hash"])

    def fill(self, texts: DataFrame, text: str, backend: Callable[[list[str]], list[list[float]]], batch: int = 64) -> None:
        """Embeds what of ``texts`` the store has not, each text once."""
        asked = texts.select(self.hash(F.col(text)).alias("hash"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).dropDuplicates(["hash"])
        asked = asked.withColumn("folder", self._folder(F.col("hash")))
        missing = asked.join(self.stored().select("folder", "hash"), ["folder", "hash"], "left_anti")
        held = f"{self.path}/_asked-{uuid.uuid4().hex[:12]}"
        missing.write.parquet(held)  # a retried task asks for its own texts alone
        missing = self.spark.read.schema(missing.schema).parquet(held)
        if not missing.isEmpty():
            self._embed(missing, backend, batch)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(held)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _embed(self, missing: DataFrame, backend: Callable[[list[str]], list[list[float]]], batch: int) -> None:
        made = embed(spread(missing), "hash", "t", backend, self.dim, batch)
        made.select(F.col("key").alias("hash"), "embedding", self._folder(F.col("key")).alias("folder")).write.partitionBy("folder").parquet(f"{self.path}/batch={uuid.uuid4().hex[:12]}")

    def vectors(self, rows: DataFrame, text: str, backend: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64) -> DataFrame:
        """``rows`` with ``embedding``, the vector of its text; with a ``backend``, texts that have none yet are embedded first."""
        if backend is not None:
            self.fill(rows, text, backend, batch)
        known = self.stored().select(F.col("folder").alias("_folder"), F.col("hash").alias("_hash"), "embedding")
        keyed = rows.drop("embedding").withColumn("_h", self.hash(F.col(text)))
        return keyed.join(known, (self._folder(F.col("_h")) == F.col("_folder")) & (F.col("_h") == F.col("_hash")), "left").drop("_h", "_folder", "_hash")

    def prune(self, rows: DataFrame, text: str) -> None:
        """Leaves only vectors of texts that ``rows`` hold, in one batch."""
        kept = self.stored().join(rows.select(self.hash(F.col(text)).alias("hash")).distinct(), "hash", "left_semi").select("hash", "embedding", "folder")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("batch=")] if files.exists(root) else []
        kept.write.partitionBy("folder").parquet(f"{self.path}/batch={uuid.uuid4().hex[:12]}")
        for path in old:
            files.delete(path, True)

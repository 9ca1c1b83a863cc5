"""The folder that all machines of a session share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, set as checkpoint folder too; where none is set, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Tables of this many bytes have splits of their own; below, text work is spread over tasks of so many bytes.
LARGE, TASK_BYTES = 1 << 30, 1 << 20


def expected_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects of ``df``, 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def spread(df: DataFrame) -> DataFrame:
    """``df`` over enough tasks for work on its texts: a small file is one split, whatever its texts cost."""
    size = expected_bytes(df)
    return df.repartition(size // TASK_BYTES + 1) if TASK_BYTES < size < LARGE else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what reads it several times does not make it again."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's setting that drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that write tables need their shuffle files no longer than they run."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)

"""Streaming ingest: files that arrive are parsed and queued; windows of events with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.functions.text import maildir_unique
from threadloom.sources.mail import COLONS, parse_mail


#: A file as the watch sees it, and what it makes of it: fresh, or moved from ``old_path``.
FILE = "path string, modificationTime timestamp, length long, content binary"
SEEN = f"{FILE}, old_path string, fresh boolean"


def _box(path: Column) -> Column:
    return F.regexp_replace(path, r"/(?:new|cur)/[^/]*$", "")


def _identify(key: tuple, files: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Files of one (mailbox, unique name): the first is fresh, each other path is a move from the present one."""
    present = state.get[0] if state.exists else None
    for part in files:
        part = part.sort_values(["modificationTime", "path"], kind="stable")
        rows = []
        for path in part["path"]:
            rows.append((None if present in (None, path) else present, present is None, present != path))
            present = path
        part["old_path"], part["fresh"] = [r[0] for r in rows], [r[1] for r in rows]
        yield part[[r[2] for r in rows]]
    state.update((present,))


def identify(files: DataFrame) -> DataFrame:
    """A stream of files as :data:`SEEN`: state holds the present path of each unique name in its mailbox, so a batch meets its own names alone."""
    named = files.withColumns({"_b": _box(F.col("path")), "_u": maildir_unique(F.col("path"))})
    return named.groupBy("_b", "_u").applyInPandasWithState(_with_content, SEEN, "path string", "append", GroupStateTimeout.NoTimeout)


def _with_content(key: tuple, files: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    for part in _identify(key, (f.drop(columns=["_b", "_u"]) for f in files), state):
        part.loc[~part["fresh"], "content"] = None  # what only moved is not read again
        yield part


def watch_maildir(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parses new files below ``root`` as they come and appends messages, failures and moves below ``target``.

    A file that was only renamed (a flag, new to cur) is not parsed again: its move from its present path is written
    for :func:`threadloom.operators.merge.move_paths`.  A name that a file had before and takes again is no
    new file to the source: :func:`threadloom.operators.reconcile.sweep_paths` heals that.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).options(**COLONS).option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(r"/(?:cur|new)/[^/]+$"))

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)
        batch.where("NOT fresh").select("old_path", F.col("path").alias("new_path")).write.mode("overwrite").parquet(f"{target}/moved/batch={number}")
        parsed = parse_mail(batch.where("fresh"), root=root).persist(StorageLevel.DISK_ONLY)
        parsed.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{target}/messages/batch={number}")
        parsed.where("error IS NOT NULL").select("filepath", "error").write.mode("overwrite").parquet(f"{target}/failed/batch={number}")
        parsed.unpersist()
        batch.unpersist()

    return identify(files).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, events): counts by window; rows later than the watermark are dropped."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), key, "events")

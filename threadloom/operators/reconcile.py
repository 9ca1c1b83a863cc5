"""Deletion by reconciliation: sweep a listing against the index, then reap old tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import is_trashed, maildir_unique
from threadloom.operators.merge import move_paths

#: Days before a tombstone is reaped, share of messages and floor of one batch.
GRACE_DAYS, BATCH_PERCENT, BATCH_FLOOR = 7, 5.0, 10


def sweep(indexed: DataFrame, listing: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(unique, filepath, new_path, action) for each indexed message.

    ``indexed`` is (unique, filepath), ``listing`` (unique, path, trashed), ``tombstones`` (filepath).
    missing and trashed get a tombstone, renamed a new path, restored lose theirs, else none.
    """
    seen = listing.select("unique", F.col("path").alias("new_path"), "trashed")
    marked = tombstones.select("filepath").distinct().withColumn("marked", F.lit(True))
    rows = indexed.join(seen, "unique", "left").join(marked, "filepath", "left")
    action = (
        F.when(F.col("new_path").isNull(), "missing").when(F.col("trashed"), "trashed").when(F.col("new_path") != F.col("filepath"), "renamed")
        .when(F.col("marked"), "restored").otherwise("none")
    )
    return rows.select("unique", "filepath", "new_path", action.alias("action"))


def current_paths(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """(filepath, current): where each stored file is now, null if it is nowhere.

    The same path counts first, then a file of the same unique name in the same folder, then one in
    the sibling of new or cur.  ``listing`` is (path).
    """
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    box = lambda c: F.regexp_replace(c, r"/(?:new|cur)/[^/]*$|/[^/]*$", "")
    want = stored.select("filepath", maildir_unique(F.col("filepath")).alias("_u"), box(F.col("filepath")).alias("_b"))
    have = listing.select("path", maildir_unique(F.col("path")).alias("_u"), box(F.col("path")).alias("_b"))
    place = F.when(F.col("path") == F.col("filepath"), 0).when(folder(F.col("path")) == folder(F.col("filepath")), 1).otherwise(2)
    found = want.join(have, ["_u", "_b"], "left")
    return found.groupBy("filepath").agg(F.min_by("path", F.struct(place, "path")).alias("current"))


def sweep_paths(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: how many stored files have another path now, and how many have none; neither is marked."""
    found = current_paths(stored, listing)
    return found.agg(F.count_if(F.col("current") != F.col("filepath")).alias("renamed"), F.count_if(F.col("current").isNull()).alias("unreachable"))


def handle_moved(indexed: DataFrame, tombstones: DataFrame, moves: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(indexed, tombstones) after file moves (src_path, dest_path) of indexed files.

    The file keeps its identity under its new path; one that is flagged as trash gets a tombstone, one that is not loses its own.
    """
    known = moves.join(indexed.select(F.col("filepath").alias("src_path")), "src_path", "left_semi")
    moved = move_paths(indexed, known.select(F.col("src_path").alias("old_path"), F.col("dest_path").alias("new_path")), "filepath")
    marks = move_paths(tombstones, known.select(F.col("src_path").alias("old_path"), F.col("dest_path").alias("new_path")), "filepath")
    now_trashed = known.where(is_trashed(F.col("dest_path"))).select(F.col("dest_path").alias("filepath"), now.alias("marked_at"))
    alive = known.where(~is_trashed(F.col("dest_path"))).select(F.col("dest_path").alias("filepath"))
    return moved, add_tombstones(marks.join(alive, "filepath", "left_anti"), now_trashed)


def add_tombstones(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Tombstones (filepath, marked_at); the first mark counts."""
    return old.unionByName(fresh).groupBy("filepath").agg(F.min("marked_at").alias("marked_at"))


def reap(messages: DataFrame, tombstones: DataFrame, now: Column, grace_days: int = GRACE_DAYS, percent: float = BATCH_PERCENT, force: bool = False) -> DataFrame:
    """Messages that survive: those with a tombstone older than the grace go, unless they are too many at once."""
    due = tombstones.where(F.col("marked_at") <= now - F.make_interval(days=F.lit(grace_days))).select("filepath").distinct()
    doomed = messages.join(due.withColumn("_due", F.lit(True)), "filepath", "left")
    total = messages.agg(F.count(F.lit(1)).alias("_total"))
    many = doomed.agg(F.count_if(F.col("_due")).alias("_many")).crossJoin(total)  # one row
    allowed = F.lit(force) | (F.col("_many") <= F.greatest(F.lit(BATCH_FLOOR), F.floor(F.col("_total") * percent / 100)))
    return doomed.crossJoin(F.broadcast(many)).where(F.col("_due").isNull() | ~allowed).select(*messages.columns)

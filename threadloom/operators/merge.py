"""Idempotent merges: thread upserts, chunk diffs, attachments, last writes, cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.threads import compute_body, distinct_people, thread_rows


def merge_threads(old: DataFrame, new: DataFrame) -> DataFrame:
    """Threads after an upsert: ids are a union in order, people one by canonical address, dates widen.

    The subject shown is that of the oldest message ever seen, the snippet that of the newest; subject
    and folder stay as first stored.  Columns that both sides have and this rule does not name (a body)
    are the new side's where it has the thread.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.thread_id") == F.col("n.thread_id"), "full_outer")
    older = F.col("o.thread_id").isNull() | (F.col("n.date_first") < F.col("o.date_first"))
    stale = F.col("n.date_last") < F.col("o.date_last")
    none = F.array().cast("array<string>")
    listed = lambda c: (F.coalesce(F.col(f"o.{c}"), none), F.coalesce(F.col(f"n.{c}"), none))
    shown = lambda side: F.nullif(F.col(f"{side}.display_subject"), F.lit(""))
    rules = {
        "thread_id": F.coalesce("o.thread_id", "n.thread_id"), "subject": F.coalesce("o.subject", "n.subject"), "folder": F.coalesce("o.folder", "n.folder"),
        "message_ids": F.array_union(*listed("message_ids")),
        "has_attachments": F.coalesce("o.has_attachments", F.lit(False)) | F.coalesce("n.has_attachments", F.lit(False)),
        "date_first": F.least("o.date_first", "n.date_first"), "date_last": F.greatest("o.date_last", "n.date_last"),
        "snippet": F.when(F.col("n.thread_id").isNull() | (stale & (F.coalesce("o.snippet", F.lit("")) != "")), F.col("o.snippet")).otherwise(F.col("n.snippet")),
        "display_subject": F.when(older | shown("o").isNull(), F.coalesce(shown("n"), shown("o"))).otherwise(shown("o")),
    }
    for people in ("participants", "senders"):
        if people in old.columns and people in new.columns:
            rules[people] = distinct_people(F.concat(*listed(people)))
    for c in old.columns:
        if c not in rules and c in new.columns:
            rules[c] = F.when(F.col("n.thread_id").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*[rule.alias(name) for name, rule in rules.items()])


def upsert_threads(old: DataFrame, messages: DataFrame) -> DataFrame:
    """Stored threads (as :func:`threadloom.operators.threads.thread_rows` makes them) after new messages of any of them."""
    known = old.select(F.col("thread_id").alias("_t"), F.explode("message_ids").alias("_m"))
    fresh = messages.join(known, (F.col("thread_id") == F.col("_t")) & (F.col("message_id") == F.col("_m")), "left_anti")
    body = compute_body(old, fresh)
    merged = merge_threads(old, thread_rows(fresh)).drop("body_text").join(body, "thread_id", "left")
    return merged.select(*old.columns)


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: insert, delete or keep; keys are compared null-safely."""
    a, b = old.select(*keys).distinct().withColumn("_o", F.lit(True)), new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_n", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    change = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").otherwise("keep")
    return a.join(b, same, "full_outer").select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys], change.alias("change"))


def diff_chunks(old: DataFrame, new: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(message_id, attachment_id, chunk_id, change) by :func:`diff`, over slices: a message's body (attachment_id null) or one attachment.

    With ``vectors`` (chunk_id), a chunk that is inserted without one is an error.
    """
    found = diff(old, new, ["message_id", "attachment_id", "chunk_id"])
    if vectors is None:
        return found
    known = vectors.select(F.col("chunk_id").alias("_c")).distinct()
    joined = found.join(known, F.col("chunk_id") == F.col("_c"), "left")
    bare = (F.col("change") == "insert") & F.col("_c").isNull()
    change = F.when(bare, F.raise_error(F.concat(F.lit("no embedding for chunk "), F.col("chunk_id"))).cast("string")).otherwise(F.col("change"))
    return joined.select("message_id", "attachment_id", "chunk_id", change.alias("change"))


def change_counts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inserted, deleted, kept)."""
    return changes.groupBy(*keys).agg(*[F.count_if(F.col("change") == c).alias(name) for c, name in (("insert", "inserted"), ("delete", "deleted"), ("keep", "kept"))])


def chunk_slice(chunks: DataFrame, message_id: str, attachment_id: str | None = None) -> DataFrame:
    """Chunk ids of a message's body, or of one of its attachments."""
    return chunks.where((F.col("message_id") == message_id) & F.col("attachment_id").eqNullSafe(F.lit(attachment_id).cast("string"))).select("chunk_id")


def replace_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of what had their keys: a vector or an index row written anew."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*table.columns))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it has not."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def last_write(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return events.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def move_paths(rows: DataFrame, renames: DataFrame, path: str = "filepath") -> DataFrame:
    """``rows`` with new paths from (old_path, new_path); identity stays."""
    moved = rows.join(renames, F.col(path) == F.col("old_path"), "left")
    return moved.select(*[F.coalesce("new_path", path).alias(path) if c == path else F.col(c) for c in rows.columns])


def cascade(tables: dict[str, DataFrame], key: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """Each table without rows of deleted keys; tables without the key stay."""
    gone = deleted.select(key).distinct()
    return {name: t.join(gone, key, "left_anti") if key in t.columns else t for name, t in tables.items()}


def by_content(df: DataFrame, content: str, keep: Column) -> DataFrame:
    """(content_hash, first, copies): rows of equal content."""
    return df.groupBy(F.sha2(F.col(content), 256).alias("content_hash")).agg(F.min(keep).alias("first"), F.count(F.lit(1)).alias("copies"))

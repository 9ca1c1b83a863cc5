"""Lookups and aggregates over threads, messages and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import canonical_addr, display_name


def list_threads(threads: DataFrame, folder: str = "INBOX", limit: int = 20, offset: int = 0, filter_type: str = "all") -> DataFrame:
    """A page of a folder's threads, newest first."""
    if filter_type != "all":
        raise ValueError(f"unknown filter_type {filter_type!r}")
    return threads.where(F.col("folder") == folder).orderBy(F.col("date_last").desc(), "thread_id").offset(offset).limit(limit)


def list_folders(threads: DataFrame, folder: str = "folder") -> DataFrame:
    return threads.groupBy(F.col(folder).alias("folder")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "folder")


def get_by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value).limit(1)


def thread_of_message(entries: DataFrame, message_id: str) -> DataFrame:
    """(thread_id) of a message, from the map (message_id, thread_id, filepath)."""
    return entries.where(F.col("message_id") == message_id).select("thread_id").limit(1)


def messages_of_thread(entries: DataFrame, thread_id: str) -> DataFrame:
    return entries.where(F.col("thread_id") == thread_id).select("message_id", "filepath").orderBy("message_id")


def paths_by_content(files: DataFrame, content_hash: str | None) -> DataFrame:
    """(filepath) of indexed files with that content; an empty or missing hash has none."""
    same = F.col("content_hash") == content_hash if content_hash else F.lit(False)
    return files.where(same).select("filepath").orderBy("filepath")


def is_indexed(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(filepath, indexed) of the asked paths."""
    known = files.select(F.col("filepath").alias("_f")).distinct().withColumn("indexed", F.lit(True))
    return paths.join(known, F.col("filepath") == F.col("_f"), "left").select("filepath", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def people(threads: DataFrame, addresses: str = "participants") -> DataFrame:
    """(thread_id, at, email, name, label): a row for each entry with an address; label is what searches look in."""
    rows = threads.select("thread_id", F.posexplode(addresses).alias("at", "who")).select("thread_id", "at", canonical_addr(F.col("who")).alias("email"), display_name(F.col("who")).alias("name"))
    return rows.where("email <> ''").withColumn("label", F.lower(F.concat_ws(" ", "name", "email")))


def ranked_contacts(match: DataFrame, limit: int) -> DataFrame:
    """(email, names, threads) of rows of :func:`people`, those in most threads first."""
    # a thread names a person once: by the first of its entries that matches
    match = match.groupBy("thread_id", "email").agg(F.min_by("name", "at").alias("name"))
    found = match.groupBy("email").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("name") != "", F.col("name")))), ", ").alias("names"), F.countDistinct("thread_id").alias("threads"))
    return found.orderBy(F.col("threads").desc(), "email").limit(limit)


def find_contact(threads: DataFrame, query: str, limit: int = 10, addresses: str = "participants") -> DataFrame:
    """(email, names, threads): people whose name or address contains ``query``, in most threads first."""
    return ranked_contacts(people(threads, addresses).where(F.col("label").contains(query.strip().lower())), limit)


def stats(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: threads, messages, earliest and latest date."""
    a = threads.agg(F.count(F.lit(1)).alias("threads"), F.min("date_first").alias("earliest"), F.max("date_last").alias("latest"))
    return a.crossJoin(messages.agg(F.count(F.lit(1)).alias("messages")))  # one row each


def counts_by_status(jobs: DataFrame, status: str, domain: list[str]) -> DataFrame:
    """(status, count), zero where no job has that status."""
    known = jobs.sparkSession.createDataFrame([(x,) for x in domain], "status string")
    found = jobs.groupBy(F.col(status).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(found, F.col("status") == F.col("_s"), "left").select("status", F.coalesce("n", F.lit(0)).alias("count"))


def stage_percentiles(timings: DataFrame, stage: str, value: str) -> DataFrame:
    """(stage, p50, p95, max): linear interpolation; stages without a value have 0."""
    return timings.groupBy(F.col(stage).alias("stage")).agg(
        F.coalesce(F.percentile(value, 0.5), F.lit(0.0)).alias("p50"), F.coalesce(F.percentile(value, 0.95), F.lit(0.0)).alias("p95"), F.coalesce(F.max(value), F.lit(0.0)).alias("max"),
    )


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 200) -> DataFrame:
    """The last ``n`` rows of each key."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def recall_mrr(results: DataFrame, expected: DataFrame, cut: int = 10) -> DataFrame:
    """One row: recall (share of questions with a hit among the first ``cut``) and mean reciprocal rank.

    ``results`` is (question, id, rank), ``expected`` (question, id); a question without a hit counts 0.
    """
    hits = expected.join(results.where(F.col("rank") <= cut), ["question", "id"], "left").groupBy("question").agg(F.min("rank").alias("rank"))
    return hits.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))

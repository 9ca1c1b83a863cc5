"""The indexing queue as a table: claims, retries with back-off, dead letters, recovery."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.vectors import is_zero
from threadloom.operators.merge import last_write

#: Attempts before a job is dead, first delay and longest delay in seconds; the stages that fail.
MAX_ATTEMPTS, BASE_SECONDS, CAP_SECONDS = 5, 30, 6 * 3600
STAGES = ("parse", "thread", "thread_commit", "chunk", "embed", "db_write")


def enqueue(jobs: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Jobs after arrivals (filepath, reason, now): the last of a path counts, with no attempts behind it."""
    latest = last_write(arrivals, ["filepath"], [F.col("now").desc()])
    fresh = latest.select("filepath", "reason", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.col("now").alias("next_attempt_at"))
    return jobs.join(latest.select("filepath"), "filepath", "left_anti").select(*fresh.columns).unionByName(fresh)


def claim(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The ``n`` queued jobs that are due, the longest waiting first; nothing changes."""
    return jobs.where((F.col("status") == "queued") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "filepath").limit(n)


def backoff_seconds(attempts: Column) -> Column:
    """Delay after a failure, ``attempts`` having been made before it."""
    return F.least(F.lit(BASE_SECONDS) * F.pow(F.lit(2.0), attempts), F.lit(float(CAP_SECONDS))).cast("long")


def mark_failed(jobs: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs after a failed attempt: dead at ``max_attempts``, else queued for later."""
    made = F.col("attempts") + 1
    dead = made >= max_attempts
    later = F.timestamp_seconds(F.unix_timestamp(now) + backoff_seconds(F.col("attempts")))
    return jobs.withColumns({"status": F.when(dead, "dead").otherwise("queued"), "next_attempt_at": F.when(dead, F.col("next_attempt_at")).otherwise(later.cast("timestamp_ntz")), "attempts": made})


def to_index(files: DataFrame, indexed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files neither indexed nor dead."""
    return files.join(indexed.select("filepath"), "filepath", "left_anti").join(jobs.where("status = 'dead'").select("filepath"), "filepath", "left_anti")


def unembedded(threads: DataFrame, vector: str, chunks: DataFrame, busy: DataFrame, key: str) -> DataFrame:
    """Threads with a zero vector and no chunk that are not waiting or dead."""
    zero = threads.where(F.col(vector).isNull() | is_zero(F.col(vector)))
    return zero.join(chunks.select(key), key, "left_anti").join(busy.select(key), key, "left_anti")


def is_dead(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'dead'").select("filepath")


def is_pending(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").select("filepath")


def settle(jobs: DataFrame, outcomes: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs after outcomes (filepath, outcome, stage, error): succeeded and skipped go, terminal is dead at once with one attempt, failed waits or dies.

    The result has last_stage and last_error too.
    """
    got = outcomes.select(F.col("filepath").alias("_f"), "outcome", "stage", "error")
    base = jobs
    for c in ("last_stage", "last_error"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string"))
    both = base.join(got, F.col("filepath") == F.col("_f"), "left").where("outcome IS NULL OR outcome NOT IN ('succeeded', 'skipped')")
    retried = mark_failed(both, now, max_attempts)
    pick = {c: F.col(c) for c in base.columns}
    failed, terminal = F.col("outcome") == "failed", F.col("outcome") == "terminal"
    named = retried.select(*[F.col(c) for c in base.columns if c not in ("status", "attempts", "next_attempt_at")], "outcome", "stage", "error", F.col("status").alias("_status"), F.col("attempts").alias("_attempts"), F.col("next_attempt_at").alias("_next"))
    before = base.select(F.col("filepath").alias("_b"), F.col("status"), F.col("attempts"), F.col("next_attempt_at"))
    rows = named.join(before, F.col("filepath") == F.col("_b"))
    pick["status"] = F.when(terminal, "dead").when(failed, F.col("_status")).otherwise(F.col("status"))
    pick["attempts"] = F.when(terminal, F.lit(1)).when(failed, F.col("_attempts")).otherwise(F.col("attempts"))
    pick["next_attempt_at"] = F.when(failed, F.col("_next")).otherwise(F.col("next_attempt_at"))
    for c, source in (("last_stage", "stage"), ("last_error", "error")):
        pick[c] = F.when(terminal | failed, F.col(source)).otherwise(F.col(c))
    return rows.select(*[v.alias(c) for c, v in pick.items()])


def split_batch(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and failed rows of one micro-batch, by its column error."""
    return results.where("error IS NULL"), results.where("error IS NOT NULL")


def drain(jobs: DataFrame, now: Column, batch: int, phases: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """One batch of due jobs through phases; (jobs after it, rows that went through).

    A phase takes rows with filepath and returns them with a column error (null for good ones); a row that fails in
    one goes no further and the others go on.  An error ``skipped`` or ``terminal: ..`` ends a job at once.
    """
    rows, outcomes = claim(jobs, now, batch).select("filepath"), None
    for stage, phase in phases:
        good, bad = split_batch(phase(rows))
        kind = F.when(F.col("error") == "skipped", "skipped").when(F.col("error").startswith("terminal: "), "terminal").otherwise("failed")
        failed = bad.select("filepath", kind.alias("outcome"), F.lit(stage).alias("stage"), "error")
        outcomes = failed if outcomes is None else outcomes.unionByName(failed)
        rows = good.drop("error")
    done = rows.select("filepath", F.lit("succeeded").alias("outcome"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"))
    return settle(jobs, done if outcomes is None else outcomes.unionByName(done), now), rows

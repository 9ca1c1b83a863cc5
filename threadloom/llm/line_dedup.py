"""Line dedup over levelled sorted runs of line hashes.

The corpus' state is a set of runs, each a table (key, n_docs, last_doc) that is bucketed and
sorted by key, with one number of buckets for all.  A batch of documents is reduced to a table
of that layout, and each bucket of it is merge-anti-joined with the same bucket of every run:
what remains are the batch's new lines, added as a run at level 0.  Its counts of known lines
are kept beside the runs as increments, as counts are sums.  No run is shuffled or sorted again
by that: when a level holds ``fan_out`` runs, they are merged, bucket by bucket, into one run of
the next level, so a key is rewritten a logarithmic number of times.  Runs live in the shared
checkpoint folder; a lost executor costs only its tasks.

Hot lines: a batch counts a line per map task before the shuffle, and a run holds one row
for a line however many documents have it.  The rows (document, line) meet the frequent
lines in a sort-merge join, whose large partitions adaptive execution splits, or by
broadcast where Spark knows the written table's size to be under its threshold.

Defined results: a null or empty text is one empty line; rows with equal doc_id count as
documents of their own, and all keep a line if theirs is the largest id; a null doc_id is
below all others; very long texts are taken whole, one at a time; an empty table gives an
empty table; other columns pass through, those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm._common import Scratch, ids_and_text
from threadloom.llm._lines import cut_lines, long_enough, strip_key, unit_digests

MIN_CHARS, MIN_DOCS, BATCHES, FAN_OUT = 40, 5, 4, 3
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Scans of sorted buckets of one file each count as sorted, so merge joins need no sort."""
    before = spark.conf.get(_ORDERED, None)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ORDERED)
        else:
            spark.conf.set(_ORDERED, before)


def _plus(a: str, b: str) -> Column:
    return (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(a)


class LineRuns:
    """Levelled runs (key binary, n_docs long, last_doc long), bucketed and sorted by key; each key is in one run."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fan_out: int = FAN_OUT):
        self.spark, self.scratch, self.fan_out = spark, scratch, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = scratch.root.rsplit("/", 1)[1].replace("-", "_")
        self.levels: list[list[str]] = []
        self.increments: list[str] = []
        self.made = 0

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def _store(self, rows: DataFrame, kind: str) -> str:
        """Writes rows, which stand in one task for each key, as a table with a sorted file for each bucket."""
        name = f"{self.prefix}_{kind}_{self.made}"
        self.made += 1
        with _ordered_scans(self.spark):
            writer = rows.select("key", "n_docs", "last_doc").write.format("parquet").option("compression", "zstd").option("path", self.scratch.path(name))
            writer.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def _merge(self, names: list[str], kind: str) -> str:
        """One table from several, two at a time, by merge joins of their buckets; the old ones go."""
        merged = names[0]
        for name in names[1:]:
            right = self.spark.table(name).select("key", F.col("n_docs").alias("n"), F.col("last_doc").alias("last"))
            both = self.spark.table(merged).join(right.hint("merge"), "key", "full_outer")
            fresh = self._store(both.select("key", _plus("n_docs", "n"), F.greatest("last_doc", "last").alias("last_doc")), kind)
            self.drop(merged)
            self.drop(name)
            merged = fresh
        return merged

    def new_keys(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose key no run has: the merge-anti-joins, one for each run."""
        for name in self.names():
            batch = batch.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")
        return batch

    def _add_run(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, entries: DataFrame) -> None:
        """Adds a batch of (doc_id, key) rows: new keys as a run, counts of known keys as increments; merges full levels."""
        counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        batch = self._store(counts, "batch")
        if not self.names():
            self._add_run(batch, 0)
            return
        rows = self.spark.table(batch)
        fresh = self._store(self.new_keys(rows), "run")
        self.increments.append(self._store(rows.join(self.spark.table(fresh).select("key").hint("merge"), "key", "left_anti"), "more"))
        self.drop(batch)
        self._add_run(fresh, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_out:
            old, self.levels[level] = self.levels[level], []
            self._add_run(self._merge(old, "run"), level + 1)
            level += 1
        if len(self.increments) >= self.fan_out:
            self.increments = [self._merge(self.increments, "more")]

    def totals(self) -> DataFrame:
        """A row for each line: each run with the increments of its keys, which are in no other run."""
        found = []
        for name in self.names():
            run = self.spark.table(name)
            for more in self.increments:
                right = self.spark.table(more).select("key", F.col("n_docs").alias("n"), F.col("last_doc").alias("last"))
                run = run.join(right.hint("merge"), "key", "left").select("key", _plus("n_docs", "n"), F.greatest("last_doc", "last").alias("last_doc"))
            found.append(run)
        return reduce(DataFrame.unionByName, found)

    def clear(self) -> None:
        for name in self.names() + self.increments:
            self.drop(name)
        self.levels, self.increments = [], []


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with text cut, and n_lines, n_dropped, spans and kept_sha256 (see :func:`cut_lines`).

    A line whose key (white space stripped, A-Z lower-cased) has at least ``min_chars`` code
    points and is found in at least ``min_docs`` documents stays only in the document with
    the largest doc_id that holds it.
    """
    spark = docs.sparkSession
    base = ids_and_text(docs)

    def wanted(key: bytes) -> bool:
        return long_enough(key, min_chars)

    scratch = Scratch(spark, "line-dedup")
    entries = unit_digests(base, strip_key, wanted).select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    entries = scratch.save(entries, "entries", ["batch"])
    runs = LineRuns(spark, scratch)
    for batch in range(batches):
        runs.add(entries.where(F.col("batch") == batch))
    common = scratch.save(runs.totals().where(F.col("n_docs") >= min_docs).select("key", "last_doc"), "common")
    runs.clear()
    gone = (
        entries.select("doc_id", "key").join(common, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    )
    return cut_lines(docs, gone, strip_key, wanted)


def filter_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the columns they have, text without its common lines, n_chars counted again."""
    cut = dedup_lines(docs, **options)
    count = F.length("text").cast("long")
    return cut.select(*[count.alias(c) if c.lower() == "n_chars" else F.col(f"`{c}`") for c in docs.columns])

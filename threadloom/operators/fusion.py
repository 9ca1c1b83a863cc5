"""Reciprocal rank fusion, filters, evidence, re-ranking, and the hybrid search they make up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, time, timezone
from email.utils import parseaddr

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from threadloom.functions.text import canonical_addr
from threadloom.functions.vectors import knn
from threadloom.operators.keyword import KeywordIndex, best_per_thread, ranked, top

#: The fusion constant, and how much more is fetched than asked for.
RRF_K, OVERSAMPLE, OVERSAMPLE_FILTERED, OVERSAMPLE_CHUNKS, OVERSAMPLE_CHUNK_TEXT = 60, 2, 4, 3, 10
CANDIDATES, TOP_N = 20, 10
EVIDENCE, EVIDENCE_POOL = 3, 200


@dataclass(frozen=True)
class Filters:
    """Conditions on threads: folders, sender, days between which the thread was alive, attachments."""

    folders: Sequence[str] = ()
    sender: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    has_attachments: bool | None = None

    def any(self) -> bool:
        return bool(self.folders or self.sender or self.date_from or self.date_to) or self.has_attachments is not None


def parse_bound(value: str, upper: bool = False) -> datetime:
    """ISO date or time as UTC; a bare date as upper bound is the end of its day; ValueError if it is none."""
    day_only = len(value) == 10
    found = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if day_only and upper:
        found = datetime.combine(found.date(), time(23, 59, 59, 999999))
    return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def matches_sender(senders: Column, wanted: str) -> Column:
    """A full address (``a@b`` or ``Name <a@b>``) must be equal in canonical form; a domain or a part of a name must be contained."""
    wanted = wanted.strip()
    address = parseaddr(wanted)[1].strip().lower()
    if "@" in address and not wanted.startswith("@"):
        return F.exists(senders, lambda s: canonical_addr(s) == address)
    return F.exists(senders, lambda s: F.lower(s).contains(wanted.lower()))


def condition(filters: Filters) -> Column:
    """Filters as one predicate on folder, senders, date_first, date_last and has_attachments."""
    found = F.lit(True)
    if filters.folders:
        found = found & F.col("folder").isin(list(filters.folders))
    if filters.sender:
        found = found & matches_sender(F.col("senders"), filters.sender)
    if filters.date_from:
        found = found & (F.col("date_last") >= F.lit(parse_bound(filters.date_from)).cast("timestamp_ntz"))
    if filters.date_to:
        found = found & (F.col("date_first") <= F.lit(parse_bound(filters.date_to, True)).cast("timestamp_ntz"))
    if filters.has_attachments is not None:
        found = found & (F.col("has_attachments") == filters.has_attachments)
    return found


def without_sender(filters: Filters) -> Filters:
    return replace(filters, sender=None)


def apply_filters(threads: DataFrame, filters: Filters) -> DataFrame:
    return threads.where(condition(filters)) if filters.any() else threads


def fetch_limit(limit: int, candidates: int, filters: Filters) -> int:
    return max(limit, candidates) * (OVERSAMPLE_FILTERED if filters.any() else OVERSAMPLE)


def rrf(lanes: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score, first_lane, first_rank) over lanes (id, rank); equal scores stand as the lanes first name them."""
    together = None
    for i, lane in enumerate(lanes):
        one = lane.select("id", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("lane"))
        together = one if together is None else together.unionByName(one)
    fused = together.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("lane", "rank")).alias("first"))
    return fused.select("id", "score", F.col("first.lane").alias("first_lane"), F.col("first.rank").alias("first_rank"))


def lift_chunks(chunks: DataFrame, thread: str) -> DataFrame:
    """Lane of threads from ranked chunks: a thread has the rank of its first chunk, gaps stay."""
    return chunks.groupBy(F.col(thread).alias("id")).agg(F.min("rank").alias("rank"))


def in_order(fused: DataFrame, limit: int) -> DataFrame:
    return fused.orderBy(F.round("score", 12).desc(), "first_lane", "first_rank", "id").limit(limit)


def evidence(chunks: DataFrame, thread: str, per_thread: int = EVIDENCE) -> DataFrame:
    """The first ``per_thread`` ranked chunks of each thread."""
    place = F.row_number().over(W.partitionBy(thread).orderBy("rank"))
    return chunks.withColumn("place", place.cast("long")).where(F.col("place") <= per_thread)


def keyword_lane(index: KeywordIndex, query: str, limit: int, thread: str | None = None, threads: DataFrame | None = None, filters: Filters | None = None) -> DataFrame:
    """(id, rank) of threads by BM25; units below threads (chunks, attachments) count by their best.

    ``thread``: the carried column that names a unit's thread; without it units are threads.  With
    ``threads`` (thread_id and the columns that filters name), folders, days and attachments hold
    before the cut; a sender does not.  Statistics are those of all units.
    """
    owner = thread or "id"
    filtered = threads is not None and filters is not None and without_sender(filters).any()
    scored = index.bm25(query) if filtered else index.top_k(query, limit if thread is None else limit * OVERSAMPLE_CHUNK_TEXT)
    if filtered:
        kept = apply_filters(threads, without_sender(filters)).select(F.col("thread_id").alias("_kept"))
        scored = scored.join(kept, F.col(owner) == F.col("_kept"), "left_semi")
    if thread is None:
        return ranked(scored, limit).select("id", "rank")
    found = top(scored, limit * OVERSAMPLE_CHUNK_TEXT)
    best = best_per_thread(found, thread).select(F.col(thread).alias("id"), "score")
    return ranked(best, limit).select("id", "rank")


def vector_lane(df: DataFrame, id_column: str, vector: str, query: Sequence[float], limit: int) -> DataFrame:
    near = knn(df, id_column, vector, query, limit)
    return near.select(F.col(id_column).alias("id"), F.row_number().over(W.orderBy("dist", id_column)).cast("long").alias("rank"))


def hybrid_search(keyword_lanes: Sequence[DataFrame], thread_vectors: DataFrame | None, chunk_ranks: DataFrame | None, threads: DataFrame, filters: Filters, limit: int, fetch: int) -> DataFrame:
    """Threads by fused rank: keyword lanes are fused and cut first, then fused with the vector lanes.

    ``keyword_lanes`` and ``thread_vectors`` are (id, rank); ``chunk_ranks`` is (thread_id, rank);
    ``threads`` has thread_id and the columns that filters name.  Filters hold again after fusion;
    keyword lanes should have been cut after them (see :func:`keyword_lane`).
    """
    lexical = in_order(rrf(keyword_lanes), fetch)
    place = F.row_number().over(W.orderBy(F.col("score").desc(), "first_lane", "first_rank", "id"))
    lanes = [lexical.withColumn("rank", place.cast("long")).select("id", "rank")]
    if thread_vectors is not None:
        lanes.append(thread_vectors)
    if chunk_ranks is not None:
        lanes.append(lift_chunks(chunk_ranks, "thread_id"))
    kept = apply_filters(threads, filters)
    return in_order(rrf(lanes).join(kept, F.col("id") == F.col("thread_id")), limit)


def evidence_of(chunks: DataFrame, threads: DataFrame, per_thread: int = EVIDENCE) -> DataFrame:
    """(thread_id, evidence): the first ranked chunks of the given threads, as an array in order of rank."""
    wanted = chunks.join(threads.select("thread_id").distinct(), "thread_id", "left_semi")
    kept = [c for c in chunks.columns if c not in ("thread_id", "rank")]
    rows = evidence(wanted, "thread_id", per_thread)
    parts = rows.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("rank", *kept))).alias("evidence"))
    return parts.select("thread_id", "evidence")


def candidate_text(subject: Column, chunk: Column, snippet: Column) -> Column:
    """What a re-ranker reads of a thread: its subject, and its best chunk or else its snippet."""
    return F.concat(F.lit("Subject: "), F.coalesce(subject, F.lit("")), F.lit("\n\n"), F.coalesce(chunk, snippet, F.lit("")))


@dataclass(frozen=True)
class Reranker:
    """A scorer of (query, texts) and how many candidates it is given."""

    score: Callable[[str, list[str]], list[float]] = field(repr=False)
    candidates: int = CANDIDATES


def rerank(results: DataFrame, text: Column, scorer: Callable[[list[str]], list[float]], top_n: int) -> DataFrame:
    """The rows of a result that a limit bounds, by a scorer's judgement; in their own order if it fails."""
    rows = results.withColumn("_text", text).collect()
    scores: list[float | None]
    try:
        scores = [float(x) for x in scorer([r["_text"] for r in rows])]
        if len(scores) != len(rows):
            raise ValueError("a score for each row is needed")
        order = sorted(range(len(rows)), key=lambda i: -scores[i])
    except Exception:  # noqa: BLE001  a scorer is remote and may fail in any way
        order, scores = list(range(len(rows))), [None] * len(rows)
    names = results.columns
    picked = [(*(rows[i][c] for c in names), scores[i], n + 1) for n, i in enumerate(order[: max(0, min(top_n, len(rows)))])]
    schema = StructType([*results.schema.fields, StructField("rerank_score", DoubleType()), StructField("position", IntegerType())])
    return results.sparkSession.createDataFrame(picked, schema)

"""Searches over one mailbox: keyword, semantic and hybrid, with filters, evidence and re-ranking.

A mailbox is a snapshot's tables, three keyword indexes and, if wanted, cells of its vectors.  The lanes of a search
run side by side; each is cut to a few rows of ids and ranks, and only these come together.  Texts
are read last, for what is shown.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.vectors import embed_query, knn
from threadloom.operators import fusion, lookups, merge, threads
from threadloom.operators.fusion import Filters, Reranker
from threadloom.operators.keyword import KeywordIndex, like_fallback
from threadloom.operators.rag import clamp
from threadloom.operators.vector_index import VectorIndex
from threadloom.sources.shared import written

#: The most threads that one search returns, and the modes of a search.
MOST_RESULTS, MODES = 50, ("hybrid", "semantic", "keyword")


#: Where a chunk is.
PLACE = ("thread_id", "chunk_index", "char_start", "char_end")


def side_by_side(lanes: Sequence[Callable[[], DataFrame]]) -> list[DataFrame]:
    """Lanes that a limit bounds to few rows, run at the same time and held as local rows."""

    def held(lane: Callable[[], DataFrame]) -> DataFrame:
        df = lane()
        return df.sparkSession.createDataFrame(df.collect(), df.schema)

    if len(lanes) == 1:
        return [held(lanes[0])]
    with ThreadPoolExecutor(len(lanes)) as pool:
        return list(pool.map(held, lanes))


def _fused(lanes: Sequence[DataFrame], limit: int) -> DataFrame:
    """(id, score, first_lane, first_rank, rank) of the best of some lanes."""
    place = F.row_number().over(W.orderBy(F.round("score", 12).desc(), "first_lane", "first_rank", "id"))
    return fusion.in_order(fusion.rrf(lanes), limit).withColumn("rank", place.cast("long"))


@dataclass(frozen=True)
class Mailbox:
    """threads (thread_id and what :func:`threadloom.operators.threads.thread_rows` makes), thread_vectors (thread_id, embedding),
    chunks (chunk_id, thread_id, chunk_index, char_start, char_end, text, embedding), and indexes on threads, chunks and attachments.

    thread_cells, chunk_cells: vector indexes of the same vectors (that of chunks carries :data:`PLACE`), which spare a scan.
    """

    threads: DataFrame
    thread_index: KeywordIndex
    thread_vectors: DataFrame | None = None
    chunks: DataFrame | None = None
    chunk_index: KeywordIndex | None = None
    attachment_index: KeywordIndex | None = None
    thread_cells: VectorIndex | None = None
    chunk_cells: VectorIndex | None = None

    def _thread_lane(self, query: str, limit: int, filters: Filters) -> DataFrame:
        """Threads by keyword; where the index cannot be read, those whose subject, people or body contain the text, newest first."""
        try:
            return fusion.keyword_lane(self.thread_index, query, limit, threads=self.threads, filters=filters)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.like_lane(query, limit, filters)

    def upsert(self, messages: DataFrame) -> Mailbox:
        """The mailbox after new messages of known or new threads: only their threads are made anew, and only these are indexed."""
        touched = messages.select("thread_id").distinct()
        grown = written(merge.upsert_threads(self.threads.join(touched, "thread_id", "left_semi"), messages), "grown")
        kept = self.threads.join(touched, "thread_id", "left_anti")
        return replace(self, threads=kept.unionByName(grown), thread_index=self.thread_index.update(indexed(grown)))

    def reap(self, messages: DataFrame, removed: DataFrame, dim: int, backend: Callable[[list[str]], list[list[float]]] | None = None) -> Mailbox:
        """The mailbox without the messages of ``removed`` (message_id), out of all ``messages``: threads that lose some are made anew
        in rows, vectors and keyword index, threads that lose all go, as do chunks of removed messages (the column message_id)."""
        gone = removed.select("message_id").distinct()
        touched = messages.join(gone, "message_id", "left_semi").select("thread_id").distinct()
        left, vectors = threads.reap_threads(self.threads, messages, removed, self.chunks, self.thread_vectors, dim, backend)
        left, vectors = written(left, "threads"), written(vectors, "vectors")
        fresh = left.join(touched, "thread_id", "left_semi")
        index = self.thread_index.update(indexed(fresh), touched.select(F.col("thread_id").alias("id")))
        return replace(self, threads=left, thread_vectors=vectors, chunks=self.chunks.join(gone, "message_id", "left_anti"), thread_index=index)

    def like_lane(self, query: str, limit: int, filters: Filters) -> DataFrame:
        rows = self.threads.where(fusion.condition(fusion.without_sender(filters))).withColumn("_people", F.array_join("participants", " "))
        found = like_fallback(rows, query, ["subject", "body_text", "_people"], "date_last", "thread_id", limit)
        place = F.row_number().over(W.orderBy(F.col("date_last").desc(), "thread_id"))
        return found.select(F.col("thread_id").alias("id"), place.cast("long").alias("rank"))

    def _lexical_lanes(self, query: str, limit: int, filters: Filters) -> list[Callable[[], DataFrame]]:
        lanes = [lambda: self._thread_lane(query, limit, filters)]
        for index in (self.chunk_index, self.attachment_index):
            if index is not None:
                lanes.append(lambda index=index: fusion.keyword_lane(index, query, limit, thread="thread_id", threads=self.threads, filters=filters))
        return lanes

    def lexical(self, query: str, limit: int, filters: Filters) -> DataFrame:
        """(id, score, first_lane, first_rank, rank): keyword lanes of threads, chunks and attachments, fused and cut."""
        return _fused(side_by_side(self._lexical_lanes(query, limit, filters)), limit)

    def _results(self, ranked: DataFrame, filters: Filters, limit: int) -> DataFrame:
        """Threads of a fused lane that the filters keep, best first."""
        kept = fusion.apply_filters(self.threads, filters)
        return fusion.in_order(ranked.join(kept, F.col("id") == F.col("thread_id")), limit).drop("id")

    def keyword_search(self, query: str, filters: Filters = Filters(), limit: int = 10) -> DataFrame:
        found = self.lexical(query, fusion.fetch_limit(limit, 0, filters), filters)
        return self._results(found, filters, limit)

    def _near(self, vector: Sequence[float], limit: int) -> DataFrame:
        """(thread_id, dist) of the nearest threads."""
        if self.thread_cells is not None:
            return self.thread_cells.knn(vector, limit).select("thread_id", "dist")
        return knn(self.thread_vectors, "thread_id", "embedding", vector, limit)

    def semantic_search(self, vector: Sequence[float], filters: Filters = Filters(), limit: int = 10) -> DataFrame:
        """By Euclidean distance to the threads' vectors; score is the negative distance."""
        near = self._near(vector, fusion.fetch_limit(limit, 0, filters))
        found = near.select(F.col("thread_id").alias("id"), (-F.col("dist")).alias("score"), F.lit(0).alias("first_lane"), F.lit(0).alias("first_rank"))
        return self._results(found, filters, limit)

    def chunk_lane(self, vector: Sequence[float], limit: int) -> DataFrame:
        """(thread_id, rank, chunk_id, chunk_index, char_start, char_end) of the nearest chunks."""
        near = self.chunk_cells.knn(vector, limit) if self.chunk_cells is not None else knn(self.chunks, "chunk_id", "embedding", vector, limit, carry=PLACE)
        return near.select("thread_id", F.row_number().over(W.orderBy("dist", "chunk_id")).cast("long").alias("rank"), "chunk_id", *PLACE[1:])

    def _evidence(self, chunks: DataFrame, wanted: DataFrame, per_thread: int = fusion.EVIDENCE) -> DataFrame:
        """(thread_id, evidence) of few ranked chunks for wanted threads; texts of those alone are read."""
        picked = fusion.evidence(chunks.join(wanted.select("thread_id").distinct(), "thread_id", "left_semi"), "thread_id", per_thread).drop("place").collect()  # chunks of one lane
        rows = self.chunks.sparkSession.createDataFrame(picked, chunks.schema)
        texts = self.chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in picked])).select("chunk_id", "text")
        return fusion.evidence_of(rows.join(texts, "chunk_id").select("thread_id", "rank", "chunk_id", *PLACE[1:], "text"), wanted, per_thread)

    def hybrid_search(self, query: str, vector: Sequence[float], filters: Filters = Filters(), limit: int = 10, with_evidence: bool = False, reranker: Reranker | None = None) -> DataFrame:
        """Keyword lanes fused with thread and chunk vectors; evidence: the chunks of the chunk lane, three a thread at most."""
        candidates = reranker.candidates if reranker else 0
        fetch = fusion.fetch_limit(limit, candidates, filters)
        place = F.row_number().over(W.orderBy("dist", "thread_id")).cast("long")
        jobs = [*self._lexical_lanes(query, fetch, filters), lambda: self._near(vector, fetch).select(F.col("thread_id").alias("id"), place.alias("rank"))]
        if self.chunks is not None:
            jobs.append(lambda: self.chunk_lane(vector, fetch * fusion.OVERSAMPLE_CHUNKS))
        lanes = side_by_side(jobs)
        chunks = lanes.pop() if self.chunks is not None else None
        fused = [_fused(lanes[:-1], fetch).select("id", "rank"), lanes[-1]]
        if chunks is not None:
            fused.append(fusion.lift_chunks(chunks, "thread_id"))
        found = self._results(fusion.rrf(fused), filters, max(limit, candidates))
        if chunks is not None and (with_evidence or reranker):
            found = side_by_side([lambda: found])[0]  # as many rows as asked for
            best = self._evidence(chunks, found)
            found = found.join(best, "thread_id", "left").orderBy(F.round("score", 12).desc(), "first_lane", "first_rank", "thread_id")
        if reranker is None:
            return found
        passage = F.get("evidence", 0)["text"] if with_evidence and chunks is not None else F.lit(None).cast("string")
        text = fusion.candidate_text(F.col("subject"), passage, F.col("snippet"))
        return fusion.rerank(found, text, lambda texts: reranker.score(query, texts), limit)

    def evidence_for(self, thread_ids: DataFrame, vector: Sequence[float], per_thread: int = fusion.EVIDENCE, pool: int = fusion.EVIDENCE_POOL) -> DataFrame:
        """(thread_id, evidence) of given threads, from the ``pool`` nearest chunks of all."""
        return self._evidence(side_by_side([lambda: self.chunk_lane(vector, pool)])[0], thread_ids, per_thread)

    def search_emails(
        self, query: str, mode: str = "hybrid", folders: Sequence[str] = (), from_addr: str | None = None, from_name: str | None = None, date_from: str | None = None, date_to: str | None = None,
        has_attachments: bool | None = None, limit: int = 10, embed: Callable[[list[str]], list[list[float]]] | None = None, dim: int | None = None, reranker: Reranker | None = None,
    ) -> DataFrame:
        """Threads by one of :data:`MODES`; ``from_name`` stands for the sender of that name in most threads, and no such sender means no result."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        limit = clamp(limit, 10, 1, MOST_RESULTS)
        if from_name and not from_addr:
            who = lookups.find_contact(self.threads, from_name, 1, "senders").first()
            if who is None:
                return self.keyword_search(query, limit=limit).where(F.lit(False))
            from_addr = who["email"]
        filters = Filters(tuple(folders or ()), from_addr, date_from, date_to, has_attachments)
        if mode == "keyword" or (mode == "hybrid" and embed is None):
            return self.keyword_search(query, filters, limit)
        vector = embed_query(embed, query, dim)
        if mode == "semantic":
            return self.semantic_search(vector, filters, limit)
        return self.hybrid_search(query, vector, filters, limit, reranker=reranker)


def indexed(rows: DataFrame) -> DataFrame:
    """Threads as their keyword index takes them, with the people in one text."""
    return rows.withColumn("_people", F.array_join("participants", " "))


def rendered(results: DataFrame) -> DataFrame:
    """(thread_id, text): a result as a person reads it."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    label = F.coalesce(F.nullif("display_subject", F.lit("")), "subject")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Subject: "), label), F.concat(F.lit("Thread ID: "), "thread_id"), F.concat(F.lit("Participants: "), F.array_join("participants", ", ")),
        F.concat(F.lit("Dates: "), day("date_first"), F.lit(" to "), day("date_last")), F.concat(F.lit("Folder: "), "folder"), F.concat(F.lit("Snippet: "), F.coalesce("snippet", F.lit(""))),
    )
    return results.select("thread_id", lines.alias("text"))

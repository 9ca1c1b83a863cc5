"""Many questions at once: keyword and vector retrieval of a table of questions, fused in one plan, and how good it is.

Questions meet postings by term and vectors by cell, so no question is compared with all texts; results are those of
single searches.  Nothing comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.stem import query_phrases
from threadloom.operators import fusion, lookups
from threadloom.operators.chunking import embed
from threadloom.operators.keyword import B, IDF_FLOOR, K1, LOST, KeywordIndex
from threadloom.operators.vector_index import VectorIndex


def phrases(questions: DataFrame) -> DataFrame:
    """(question, phrase, step, term): the distinct phrases of each question (question, query), a row for each of their terms; phrase names equal ones alike."""
    kind = dict(questions.dtypes)["question"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, " ".join(p), step, term) for i, text in enumerate(batch.column("query").to_pylist()) for p in dict.fromkeys(map(tuple, query_phrases(text or ""))) for step, term in enumerate(p)]
            at, phrase, step, term = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("question").take(pa.array(at, pa.int32())), pa.array(phrase, pa.string()), pa.array(step, pa.int32()), pa.array(term, pa.string())], names=["question", "phrase", "step", "term"]
            )

    return questions.select("question", F.col("query").cast("string").alias("query")).mapInArrow(run, f"question {kind}, phrase string, step int, term string")


def _frequencies(index: KeywordIndex) -> DataFrame:
    """(term, rows) of all terms, from the dictionaries."""
    found = None
    for segment in index.segments:
        rows = index.spark.read.schema("term string, tier int, n long, most double").parquet(index._at(segment, "terms")).select("term", "n")
        found = rows if found is None else found.union(rows)
        if segment.dead:
            lost = index.spark.read.schema(LOST).parquet(index._at(segment, "lost")).where(F.col("segment").isin([s.name for s in index.segments]))
            found = found.union(lost.select("term", -F.col("n")))
    return found.groupBy("term").agg(F.sum("n").alias("held"))


def bm25_many(index: KeywordIndex, questions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(question, id, carried columns, score) of all rows that hold a phrase of a question (question, query)."""
    asked = phrases(questions)
    wanted = asked.select("phrase", "step", "term").distinct()
    found = index._living(index._postings(range(len(index.segments)), wanted.select("term").distinct())).select("id", *carry, "length", "term", "tf", "positions")
    single = wanted.groupBy("phrase").agg(F.count(F.lit(1)).alias("words"))
    wanted = wanted.join(single, "phrase")
    # one term: its postings as they are, and its frequency from the dictionary
    one = wanted.where("words = 1").join(_frequencies(index), "term").select("phrase", "term", "held").join(found.drop("positions"), "term").drop("term")
    # several terms: the places at which each would let the phrase begin must meet
    several = wanted.where("words > 1").join(found, "term").withColumn("begin", F.transform("positions", lambda p: p - F.col("step")))
    met = several.groupBy("phrase", "words", "id", *carry, "length").agg(F.collect_list("begin").alias("begins"))
    start = F.aggregate(F.slice("begins", 2, 1 << 30), F.get("begins", 0), F.array_intersect)
    met = met.where(F.size("begins") == F.col("words")).withColumn("tf", F.size(start)).where("tf > 0").select("phrase", "id", *carry, "length", "tf")
    held = met.groupBy("phrase").agg(F.count(F.lit(1)).alias("held"))
    rows = one.unionByName(met.join(held, "phrase").select(one.columns))
    idf = F.greatest(F.log((F.lit(float(index.rows)) - F.col("held") + 0.5) / (F.col("held") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(index.mean or 1.0)))
    scored = rows.withColumn("part", part).drop("length", "tf", "held")
    return scored.join(asked.select("question", "phrase").distinct(), "phrase").groupBy("question", "id", *carry).agg(F.round(F.sum("part"), 9).alias("score"))


def best(scored: DataFrame, limit: int) -> DataFrame:
    """(question, id, score, rank): the best of each question, ties by id."""
    place = F.row_number().over(W.partitionBy("question").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= limit)


def keyword_lane_many(index: KeywordIndex, questions: DataFrame, limit: int, thread: str | None = None) -> DataFrame:
    """(question, id, rank) as :func:`threadloom.operators.fusion.keyword_lane` gives each question; ``thread``: the carried column that names a unit's thread."""
    if thread is None:
        return best(bm25_many(index, questions), limit).select("question", "id", "rank")
    units = best(bm25_many(index, questions, (thread,)), limit * fusion.OVERSAMPLE_CHUNK_TEXT)
    top = units.groupBy("question", F.col(thread).alias("id")).agg(F.max("score").alias("score"))
    return best(top, limit).select("question", "id", "rank")


def fused(lanes: list[DataFrame], limit: int, k: int = fusion.RRF_K) -> DataFrame:
    """(question, id, score, rank): reciprocal rank fusion of lanes (question, id, rank) within each question, ties as the lanes first name them."""
    together = None
    for i, lane in enumerate(lanes):
        one = lane.select("question", "id", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("lane"))
        together = one if together is None else together.unionByName(one)
    rows = together.groupBy("question", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("lane", "rank")).alias("first"))
    place = F.row_number().over(W.partitionBy("question").orderBy(F.round("score", 12).desc(), "first", "id"))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= limit).select("question", "id", "score", "rank")


def retrieve(
    questions: DataFrame, limit: int, units: KeywordIndex, vectors: VectorIndex | None = None, chunks: KeywordIndex | None = None, backend: Callable[[list[str]], list[list[float]]] | None = None, thread: str = "thread_id",
) -> DataFrame:
    """(question, id, score, rank) of each question (question, query, and vector where there is no ``backend`` to make it).

    Keyword lanes of threads and of chunks are fused and cut first, then fused with the vector lane, as a single hybrid search does.
    """
    fetch = fusion.fetch_limit(limit, 0, fusion.Filters())
    lexical = [keyword_lane_many(units, questions, fetch)]
    if chunks is not None:
        lexical.append(keyword_lane_many(chunks, questions, fetch, thread))
    lanes = [fused(lexical, fetch)]
    if vectors is not None:
        if backend is not None:
            made = embed(questions, "question", "query", backend, vectors.dim)
            asked = questions.select("question").join(made, F.col("question").cast("string") == F.col("key")).select("question", F.col("embedding").alias("vector"))
        else:
            asked = questions.select("question", "vector")
        lanes.append(vectors.knn_many(asked, fetch).select("question", "id", "rank"))
    return fused(lanes, limit)


def quality(found: DataFrame, expected: DataFrame, cut: int = 10) -> DataFrame:
    """Recall and mean reciprocal rank of :func:`retrieve` against (question, id)."""
    return lookups.recall_mrr(found.select("question", "id", "rank"), expected, cut)

"""Registered queries over indexes and stores: pruned neighbours, many questions, substrings, vectors by content."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import batch, substring
from threadloom.operators.substring import SubstringIndex
from threadloom.operators.vector_index import VectorIndex
from threadloom.operators.vector_store import VectorStore
from threadloom.plans.catalog import DIST, LICENSE, MAIL, PROBE, RELEASED, bm25_sql, document_index, mail, once, query, table
from threadloom.sources.shared import fresh_dir


def cells(spark, d) -> VectorIndex:
    return once(spark, d, "cells", lambda: VectorIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding", 64, carry=("label",)))


def substrings(spark, d) -> SubstringIndex:
    return once(spark, d, "substrings", lambda: SubstringIndex.build(table(spark, d, "documents"), "doc_id", ["text", "source"]))


@query(f"WITH {DIST} SELECT vec_id, label, round(dist, 6) AS dist FROM d ORDER BY d.dist, vec_id LIMIT 10")
def vector_cells(spark, d):
    return cells(spark, d).knn(PROBE, 10).select("vec_id", "label", F.round("dist", 6).alias("dist"))


@query(f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE) / 2) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings WHERE vec_id % 10 <> 3)
SELECT vec_id, round(list_distance(v, CAST({PROBE} AS DOUBLE[])), 6) AS dist FROM e ORDER BY list_distance(v, CAST({PROBE} AS DOUBLE[])), vec_id LIMIT 40""")
def vector_cells_update(spark, d):
    """Some vectors change and some go; the index is not built again."""
    rows = table(spark, d, "embeddings")
    changed = rows.where("vec_id % 4 = 0 AND vec_id % 10 <> 3").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") / 2))
    now = cells(spark, d).update(changed, "embedding", rows.where("vec_id % 10 = 3").select(F.col("vec_id").alias("id")))
    return now.knn(PROBE, 40).select("vec_id", F.round("dist", 6).alias("dist"))


@query("""WITH p AS (SELECT q.vec_id AS question, e.vec_id AS id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS dist FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY dist, id) AS rank FROM p) SELECT question, id, rank, round(dist, 6) AS dist FROM r WHERE rank <= 10""")
def vectors_many(spark, d):
    """Every twentieth vector as a question to all."""
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    return cells(spark, d).knn_many(asked, 10).select("question", "id", "rank", F.round("dist", 6).alias("dist"))


QUESTIONS = {"a": ("license released", [LICENSE, RELEASED]), "b": ("apache Copyrighted", ["apaches?", "copyright(s|ed|ing)?"]), "c": ("notice", ["notic(e|es|ed|ing)?"])}
_DOCS = "(SELECT doc_id AS id, source AS owner, text FROM documents)"


@query(
    "WITH " + ", ".join(bm25_sql(f"bm_{q}", _DOCS, forms) for q, (_, forms) in QUESTIONS.items())
    + " SELECT * FROM ("
    + " UNION ALL ".join(f"(SELECT '{q}' AS question, id, row_number() OVER (ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM bm_{q} QUALIFY rank <= 20)" for q in QUESTIONS)
    + ")"
)
def keyword_many(spark, d):
    asked = spark.createDataFrame([(q, text) for q, (text, _) in QUESTIONS.items()], "question string, query string")
    return batch.best(batch.bm25_many(document_index(spark, d), asked), 20).select("question", "id", "rank", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT q.vec_id AS question, e.vec_id AS id, q.label = e.label AS same, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS dist FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY dist, id) AS rank FROM p), h AS (SELECT question, min(rank) FILTER (WHERE same AND id <> question AND rank <= 10) AS rank FROM r GROUP BY question)
SELECT round(avg(CAST(rank IS NOT NULL AS INTEGER)), 9) AS recall, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM h""")
def retrieval_quality(spark, d):
    """How often, and how early, a vector's ten nearest hold another of its label."""
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"), F.col("label").alias("_wanted"))
    found = cells(spark, d).knn_many(asked.select("question", "vector"), 10)
    right = asked.select("question", "_wanted").join(rows, F.col("_wanted") == F.col("label")).where("vec_id <> question").select("question", F.col("vec_id").alias("id"))
    # a question without any other row of its label has nothing to find: it counts as missed
    bare = asked.select("question").join(right.select("question").distinct(), "question", "left_anti").select("question", F.lit(-1).cast("long").alias("id"))
    got = batch.quality(found, right.unionByName(bare))
    return got.select(F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"))


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%licen_e%der%' OR source ILIKE '%licen_e%der%'")
def substring_search(spark, d):
    return substrings(spark, d).search("licen_e%der").select("doc_id", "source")


@query(f"""WITH {MAIL} SELECT addr AS email, min(trim(split_part(from_addr, '<', 1))) AS names, count(DISTINCT thread_id) AS threads FROM mail
WHERE lower(trim(split_part(from_addr, '<', 1)) || ' ' || addr) LIKE '%example%' GROUP BY addr""")
def contact_search(spark, d):
    def build():
        return substring.contact_index(mail(spark, d).groupBy("thread_id").agg(F.collect_set("from_addr").alias("participants")))

    return substring.find_contact(once(spark, d, "contacts", build), "Example")


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS length, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS DOUBLE) AS e FROM documents")
def embed_once(spark, d):
    """Each distinct text is embedded once; the vectors come back to all rows."""
    store = VectorStore(spark, fresh_dir(spark, "vector-store"), 2)
    found = store.vectors(table(spark, d, "documents"), "text", lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return found.select("doc_id", F.get("embedding", 0).cast("double").alias("length"), F.get("embedding", 1).cast("double").alias("e"))

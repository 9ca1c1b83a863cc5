import random

import pytest

from threadloom.operators import batch, fusion
from threadloom.operators.chunking import hash_embedder
from threadloom.operators.keyword import KeywordIndex
from threadloom.operators.vector_index import VectorIndex

WORDS = "alpha beta gamma delta running runs fly flies report reports license licensed a.b@c.org x1 y2".split()


@pytest.fixture(scope="module")
def parts(spark):
    r = random.Random(9)
    texts = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 25)))) for i in range(150)]
    model = hash_embedder(16)
    rows = spark.createDataFrame([(i, t, f"t{i % 40}", model([t])[0]) for i, t in texts], "id long, text string, thread_id string, embedding array<double>").persist()
    index = KeywordIndex.build(rows, "id", "text", carry=("thread_id",))
    index = index.update(rows.where("id % 7 = 0").withColumn("text", rows["thread_id"]), rows.where("id = 11").select("id"))
    asked = [(q, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 4)))) for q in range(25)] + [(97, "!!"), (98, None), (99, "nothing here")]
    return rows, index, VectorIndex.build(rows, "id", "embedding", 16), asked, model


def test_questions_score_as_single_searches(spark, parts):
    _, index, _, asked, _ = parts
    questions = spark.createDataFrame(asked, "question long, query string")
    many = {}
    for r in batch.bm25_many(index, questions).collect():
        many.setdefault(r.question, {})[r.id] = round(r.score, 7)
    for q, text in asked[:10] + asked[25:]:
        assert many.get(q, {}) == {x.id: round(x.score, 7) for x in index.bm25(text or "").collect()}, text
    lanes = {}
    for r in batch.keyword_lane_many(index, questions, 5, "thread_id").collect():
        lanes.setdefault(r.question, []).append((r.rank, r.id))
    for q, text in asked[:6]:
        assert sorted(lanes[q]) == sorted((x.rank, x.id) for x in fusion.keyword_lane(index, text, 5, thread="thread_id").collect())


def test_hybrid_of_many_questions(spark, parts):
    rows, index, vectors, asked, model = parts
    questions = spark.createDataFrame(asked, "question long, query string")
    found = batch.retrieve(questions, 10, index, vectors, backend=model).persist()
    for q, text in asked[:6]:
        lexical = fusion.keyword_lane(index, text, 20)
        near = vectors.knn(model([text])[0], 20).orderBy("dist", "id").collect()
        lane = spark.createDataFrame([(r.id, i + 1) for i, r in enumerate(near)], "id long, rank long")
        want = [r.id for r in fusion.in_order(fusion.rrf([lexical, lane]), 10).collect()]
        assert [r.id for r in sorted((r for r in found.collect() if r.question == q), key=lambda r: r.rank)] == want
    expected = spark.createDataFrame([(q, r.id) for q in range(25) for r in index.top_k(asked[q][1], 1).collect()], "question long, id long")
    got = batch.quality(found, expected).first()
    assert 0.5 < got.recall <= 1 and 0 < got.mrr <= got.recall


def test_many_questions_open_the_blocks_of_their_terms_alone(spark):
    index = KeywordIndex.build(spark.createDataFrame([(i, f"word{i} common") for i in range(30)], "id long, text string"), "id", "text")
    asked = spark.createDataFrame([("a", "word7 common")], "question string, query string")
    plan = batch.bm25_many(index, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Generate inline" in plan and plan.index("Generate inline") < plan.index("LeftSemi")
    assert batch.bm25_many(index, asked).count() == 30

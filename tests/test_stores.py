import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import chunking
from threadloom.operators.substring import SubstringIndex, required_trigrams
from threadloom.operators.vector_store import VectorStore


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()
    place = str(log)

    def backend(texts):
        import uuid

        with open(f"{place}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def asked():
        found = sorted(line for p in log.iterdir() for line in p.read_text().split("\n"))
        for p in log.iterdir():
            p.unlink()
        return found

    store = VectorStore(spark, f"file://{tmp_path}/store", 2)
    first = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)] + [(90, None), (91, "")], "id long, t string").repartition(3)
    rows = store.vectors(first, "t", backend).collect()
    assert asked() == ["", *(f"text {i}" for i in range(7))]
    assert all(r.embedding == [float(len(r.t or "")), 1.0] for r in rows) and len(rows) == 42
    again = first.union(spark.createDataFrame([(100, "new one")], "id long, t string"))
    assert store.vectors(again, "t", backend).count() == 43 and asked() == ["new one"]
    assert store.vectors(again, "t", backend).where("embedding IS NULL").count() == 0 and asked() == []
    assert [r.embedding for r in store.vectors(spark.createDataFrame([(1, "unknown")], "id long, t string"), "t").collect()] == [None]
    store.prune(again.where("id = 100"), "t")
    assert store.stored().count() == 1


def test_substrings_as_ilike_finds_them(spark):
    r = random.Random(6)
    words = ["Invoice", "invoice%", "REPORT_7", "é́clair", "straße", "İstanbul", "K2", "a\\b", "100%", "über", "plan", "Plan b", "abcabc"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6))), r.choice(words) if i % 5 else None, i % 17) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, at int")
    index = SubstringIndex.build(df, "id", ["a", "b"])
    for pattern in ("invoice", "VOIC", "in%ce", "re_ort", "plan b", "éclair", "straße", "ab", "", "100", "k2", "nowhere at all", "abcabc", "port%oice", "stanbul"):
        want = {x.id for x in df.where(F.col("a").ilike(f"%{pattern}%") | F.col("b").ilike(f"%{pattern}%")).collect()}
        assert {x.id for x in index.search(pattern).collect()} == want, pattern
    assert [x.id for x in index.newest("plan", "at", 5).collect()] == [x.id for x in df.where("a ILIKE '%plan%' OR b ILIKE '%plan%'").orderBy(F.col("at").desc(), "id").limit(5).collect()]
    plan = index.search("invoice")._jdf.queryExecution().executedPlan().toString()
    assert "In(id" in plan or "id#" in plan
    assert required_trigrams("a%bcd_efgh") == ["bcd", "efg", "fgh"] and required_trigrams("ab%cé") == []


@pytest.fixture(scope="module")
def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_chunks_by_tokens_of_a_file(spark, tokenizer_file):
    from tokenizers import Tokenizer

    r = random.Random(2)
    pieces = ["don't", "Straße", "中文字", "x" * 90, "end.", "1234567", "a-b", "  ", "\n\n", "é", "word", "!?", "\t", "<|endoftext|>"]
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randint(1, 300))) for _ in range(15)] + ["漢" * 700 + "x" * 3000, "", " "]
    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = True
    counter = chunking.TokenizerCounter(tokenizer_file)
    whole = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for text in texts:
        assert counter(text).count(0, len(text)) == whole(text)
        marks = counter(text)
        for _ in range(40):
            a, b = sorted(r.sample(range(len(text) + 1), 2)) if text else (0, 0)
            piece = text[a:b]
            if piece and not piece[0].isspace() and not piece[-1].isspace():
                assert abs(marks.count(a, b) - whole(piece)) <= (0 if (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace()) else 3)
    rows = chunking.chunk_messages(spark.createDataFrame([*enumerate(texts), (None, "x")], "id long, t string"), "id", "t", 60, 80, 10, counter).collect()
    assert {r.key for r in rows} == {str(i) for i, t in enumerate(texts) if t.strip()}
    for r_ in rows:
        assert texts[int(r_.key)][r_.char_start : r_.char_end] == r_.text and whole(r_.text) <= 80 and r_.token_est == whole(r_.text)
    for i, text in enumerate(texts):
        held = set().union(*[range(x.char_start, x.char_end) for x in rows if x.key == str(i)], set())
        assert {k for k, c in enumerate(text) if not c.isspace()} <= held


def test_default_counts_are_those_of_the_slices():
    text = "Some words, and more.\n\n" * 40
    for (a, b), n in chunking._chunks(text, 35, 50, 6, chunking.Tokens):
        assert n == chunking.count_tokens(text[a:b])

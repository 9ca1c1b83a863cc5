"""The segmented keyword index: updates against fresh builds and SQLite, top-k by tiers, what a search reads."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadloom.functions.stem import query_phrases
from threadloom.operators import keyword
from threadloom.operators.keyword import KeywordIndex

QUERIES = ["run", "cafe licensing", "alice@example.com", "x1 happy run", "nowhere", "hope fly licens relate", "!!!"]
POOL = "Running runs runner cafés Café naïve relational conditional hopping hopeful goodness licenses licensed license flies fly happily happiness the of x1 2fa b-c alice@example.com".split()


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(keyword, "LEAST_BUCKETS", 2)


def said(r, n):
    return " ".join(r.choice(POOL) for _ in range(n))


def scores(index, query):
    return {(x.id, x.owner): round(x.score, 6) for x in index.bm25(query).collect()}


def fresh(spark, rows):
    return spark.createDataFrame([(i, o, a, b) for i, (o, a, b) in rows.items()], "id long, owner string, a string, b string")


def sqlite_scores(rows, query):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no FTS5")
    con.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", [(i, a or "", b or "") for i, (_, a, b) in rows.items()])
    match = " OR ".join(f'"{run}"' for run in re.findall(r"[\w@.\-]+", query))
    if not match:
        return {}
    return {(i, rows[i][0]): round(-s, 6) for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}


def test_updates_equal_a_fresh_build(spark):
    r = random.Random(2)
    rows = {i: (f"o{i % 3}", said(r, r.randint(0, 20)), None if i % 9 == 0 else said(r, 3)) for i in range(80)}
    index = KeywordIndex.build(fresh(spark, rows), "id", "a", "b", carry=("owner",))
    for step in range(5):
        changed = {i: (f"o{i % 4}", said(r, r.randint(0, 25)), said(r, 2)) for i in r.sample(sorted(rows), 6) + [100 + step, 200 + step]}
        gone = r.sample(sorted(set(rows) - set(changed)), 3)
        before = index
        index = index.update(fresh(spark, changed), spark.createDataFrame([(i,) for i in [*gone, 9999]], "id long"))
        rows = {i: x for i, x in (rows | changed).items() if i not in gone}
        assert index.rows == len(rows)
        if step in (1, 4):
            whole = KeywordIndex.build(fresh(spark, rows), "id", "a", "b", carry=("owner",))
            assert (index.rows, index.total) == (whole.rows, whole.total)
            assert index.frequencies(["run", "licens", "nowher"]) == whole.frequencies(["run", "licens", "nowher"])
            for query in QUERIES:
                assert scores(index, query) == scores(whole, query), query
    assert len(index.segments) < 6 and max(s.level for s in index.segments) >= 1
    again = KeywordIndex.open(spark, index.path)
    assert again == index and scores(again, "run fly") == sqlite_scores(rows, "run fly")
    assert scores(before, "run")  # an earlier version still answers
    small = index.compact()
    assert len(small.segments) == 1 and (small.rows, small.total) == (index.rows, index.total)
    assert scores(small, "happy x1 alice@example.com") == scores(index, "happy x1 alice@example.com") == sqlite_scores(rows, "happy x1 alice@example.com")
    with pytest.raises(OSError, match="published already"):
        index.update(fresh(spark, {1: ("o", "run", "x")}))
    bare = small.update(deleted=spark.createDataFrame([(i,) for i in rows], "id long"))
    assert bare.rows == 0 and bare.bm25("run").count() == 0 and bare.update(fresh(spark, {1: ("o", "run", "x")})).bm25("run").count() == 1


def test_an_update_reads_its_own_folders(spark):
    rows = {i: ("o", f"word{i} common", "") for i in range(400)}
    index = KeywordIndex.build(fresh(spark, rows), "id", "a", "b", carry=("owner",))
    plan = index._forward([1]).join(spark.range(1).select(F.col("id")), "id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan and "PartitionFilters: [isnotnull(id_bucket" in plan
    files = {p for p in index._forward([1]).inputFiles() if "id_bucket=1" in p}
    assert len(files) <= 2


def test_top_k_equals_bm25(spark, monkeypatch):
    r = random.Random(1)
    rows = {i: ("o", said(r, int(r.paretovariate(1.2)) % 60), "hot") for i in range(600)}
    index = KeywordIndex.build(fresh(spark, rows), "id", "a", "b", carry=("owner",))
    changed = {i: ("n", said(r, 8), "hot hot") for i in range(0, 600, 37)}
    index = index.update(fresh(spark, changed), spark.createDataFrame([(5,), (6,)], "id long"))
    monkeypatch.setattr(keyword, "SMALL", 0)
    for query in ("hot", "run license", "hot run happy the", "x1 nowhere", "alice@example.com run"):
        for k in (1, 40):
            want = [tuple(x) for x in keyword.top(index.bm25(query), k).collect()]
            assert [tuple(x) for x in index.top_k(query, k).collect()] == want, (query, k)
    monkeypatch.setattr(keyword, "NAMED", 0)
    assert [tuple(x) for x in index.top_k("hot run", 9).collect()] == [tuple(x) for x in keyword.top(index.bm25("hot run"), 9).collect()]


def test_top_k_leaves_tiers_of_a_hot_term_unread(spark, monkeypatch):
    monkeypatch.setattr(keyword, "SMALL", 1000)
    rows = spark.range(40_000).select(F.col("id"), F.concat(F.lit("hot "), F.repeat(F.lit("filler "), (F.col("id") % 97).cast("int"))).alias("t"))
    index = KeywordIndex.build(rows, "id", "t")
    best = index.top_k("hot", 10)
    assert [x.id for x in best.collect()] == [x.id for x in keyword.top(index.bm25("hot"), 10).collect()]
    scan = best._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"LessThanOrEqual\(tier,\d+\)|tier#\d+ <= \d", scan)
    read = index._read(["hot"])
    tier = max(t for t, n, _ in index.tiers(["hot"])["hot"] if n)
    assert read.where(f"tier < {tier}").count() < read.count() == 40_000


def test_empty_indexes_and_phrases(spark):
    none = KeywordIndex.build(spark.createDataFrame([], "id long, t string"), "id", "t")
    assert none.bm25("alice").count() == 0 and keyword.phrase_rows(none, "a b").count() == 0 and none.top_k("alice", 3).count() == 0
    bare = KeywordIndex.build(spark.createDataFrame([(1, None), (2, "!!!")], "id long, t string"), "id", "t")
    assert (bare.rows, bare.mean) == (2, 0.0)
    assert bare.bm25("alice").count() == 0 and keyword.phrase_rows(bare, "a b").count() == 0 and keyword.phrase_rows(bare, "!!").count() == 0
    assert query_phrases("!!") == [] and bare.update(spark.createDataFrame([(2, "alice")], "id long, t string")).bm25("alice").count() == 1


def test_mailbox_is_kept_up(spark):
    """Upserts and reaps leave rows, vectors, chunks and keyword index as if the mailbox had been made of what is left."""
    from datetime import datetime, timedelta

    from threadloom.operators import search, threads

    day = datetime(2024, 1, 1)
    data = [(f"m{i}", f"t{i % 4}", f"Re: topic {i % 4}", "INBOX", "Al <a@x.org>", ["Al <a@x.org>"], day + timedelta(days=i), f"body word{i} common", False) for i in range(12)]
    mails = spark.createDataFrame(data, "message_id string, thread_id string, subject string, folder string, from_addr string, addresses array<string>, date timestamp_ntz, body string, has_attachments boolean")
    chunks = mails.selectExpr("concat('k', message_id) AS chunk_id", "message_id", "thread_id", "0 AS chunk_index", "0 AS char_start", "9 AS char_end", "body AS text", "array(cast(substr(message_id, 2) AS double), 1D) AS embedding")
    vectors = spark.createDataFrame([(f"t{i}", [1.0, float(i)]) for i in range(4)], "thread_id string, embedding array<double>")

    def box_of(rows):
        made = threads.thread_rows(rows)
        return search.Mailbox(made, KeywordIndex.build(search.indexed(made), "thread_id", "subject", "_people", "body_text"), vectors, chunks)

    early = mails.where("cast(substr(message_id, 2) AS int) < 7")
    box = box_of(early).upsert(mails)
    assert {r.thread_id: len(r.message_ids) for r in box.threads.collect()} == {f"t{i}": 3 for i in range(4)}
    assert [r.id for r in box.thread_index.bm25("word11").collect()] == ["t3"]
    gone = mails.where("thread_id = 't1' OR message_id = 'm3'").select("message_id")
    left = box.reap(mails, gone, 2)
    whole = box_of(mails.join(gone, "message_id", "left_anti"))
    assert {r.thread_id for r in left.threads.collect()} == {"t0", "t2", "t3"} and left.chunks.where("message_id = 'm3' OR thread_id = 't1'").count() == 0
    assert left.thread_index.rows == 3 and left.thread_index.bm25("word3 word1").count() == 0
    assert {r.id for r in left.thread_index.bm25("common word7").collect()} == {r.id for r in whole.thread_index.bm25("common word7").collect()}
    assert {r.thread_id for r in left.thread_vectors.collect()} == {"t0", "t2", "t3"}


def test_slices_leave_no_shuffle_files_behind(spark, monkeypatch, tmp_path):
    """A segment written slice by slice is the same, and neither shuffle files nor rows on their way stay on disk."""
    import time

    r = random.Random(9)
    rows = {i // 2: ("o", said(r, r.randrange(40)), None if i % 7 == 0 else said(r, 3)) for i in range(240)}
    df = fresh(spark, rows).union(fresh(spark, dict(list(rows.items())[:9]))).coalesce(4)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = blocks.getAllBlocks().size()
    monkeypatch.setattr(keyword, "LEAST_BUCKETS", 6)
    one = KeywordIndex.build(df, "id", "a", "b", carry=("owner",))
    monkeypatch.setattr(keyword, "SLICE_BYTES", 1)
    monkeypatch.setattr(keyword, "LARGE", 1)
    many = KeywordIndex.build(df, "id", "a", "b", carry=("owner",))
    until = time.time() + 20
    while blocks.getAllBlocks().size() > before and time.time() < until:
        time.sleep(0.2)
    assert blocks.getAllBlocks().size() <= before
    assert (one._slices(1 << 30), many._slices(1 << 30)) == (6, 6) and (one.rows, one.total) == (many.rows, many.total)
    for table in ("postings", "terms", "forward"):
        a, b = (spark.read.parquet(x._at(x.segments[0], table)) for x in (one, many))
        if table == "forward":
            a, b = (x.withColumn("terms", F.array_sort("terms")) for x in (a, b))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count()
    assert not list(tmp_path.parent.rglob("rows/slice=*"))


def test_postings_of_a_term_share_rows_and_bounds_hold(spark):
    """A row of a segment is of all texts that a task met, not of one; what tiers say bounds the postings in them and below, though tasks had other mean lengths."""
    short = spark.range(200).select(F.col("id"), F.concat(F.lit("hot word"), F.col("id"), F.repeat(F.lit(" filler"), (F.col("id") % 9).cast("int"))).alias("t")).coalesce(1)
    long = spark.range(200, 500).select(F.col("id"), F.concat(F.lit("hot hot "), F.repeat(F.lit("filler rest "), (F.col("id") % 97 * 3).cast("int"))).alias("t")).coalesce(1)
    index = KeywordIndex.build(short.union(long), "id", "t", carry=())
    rows, postings = index._blocks([0]).count(), index._postings([0]).count()
    assert rows < 200 + 3 * 2 * keyword.TIERS < postings
    tiers = index.tiers(["hot"])["hot"]
    assert sum(n for _, n, _ in tiers) == index.frequencies(["hot"])["hot"] == 500 and len(tiers) > 1
    bounds = [most for _, _, most in tiers]
    assert bounds == sorted(bounds, reverse=True)
    weight = keyword._weight(F.col("tf"), F.col("length"), index.mean)
    found = {r.tier: r.w for r in index._read(["hot"]).groupBy("tier").agg(F.max(weight).alias("w")).collect()}
    assert all(found[tier] <= most + 1e-12 for tier, _, most in tiers)
    got = {r.id: (r.tf, len(r.positions)) for r in index.postings(["filler"]).collect()}
    assert got[8] == (8, 8) and got[201] == (201 % 97 * 3,) * 2

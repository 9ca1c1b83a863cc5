"""Threads by arrival against a plain fold over all messages in order."""

import random
from datetime import datetime, timedelta

import pytest

from threadloom.operators import arrival

SCHEMA = "message_id string, in_reply_to string, references array<string>, subject string, folder string, addresses array<string>, date timestamp_ntz, arrival long"


def folded(rows, days=60, most=10):
    home, threads, by = {}, {}, {}
    for mid, reply, refs, subject, folder, people, date, _ in sorted(rows, key=lambda r: (r[7], r[0])):
        who = {p.lower() for p in people}
        found = next((home[a] for a in [reply, *reversed(refs or [])] if a in home), None)
        if found is None and subject:
            near = sorted(by.get((folder, subject), []), key=lambda t: threads[t][1], reverse=True)[:most]
            found = next((t for t in near if who & threads[t][0] and abs(date - threads[t][1]) <= timedelta(days=days)), None)
        if found is None:
            found = mid
            threads[found] = [set(), date]
            by.setdefault((folder, subject), []).append(found)
        threads[found][0] |= who
        threads[found][1] = max(threads[found][1], date)
        home[mid] = found
    return home


def made(seed, n, subjects, people, span):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        before = [f"m{r.randrange(n):04d}" for _ in range(r.choice([0, 0, 0, 1, 2]))]
        reply = f"m{r.randrange(n):04d}" if r.random() < 0.25 else ""
        who = [f"P{r.randrange(people)}@x.org" for _ in range(r.choice([0, 1, 1, 2]))]
        rows.append((f"m{i:04d}", reply, before, r.choice(subjects), r.choice(["INBOX", "Sent"]), who, datetime(2024, 1, 1) + timedelta(days=r.randrange(span)), r.randrange(n)))
    return rows


@pytest.mark.parametrize("seed,n,subjects,people,span,block", [(1, 250, ["a", "b", ""], 6, 500, 20_000), (2, 200, ["a"], 12, 300, 15), (4, 120, ["a"], 60, 40, 7)])
def test_equal_to_the_fold(spark, seed, n, subjects, people, span, block):
    rows = made(seed, n, subjects, people, span)
    got = {r.message_id: r.thread_id for r in arrival.arrival_threads(spark.createDataFrame(rows, SCHEMA), 60, 10, block).collect()}
    assert got == folded(rows)


def test_a_replay_in_batches_gives_the_same(spark, tmp_path):
    rows = sorted(made(6, 150, ["a", "b", ""], 6, 400), key=lambda r: (r[7], r[0]))
    rows = [(*r[:7], i) for i, r in enumerate(rows)]
    source, target = tmp_path / "in", str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        arrival.thread_stream(stream, target, str(tmp_path / "ck"), 60, 10, 30).awaitTermination(300)

    for i, (a, b) in enumerate([(0, 60), (60, 61), (61, 150)]):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if i != 0:
            run()  # a restart between the runs
    home = {r.message_id: r.thread_id for r in spark.read.parquet(f"{target}/home").collect()}
    assert home == folded(rows)


def test_odd_rows(spark):
    day = datetime(2024, 1, 1)
    rows = [("a", None, None, None, None, None, None, 0), ("b", "a", None, "x", "f", ["p@x"], day, 1), ("b", "", None, "y", "f", [], day, 5), ("c", "c", ["c"], " ", "f", ["p@x"], day, 2)]
    got = {r.message_id: r.thread_id for r in arrival.arrival_threads(spark.createDataFrame(rows, SCHEMA), 60, 10).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
    assert arrival.arrival_threads(spark.createDataFrame([], SCHEMA), 60, 10).count() == 0


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "int"])
def test_arrival_of_any_type(spark, kind):
    """Times order messages down to the microsecond; a message without arrival comes last."""
    day = datetime(2024, 1, 1)
    came = {"int": [1, 2, 3], "date": [(day + timedelta(days=i)).date() for i in range(3)]}.get(kind) or [day + timedelta(microseconds=i) for i in range(3)]
    rows = [("c", "b", None, "s", "f", ["p@x"], day, came[0]), ("b", "", None, "t", "f", ["p@x"], day, came[1]), ("a", "b", None, "s", "f", ["q@x"], day, came[2]), ("z", "a", None, "s", "f", ["q@x"], day, None)]
    got = {r.message_id: r.thread_id for r in arrival.arrival_threads(spark.createDataFrame(rows, SCHEMA.replace("arrival long", f"arrival {kind}")), 60, 10).collect()}
    assert got == {"c": "c", "b": "b", "a": "b", "z": "b"}


def test_the_registered_query(spark):
    """arrival_threads over the driver's conversations, whose arrival is a time, against the fold."""
    from threadloom.plans.catalog import _linked_mail, arrival_threads

    sf_dir = "/root/testdata/sf0.001"
    rows = [(m.message_id, m.in_reply_to, m.references, " ".join(m.subject.lower().removeprefix("re: ").split()), m.folder, [m.from_addr], m.date, m.arrival) for m in _linked_mail(spark, sf_dir).collect()]
    assert {r.message_id: r.thread_id for r in arrival_threads(spark, sf_dir).collect()} == folded(rows)

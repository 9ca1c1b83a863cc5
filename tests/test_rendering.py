"""Renderings of threads, messages, pages, contacts and errors."""

from datetime import datetime

from pyspark.sql import functions as F

from threadloom.operators import rendering

COLUMNS = "thread_id string, subject string, display_subject string, folder string, participants array<string>, date_first timestamp, date_last timestamp, message_ids array<string>, snippet string, body_text string, has_attachments boolean"
DAY = datetime(2024, 1, 5, 10)


def rows(spark, n=0):
    full = ("t1", "plan", "Plan", "INBOX", ["Ann <a@x>", "b@x", "c@x"], DAY, datetime(2024, 2, 1), ["m1", "m2"], "short", "The plan\nstands.", True)
    bare = ("t2", None, None, "INBOX", None, None, None, None, None, None, None)
    brief = ("t3", "note", "", "INBOX", [], DAY, DAY, ["m3"], "only this", "", False)
    more = [(f"x{i:04d}", "s", "s", "Archive", ["a@x"], DAY, DAY, ["m"], "", "", False) for i in range(n)]
    return spark.createDataFrame([full, bare, brief, *more], COLUMNS)


def test_thread_text(spark):
    got = {r.thread_id: r.text for r in rendering.thread_text(rows(spark)).collect()}
    assert got["t1"] == (
        "Subject: Plan\nFolder: INBOX\nParticipants: Ann <a@x>, b@x, c@x\nDates: 2024-01-05 to 2024-02-01\nCount: 2\n\nText:\nThe plan\nstands."
        "\n\nMessages:\n1. m1\n2. m2\n\nThis thread has attachments."
    )
    assert got["t2"] == "Subject: \nFolder: INBOX\nParticipants: \nDates: unknown to unknown\nCount: 0"
    assert got["t3"].startswith("Subject: note\n") and "\n\nSnippet:\nonly this\n" in got["t3"] and "attachments" not in got["t3"]
    assert "attachments" not in rendering.thread_text(rows(spark), attachments=False).where("thread_id = 't1'").first().text
    assert rendering.thread_text(rows(spark).limit(0)).count() == 0


def test_message_text(spark):
    asked = spark.createDataFrame([("m1", "t1"), ("lost", "gone"), ("odd", None)], "message_id string, thread_id string")
    got = {r.message_id: r.text for r in rendering.message_text(asked, rows(spark)).collect()}
    assert got["m1"].startswith("Message: m1\nSubject: Plan\n") and got["m1"].endswith("The plan\nstands.")
    assert got["lost"] is None and got["odd"] is None


def test_folder_pages(spark):
    pages = rendering.folder_pages(rows(spark, 50).repartition(4), limit=3, offset=1)
    got = {r.folder: (r.shown, r.text) for r in pages.collect()}
    assert got["INBOX"] == (2, "2. note\n    | 2024-01-05 | 1 message(s)\n   ID: t3\n3. \n    | unknown | 0 message(s)\n   ID: t2")
    assert got["Archive"][0] == 3 and [line for line in got["Archive"][1].split("\n") if "ID" in line] == [f"   ID: x{i:04d}" for i in (1, 2, 3)]
    first = rendering.folder_pages(rows(spark), limit=1).first().text
    assert first == "1. Plan\n   Ann <a@x>, b@x... | 2024-02-01 | 2 message(s) | attachments\n   ID: t1"
    assert "WindowGroupLimit" in pages._jdf.queryExecution().executedPlan().toString(), "ranks are cut before the shuffle"


def test_contact_and_folder_texts(spark):
    contacts = spark.createDataFrame([("a@x", "Ann, Anna", 3), ("b@x", "", 1), ("c@x", None, 1)], "email string, names string, threads long")
    assert [r.text for r in rendering.contact_text(contacts).orderBy("email").collect()] == [
        "a@x\n   Names: Ann, Anna\n   Threads: 3", "b@x\n   Names: (no name)\n   Threads: 1", "c@x\n   Names: (no name)\n   Threads: 1",
    ]
    folders = spark.createDataFrame([("INBOX", 2), (None, 1)], "folder string, count long")
    assert {r.text for r in rendering.folder_text(folders).collect()} == {"INBOX (2 threads)", " (1 threads)"}


def test_safe_error_never_quotes_a_provider(spark):
    failures = spark.createDataFrame(
        [(1, "StatusError", 400, "bad input: Dear Ann, the code is 42"), (2, "TimeoutError", None, "no answer with key s3cr3t-value"), (3, None, 500, "x"), (4, "E", None, None)],
        "id int, kind string, status int, message string",
    )
    shown = failures.select("id", rendering.safe_error(F.col("kind"), F.col("status"), F.col("message"), ("s3cr3t-value",)).alias("e"))
    assert {r.id: r.e for r in shown.collect()} == {1: "StatusError: status=400", 2: "no answer with key [REDACTED]", 3: "Error: status=500", 4: ""}

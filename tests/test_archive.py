import io
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadloom.functions.vectors import thread_vectors
from threadloom.operators import attachments, merge, queue, reconcile, threads
from threadloom.sources.mail import html_text, parse, parse_mail, read_maildir
from threadloom.sources.snapshot import Snapshots
from threadloom.streaming.ingest import watch_maildir, windowed_counts

MAIL = b"""From: =?utf-8?q?Al=C3=A9?= <Al@x.org>\r\nTo: b@x.org, \r\nSubject: Re: Plan\r\nMessage-ID: <m1@x>\r\nReferences: <m0@x>\r\nDate: Mon, 1 Jan 2024 12:00:00 +0200\r\nMIME-Version: 1.0
Content-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>hi</p>\r\n--B\r\nContent-Type: text/plain\r\n\r\n plain text \r\n--B\r\nContent-Type: text/plain; name=a.txt\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\nbody\r\n--B--\r\n"""


def test_parse_prefers_plain_text():
    got = parse("/root/INBOX/cur/1:2,S", MAIL)
    assert (got["message_id"], got["references"], got["body"], got["from_addr"], got["folder"]) == ("m1@x", ["m0@x"], "plain text", "Alé <Al@x.org>", "INBOX")
    assert got["date"].hour == 10 and [a["filename"] for a in got["attachments"]] == ["a.txt"]
    assert parse("/x/cur/1", b"Subject: no id\n\n") is None
    empty_plain = MAIL.replace(b" plain text ", b"  ")
    assert parse("/root/Archive/2024/cur/1:2,S", empty_plain, "/root")["body"] == "hi"
    assert parse("file:///root/Archive/2024/cur/1:2,S", MAIL, "/root")["folder"] == "Archive/2024" and parse("/root/cur/1", MAIL, "/root")["folder"] == ""
    nameless = parse("/x/cur/1", MAIL.replace(b"; name=a.txt", b"").replace(b"; filename=a.txt", b""))
    assert [a["filename"] for a in nameless["attachments"]] == ["unnamed"]
    assert parse("/x/cur/1", b"Message-ID: <z>\nContent-Type: text/calendar\n\nBEGIN")["body"] == "BEGIN"
    assert html_text("<head><title>t</title></head><p>a&amp;b</p><script>x</script><p>c</p>") == "a&b\n\nc"


def test_maildir_batch_and_stream(spark, tmp_path):
    box = tmp_path / "mail" / "INBOX" / "cur"
    box.mkdir(parents=True)
    (box / "1:2,S").write_bytes(MAIL)
    (box / "2:2,").write_bytes(b"no id\n\n")
    (tmp_path / "mail" / "INBOX" / "note").write_bytes(b"not mail")
    rows = parse_mail(read_maildir(spark, str(tmp_path / "mail"))).collect()
    assert sorted((r.message_id or "", r.error or "") for r in rows) == [("", "no message id"), ("m1@x", "")]
    assert all(r.error == "oversized" for r in parse_mail(read_maildir(spark, str(tmp_path / "mail")), max_bytes=3).collect())
    watch_maildir(spark, str(tmp_path / "mail"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "messages")).count() == 1
    # a flag is set: the file has another name, and is a move, not a message
    (box / "1:2,S").rename(box / "1:2,RS")
    (box / "3:2,").write_bytes(MAIL.replace(b"m1@x", b"m3@x"))
    watch_maildir(spark, str(tmp_path / "mail"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "out" / "messages")).collect()) == ["m1@x", "m3@x"]
    moves = lambda: {(r.old_path.rpartition("/INBOX/")[2], r.new_path.rpartition("/INBOX/")[2]) for r in spark.read.parquet(str(tmp_path / "out" / "moved")).collect()}
    assert moves() == {("cur/1:2,S", "cur/1:2,RS")}
    # each further move starts where the one before ended, whatever the order of the names
    (tmp_path / "mail" / "INBOX" / "new").mkdir()
    (box / "1:2,RS").rename(tmp_path / "mail" / "INBOX" / "new" / "1")
    watch_maildir(spark, str(tmp_path / "mail"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    (tmp_path / "mail" / "INBOX" / "new" / "1").rename(box / "1:2,FS")
    watch_maildir(spark, str(tmp_path / "mail"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert moves() == {("cur/1:2,S", "cur/1:2,RS"), ("cur/1:2,RS", "new/1"), ("new/1", "cur/1:2,FS")}
    assert spark.read.parquet(str(tmp_path / "out" / "messages")).count() == 2


def test_windowed_counts_plan(spark):
    events = spark.readStream.format("rate").load().withColumn("k", F.lit(1))
    assert windowed_counts(events, "timestamp", "k").isStreaming


def mails(spark, rows):
    base = datetime(2024, 1, 1)
    data = [(i, r, [], s, "INBOX", [who], base + timedelta(days=day), n) for n, (i, r, s, who, day) in enumerate(rows)]
    return spark.createDataFrame(data, "message_id string, in_reply_to string, references array<string>, subject string, folder string, addresses array<string>, date timestamp_ntz, arrival int")


def test_arrival_and_linked_threads_differ(spark):
    rows = mails(spark, [("child", "root", "Re: A", "x@x.org", 1), ("root", "", "A", "y@x.org", 0), ("late", "", "Re: A", "x@x.org", 90), ("near", "", "a", "x@x.org", 2)])
    arrival = {r.message_id: r.thread_id for r in threads.arrival_threads(rows).collect()}
    assert arrival == {"child": "child", "root": "root", "late": "late", "near": "child"} or arrival["near"] in ("child", "late")
    linked = {r.message_id: r.thread_id for r in threads.linked_threads(rows).collect()}
    assert linked["child"] == linked["root"] == "root" and linked["late"] == "late"


def test_undated_messages_are_the_newest(spark):
    rows = mails(spark, [("root", "", "Plan", "x@x.org", 0), ("reply", "root", "Re: Plan", "y@x.org", 1)]).withColumn("body", F.col("message_id")).withColumn("from_addr", F.get("addresses", 0))
    lost = rows.where("message_id = 'reply'").withColumns({"message_id": F.lit("bare"), "date": F.lit(None).cast("timestamp_ntz"), "subject": F.lit("Undated"), "folder": F.lit("Junk"), "body": F.lit("late")})
    got = threads.thread_rows(rows.unionByName(lost).withColumns({"thread_id": F.lit("t"), "has_attachments": F.lit(False)})).first()
    assert (got.display_subject, got.folder, got.message_ids, got.snippet, got.date_last) == ("Plan", "INBOX", ["root", "reply", "bare"], "late", datetime(2024, 1, 2))
    three = mails(spark, [("a", "", "Hi", "x@x.org", 0), ("c", "b", "Re: Hi", "x@x.org", 1), ("b", "", "Hi", "x@x.org", 2)])
    three = three.withColumn("date", F.when(F.col("message_id") == "c", F.lit(None).cast("timestamp_ntz")).otherwise(F.col("date")))
    assert {r.message_id: r.thread_id for r in threads.arrival_threads(three).collect()} == {"a": "a", "c": "a", "b": "a"}


def test_distinct_people_keep_first_forms(spark):
    df = spark.createDataFrame([(["Bob <b@x.org>", "list", "B@x.org (b)", "LIST ", "c@x.org", None],), ([],)], "p array<string>")
    assert [r.x for r in df.select(threads.distinct_people(F.col("p")).alias("x")).collect()][0][:3] == ["Bob <b@x.org>", "list", "c@x.org"]


def test_long_reply_chain_is_one_thread(spark):
    names = [f"m{i:04d}" for i in range(1000)]
    random.Random(3).shuffle(names)
    rows = mails(spark, [(m, names[i - 1] if i else "", f"s{i}", "x@x.org", i) for i, m in enumerate(names)])
    edges = threads.header_edges(rows).select(F.col("message_id").alias("a"), F.col("parent").alias("b"))
    assert {r.root for r in threads.components(rows.select(F.col("message_id").alias("id")), edges).collect()} == {"m0000"}
    assert {r.thread_id for r in threads.linked_threads(rows).collect()} == {names[0]}
    arrival = {r.message_id: r.thread_id for r in threads.arrival_threads(rows).collect()}
    assert len(arrival) == 1000 and set(arrival.values()) == {names[0]}


def test_merge_and_diff(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k long, s string")
    b = spark.createDataFrame([(1, None), (3, "y")], "k long, s string")
    assert {(r.k, r.change) for r in merge.diff(a, b, ["k", "s"]).collect()} == {(1, "keep"), (2, "delete"), (3, "insert")}
    assert merge.insert_if_absent(a, b, ["k"]).count() == 3
    assert [r.path for r in merge.move_paths(spark.createDataFrame([("o",), ("z",)], "path string"), spark.createDataFrame([("o", "n")], "old_path string, new_path string"), "path").orderBy("path").collect()] == ["n", "z"]


def test_queue_backoff(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    jobs = spark.createDataFrame([("a", "queued", 0), ("b", "queued", 4), ("c", "queued", 3)], "filepath string, status string, attempts int").withColumn("next_attempt_at", now.cast("timestamp_ntz"))
    got = {r.filepath: (r.status, r.attempts, r.next_attempt_at) for r in queue.mark_failed(jobs, now).collect()}
    assert got["a"] == ("queued", 1, datetime(2024, 1, 1, 0, 0, 30)) and got["b"][0] == "dead" and got["c"][2] == datetime(2024, 1, 1, 0, 4)


def test_reap_brake(spark):
    now, old = F.lit("2024-02-01").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    for total, marked, force, left in ((30, 20, False, 30), (30, 20, True, 10), (10, 6, False, 4)):
        rows = spark.range(total).select(F.col("id").cast("string").alias("filepath"))
        marks = spark.range(marked).select(F.col("id").cast("string").alias("filepath"), old.alias("marked_at"))
        assert reconcile.reap(rows, marks, now, force=force).count() == left


def test_extract(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>')
    assert attachments.extract_one(data.getvalue(), None, "a.docx") == ("success", "docx", "Hello", None, False)
    assert attachments.extract_one(b"%PDF", "application/pdf", "a.pdf")[0] == "unsupported"
    assert attachments.extract_one(b"broken", None, "a.docx")[0] == "failed"
    assert attachments.extract_one(b"  ", "text/plain", None)[0] == "empty"
    assert attachments.extract_one(b"x", "image/x-odd", None)[1:4:2] == ("image", "OCR disabled") and attachments.extract_one(b"x", None, "a.png")[0] == "unsupported"
    assert attachments.extract_one(b"y" * 200_001, "text/plain", None)[4]


def test_xlsx_sheets_go_by_their_relations():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda *rows: f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(f"<c><v>{v}</v></c>" for v in row) + "</row>" for row in rows) + "</sheetData></worksheet>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/><sheet name="none" r:id="r3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2, 3)) + "</Relationships>")
        z.writestr("xl/worksheets/sheet1.xml", sheet((1, 2), (3,)))
        z.writestr("xl/worksheets/sheet2.xml", sheet((9,)))
        z.writestr("xl/worksheets/sheet3.xml", sheet())
    assert attachments.xlsx_text(data.getvalue()) == "[Sheet: B]\n9\n[Sheet: A]\n1\t2\n3"


def test_attachments_are_planned_and_applied(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    part = "array<struct<filename:string,content_type:string,size:long,payload:binary,content_hash:string>>"
    rows = spark.createDataFrame([("m1", "t", [("a.txt", "text/plain", 1, b"one", "h1"), ("b.txt", "text/plain", 1, b"two", "h2")]), ("m2", "t", [("c.txt", "text/plain", 1, b"one", "h1")])], f"message_id string, thread_id string, attachments {part}")
    cache = spark.createDataFrame([("h2", "success", "text", "two", None, False), ("h1", "failed", "text", "", "e", False)], attachments.EXTRACTED).withColumn("extracted_at", F.lit("2024-01-01").cast("timestamp"))
    occurrences, todo = attachments.prepare(rows, cache, now)
    assert [r.content_hash for r in todo.collect()] == ["h1"]
    stored, fresh = attachments.apply(occurrences, cache, attachments.extract(todo), now)
    assert sorted((r.message_id, r.filename, r.status, r.text) for r in stored.collect()) == [("m1", "a.txt", "success", "one"), ("m1", "b.txt", "success", "two"), ("m2", "c.txt", "success", "one")]
    assert fresh.count() == 2 and fresh.where("status = 'failed'").count() == 0


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "snap"))
    assert s.current() is None
    for n in (1, 2, 3):
        assert s.write({"t": spark.range(n)}) == n
    s.vacuum(1)
    assert s.read("t").count() == 3 and not (tmp_path / "snap" / "v=1").exists()
    # a writer that died has left a folder without a pointer: readers pass it by, the next writer goes on behind it
    (tmp_path / "snap" / "v=9").mkdir()
    assert s.current() == 3 and s.write({"u": spark.range(1)}, carry=True) == 10
    assert s.read("t").count() == 3 and s.read("u").count() == 1


def test_merge_unites_people_and_follows_dates(spark):
    columns = "thread_id string, subject string, display_subject string, folder string, message_ids array<string>, participants array<string>, date_first timestamp_ntz, date_last timestamp_ntz, snippet string, has_attachments boolean"
    day = lambda n: datetime(2024, 1, n)
    old = spark.createDataFrame([("t", "s", "Re: s", "INBOX", ["b"], ["Bob <b@x.org>", "list"], day(5), day(6), "old", False)], columns)
    new = spark.createDataFrame([("t", "s", "S", "Sent", ["a"], ["B@x.org", "LIST ", "c@x.org"], day(1), day(2), "new", True)], columns)
    got = merge.merge_threads(old, new).first()
    assert (got.message_ids, got.participants, got.folder) == (["b", "a"], ["Bob <b@x.org>", "list", "c@x.org"], "INBOX")
    assert (got.display_subject, got.snippet, got.date_first, got.date_last, got.has_attachments) == ("S", "old", day(1), day(6), True)


def test_chunk_without_a_vector_is_an_error(spark):
    columns = "message_id string, attachment_id string, chunk_id string"
    old, new = spark.createDataFrame([("m", None, "a")], columns), spark.createDataFrame([("m", None, "a"), ("m", "x", "b")], columns)
    assert {(r.chunk_id, r.change) for r in merge.diff_chunks(old, new, spark.createDataFrame([("b",)], "chunk_id string")).collect()} == {("a", "keep"), ("b", "insert")}
    with pytest.raises(Exception, match="no embedding for chunk b"):
        merge.diff_chunks(old, new, spark.createDataFrame([("z",)], "chunk_id string")).collect()


def test_thread_vectors_fall_back(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", " "), ("d", "z")], "thread_id string, subject string")
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0])], "thread_id string, embedding array<float>")
    prior = spark.createDataFrame([("a", [9.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 0.0])], "thread_id string, embedding array<float>")
    got = {r.thread_id: (r.origin, [round(x, 3) for x in r.embedding]) for r in thread_vectors(rows, chunks, prior, 2, lambda texts: [[3.0, 4.0] if t == "(empty thread)" else [1.0, 0.0] for t in texts]).collect()}
    assert got == {"a": ("chunks", [0.707, 0.707]), "b": ("prior", [0.0, 1.0]), "c": ("subject", [0.6, 0.8]), "d": ("subject", [1.0, 0.0])}


def test_entry_without_corpus_operators():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

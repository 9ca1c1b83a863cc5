"""Registered queries over a mailbox made of conversations: searches, thread maintenance, queue, paths, attachments, prompts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import vectors as V
from threadloom.operators import attachments, fusion, lookups, merge, queue, rag, reconcile, search, threads
from threadloom.operators.keyword import KeywordIndex
from threadloom.plans.catalog import BLOCK, BODIES, MAIL, PROBE, REDACTED, bm25_sql, mail, once, query, table
from threadloom.sources.mail import parse_mail
from threadloom.sources.shared import fresh_dir, spread, written
from threadloom.sources.snapshot import Snapshots
from threadloom.streaming.ingest import windowed_counts

# ---- the mailbox ------------------------------------------------------------------------


def messages(spark, d) -> DataFrame:
    return mail(spark, d).withColumn("addresses", F.array("from_addr"))


def chunk_table(spark, d) -> DataFrame:
    """A chunk for each message: its body, with a vector of the table."""
    vectors = table(spark, d, "embeddings")
    n = F.broadcast(vectors.agg(F.count(F.lit(1)).alias("_n")))  # one row
    c = table(spark, d, "conversations").crossJoin(n)
    rows = c.select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("chunk_id"), F.concat(F.lit("c"), "conv_id").alias("thread_id"), F.col("turn").cast("int").alias("chunk_index"),
        F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text", ((F.col("conv_id") * 3 + F.col("turn")) % F.col("_n")).alias("_v"),
    )
    return rows.join(vectors.select(F.col("vec_id").alias("_v"), "embedding"), "_v").drop("_v")


def attachment_table(spark, d) -> DataFrame:
    rows = mail(spark, d).where("has_attachments")
    return rows.select(F.concat(F.lit("a-"), "message_id").alias("attachment_id"), "thread_id", F.concat(F.lit("report-"), F.expr("substr(subject, 11)"), F.lit(".pdf")).alias("filename"), F.lit("application/pdf").alias("content_type"))


def mailbox(spark, d) -> search.Mailbox:
    """Written as one snapshot, with its indexes, at the first call for a folder."""

    def build() -> search.Mailbox:
        store = Snapshots(spark, fresh_dir(spark, "mailbox"))
        vectors = table(spark, d, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("thread_id"), "embedding")
        store.write({"threads": threads.thread_rows(messages(spark, d)), "chunks": chunk_table(spark, d), "attachments": attachment_table(spark, d), "thread_vectors": vectors})
        rows = store.read("threads")
        return search.Mailbox(
            rows, KeywordIndex.build(search.indexed(rows), "thread_id", "subject", "_people", "body_text"), store.read("thread_vectors"), store.read("chunks"),
            KeywordIndex.build(store.read("chunks"), "chunk_id", "text", carry=("thread_id",)), KeywordIndex.build(store.read("attachments"), "attachment_id", "filename", "content_type", carry=("thread_id",)),
        )

    return once(spark, d, "mailbox", build)


ROWS = f"""{MAIL}, {BODIES}, base AS (SELECT thread_id, regexp_replace(lower(arg_min(subject, (date, message_id))), '^re: ', '') AS subject, arg_min(subject, (date, message_id)) AS display_subject, arg_min(folder, (date, message_id)) AS folder,
  min(date) AS date_first, max(date) AS date_last, list(message_id ORDER BY date, message_id) AS message_ids, arg_max(replace(substr(body, 1, 200), chr(10), ' '), (date, message_id)) AS snippet, bool_or(has_attachments) AS has_attachments FROM mail GROUP BY thread_id),
threads AS (SELECT base.*, participants, participants AS senders, body_text FROM base JOIN people USING (thread_id) JOIN bodies USING (thread_id))"""
CHUNKS = """chunks AS (SELECT 'c' || conv_id || '-' || turn AS chunk_id, 'c' || conv_id AS thread_id, CAST(turn AS INTEGER) AS chunk_index, text, embedding FROM conversations JOIN embeddings ON vec_id = (conv_id * 3 + turn) % (SELECT count(*) FROM embeddings))"""
UNITS = f"""tu AS (SELECT thread_id AS id, thread_id AS owner, subject || ' ' || array_to_string(participants, ' ') || ' ' || body_text AS text FROM threads),
cu AS (SELECT chunk_id AS id, thread_id AS owner, text FROM chunks), au AS (SELECT 'a-' || message_id AS id, thread_id AS owner, 'report-' || substr(subject, 11) || '.pdf application/pdf' AS text FROM mail WHERE has_attachments)"""
FORMS = ["quis?", "reports?", "3"]
QUESTION = "qui report 3"


def lexical_sql(condition: str, limit: int) -> str:
    """CTEs up to lex (id, score, first, rank): three keyword lanes of threads that meet a condition, fused and cut."""
    lanes = [f"l0 AS (SELECT b.id, row_number() OVER (ORDER BY score DESC, b.id) AS rank FROM k0 b JOIN threads t ON t.thread_id = b.owner WHERE {condition} QUALIFY rank <= {limit})"]
    for i in (1, 2):
        lanes.append(f"""h{i} AS (SELECT b.id, owner, score FROM k{i} b JOIN threads t ON t.thread_id = b.owner WHERE {condition} ORDER BY score DESC, b.id LIMIT {10 * limit}),
l{i} AS (SELECT owner AS id, row_number() OVER (ORDER BY score DESC, owner) AS rank FROM (SELECT owner, max(score) AS score FROM h{i} GROUP BY owner) QUALIFY rank <= {limit})""")
    scored = ", ".join(bm25_sql(f"k{i}", units, FORMS) for i, units in enumerate(("tu", "cu", "au")))
    return f"""{ROWS}, {CHUNKS}, {UNITS}, {scored}, {", ".join(lanes)},
ku AS (SELECT *, 0 AS lane FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2), kg AS (SELECT id, sum(1.0 / (60 + rank)) AS score, min((lane, rank)) AS first FROM ku GROUP BY id),
lex AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, first, id) AS rank FROM kg QUALIFY rank <= {limit})"""


INBOX = "folder IN ('INBOX', 'Archive') AND date_last >= TIMESTAMP '2024-01-10'"
FILTERS = fusion.Filters(folders=("INBOX", "Archive"), date_from="2024-01-10")


def hybrid_sql(condition: str, fetch: int, limit: int) -> str:
    return f"""{lexical_sql(condition, fetch)}, vl AS (SELECT 'c' || vec_id AS id, row_number() OVER (ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])), 'c' || vec_id) AS rank FROM embeddings QUALIFY rank <= {fetch}),
cl AS (SELECT *, row_number() OVER (ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])), chunk_id) AS rank FROM chunks QUALIFY rank <= {3 * fetch}),
fu AS (SELECT id, rank, 0 AS lane FROM lex UNION ALL SELECT id, rank, 1 FROM vl UNION ALL SELECT thread_id, min(rank), 2 FROM cl GROUP BY thread_id), fg AS (SELECT id, sum(1.0 / (60 + rank)) AS score, min((lane, rank)) AS first FROM fu GROUP BY id),
found AS (SELECT * FROM fg JOIN threads ON thread_id = id WHERE {condition} ORDER BY round(score, 12) DESC, first, id LIMIT {limit})"""


EVIDENCE = "ev AS (SELECT thread_id, string_agg(chunk_id, ',' ORDER BY rank) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY rank) AS p FROM {}) WHERE p <= 3 GROUP BY thread_id)"


def chunk_ids_of(evidence) -> F.Column:
    return F.array_join(F.transform(evidence, lambda e: e["chunk_id"]), ",")


@query(f"WITH {lexical_sql(INBOX, 40)} SELECT id AS thread_id, folder, round(score, 9) AS score FROM lex JOIN threads ON thread_id = id WHERE {INBOX} ORDER BY round(score, 12) DESC, first, id LIMIT 10")
def keyword_search(spark, d):
    return mailbox(spark, d).keyword_search(QUESTION, FILTERS).select("thread_id", "folder", F.round("score", 9).alias("score"))


@query(f"WITH {lexical_sql('true', 40)} SELECT id, rank FROM l2")
def attachment_keyword(spark, d):
    return fusion.keyword_lane(mailbox(spark, d).attachment_index, QUESTION, 40, thread="thread_id")


@query(f"""WITH {ROWS}, {CHUNKS}, {UNITS}, {bm25_sql("k1", "cu", FORMS)}, h1 AS (SELECT id, owner, score FROM k1 ORDER BY score DESC, id LIMIT 400)
SELECT owner AS id, row_number() OVER (ORDER BY score DESC, owner) AS rank FROM (SELECT owner, max(score) AS score FROM h1 GROUP BY owner) QUALIFY rank <= 40""")
def chunk_keyword(spark, d):
    return fusion.keyword_lane(mailbox(spark, d).chunk_index, QUESTION, 40, thread="thread_id")


@query(f"""WITH {ROWS} SELECT thread_id AS id, row_number() OVER (ORDER BY date_last DESC, thread_id) AS rank FROM threads WHERE {INBOX}
AND (subject ILIKE '%opic 3%' OR body_text ILIKE '%opic 3%' OR array_to_string(participants, ' ') ILIKE '%opic 3%') QUALIFY rank <= 20""")
def like_lane(spark, d):
    return mailbox(spark, d).like_lane("opic 3", 20, FILTERS)


@query(f"""WITH {ROWS}, n AS (SELECT 'c' || vec_id AS id, list_distance(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])) AS dist FROM embeddings ORDER BY dist, id LIMIT 400)
SELECT thread_id, round(-dist, 6) AS score FROM n JOIN threads ON thread_id = id WHERE folder = 'INBOX' AND list_contains(list_transform(senders, lambda x: regexp_extract(lower(x), '<(.*)>', 1)), 'user@example.com') ORDER BY dist, id LIMIT 100""")
def semantic_search(spark, d):
    filters = fusion.Filters(folders=("INBOX",), sender="Someone <User@Example.com>")
    return mailbox(spark, d).semantic_search(PROBE, filters, 100).select("thread_id", F.round("score", 6).alias("score"))


@query(f"WITH {hybrid_sql(INBOX, 40, 10)}, {EVIDENCE.format('cl')} SELECT found.thread_id, subject, round(score, 9) AS score, evidence FROM found LEFT JOIN ev ON ev.thread_id = found.thread_id")
def hybrid_three_lanes(spark, d):
    found = mailbox(spark, d).hybrid_search(QUESTION, PROBE, FILTERS, with_evidence=True)
    return found.select("thread_id", "subject", F.round("score", 9).alias("score"), chunk_ids_of(F.col("evidence")).alias("evidence"))


@query(f"""WITH {hybrid_sql("true", 40, 20)}, {EVIDENCE.format("cl")}, x AS (SELECT found.thread_id, 'Subject: ' || subject || chr(10) || chr(10) || coalesce((SELECT text FROM chunks c WHERE c.chunk_id = split_part(evidence, ',', 1)), snippet) AS t, round(score, 12) AS s, first FROM found LEFT JOIN ev ON ev.thread_id = found.thread_id)
SELECT thread_id, CAST(length(t) AS DOUBLE) AS rerank_score, CAST(row_number() OVER (ORDER BY length(t) DESC, s DESC, first, thread_id) AS INTEGER) AS position FROM x QUALIFY position <= 10""")
def hybrid_reranked(spark, d):
    longest = fusion.Reranker(lambda _, texts: [float(len(t)) for t in texts])
    return mailbox(spark, d).hybrid_search(QUESTION, PROBE, limit=10, with_evidence=True, reranker=longest).select("thread_id", "rerank_score", "position")


ASSISTANT = "list_contains(list_transform(senders, lambda x: regexp_extract(lower(x), '<(.*)>', 1)), 'assistant@example.com')"


@query(f"""WITH {hybrid_sql("true", 40, 1000000).replace("WHERE true ORDER BY round(score, 12) DESC, first, id LIMIT 1000000", f"WHERE {ASSISTANT} ORDER BY round(score, 12) DESC, first, id LIMIT 10")} SELECT thread_id, round(score, 9) AS score FROM found""")
def search_emails(spark, d):
    found = mailbox(spark, d).search_emails(QUESTION, from_name="assist", embed=lambda texts: [PROBE for _ in texts], dim=64)
    return found.select("thread_id", F.round("score", 9).alias("score"))


@query(f"""WITH {ROWS}, {CHUNKS}, cl AS (SELECT *, row_number() OVER (ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])), chunk_id) AS rank FROM chunks QUALIFY rank <= 200),
w AS (SELECT cl.* FROM cl JOIN threads USING (thread_id) WHERE folder = 'Sent'), {EVIDENCE.format("w")} SELECT * FROM ev""")
def evidence_for_threads(spark, d):
    box = mailbox(spark, d)
    return box.evidence_for(box.threads.where("folder = 'Sent'"), PROBE).select("thread_id", chunk_ids_of(F.col("evidence")).alias("evidence"))


@query(f"""WITH {ROWS} SELECT thread_id, 'Subject: ' || display_subject || chr(10) || 'Thread ID: ' || thread_id || chr(10) || 'Participants: ' || array_to_string(participants, ', ') || chr(10) || 'Dates: ' || strftime(date_first, '%Y-%m-%d') || ' to ' || strftime(date_last, '%Y-%m-%d')
  || chr(10) || 'Folder: ' || folder || chr(10) || 'Snippet: ' || snippet AS text FROM threads""")
def rendered_threads(spark, d):
    return search.rendered(mailbox(spark, d).threads)


# ---- threads ----------------------------------------------------------------------------


@query(f"WITH {ROWS} SELECT * REPLACE (array_to_string(message_ids, ',') AS message_ids, array_to_string(participants, ';') AS participants, array_to_string(senders, ';') AS senders) FROM threads")
def rebuild_thread(spark, d):
    return flat(threads.thread_rows(messages(spark, d)))


def flat(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"message_ids": F.array_join("message_ids", ","), "participants": F.array_join("participants", ";"), "senders": F.array_join("senders", ";")})


def _early(rows: DataFrame):
    return F.split("message_id", "-")[1].cast("int") < 2


GROWN = f"""{MAIL.replace("mail AS (", "whole AS (")}, mail AS (SELECT * FROM whole WHERE CAST(split_part(message_id, '-', 2) AS INTEGER) < 2), {BODIES},
late AS (SELECT thread_id, string_agg({BLOCK.format(2000)}, chr(10) ORDER BY date, message_id) AS more FROM whole WHERE CAST(split_part(message_id, '-', 2) AS INTEGER) >= 2 GROUP BY thread_id),
grown AS (SELECT thread_id, body_text || coalesce(chr(10) || more, '') AS body_text FROM bodies LEFT JOIN late USING (thread_id))"""


@query(f"WITH {GROWN} SELECT * FROM grown")
def compute_body(spark, d):
    rows = messages(spark, d)
    return threads.compute_body(threads.thread_rows(rows.where(_early(rows))), rows)


@query(f"""WITH {GROWN}, w AS (SELECT thread_id, min(date) AS date_first, max(date) AS date_last, string_agg(message_id, ',' ORDER BY date, message_id) AS message_ids, arg_max(replace(substr(body, 1, 200), chr(10), ' '), date) AS snippet, bool_or(has_attachments) AS has_attachments FROM whole GROUP BY thread_id),
p AS (SELECT thread_id, string_agg(who, ';' ORDER BY m) AS participants FROM (SELECT thread_id, arg_min(from_addr, date) AS who, min(date) AS m FROM whole GROUP BY thread_id, addr) GROUP BY thread_id)
SELECT thread_id, date_first, date_last, message_ids, snippet, has_attachments, participants, participants AS senders, md5(body_text) AS body_text FROM w JOIN p USING (thread_id) JOIN grown USING (thread_id)""")
def upsert_threads(spark, d):
    rows = messages(spark, d)
    merged = flat(merge.upsert_threads(threads.thread_rows(rows.where(_early(rows))), rows))
    return merged.select("thread_id", "date_first", "date_last", "message_ids", "snippet", "has_attachments", "participants", "senders", F.md5("body_text").alias("body_text"))


REAPED = "CAST(substr(thread_id, 2) AS BIGINT) % 5 = 0"


@query(f"""WITH {GROWN}, rest AS (SELECT thread_id, regexp_replace(lower(arg_min(subject, (date, message_id))), '^re: ', '') AS subject FROM whole WHERE NOT {REAPED} GROUP BY thread_id),
who AS (SELECT thread_id, string_agg(who, ' ' ORDER BY m) AS people FROM (SELECT thread_id, arg_min(from_addr, date) AS who, min(date) AS m FROM whole GROUP BY thread_id, addr) GROUP BY thread_id),
units AS (SELECT thread_id AS id, thread_id AS owner, subject || ' ' || people || ' ' || body_text AS text FROM rest JOIN who USING (thread_id) JOIN grown USING (thread_id)), {bm25_sql("k", "units", FORMS)}
SELECT id AS thread_id, round(score, 6) AS score FROM k""")
def index_upsert(spark, d):
    """An index of threads as they began, then their later messages, then threads that go."""
    rows = messages(spark, d)
    before = written(threads.thread_rows(rows.where(_early(rows))), "early")
    box = search.Mailbox(before, KeywordIndex.build(search.indexed(before), "thread_id", "subject", "_people", "body_text")).upsert(rows)
    index = box.thread_index.update(deleted=rows.where(REAPED).select(F.col("thread_id").alias("id")).distinct())
    return index.bm25(QUESTION).select(F.col("id").alias("thread_id"), F.round("score", 6).alias("score"))


GONE = "(CAST(substr(thread_id, 2) AS BIGINT) % 5 = 0 OR (CAST(substr(thread_id, 2) AS BIGINT) % 3 = 0 AND message_id LIKE '%-0'))"


def _reaped(spark, d):
    rows = messages(spark, d)
    chunks = chunk_table(spark, d).withColumn("message_id", F.col("chunk_id"))
    prior = table(spark, d, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("thread_id"), "embedding")
    return threads.reap_threads(threads.thread_rows(rows), rows, rows.where(GONE), chunks, prior.join(rows.select("thread_id").distinct(), "thread_id"), 64)


@query(f"""WITH {ROWS.replace(MAIL, MAIL.replace("mail AS (", "whole AS (") + f", mail AS (SELECT * FROM whole WHERE NOT {GONE})")}
SELECT thread_id, array_to_string(message_ids, ',') AS message_ids, display_subject, snippet, date_first, md5(body_text) AS body_text FROM threads""")
def reap_threads(spark, d):
    rows = flat(_reaped(spark, d)[0])
    return rows.select("thread_id", "message_ids", "display_subject", "snippet", "date_first", F.md5("body_text").alias("body_text"))


@query(f"""WITH {MAIL}, {CHUNKS}, hit AS (SELECT DISTINCT thread_id FROM mail WHERE {GONE}), left_ AS (SELECT DISTINCT thread_id FROM mail WHERE NOT {GONE}),
m AS (SELECT thread_id, i, avg(x) AS x FROM (SELECT c.thread_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM chunks c JOIN mail ON message_id = chunk_id WHERE NOT {GONE.replace("thread_id", "mail.thread_id")} AND c.thread_id IN (SELECT thread_id FROM hit)) GROUP BY ALL),
v AS (SELECT thread_id, sqrt(sum(x * x)) AS norm, max(x) FILTER (WHERE i = 1) AS a, max(x) FILTER (WHERE i = 64) AS z FROM m GROUP BY thread_id)
SELECT thread_id, round(a / norm, 6) AS first, round(z / norm, 6) AS last FROM v
UNION ALL SELECT 'c' || vec_id, round(CAST(embedding[1] AS DOUBLE), 6), round(CAST(embedding[64] AS DOUBLE), 6) FROM embeddings WHERE 'c' || vec_id IN (SELECT thread_id FROM left_) AND 'c' || vec_id NOT IN (SELECT thread_id FROM hit)""")
def reap_vectors(spark, d):
    vectors = _reaped(spark, d)[1]
    return vectors.select("thread_id", F.round(F.get("embedding", 0), 6).alias("first"), F.round(F.get("embedding", 63), 6).alias("last"))


_SCALED = "CASE WHEN norm = 0 OR abs(norm - 1) <= 1e-6 THEN {0} ELSE {0} / norm END"


@query(f"""WITH {MAIL}, {CHUNKS}, t AS (SELECT DISTINCT thread_id, CAST(substr(thread_id, 2) AS BIGINT) AS n FROM mail),
m AS (SELECT thread_id, i, avg(x) AS x FROM (SELECT thread_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM chunks WHERE CAST(substr(thread_id, 2) AS BIGINT) % 3 = 0) GROUP BY ALL),
p AS (SELECT 'c' || vec_id AS thread_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 3 = 1),
v AS (SELECT thread_id, 'chunks' AS origin, sqrt(sum(x * x)) AS norm, max(x) FILTER (WHERE i = 1) AS a, max(x) FILTER (WHERE i = 64) AS z FROM m GROUP BY thread_id
  UNION ALL SELECT thread_id, 'prior', sqrt(sum(x * x)), max(x) FILTER (WHERE i = 1), max(x) FILTER (WHERE i = 64) FROM p GROUP BY thread_id)
SELECT t.thread_id, coalesce(origin, 'none') AS origin, round(coalesce({_SCALED.format("a")}, 0.0), 5) AS first, round(coalesce({_SCALED.format("z")}, 0.0), 5) AS last FROM t LEFT JOIN v USING (thread_id)""")
def thread_vector(spark, d):
    rows = mail(spark, d).select("thread_id", "subject").dropDuplicates(["thread_id"])
    third = F.expr("CAST(substr(thread_id, 2) AS BIGINT) % 3")
    prior = table(spark, d, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("thread_id"), "embedding").where(third == 1)
    zero = prior.select("thread_id", F.transform("embedding", lambda x: x * 0).alias("embedding")).withColumn("thread_id", F.concat(F.lit("c"), F.expr("CAST(substr(thread_id, 2) AS BIGINT) + 1")))
    found = V.thread_vectors(rows, chunk_table(spark, d).where(third == 0), prior.unionByName(zero), 64)
    return found.select("thread_id", "origin", F.round(F.get("embedding", 0), 5).alias("first"), F.round(F.get("embedding", 63), 5).alias("last"))


@query(f"""WITH {MAIL}, f AS (SELECT thread_id, CASE WHEN message_id LIKE '%-0' THEN 'list' ELSE addr END AS k, min((date, message_id)) AS m, arg_min(CASE WHEN message_id LIKE '%-0' THEN ' LIST ' ELSE from_addr END, (date, message_id)) AS who FROM mail GROUP BY ALL)
SELECT thread_id, string_agg(who, ';' ORDER BY m) AS senders FROM f GROUP BY thread_id""")
def senders_with_nameless(spark, d):
    rows = mail(spark, d).withColumn("who", F.array(F.when(F.col("message_id").endswith("-0"), " LIST ").otherwise(F.col("from_addr"))))
    return threads.participants(rows, "thread_id", "who", keep_nameless=True, out="senders").select("thread_id", F.array_join("senders", ";").alias("senders"))


@query(f"""WITH {ROWS}, m AS (SELECT message_id, 'topic ' || (CAST(substr(thread_id, 2) AS BIGINT) % 7) AS s, folder AS f, date, addr FROM mail WHERE message_id LIKE '%-0'),
n AS (SELECT message_id, thread_id, date, date_last, addr, participants, row_number() OVER (PARTITION BY message_id ORDER BY date_last DESC, thread_id) AS p FROM m JOIN threads t ON t.subject = m.s AND t.folder = m.f QUALIFY p <= 10)
SELECT message_id, arg_min(thread_id, p) AS thread_id FROM n WHERE list_contains(list_transform(participants, lambda x: regexp_extract(lower(x), '<(.*)>', 1)), addr) AND abs(epoch(date) - epoch(date_last)) <= 60 * 86400 GROUP BY message_id""")
def subject_candidates(spark, d):
    rows = threads.thread_rows(messages(spark, d))
    known = rows.select("thread_id", F.col("subject").alias("norm_subject"), "folder", "date_last", F.transform("participants", lambda x: T.canonical_addr(x)).alias("people"))
    new = mail(spark, d).where("message_id LIKE '%-0'").select("message_id", T.normalize_subject(F.col("subject")).alias("norm_subject"), "folder", "date", F.array(T.canonical_addr(F.col("from_addr"))).alias("people"))
    return threads.subject_candidates(known, new)


# ---- lookups, chunks, vectors -----------------------------------------------------------


@query(f"WITH {MAIL} SELECT message_id, '/mail/' || message_id AS filepath FROM mail WHERE thread_id = (SELECT thread_id FROM mail WHERE message_id = 'c7-1')")
def thread_of_message(spark, d):
    entries = mail(spark, d).select("message_id", "thread_id", F.concat(F.lit("/mail/"), "message_id").alias("filepath"))
    thread = lookups.thread_of_message(entries, "c7-1").first()
    return lookups.messages_of_thread(entries, thread["thread_id"] if thread else "")


@query("SELECT '/d/' || doc_id AS filepath FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 5)")
def paths_by_content(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("/d/"), "doc_id").alias("filepath"), F.sha2("text", 256).alias("content_hash"))
    return lookups.paths_by_content(files, files.where("filepath = '/d/5'").first()["content_hash"])


@query("SELECT '/d/' || doc_id AS filepath, doc_id % 3 = 0 AS indexed FROM documents")
def is_indexed(spark, d):
    paths = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/d/"), "doc_id").alias("filepath"))
    return lookups.is_indexed(paths.where("doc_id % 3 = 0"), paths.select("filepath"))


@query(r"SELECT doc_id, CAST(regexp_count AS BIGINT) AS tokens, md5(CASE WHEN regexp_count > 50 THEN array_to_string(w[1:50], '') ELSE text END) AS cut FROM (SELECT doc_id, text, regexp_extract_all(text, '[ \t\n\v\f\r]*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\v\f\r])') AS w, len(w) AS regexp_count FROM documents WHERE text IS NOT NULL)")
def truncate_tokens(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"), F.md5(T.truncate_to_tokens(F.col("text"), 50)).alias("cut"))


@query("SELECT source AS message_id, count(*) FILTER (WHERE doc_id % 5 = 0) AS inserted, count(*) FILTER (WHERE doc_id % 5 = 1) AS deleted, count(*) FILTER (WHERE doc_id % 5 > 1) AS kept FROM documents GROUP BY source")
def chunk_change_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("message_id"), F.lit(None).cast("string").alias("attachment_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_id"))
    changes = merge.diff_chunks(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 <> 1"), docs.where("doc_id % 5 = 0"))
    return merge.change_counts(changes, ["message_id"])


@query("SELECT md5(CAST(doc_id AS VARCHAR)) AS chunk_id FROM documents WHERE source = 'src1' AND doc_id % 2 = 0")
def chunk_slice(spark, d):
    attachment = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("a"), "doc_id"))
    rows = table(spark, d, "documents").select(F.col("source").alias("message_id"), attachment.alias("attachment_id"), F.md5(F.col("doc_id").cast("string")).alias("chunk_id"))
    return merge.chunk_slice(rows, "src1")


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) || '::' || sha256(text) AS key FROM documents WHERE text IS NOT NULL")
def attachment_chunk_keys(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", attachments.attachment_chunk_key(F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("key"))


@query("SELECT vec_id, round(CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END, 5) AS norm FROM embeddings")
def vector_backfill(spark, d):
    scaled = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 7 == 0, x * 0).otherwise(x * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(V.backfill_normalized(scaled)), 5).alias("norm"))


@query("SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) AS third FROM embeddings WHERE label = 4")
def vector_fetch(spark, d):
    vectors = table(spark, d, "embeddings")
    return V.fetch_vectors(vectors, vectors.where("label = 4"), "vec_id").select("vec_id", F.round(F.get("embedding", 2).cast("double"), 6).alias("third"))


@query("SELECT vec_id, round(CASE WHEN vec_id % 4 = 0 THEN 9.0 ELSE CAST(embedding[1] AS DOUBLE) END, 6) AS first FROM embeddings")
def vector_replace(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fresh = rows.where("vec_id % 4 = 0").withColumn("embedding", F.array(F.lit(9.0)))
    return merge.replace_rows(rows, fresh, ["vec_id"]).select("vec_id", F.round(F.get("embedding", 0), 6).alias("first"))


# ---- queue ------------------------------------------------------------------------------

NOW = "2024-06-01 00:00:00"


@query("""SELECT event_id AS filepath, CASE WHEN event_id % 5 = 2 THEN 'dead' WHEN event_id % 5 = 3 AND event_id % 7 + 1 >= 5 THEN 'dead' ELSE 'queued' END AS status,
CAST(CASE WHEN event_id % 5 = 2 THEN 1 WHEN event_id % 5 = 3 THEN event_id % 7 + 1 ELSE event_id % 7 END AS INTEGER) AS attempts, CASE event_id % 5 WHEN 2 THEN 'parse' WHEN 3 THEN 'embed' END AS last_stage FROM events WHERE event_id % 5 > 1""")
def queue_outcomes(spark, d):
    jobs = table(spark, d, "events").select(F.col("event_id").alias("filepath"), F.lit("queued").alias("status"), (F.col("event_id") % 7).cast("int").alias("attempts"), F.col("ts").alias("next_attempt_at"))
    kind = F.element_at(F.array(*map(F.lit, ("succeeded", "skipped", "terminal", "failed"))), (F.col("filepath") % 5 + 1).cast("int"))
    stage = F.when(F.col("filepath") % 5 == 2, "parse").when(F.col("filepath") % 5 == 3, "embed")
    outcomes = jobs.where("filepath % 5 < 4").select("filepath", kind.alias("outcome"), stage.alias("stage"), F.lit("e").alias("error"))
    return queue.settle(jobs, outcomes, F.lit(NOW).cast("timestamp")).select("filepath", "status", "attempts", "last_stage")


@query("""WITH b AS (SELECT event_id, ts FROM events ORDER BY ts, CAST(event_id AS VARCHAR) LIMIT 50)
SELECT CAST(e.event_id AS VARCHAR) AS filepath, CASE WHEN b.event_id IS NULL THEN 'untouched' WHEN e.event_id % 4 = 0 THEN 'thread' ELSE 'embed' END AS stage FROM events e LEFT JOIN b USING (event_id) WHERE b.event_id IS NULL OR e.event_id % 4 = 0 OR e.event_id % 4 = 1""")
def queue_drain(spark, d):
    jobs = table(spark, d, "events").select(F.col("event_id").cast("string").alias("filepath"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.col("ts").alias("next_attempt_at"))

    def failing(rest: int):
        return lambda rows: rows.withColumn("error", F.when(F.col("filepath").cast("long") % 4 == rest, "boom"))

    left, _ = queue.drain(jobs, F.lit("2030-01-01").cast("timestamp_ntz"), 50, [("thread", failing(0)), ("embed", failing(1))])
    return left.select("filepath", F.coalesce("last_stage", F.lit("untouched")).alias("stage"))


@query("SELECT CAST(event_id AS VARCHAR) AS filepath, event_id % 3 = 0 AS dead FROM events WHERE event_id % 3 <> 2")
def queue_states(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("dead", "queued", "gone"))), (F.col("event_id") % 3 + 1).cast("int"))
    jobs = table(spark, d, "events").select(F.col("event_id").cast("string").alias("filepath"), status.alias("status"))
    return queue.is_dead(jobs).withColumn("dead", F.lit(True)).unionByName(queue.is_pending(jobs).withColumn("dead", F.lit(False)))


@query("SELECT CAST(doc_id AS VARCHAR) AS filepath FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0")
def initial_index(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filepath"), "doc_id")
    jobs = files.where("doc_id % 3 = 0").select("filepath", F.lit("dead").alias("status"))
    return queue.to_index(files.select("filepath"), files.where("doc_id % 2 = 0"), jobs)


@query("SELECT CAST(user_id AS VARCHAR) AS filepath, max(ts) AS next_attempt_at FROM events GROUP BY user_id")
def queue_enqueue(spark, d):
    arrivals = table(spark, d, "events").select(F.col("user_id").cast("string").alias("filepath"), F.lit("created").alias("reason"), F.col("ts").alias("now"))
    old = arrivals.select("filepath", "reason", F.lit("dead").alias("status"), F.lit(5).alias("attempts"), F.col("now").alias("next_attempt_at")).limit(3)
    return queue.enqueue(old, arrivals).where("status = 'queued' AND attempts = 0").select("filepath", "next_attempt_at")


# ---- files ------------------------------------------------------------------------------


def _stored(spark, d) -> tuple[DataFrame, DataFrame]:
    ids = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 6).alias("m"))
    stored = ids.select(F.concat(F.lit("/box/new/"), "doc_id", F.lit(":2,")).alias("filepath"))
    place = F.when(F.col("m") == 1, F.lit("/box/new/")).when(F.col("m") == 3, F.lit("/other/new/")).otherwise(F.when(F.col("m") == 0, F.lit("/box/new/")).otherwise(F.lit("/box/cur/")))
    flags = F.when(F.col("m") == 0, F.lit(":2,")).otherwise(F.lit(":2,S"))
    return stored, ids.where("m <> 5").select(F.concat(place, F.col("doc_id").cast("string"), flags).alias("path"))


@query("""SELECT '/box/new/' || doc_id || ':2,' AS filepath, CASE doc_id % 6 WHEN 0 THEN '/box/new/' || doc_id || ':2,' WHEN 1 THEN '/box/new/' || doc_id || ':2,S' WHEN 2 THEN '/box/cur/' || doc_id || ':2,S' WHEN 4 THEN '/box/cur/' || doc_id || ':2,S' END AS current FROM documents""")
def current_paths(spark, d):
    return reconcile.current_paths(*_stored(spark, d))


@query("SELECT count(*) FILTER (WHERE doc_id % 6 IN (1, 2, 4)) AS renamed, count(*) FILTER (WHERE doc_id % 6 IN (3, 5)) AS unreachable FROM documents")
def sweep_paths(spark, d):
    return reconcile.sweep_paths(*_stored(spark, d))


@query("""SELECT CASE doc_id % 4 WHEN 0 THEN '/c/' || doc_id || ':2,ST' WHEN 1 THEN '/c/' || doc_id || ':2,S' ELSE '/n/' || doc_id END AS filepath, doc_id % 4 = 0 OR doc_id % 4 = 2 AS marked FROM documents""")
def moved_files(spark, d):
    ids = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/n/"), "doc_id").alias("filepath"))
    flags = F.when(F.col("doc_id") % 4 == 0, ":2,ST").otherwise(":2,S")
    moves = ids.where("doc_id % 4 < 2").select(F.col("filepath").alias("src_path"), F.concat(F.lit("/c/"), "doc_id", flags).alias("dest_path"))
    marks = ids.where("doc_id % 4 IN (1, 2)").select("filepath", F.lit(NOW).cast("timestamp").alias("marked_at"))
    indexed, left = reconcile.handle_moved(ids.select("filepath"), marks, moves, F.lit(NOW).cast("timestamp"))
    return indexed.join(left.select("filepath", F.lit(True).alias("_m")), "filepath", "left").select("filepath", F.coalesce("_m", F.lit(False)).alias("marked"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ST' WHEN doc_id % 3 = 1 THEN 'F' ELSE '' END AS flags, doc_id % 3 = 0 AS trashed, CAST(doc_id AS VARCHAR) || '.host' AS uniq FROM documents")
def maildir_flags(spark, d):
    path = F.concat(F.lit("/m/INBOX/cur/"), F.col("doc_id").cast("string"), F.lit(".host"), F.element_at(F.array(*map(F.lit, (":2,ST", ":2,F", ""))), (F.col("doc_id") % 3 + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", T.maildir_flags(path).alias("flags"), T.is_trashed(path).alias("trashed"), T.maildir_unique(path).alias("uniq"))


@query(f"""WITH {MAIL} SELECT message_id || '@x' AS message_id, CASE WHEN split_part(message_id, '-', 2) = '0' THEN '' ELSE thread_id || '-0@x' END AS in_reply_to, subject, regexp_replace(from_addr, '@Example', '@Example') AS from_addr, date, md5(trim(body, ' ' || chr(9) || chr(10) || chr(13))) AS body,
'Work/' || folder AS folder, CASE WHEN has_attachments THEN 1 ELSE 0 END AS n_attachments, CASE WHEN has_attachments THEN 'unnamed' END AS filename FROM mail""")
def parse_messages(spark, d):
    rows = mail(spark, d)
    reply = F.when(F.split("message_id", "-")[1] != "0", F.concat(F.lit("In-Reply-To: <"), "thread_id", F.lit("-0@x>\r\n"))).otherwise("")
    head = F.concat(F.lit("From: "), "from_addr", F.lit("\r\nTo: b@x.org, \r\nSubject: "), "subject", F.lit("\r\nMessage-ID: <"), "message_id", F.lit("@x>\r\n"), reply, F.lit("Date: "), F.date_format("date", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000\r\nMIME-Version: 1.0\r\n"))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), "body")
    both = F.concat(F.lit("Content-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\n"), plain, F.lit("\r\n--B\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment\r\n\r\nxyz\r\n--B--\r\n"))
    content = F.encode(F.concat(head, F.when(F.col("has_attachments"), both).otherwise(plain)), "utf-8")
    files = rows.select(F.concat(F.lit("/mail/Work/"), "folder", F.lit("/cur/"), "message_id", F.lit(":2,S")).alias("path"), F.lit(NOW).cast("timestamp").alias("modificationTime"), F.length(content).cast("long").alias("length"), content.alias("content"))
    found = parse_mail(files, root="/mail").where("error IS NULL")
    return found.select(
        "message_id", "in_reply_to", "subject", "from_addr", F.col("date").cast("timestamp_ntz").alias("date"), F.md5("body").alias("body"), "folder", F.size("attachments").alias("n_attachments"), F.get("attachments", 0)["filename"].alias("filename"),
    )


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def snapshot_round_trip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    store = Snapshots(spark, fresh_dir(spark, "snapshot"))
    store.write({"docs": docs, "other": docs.where("lang = 'de'")})
    store.write({"docs": docs.where("lang = 'en'").drop("lang")}, carry=True)
    return store.read("docs")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- attachments and prompts ------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT h AS content_hash, count(*) AS occurrences, NOT bool_or(doc_id % 2 = 0) AS todo FROM r GROUP BY h""")
def attachment_plan(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    part = F.struct(F.lit("a.txt").alias("filename"), F.lit("text/plain").alias("content_type"), F.length("text").cast("long").alias("size"), F.encode("text", "utf-8").alias("payload"), F.sha2("text", 256).alias("content_hash"))
    rows = docs.select(F.col("doc_id").cast("string").alias("message_id"), F.col("source").alias("thread_id"), F.array(part).alias("attachments"))
    null = F.lit(None).cast("string")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("content_hash"), F.lit("empty").alias("status"), null.alias("extractor"), null.alias("text"), null.alias("error"), F.lit(NOW).cast("timestamp").alias("extracted_at")).distinct()
    occurrences, todo = attachments.prepare(rows, cache, F.lit(NOW).cast("timestamp"))
    counts = occurrences.groupBy("content_hash").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.join(todo.select("content_hash", F.lit(True).alias("_t")), "content_hash", "left").select("content_hash", "occurrences", F.coalesce("_t", F.lit(False)).alias("todo"))


@query(f"WITH {ROWS} SELECT thread_id, substr(body_text, 1, 2000) AS context FROM threads")
def thread_context(spark, d):
    return rag.thread_context(mailbox(spark, d).threads).select("thread_id", "context")


@query(f"""WITH {ROWS} SELECT thread_id AS source_thread, strftime(date_last, '%Y-%m-%dT%H:%M:%S') AS date, '{{"_date": "' || strftime(date_last, '%Y-%m-%dT%H:%M:%S') || '", "_source_thread": "' || thread_id || '", "ok": 1}}' AS record FROM threads ORDER BY date_last DESC, thread_id LIMIT 20""")
def extract_from_emails(spark, d):
    newest = mailbox(spark, d).threads.orderBy(F.col("date_last").desc(), "thread_id").limit(20)
    return rag.extract_from_emails(rag.thread_context(newest), {"ok": 0}, lambda prompt: json.dumps([{"ok": 1}, 7]))


@query(f"WITH {hybrid_sql('true', 10, 5)} SELECT thread_id, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, first, id) AS INTEGER) AS place FROM found")
def ask_mailbox(spark, d):
    _, sources = rag.ask_mailbox(mailbox(spark, d), QUESTION, PROBE, lambda prompt: f"{len(prompt)} characters")
    return spark.createDataFrame([(s, i + 1) for i, s in enumerate(sources)], "thread_id string, place int")


@query(f"WITH {MAIL} SELECT 'c7' AS thread_id, true AS found FROM mail WHERE thread_id = 'c7' LIMIT 1")
def summarize_thread(spark, d):
    answer = rag.summarize_thread(mailbox(spark, d), "c7", lambda prompt: "short", "action-items")
    return spark.createDataFrame([("c7", answer == "short")], "thread_id string, found boolean")


@query(REDACTED.replace("FROM documents", "FROM (SELECT doc_id, replace(text, 'the', '[REDACTED]') AS text FROM documents)"))
def redact_given(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(T.redact(F.col("text"), ["the", ""])).alias("redacted"))

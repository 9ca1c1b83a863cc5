"""Registered queries over renderings of the mailbox, and over errors that are safe to keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import lookups, rendering
from threadloom.plans.catalog import MAIL, REDACTED, query, table
from threadloom.plans.mailbox import ROWS, mailbox
from threadloom.sources.shared import spread

HEADING = """'Subject: ' || display_subject || chr(10) || 'Folder: ' || folder || chr(10) || 'Participants: ' || array_to_string(participants, ', ') || chr(10)
  || 'Dates: ' || strftime(date_first, '%Y-%m-%d') || ' to ' || strftime(date_last, '%Y-%m-%d')"""
CONTENT = """CASE WHEN length(body_text) > 0 THEN chr(10) || chr(10) || 'Text:' || chr(10) || body_text WHEN length(snippet) > 0 THEN chr(10) || chr(10) || 'Snippet:' || chr(10) || snippet ELSE '' END"""


@query(f"""WITH {ROWS} SELECT thread_id, {HEADING} || chr(10) || 'Count: ' || len(message_ids) || {CONTENT}
  || chr(10) || chr(10) || 'Messages:' || chr(10) || array_to_string(list_transform(message_ids, lambda x, i: i || '. ' || x), chr(10))
  || CASE WHEN has_attachments THEN chr(10) || chr(10) || 'This thread has attachments.' ELSE '' END AS text FROM threads""")
def thread_texts(spark, d):
    return rendering.thread_text(mailbox(spark, d).threads)


@query(f"""WITH {ROWS}, asked AS (SELECT message_id, thread_id FROM mail)
SELECT message_id, thread_id, md5('Message: ' || message_id || chr(10) || {HEADING} || {CONTENT}) AS text FROM asked JOIN threads USING (thread_id)""")
def message_texts(spark, d):
    rows = mailbox(spark, d).threads
    entries = rows.select("thread_id", F.explode("message_ids").alias("message_id"))
    return rendering.message_text(entries, rows).withColumn("text", F.md5("text"))


@query(f"""WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY date_last DESC, thread_id) AS place FROM threads)
SELECT folder, count(*) AS shown, string_agg(place || '. ' || display_subject || chr(10) || '   ' || array_to_string(participants[1:2], ', ') || CASE WHEN len(participants) > 2 THEN '...' ELSE '' END
  || ' | ' || strftime(date_last, '%Y-%m-%d') || ' | ' || len(message_ids) || ' message(s)' || CASE WHEN has_attachments THEN ' | attachments' ELSE '' END
  || chr(10) || '   ID: ' || thread_id, chr(10) ORDER BY place) AS text FROM r WHERE place BETWEEN 6 AND 25 GROUP BY folder""")
def folder_pages(spark, d):
    return rendering.folder_pages(mailbox(spark, d).threads, limit=20, offset=5)


@query(f"""WITH {MAIL}, p AS (SELECT addr AS email, min(trim(split_part(from_addr, '<', 1))) AS names, count(DISTINCT thread_id) AS threads FROM mail
  WHERE lower(trim(split_part(from_addr, '<', 1)) || ' ' || addr) LIKE '%example%' GROUP BY addr)
SELECT email, email || chr(10) || '   Names: ' || coalesce(nullif(names, ''), '(no name)') || chr(10) || '   Threads: ' || threads AS text FROM p ORDER BY threads DESC, email LIMIT 10""")
def contact_texts(spark, d):
    return rendering.contact_text(lookups.find_contact(mailbox(spark, d).threads, "Example"))


@query(f"WITH {ROWS} SELECT folder, folder || ' (' || count(*) || ' threads)' AS text FROM threads GROUP BY folder")
def folder_texts(spark, d):
    return rendering.folder_text(lookups.list_folders(mailbox(spark, d).threads))


@query(f"""WITH red AS ({REDACTED.replace("md5(regexp_replace(t,", "(regexp_replace(t,")})
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'StatusError: status=' || (400 + doc_id % 100) ELSE md5(coalesce(redacted, '')) END AS error FROM documents JOIN red USING (doc_id)""")
def safe_errors(spark, d):
    """Failures whose message quotes a document; a third came back with a status."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text"))
    status = F.when(F.col("doc_id") % 3 == 0, 400 + F.col("doc_id") % 100)
    error = rendering.safe_error(F.lit("StatusError"), status, F.col("text"))
    return rows.select("doc_id", F.when(status.isNotNull(), error).otherwise(F.md5(error)).alias("error"))

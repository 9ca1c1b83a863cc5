"""Rows as a person or a model reads them: threads, messages, pages of folders, contacts, errors.

Each rendering is an expression over the rows it is given and takes part in their plan; only a
page of a folder gathers rows, at most ``limit`` of a folder, cut before the shuffle.  Nulls read
as empty: a thread without a text shows its snippet, one without either ends with its heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import redact


def _or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _day(column: str) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit("unknown"))


def _subject() -> Column:
    return F.coalesce(F.nullif("display_subject", F.lit("")), F.col("subject"), F.lit(""))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _heading() -> list[Column]:
    people = F.coalesce(F.array_join("participants", ", "), F.lit(""))
    return [_line("Subject", _subject()), _line("Folder", _or_empty("folder")), _line("Participants", people), _line("Dates", F.concat(_day("date_first"), F.lit(" to "), _day("date_last")))]


def _content() -> Column:
    """The text under its label, else the snippet under its own, else null."""
    under = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(f"\n{label}:\n"), F.col(c)))
    return F.coalesce(under("Text", "body_text"), under("Snippet", "snippet"))


def thread_text(threads: DataFrame, attachments: bool = True) -> DataFrame:
    """(thread_id, text): heading, indexed text, numbered message ids, and whether files hang on the thread."""
    ids = F.coalesce("message_ids", F.array().cast("array<string>"))
    numbered = F.array_join(F.transform(ids, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    listed = F.when(F.size(ids) > 0, F.concat(F.lit("\nMessages:\n"), numbered))
    note = F.when(F.col("has_attachments") & F.lit(attachments), F.lit("\nThis thread has attachments."))
    return threads.select("thread_id", F.concat_ws("\n", *_heading(), _line("Count", F.size(ids).cast("string")), _content(), listed, note).alias("text"))


def message_text(entries: DataFrame, threads: DataFrame) -> DataFrame:
    """(message_id, thread_id, text) of each asked message, from the map (message_id, thread_id); text is null where no thread is known.

    The index keeps texts by thread, so a message is shown within its thread.
    """
    shown = threads.select(F.col("thread_id").alias("_t"), F.concat_ws("\n", *_heading(), _content()).alias("_text"))
    rows = entries.join(shown, F.col("thread_id") == F.col("_t"), "left")
    return rows.select("message_id", "thread_id", F.concat(F.lit("Message: "), F.col("message_id"), F.lit("\n"), F.col("_text")).alias("text"))


def folder_pages(threads: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """(folder, shown, text): a page of each folder, newest first, numbered from ``offset``; at most two people of a thread are named.

    A folder with a third of all threads sends ``offset + limit`` rows of each task to the shuffle, as the rank is limited.
    """
    people = F.coalesce("participants", F.array().cast("array<string>"))
    named = F.concat(F.array_join(F.slice(people, 1, 2), ", "), F.when(F.size(people) > 2, F.lit("...")).otherwise(F.lit("")))
    count = F.concat(F.size(F.coalesce("message_ids", F.array().cast("array<string>"))).cast("string"), F.lit(" message(s)"))
    files = F.when(F.col("has_attachments"), F.lit("attachments"))
    rows = threads.select("folder", "thread_id", "date_last", F.concat_ws("\n   ", _subject(), F.concat_ws(" | ", named, _day("date_last"), count, files), _line("ID", F.col("thread_id"))).alias("entry"))
    place = F.row_number().over(W.partitionBy("folder").orderBy(F.col("date_last").desc(), "thread_id"))
    page = rows.withColumn("place", place).where(F.col("place") <= offset + limit).where(F.col("place") > offset)
    entries = F.array_sort(F.collect_list(F.struct("place", "entry")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["place"].cast("string"), F.lit(". "), e["entry"])), "\n")
    return page.groupBy("folder").agg(F.count(F.lit(1)).alias("shown"), text.alias("text"))


def contact_text(contacts: DataFrame) -> DataFrame:
    """(email, text) of rows (email, names, threads), as :func:`lookups.find_contact` gives them."""
    names = F.coalesce(F.nullif("names", F.lit("")), F.lit("(no name)"))
    return contacts.select("email", F.concat_ws("\n   ", "email", _line("Names", names), _line("Threads", F.col("threads").cast("string"))).alias("text"))


def folder_text(folders: DataFrame) -> DataFrame:
    """(folder, text) of rows (folder, count)."""
    return folders.select("folder", F.concat(_or_empty("folder"), F.lit(" ("), F.col("count").cast("string"), F.lit(" threads)")).alias("text"))


def safe_error(kind: Column, status: Column, message: Column, secrets: tuple[str, ...] = ()) -> Column:
    """What may be logged or stored of a failure.

    A provider's answer with a status can quote the mail that was sent to it: of such a failure
    only its kind and status remain.  Of others the message remains, with secrets replaced.
    """
    return F.when(status.isNotNull(), F.concat(F.coalesce(kind, F.lit("Error")), F.lit(": status="), status.cast("string"))).otherwise(redact(F.coalesce(message, F.lit("")), secrets))

"""Messages to threads: roll-up, participants, header links, subject fallback.

Two ways of threading.  ``linked`` connects messages by their headers whatever their order
of arrival.  ``arrival`` is the ordered fold: a message joins the thread of the first
ancestor already seen, else one with its subject in its folder (newest first, ten at most,
a participant in common, within 60 days), else it starts one; threads never merge.  See
:mod:`threadloom.operators.arrival`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import canonical_addr, normalize_subject, trimmed, truncate_to_tokens
from threadloom.functions.vectors import thread_vectors
from threadloom.operators import arrival
from threadloom.sources.shared import shared_dir

#: Days and number of candidates of the subject fallback; characters of a message in a thread's texts; tokens of these.
SUBJECT_DAYS, SUBJECT_CANDIDATES, EMBED_CHARS, SNIPPET_CHARS, BODY_CHARS, BODY_TOKENS = 60, 10, 500, 200, 2000, 4000


def moment() -> Column:
    """What orders messages: the date, then the id; a message without a date is the newest, as one that comes in now."""
    return F.struct(F.col("date").isNull().alias("undated"), "date", "message_id")


def participants(messages: DataFrame, key: str, addresses: str, keep_nameless: bool = False, out: str = "participants") -> DataFrame:
    """(key, participants): one display form for each canonical address, in order of first use.

    Entries without an address are dropped, or kept as people of their own.
    """
    people = messages.select(key, "date", "message_id", F.posexplode(addresses).alias("at", "who")).withColumn("addr", person_key(F.col("who"), keep_nameless)).where("addr <> ''")
    first = people.groupBy(key, "addr").agg(F.min(F.struct(moment().alias("m"), "at", "who")).alias("f"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("f")), lambda s: s["who"]).alias(out))


def person_key(who: Column, keep_nameless: bool = True) -> Column:
    """What makes two entries one person: the canonical address, or else the entry itself, trimmed and in lower case."""
    address = canonical_addr(who)
    return F.when(address != "", address).otherwise(F.lower(trimmed(who)) if keep_nameless else F.lit(""))


def distinct_people(entries: Column) -> Column:
    """An array of people without later entries of one person; entries without an address stay."""
    keys = F.transform(entries, lambda x: person_key(x))
    # each key once, in order of first use; the entry is the one at the key's first place
    return F.transform(F.array_distinct(keys), lambda k: F.element_at(entries, F.array_position(keys, k).cast("int")))


def rollup(messages: DataFrame, key: str = "thread_id") -> DataFrame:
    """One row for each thread: dates, ids in order, subject of its oldest message, snippet of its newest, attachments."""
    return messages.groupBy(key).agg(
        F.min("date").alias("date_first"), F.max("date").alias("date_last"), F.count(F.lit(1)).alias("messages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(moment())), lambda s: s["message_id"]), ",").alias("message_ids"),
        F.min_by("subject", moment()).alias("display_subject"),
        F.max_by(F.replace(F.substring("body", 1, SNIPPET_CHARS), F.lit("\n"), F.lit(" ")), moment()).alias("snippet"),
        F.max("has_attachments").alias("has_attachments"), F.min_by("folder", moment()).alias("folder"),
    )


def message_block(chars: int) -> Column:
    """What of a message goes into its thread's text."""
    stamp = F.concat(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.concat_ws("\n", F.concat(F.lit("From: "), "from_addr"), F.concat(F.lit("Date: "), stamp), F.substring("body", 1, chars))


def _blocks(messages: DataFrame, key: str, chars: int, end: str, between: str, out: str) -> DataFrame:
    parts = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(moment().alias("m"), message_block(chars).alias("t")))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda s: F.concat(s["t"], F.lit(end))), between).alias(out))


def embedding_text(messages: DataFrame, key: str = "thread_id", chars: int = EMBED_CHARS, tokens: int = BODY_TOKENS) -> DataFrame:
    """(key, text): what of a thread is embedded and indexed: subject, people, messages in order, cut to ``tokens``.

    ``messages`` has from_addr, date, message_id, body, subject and addresses; the subject is the oldest message's, normalised.
    """
    subject = messages.groupBy(key).agg(normalize_subject(F.min_by("subject", moment())).alias("_subject"))
    people = participants(messages, key, "addresses", out="_people")
    text = F.concat(F.lit("Subject: "), "_subject", F.lit("\nParticipants: "), F.coalesce(F.array_join("_people", ", "), F.lit("")), F.lit("\n\n"), "_blocks")
    joined = _blocks(messages, key, chars, "\n", "\n", "_blocks").join(subject, key).join(people, key, "left")
    return joined.select(key, truncate_to_tokens(text, tokens).alias("text"))


def thread_rows(messages: DataFrame, key: str = "thread_id") -> DataFrame:
    """Threads made anew from their messages: what an index stores of each.

    The same whether a thread is new, grown, or what is left of it after deletions.
    """
    base = rollup(messages, key).withColumn("message_ids", F.split("message_ids", ","))
    people = participants(messages, key, "addresses")
    senders = participants(messages.withColumn("_from", F.array("from_addr")), key, "_from", keep_nameless=True, out="senders")
    body = embedding_text(messages, key).withColumnRenamed("text", "body_text")
    none = F.array().cast("array<string>")
    rows = base.join(people, key, "left").join(senders, key, "left").join(body, key, "left")
    return rows.select(
        key, normalize_subject(F.col("display_subject")).alias("subject"), "display_subject", F.coalesce("participants", none).alias("participants"), F.coalesce("senders", none).alias("senders"),
        "folder", "date_first", "date_last", "message_ids", "snippet", "has_attachments", "body_text",
    )


def compute_body(old: DataFrame, messages: DataFrame, key: str = "thread_id", chars: int = BODY_CHARS, tokens: int = BODY_TOKENS) -> DataFrame:
    """(key, body_text): a stored thread's text with its new messages behind, cut to ``tokens``; threads without a stored text get one anew.

    ``old`` has message_ids and body_text.
    """
    stored = old.where("body_text IS NOT NULL AND body_text <> ''").select(F.col(key).alias("_k"), "message_ids", F.col("body_text").alias("_old"))
    joined = messages.join(stored, F.col(key) == F.col("_k"), "left")
    fresh = joined.where(F.col("_k").isNotNull() & ~F.coalesce(F.array_contains("message_ids", F.col("message_id")), F.lit(False))).drop("_k", "message_ids", "_old")
    grown = stored.join(_blocks(fresh, key, chars, "", "\n", "_more"), F.col("_k") == F.col(key), "left")
    text = F.when(F.col("_more").isNull(), F.col("_old")).otherwise(truncate_to_tokens(F.concat_ws("\n", "_old", "_more"), tokens))
    grown = grown.select(F.col("_k").alias(key), text.alias("body_text"))
    new = embedding_text(joined.where("_k IS NULL").drop("_k", "message_ids", "_old"), key).withColumnRenamed("text", "body_text")
    return grown.unionByName(new)


def reap_threads(threads: DataFrame, messages: DataFrame, removed: DataFrame, chunks: DataFrame, prior: DataFrame, dim: int, backend=None) -> tuple[DataFrame, DataFrame]:
    """(threads, vectors) after messages (message_id) are removed.

    Threads that lose none stay; those that lose some are made anew from the rest, with the mean of the
    chunks that are left as vector, or else their subject's; those that lose all go.
    """
    left = messages.join(removed.select("message_id").distinct(), "message_id", "left_anti")
    touched = messages.join(removed.select("message_id").distinct(), "message_id", "left_semi").select("thread_id").distinct()
    fresh = thread_rows(left.join(touched, "thread_id", "left_semi"))
    kept_chunks = chunks.join(removed.select("message_id").distinct(), "message_id", "left_anti").join(touched, "thread_id", "left_semi")
    vectors = thread_vectors(fresh, kept_chunks, None, dim, backend).drop("origin")
    untouched = prior.join(touched, "thread_id", "left_anti").select("thread_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return threads.join(touched, "thread_id", "left_anti").unionByName(fresh), untouched.unionByName(vectors)


def subject_gaps(messages: DataFrame, days: int = SUBJECT_DAYS) -> DataFrame:
    """(.., subject_thread): messages of one folder and normalised subject, cut where more than ``days`` pass."""
    key = W.partitionBy("folder", "norm_subject").orderBy("date", "message_id")
    rows = messages.withColumn("norm_subject", normalize_subject(F.col("subject")))
    gap = F.datediff("date", F.lag("date").over(key)) > days
    return rows.withColumn("subject_thread", F.sum(F.when(gap, 1).otherwise(0)).over(key).cast("long"))


def header_edges(messages: DataFrame) -> DataFrame:
    """(message_id, parent): In-Reply-To and References that are messages of the archive."""
    named = messages.select("message_id", F.explode(F.concat(F.array("in_reply_to"), F.coalesce("references", F.array().cast("array<string>")))).alias("parent")).where("parent <> ''")
    return named.join(messages.select(F.col("message_id").alias("parent")).distinct(), "parent").select("message_id", "parent").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): least id connected with each node (id) by edges (a, b); lineage is cut by checkpoint() each round.

    A round takes the least root's root among a node's neighbours, for the node and for its
    root, then the root's root; rounds go on until no root moves, and grow with the logarithm
    of a chain's length.
    """
    shared_dir(nodes.sparkSession)  # where checkpoint() writes
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select("id", F.col("id").alias("root"), F.col("id").alias("grand")).distinct().checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("_a")).agg(F.min("grand").alias("low"))
        hooks = near.join(labels, F.col("_a") == F.col("id")).select(F.explode(F.array("id", "root")).alias("_a"), "low")
        low = hooks.groupBy("_a").agg(F.min("low").alias("low"))
        moved = labels.join(low, F.col("id") == F.col("_a"), "left").select("id", F.least("root", "grand", "low").alias("root"), F.col("root").alias("was")).checkpoint()
        parents = moved.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        fresh = moved.join(parents, F.col("root") == F.col("_i"), "left").select("id", "root", F.coalesce("_r", "root").alias("grand"))
        if not moved.where("root <> was").limit(1).count():
            return moved.select("id", "root")
        labels = fresh.checkpoint()


def linked_threads(messages: DataFrame) -> DataFrame:
    """(message_id, thread_id): messages that headers connect; the thread is named by its oldest message."""
    found = components(messages.select(F.col("message_id").alias("id")), header_edges(messages).select(F.col("message_id").alias("a"), F.col("parent").alias("b")))
    rows = messages.join(found, F.col("message_id") == F.col("id")).select("message_id", "date", "root")
    name = rows.groupBy("root").agg(F.min_by("message_id", moment()).alias("thread_id"))
    return rows.join(name, "root").select("message_id", "thread_id")


def subject_candidates(threads: DataFrame, messages: DataFrame, days: int = SUBJECT_DAYS, most: int = SUBJECT_CANDIDATES) -> DataFrame:
    """(message_id, thread_id): the thread of a message's subject and folder that it may join: of the ``most`` newest, the newest
    with a participant in common and not more than ``days`` away.

    ``threads`` has thread_id, norm_subject, folder, date_last and people (canonical addresses), ``messages`` norm_subject, folder, date and people.
    """
    # a subject's newest threads are the same for all its messages: ranked before the join, a message meets ``most`` rows
    newest = W.partitionBy("norm_subject", "folder").orderBy(F.col("date_last").desc(), "thread_id")
    few = threads.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= most)
    near = messages.select("message_id", "norm_subject", "folder", F.col("date").alias("_at"), F.col("people").alias("_who")).join(few, ["norm_subject", "folder"])
    apart = F.abs(F.unix_timestamp(F.col("_at").cast("timestamp")) - F.unix_timestamp(F.col("date_last").cast("timestamp")))
    fits = near.where(F.arrays_overlap("people", "_who") & (apart <= days * 86400))
    return fits.groupBy("message_id").agg(F.min_by("thread_id", "_place").alias("thread_id"))


def arrival_threads(messages: DataFrame) -> DataFrame:
    """(message_id, thread_id) by the ordered fold; ``arrival`` orders messages, ``addresses`` lists their people."""
    return arrival.arrival_threads(messages, SUBJECT_DAYS, SUBJECT_CANDIDATES)

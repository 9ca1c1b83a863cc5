"""Threads by order of arrival, in rounds over all messages instead of one task for each connected group.

A message joins the thread of its first ancestor that came before it; else, with a subject, the newest of the ten newest threads
of its subject and folder that shares a participant and lies within 60 days; else it begins a thread.  Threads never merge.

1. The first ancestor that came before is fixed by the table alone: pointers to it are followed by doubling to the first message of
   each tree.  A tree is in one thread, so only first messages choose, among threads of their own subject and folder.
2. Messages are dealt by range of (folder, subject, arrival) to blocks; a block is worked through in order, from what the blocks before it
   left: the ten newest threads, and the threads that its own messages add to.  A key of many messages has many blocks.
3. What blocks leave depends on the choices in them, so blocks are worked through again until no choice changes.  Keys within one block
   are right at once; others need as many rounds as choices hang on each other across blocks.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.functions.text import canonical_addr, normalize_subject
from threadloom.sources.shared import fresh_dir, removed, shared_dir

#: Messages of a block, about.
BLOCK_ROWS = 20_000
_ZERO = datetime(1970, 1, 1)


def first_ancestors(messages: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(message_id, parent): In-Reply-To, then References from the last, the first that is a message which came before.

    ``earlier``: (message_id) of messages that came before all of these.
    """
    none = F.array().cast("array<string>")
    named = F.concat(F.array("in_reply_to"), F.reverse(F.coalesce("references", none)))
    asked = messages.select("message_id", "arrival", F.posexplode(named).alias("at", "parent")).where("parent <> ''")
    known = messages.select(F.col("message_id").alias("parent"), F.col("arrival").cast("long").alias("came"))
    if earlier is not None:
        known = known.unionByName(earlier.select(F.col("message_id").alias("parent"), F.lit(None).cast("long").alias("came")))
    met = asked.join(known, "parent").where(F.col("came").isNull() | (F.struct("came", "parent") < F.struct(F.col("arrival").cast("long").alias("came"), F.col("message_id").alias("parent"))))
    return met.groupBy("message_id").agg(F.min_by("parent", "at").alias("parent"))


def tree_roots(messages: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(message_id, root): the first message of each message's tree, or the earlier one that it hangs on; each round doubles how far pointers reach."""
    shared_dir(messages.sparkSession)  # where checkpoint() writes
    reach = messages.select("message_id").join(first_ancestors(messages, earlier), "message_id", "left").select("message_id", F.coalesce("parent", "message_id").alias("root")).checkpoint()
    while True:
        up = reach.select(F.col("message_id").alias("root"), F.col("root").alias("higher"))
        further = reach.join(up, "root", "left").select("message_id", F.coalesce("higher", "root").alias("root"), (F.coalesce("higher", "root") != F.col("root")).alias("moved")).checkpoint()
        reach = further.drop("moved")
        if further.where("moved").isEmpty():
            return reach


def choose(rows: list[dict], start: list[dict], days: int, most: int) -> dict[str, str]:
    """For the first messages of one block, the thread that each joins, or itself where it begins one.

    ``rows``: the block's messages, owner being the thread of their tree's first message as last chosen; ``start``: threads before the block.
    """
    threads = {t["owner"]: [set(t["who"]), t["last"], (t["began"], t["owner"])] for t in start}
    newest = sorted((_ZERO - last, began, t) for t, (_, last, began) in threads.items())
    chosen: dict[str, str] = {}
    for m in sorted(rows, key=lambda m: (m["arrival"], m["message_id"])):
        people, mine = set(m["people"]), m["message_id"]
        if mine == m["root"]:
            near = (t for _, _, t in newest[:most] if people & threads[t][0] and abs(m["date"] - threads[t][1]) <= timedelta(days=days))
            chosen[mine] = next(near, mine) if m["norm_subject"] else mine
        owner = chosen.get(m["root"], m["owner"])
        held = threads.get(owner)
        if held is None:
            held = threads[owner] = [people, m["date"], (m["arrival"], mine)]
            bisect.insort(newest, (_ZERO - held[1], held[2], owner))
        elif m["date"] > held[1]:
            newest.pop(bisect.bisect_left(newest, (_ZERO - held[1], held[2], owner)))
            held[1] = m["date"]
            bisect.insort(newest, (_ZERO - held[1], held[2], owner))
        held[0] |= people
    return chosen


def _before(rows: DataFrame, most: int) -> DataFrame:
    """(folder, norm_subject, block, owner, last, who, began): threads as they stand before each block, as far as it may need them."""
    key = ["folder", "norm_subject"]
    began = rows.where("message_id = owner").select("owner", F.col("arrival").alias("began"))
    each = rows.groupBy(*key, "block", "owner").agg(F.max("date").alias("last"), F.flatten(F.collect_list("people")).alias("who"))
    so_far = W.partitionBy(*key, "owner").orderBy("block")
    upto = each.withColumns({"last": F.max("last").over(so_far), "who": F.array_distinct(F.flatten(F.collect_list("who").over(so_far)))}).join(began, "owner")
    # threads that a block adds to, as the last block before it left them
    earlier = W.partitionBy(*key, "owner").orderBy("block")
    own = upto.select(*key, "block", "owner", *[F.lag(c).over(earlier).alias(c) for c in ("last", "who")], "began").where("last IS NOT NULL")
    # the newest threads: of each earlier block the newest it added to, by how it left them
    newest = W.partitionBy(*key, "block").orderBy(F.col("last").desc(), "began", "owner")
    tops = upto.withColumn("_p", F.row_number().over(newest)).where(F.col("_p") <= most).groupBy(*key, "block").agg(F.collect_list(F.struct("owner", "last", "who", "began")).alias("tops"))
    blocks = rows.select(*key, "block").distinct().join(tops, [*key, "block"], "left")
    seen = blocks.withColumn("seen", F.flatten(F.collect_list("tops").over(W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)))).where(F.size("seen") > 0)
    rest = seen.select(*key, "block", F.inline("seen"))
    latest = rest.unionByName(own).groupBy(*key, "block", "owner").agg(F.max_by(F.struct("last", "who", "began"), "last").alias("s"))
    # both sides give a thread's state at its last block before this one: people only grow with it
    return latest.select(*key, "block", "owner", "s.last", "s.who", "s.began")


@dataclass(frozen=True)
class Known:
    """What earlier messages left: ``home`` (message_id, thread_id), and ``threads`` (thread_id, folder, norm_subject, people, last, began)."""

    home: DataFrame
    threads: DataFrame


def _order(messages: DataFrame) -> Column:
    """arrival as a long: of times and dates the microseconds, whatever the session's time zone; a message without one comes last."""
    kind, at = messages.schema["arrival"].dataType.typeName(), F.col("arrival")
    if kind == "timestamp":
        number = F.unix_micros(at)
    elif kind in ("timestamp_ntz", "date"):
        at = at.cast("timestamp_ntz")
        second = (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")
        number = ((F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)) * 60_000_000 + second
    else:
        number = at.cast("long")
    return F.coalesce(number, F.lit((1 << 63) - 1))


def _plain(messages: DataFrame) -> DataFrame:
    """Messages as the rounds take them: canonical people, no nulls, one row an id."""
    people = F.filter(F.transform("addresses", canonical_addr), lambda x: x != "")
    plain = messages.select(
        "message_id", F.coalesce("in_reply_to", F.lit("")).alias("in_reply_to"), "references", F.coalesce(normalize_subject(F.col("subject")), F.lit("")).alias("norm_subject"),
        F.coalesce("folder", F.lit("")).alias("folder"), F.coalesce(people, F.array().cast("array<string>")).alias("people"), F.col("date").cast("timestamp_ntz").alias("date"), _order(messages).alias("arrival"),
    )
    first = W.partitionBy("message_id").orderBy("arrival", "date")
    plain = plain.where("message_id IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    newest = plain.agg(F.max("date").alias("_newest"))  # one row
    return plain.crossJoin(F.broadcast(newest)).withColumn("date", F.coalesce("date", "_newest", F.lit("1970-01-01").cast("timestamp_ntz"))).drop("_newest")


def assign(messages: DataFrame, days: int, most: int, block_rows: int = BLOCK_ROWS, known: Known | None = None) -> tuple[DataFrame, DataFrame]:
    """(message_id, thread_id) of the messages that ``known`` has not, and the rows (.., owner, people, date, arrival) that its threads grow by.

    ``messages`` has message_id, in_reply_to, references, subject, folder, addresses, date and arrival (a number, a time or a date); with ``known``, all of them arrive after it.
    A message without a date has the newest date of all; of rows of one id the first to arrive counts; null subjects are empty, and a null id is left out.
    """
    spark = messages.sparkSession
    shared_dir(spark)
    plain = _plain(messages)
    if known is not None:
        plain = plain.join(known.home.select("message_id"), "message_id", "left_anti")
    plain = plain.checkpoint()
    roots = tree_roots(plain, None if known is None else known.home)
    # the subject and folder of a message are those of its tree's first one
    heads = plain.select(F.col("message_id").alias("root"), F.col("norm_subject").alias("_s"), F.col("folder").alias("_f"), F.lit(None).cast("string").alias("fixed"))
    if known is not None:
        hung = roots.join(known.home.select(F.col("message_id").alias("root"), F.col("thread_id").alias("fixed")), "root").select("root", "fixed").distinct()
        of = known.threads.select(F.col("thread_id").alias("fixed"), F.col("norm_subject").alias("_s"), F.col("folder").alias("_f"))
        heads = heads.unionByName(hung.join(of, "fixed").select(*heads.columns))
    rows = plain.drop("in_reply_to", "references").join(roots, "message_id").join(heads, "root").withColumns({"norm_subject": F.col("_s"), "folder": F.col("_f")}).drop("_s", "_f")
    n = plain.count()
    dealt = rows.repartitionByRange(n // block_rows + 1, "folder", "norm_subject", "arrival", "message_id").withColumn("block", F.spark_partition_id())
    scratch = fresh_dir(spark, "arrival")
    dealt.write.parquet(scratch)
    rows = spark.read.schema(dealt.schema).parquet(scratch)
    key = ["folder", "norm_subject", "block"]
    old = None
    if known is not None:
        # threads of the same subjects as rows of a block before all others
        mine = rows.select("folder", "norm_subject").distinct()
        old = known.threads.join(mine, ["folder", "norm_subject"]).select(
            F.col("thread_id").alias("message_id"), "folder", "norm_subject", "people", F.col("last").alias("date"), F.col("began").alias("arrival"), F.lit(-1).alias("block"), F.col("thread_id").alias("owner"),
        ).checkpoint()

    def worked(some: pa.Table, start: pa.Table) -> pa.Table:
        chosen = choose(some.to_pylist(), start.to_pylist(), days, most)
        return pa.table({"root": pa.array(chosen.keys(), pa.string()), "owner": pa.array(chosen.values(), pa.string())})

    fixed = rows.where("fixed IS NOT NULL").select("root", F.col("fixed").alias("owner")).distinct()
    owners = rows.where("message_id = root").select("root", F.col("root").alias("owner")).checkpoint()
    while True:
        held = rows.drop("fixed").join(owners.unionByName(fixed), "root").checkpoint()
        seen = held.drop("root") if old is None else held.drop("root").unionByName(old)
        before = _before(seen, most).select(*[F.col(c).alias(f"at_{c}") for c in key], "owner", "last", "who", "began")
        made = held.groupBy(*key).cogroup(before.groupBy(*[f"at_{c}" for c in key])).applyInArrow(worked, "root string, owner string").checkpoint()
        # a thread that was joined may have been begun by a message that joins another one now: the next round sees that
        settled = made.join(owners.select("root", F.col("owner").alias("was")), "root").where("owner <> was").isEmpty()
        owners = made
        if settled:
            removed(spark, scratch)  # ``held`` is a checkpoint
            return held.select("message_id", F.col("owner").alias("thread_id")), held


def arrival_threads(messages: DataFrame, days: int, most: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(message_id, thread_id) of all messages; see :func:`assign`."""
    return assign(messages, days, most, block_rows)[0]


def grown(threads: DataFrame | None, rows: DataFrame) -> DataFrame:
    """(thread_id, folder, norm_subject, people, last, began) of the threads that ``rows`` add to, on top of what ``threads`` says of them."""
    more = rows.groupBy(F.col("owner").alias("thread_id")).agg(
        F.first("folder").alias("folder"), F.first("norm_subject").alias("norm_subject"), F.array_distinct(F.flatten(F.collect_list("people"))).alias("people"), F.max("date").alias("last"), F.min("arrival").alias("began"),
    )
    if threads is None:
        return more
    had = threads.select("thread_id", F.col("people").alias("_p"), F.col("last").alias("_l"), F.col("began").alias("_b"))
    none = F.array().cast("array<string>")
    both = more.join(had, "thread_id", "left")
    return both.select("thread_id", "folder", "norm_subject", F.array_union(F.coalesce("_p", none), "people").alias("people"), F.greatest("last", "_l").alias("last"), F.coalesce("_b", "began").alias("began"))


def thread_stream(messages: DataFrame, target: str, checkpoint: str, days: int, most: int, block_rows: int = BLOCK_ROWS) -> StreamingQuery:
    """Threads a stream of messages as it comes: appends ``home`` and the states of ``threads`` that grew below ``target``, a folder a batch.

    Messages of a batch arrive after those of all batches before it (``arrival`` goes on).  A batch that is run again after a restart meets
    earlier batches alone and writes its folders anew, so the result is that of one batch over all messages.
    """
    spark = messages.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def before(number: int) -> Known | None:
        if number == 0 or not files.exists(hadoop(f"{target}/home")):
            return None
        home = spark.read.schema("message_id string, thread_id string, batch long").parquet(f"{target}/home").where(F.col("batch") < number).select("message_id", "thread_id")
        states = "thread_id string, folder string, norm_subject string, people array<string>, last timestamp_ntz, began long, batch long"
        rows = spark.read.schema(states).parquet(f"{target}/threads").where(F.col("batch") < number)
        latest = rows.groupBy("thread_id").agg(F.max_by(F.struct("folder", "norm_subject", "people", "last", "began"), "batch").alias("s")).select("thread_id", "s.*")
        return Known(home, latest)

    def store(batch: DataFrame, number: int) -> None:
        known = before(number)
        found, rows = assign(batch, days, most, block_rows, known)
        grown(None if known is None else known.threads, rows).write.mode("overwrite").parquet(f"{target}/threads/batch={number}")
        found.write.mode("overwrite").parquet(f"{target}/home/batch={number}")

    return messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Sharding by fixed virtual slots.

A record's virtual slot is a hash of its doc_id and text modulo ``slots`` (thousands, fixed for
the life of a corpus).  Bytes and rows are aggregated per slot, and a slot map says which shard
each slot lies in.  A map is built from the slots' bytes, largest first, each into the shard with
the fewest bytes so far; so shards differ by about their smallest slots, unless one record alone
is larger than a fair share.  Maps are stored by version; :func:`edit_map` makes the next one when
data has grown or the number of shards changes, and moves as few bytes as it can: with one more
shard, slots move only into that one.

Only DataFrame functions touch records.  What reaches the driver is the map: a row for each slot,
whatever the number of records.  ``slot`` of a record is its place in its shard, from 0 without
gaps: rows before its virtual slot in that shard, rows of that slot in partitions before, and its
place among the rows of slot and partition.  So no task orders a whole shard, and rows that are all
alike are still numbered in many tasks.

Defined results: a null text has no bytes (size 1) and checksum 0; a null doc_id is a value like
others; rows alike in doc_id and text share a virtual slot and are rows of their own in it; other
columns are left out by :func:`place_documents` and pass through :func:`with_shard`; an empty table
gives no rows and a map that deals slots in turn.  Equal texts have no part in this law: as copies
may be a third of all rows, holding them together would leave shards unequal.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm._common import Scratch, free_names

SHARDS, SLOTS = 16, 4096


@dataclass(frozen=True)
class SlotMap:
    """version, and for each virtual slot its shard, bytes and rows."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    size_of: tuple[int, ...]
    rows_of: tuple[int, ...]

    def loads(self) -> list[int]:
        found = [0] * self.shards
        for shard, size in zip(self.shard_of, self.size_of, strict=True):
            found[shard] += size
        return found

    def frame(self, spark: SparkSession) -> DataFrame:
        """(virtual_slot, shard, bytes, rows, first): first counts the shard's rows in slots before."""
        first, seen = [], [0] * self.shards
        for shard, rows in zip(self.shard_of, self.rows_of, strict=True):
            first.append(seen[shard])
            seen[shard] += rows
        text = ",".join(f"{a}:{b}:{c}:{d}" for a, b, c, d in zip(self.shard_of, self.size_of, self.rows_of, first, strict=True))
        rows = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("virtual_slot", "held"))
        held = F.split("held", ":")
        return rows.select("virtual_slot", held[0].cast("int").alias("shard"), *[held[i].cast("long").alias(n) for i, n in ((1, "bytes"), (2, "rows"), (3, "first"))])


def virtual_slot(slots: int = SLOTS) -> Column:
    """The slot of a record; a pure function of its doc_id and text."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(slots)).cast("int")


def slot_sizes(placed: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot from rows (virtual_slot, size)."""
    sizes, rows = [0] * slots, [0] * slots
    for r in placed.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # at most one row a slot
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return sizes, rows


def build_map(sizes: list[int], rows: list[int], shards: int = SHARDS) -> SlotMap:
    """The first version: slots from large to small, each into the shard with the fewest bytes (then rows, then number)."""
    shard_of = [0] * len(sizes)
    heap = [(0, 0, s) for s in range(shards)]
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held, count, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (held + sizes[slot], count + 1, shard))
    return SlotMap(1, shards, tuple(shard_of), tuple(sizes), tuple(rows))


def edit_map(old: SlotMap, sizes: list[int], rows: list[int], shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
    """The next version for slots of ``sizes`` and ``rows``; slots stay where they are unless a shard is closed or too full.

    Slots of closed shards go first, large ones first, to the emptiest shard.  Then shards more than
    ``tolerance`` above the fair share give slots to the emptiest one, the largest that does not lift it
    above the share; a shard whose slots are all too large for that keeps them.
    """
    shards = shards or old.shards
    shard_of, loads = list(old.shard_of), [0] * shards
    slots_in: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            loads[shard] += sizes[slot]
            slots_in[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda i: (-sizes[i], i)):
        shard = min(range(shards), key=lambda s: (loads[s], s))
        shard_of[slot] = shard
        loads[shard] += sizes[slot]
        slots_in[shard].append(slot)
    fair = sum(sizes) / shards
    growing = range(old.shards, shards)
    for held in slots_in:
        held.sort(key=lambda i: (-sizes[i], i))
    stuck: set[int] = set()
    while True:
        over = [s for s in range(shards) if s not in stuck and s not in growing and loads[s] > fair * (1 + tolerance)]
        if growing and min(loads[s] for s in growing) < fair * (1 - tolerance):
            over = over or [s for s in range(old.shards) if s not in stuck and loads[s] > fair]
        if not over:
            break
        giver = max(over, key=lambda s: (loads[s], -s))
        taker = min(growing or range(shards), key=lambda s: (loads[s], s))
        spare = min(fair * (1 + tolerance / 2) - loads[taker], loads[giver] - fair * (1 - tolerance / 2))
        slot = next((i for i in slots_in[giver] if 0 < sizes[i] <= spare), None)
        if slot is None:
            stuck.add(giver)
            continue
        shard_of[slot] = taker
        slots_in[giver].remove(slot)
        slots_in[taker].append(slot)
        loads[giver] -= sizes[slot]
        loads[taker] += sizes[slot]
    return SlotMap(old.version + 1, shards, tuple(shard_of), tuple(sizes), tuple(rows))


class MapStore:
    """Slot maps below a folder that driver and executors share, one sub-folder a version.

    A version is written once; a second writer of the same version fails, so two edits of one
    version cannot both hold.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, found: SlotMap) -> SlotMap:
        frame = found.frame(self.spark).withColumn("shards", F.lit(found.shards)).coalesce(1)
        frame.write.mode("errorifexists").parquet(f"{self.path}/version={found.version}")
        return found

    def versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        done = [n for n in names if n.startswith("version=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def read(self, version: int | None = None) -> SlotMap:
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.parquet(f"{self.path}/version={version}").orderBy("virtual_slot").collect()  # one row a slot
        return SlotMap(version, rows[0]["shards"], *(tuple(r[n] for r in rows) for n in ("shard", "bytes", "rows")))


def with_shard(docs: DataFrame, held: SlotMap, name: str = "shard") -> DataFrame:
    """``docs`` with the shard of each record, as a lookup in the map; nothing is shuffled."""
    (slot,) = free_names(docs, "slot")
    shards = held.frame(docs.sparkSession).select(F.col("virtual_slot").alias(slot), F.col("shard").alias(name))
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    return docs.withColumn(slot, virtual_slot(len(held.shard_of))).select(*[F.col(f"`{c}`") for c in kept], slot).join(F.broadcast(shards), slot).drop(slot)


def write_shards(docs: DataFrame, held: SlotMap, path: str) -> None:
    """``docs`` as Parquet, one sub-folder a shard."""
    with_shard(docs, held).write.mode("errorifexists").partitionBy("shard").parquet(path)


def place_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, store: MapStore | None = None, version: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) of each row.

    ``store`` with versions: that map (``version`` or the latest) is kept to; else one is built from the bytes and saved.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col("text").cast("string")
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        virtual_slot(slots).alias("virtual_slot"),
        F.spark_partition_id().alias("part"),
    )
    placed = scratch.save(placed, "placed")
    sizes, rows = slot_sizes(placed, slots)
    store = store or MapStore(spark, scratch.path("map"))
    if store.versions():
        known = store.read(version)
        held = SlotMap(known.version, known.shards, known.shard_of, tuple(sizes), tuple(rows))
    else:
        held = store.save(build_map(sizes, rows, shards))
    cell = W.partitionBy("virtual_slot", "part")
    numbered = placed.withColumn("place", F.row_number().over(cell.orderBy("doc_id", "size", "text_crc32")))
    cells = placed.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
    before = cells.select("virtual_slot", "part", (F.sum("n").over(W.partitionBy("virtual_slot").orderBy("part")) - F.col("n")).alias("before"))
    found = numbered.join(before, ["virtual_slot", "part"]).join(F.broadcast(held.frame(spark)), "virtual_slot")
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(held.version).alias("map_version"),
    )

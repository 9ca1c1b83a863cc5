"""Alignment of two tokenizers' tokens over whole texts, by distinct segments.

Tokenizer A is a byte-level BPE with a pattern that splits words, B a SentencePiece BPE with byte fallback.  Both see
a space and the text.  Texts are cut before runs of white space where neither vocabulary can merge across: no entry of A
or B has a character that is not white space followed by the run's first one (and no piece of B has a space mark followed
by it), and A's pattern never takes white space after anything else into one word.  Which characters begin
a run so is read off the two vocabularies (:func:`safe_starts`).  The tokens of a text are then those of its segments, one
after the other, and at each segment's end tokens of both sides end.

1. Tasks cut blocks of texts and number the distinct segments of each block; texts become codes (``blocks``).
2. Segments are dealt by content and sorted, so equal ones are neighbours: each distinct one is tokenised and aligned
   once, and its alignment goes to each block that has it (``aligned``).  A segment has one row a block, so none is hot.
3. Id pairs are counted from distinct segments times their occurrences, less those in texts without tokens.  Counts come
   back to distinct segments by broadcast while they are few, else under a salt, as one pair may stand in a third of the segments.
4. Blocks meet their alignments and compose their documents.

Defined results: a null or empty text, and one whose joined token bytes on either side differ from space and text, has no
tokens, and its links count nowhere; null and repeated doc_ids are rows of their own; a text without white space is one
segment, of any length, as is a text of white space alone; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm._common import WHITE, Scratch, buckets_for, ids_and_text, prefix, release, slices, text_buffer

#: Bytes of text in a block, rows of segments handled at once, id pairs up to which their counts are broadcast, salts of hot pairs beyond, bytes of input in a bucket.
BLOCK_BYTES, STEP, BROADCAST_PAIRS, SALTS, BUCKET_BYTES = 16 << 20, 8192, 400_000, 16, 8 << 20

#: White space beyond ASCII (and the space mark), as UTF-8.
WIDE_WHITE = [chr(c) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x2581, 0x3000)]

MARK = chr(0x2581)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """The two tokenizers, the bytes of their entries and the characters before which texts may be cut."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # the special tokens' strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [b""] * size
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_bytes = []
        for i in range(len(self.b)):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.mark = self.b.piece_to_id(MARK)
        self.starts = safe_starts([*self.a_bytes, *self.b_bytes], self.b_bytes)

    def encode(self, segments: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for each segment, which begins with a space or another safe start."""
        texts = [s.decode("utf-8", "replace") for s in segments]
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        # B puts a space before what it is given: it stands for the segment's own one, or else is a piece of its own
        b = self.b.encode([t[1:] if t.startswith(" ") else t for t in texts], num_threads=1)
        for i, t in enumerate(texts):
            if not t.startswith(" "):
                b[i] = b[i][1:] if b[i] and b[i][0] == self.mark else []
            elif t == " ":
                b[i] = [self.mark]
        return a, b


def safe_starts(entries: list[bytes], pieces: list[bytes]) -> bytes:
    """ASCII white space that no entry has after a character that is not white space, nor a piece after a space (but the space)."""
    wide = tuple(w.encode() for w in WIDE_WHITE)
    bad = set()
    for entry in entries:
        for i in range(1, len(entry)):
            c = entry[i]
            if c < 128 and WHITE[c] and not WHITE[entry[i - 1]] and not entry[:i].endswith(wide):
                bad.add(c)
    for piece in pieces:
        for i in range(1, len(piece)):
            if piece[i - 1] == 32 and piece[i] != 32 and piece[i] < 128 and WHITE[piece[i]]:
                bad.add(piece[i])
    return bytes(c for c in range(128) if WHITE[c] and c not in bad)


@functools.lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pair(a_path, b_path)


def segment_starts(data: np.ndarray, edges: np.ndarray, starts: bytes) -> np.ndarray:
    """Where segments begin in ``data``, texts one after the other that begin at ``edges``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    safe = np.zeros(256, bool)
    safe[list(starts)] = True
    cut = safe[data]
    before = np.empty(n, bool)
    before[0] = True
    # white space or a control byte before: the run began there, or it may be white space to a tokenizer
    before[1:] = data[:-1] <= 32
    at = np.flatnonzero(cut & ~before)
    wide = at[data[at - 1] >= 128]
    gone = np.zeros(len(wide), bool)
    for w in WIDE_WHITE if len(wide) else ():
        tail = np.frombuffer(w.encode(), np.uint8)
        hit = wide >= len(tail)
        for j in range(len(tail)):
            hit &= data[wide - len(tail) + j] == tail[j]
        gone |= hit
    at = np.setdiff1d(at, wide[gone], assume_unique=True)
    return np.union1d(at, edges)


_BLOCK = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.binary()),
     ("segments", pa.list_(pa.struct([("segment", pa.binary()), ("n", pa.int32())]))), ("part", pa.int32())]
)
_BLOCK_SQL = "block long, doc_ids array<long>, counts array<int>, codes binary, segments array<struct<segment: binary, n: int>>, part int"

#: Values of part: a block's documents, and its segments.
DOCUMENTS, SEGMENTS = 0, 1


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes, small ones being frequent, as four planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def unpack_codes(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def cut_blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Two rows a block of texts: its documents with how many segments each has and their codes; the distinct segments, in order of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = _pair(a_path, b_path).starts
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=block_bytes):
                raw, offsets = text_buffer(part.column("text"))
                full = np.flatnonzero(np.diff(offsets) > 0)
                edges = offsets[full] + np.arange(len(full))  # after a space has come before each text that is not empty
                data = np.insert(raw, offsets[full], 32)
                begins = segment_starts(data, edges, starts)
                packed = np.append(begins, len(data)).astype(np.int32) if len(begins) else np.zeros(1, np.int32)
                found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(packed), pa.py_buffer(data)]).dictionary_encode()
                codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                counts = np.zeros(len(part), np.int32)
                counts[full] = np.diff(np.searchsorted(begins, np.append(edges, len(data))))
                seen = np.bincount(codes, minlength=len(found.dictionary)).astype(np.int32)
                order = np.argsort(-seen, kind="stable")  # frequent segments have small codes
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                segments = pa.StructArray.from_arrays([found.dictionary.take(pa.array(order)), pa.array(seen[order])], names=["segment", "n"])
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                packed = pa.array([pack_codes(rank[codes])], pa.binary())
                nothing = [pa.nulls(1, f.type) for f in _BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([number]), one(part.column("doc_id")), one(pa.array(counts)), packed, nothing[4], pa.array([DOCUMENTS], pa.int32())], schema=_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([number]), *nothing[1:4], one(segments), pa.array([SEGMENTS], pa.int32())], schema=_BLOCK)
                number += 1

    return docs.mapInArrow(run, _BLOCK_SQL)


class Aligned:
    """Alignments of a list of distinct segments, as arrays; segments whose tokens do not give their bytes have none."""

    def __init__(self, pair: Pair, segments: list[bytes]):
        a, b = pair.encode(segments)
        self.ok = np.ones(len(segments), bool)
        whole = b"".join(segments)
        if any(b"".join([table[i] for ids in side for i in ids]) != whole for side, table in ((a, pair.a_bytes), (b, pair.b_bytes))):
            # some segment differs: find out which, as parts may fit together by chance
            for i, s in enumerate(segments):
                if b"".join(map(pair.a_bytes.__getitem__, a[i])) != s or b"".join(map(pair.b_bytes.__getitem__, b[i])) != s:
                    self.ok[i], a[i], b[i] = False, [], []
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a_ids, b_ids = (np.fromiter((i for ids in x for i in ids), np.int64) for x in (a, b))
        a_ends, b_ends = np.cumsum(pair.a_len[a_ids]), np.cumsum(pair.b_len[b_ids])
        a_common, b_common = _member(a_ends, b_ends), _member(b_ends, a_ends)
        self.links = a_ids[a_common] << 32 | b_ids[b_common]
        self.n_links = np.diff(prefix(a_common)[prefix(self.n_a)])
        self.groups = self._texts(a_ids, b_ids, a_common, b_common)

    def _texts(self, a_ids, b_ids, a_common, b_common) -> pa.Array:
        """Ids of each group of each segment, written out: every id with the sign behind it, in order."""
        a_group, b_group = np.cumsum(a_common) - a_common, np.cumsum(b_common) - b_common
        n_groups = int(a_common.sum())
        a_before, b_before = prefix(np.bincount(a_group, minlength=n_groups)), prefix(np.bincount(b_group, minlength=n_groups))
        place = np.concatenate([np.arange(len(a_ids)) + b_before[a_group], np.arange(len(b_ids)) + a_before[b_group + 1]])
        ids, signs = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
        ids[place] = np.concatenate([a_ids, b_ids])
        signs[place] = np.concatenate([np.where(a_common, ord("|"), ord(",")), np.where(b_common, ord(";"), ord(","))])
        digits = np.ones(len(ids), np.int64)
        for power in range(1, 10):
            digits += ids >= 10**power
        ends = np.cumsum(digits + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = signs
        rest = ids
        for k in range(int(digits.max(initial=0))):
            here = digits > k
            out[ends[here] - 2 - k] = 48 + rest[here] % 10
            rest = rest // 10
        # a segment's last sign is left out
        last = prefix(digits + 1)[prefix(self.n_a + self.n_b)]
        full = np.diff(last) > 0
        keep = np.ones(len(out), bool)
        keep[last[1:][full] - 1] = False
        offsets = last - prefix(full)
        return pa.Array.from_buffers(pa.string(), len(self.ok), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out[keep])])


def _member(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each of ascending values is among ascending others."""
    if not len(others):
        return np.zeros(len(values), bool)
    return others[np.minimum(np.searchsorted(others, values), len(others) - 1)] == values


_ALIGNED = pa.schema(
    [("block", pa.int64()), ("local", pa.int32()), ("sid", pa.int64()), ("n", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("n_links", pa.int32()),
     ("bad", pa.bool_()), ("groups", pa.string()), ("links", pa.list_(pa.int64()))]
)
_ALIGNED_SQL = "block long, local int, sid long, n long, n_a int, n_b int, n_links int, bad boolean, groups string, links array<long>"


def _distinct_rows(ids: np.ndarray, totals: np.ndarray, table: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of distinct segments: how often they occur, and their alignments."""
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(ids), pa.array(totals), *table.columns], schema=_ALIGNED)


def align_segments(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(block, local, sid) of rows (block, local, segment, n) that are sorted by segment within partitions, and a row without block for each distinct segment.

    sid numbers distinct segments; their own rows have how often they occur in all, their alignment, and their links, A's id in the upper 32 bits and B's in the lower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        sid = TaskContext.get().partitionId() << 40  # of the segment at hand
        last, known, total = None, None, 0  # that segment, its alignment, its occurrences so far
        for whole in batches:
            for part in slices(whole, "segment", BLOCK_BYTES):
                for at in range(0, len(part), STEP):
                    some = part.slice(at, STEP)
                    coded = some.column("segment").dictionary_encode()
                    segments, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                    seen = np.bincount(codes, some.column("n").to_numpy(), len(segments)).astype(np.int64)
                    old = last is not None and segments[0] == last
                    if last is not None and not old:
                        yield _distinct_rows(np.array([sid]), np.array([total]), known)
                        sid += 1
                    fresh = Aligned(pair, segments[1:] if old else segments)
                    edges = prefix(fresh.n_links).astype(np.int32)
                    links = pa.ListArray.from_arrays(pa.array(edges), pa.array(fresh.links))
                    table = pa.RecordBatch.from_arrays(
                        [pa.array(fresh.n_a, pa.int32()), pa.array(fresh.n_b, pa.int32()), pa.array(fresh.n_links, pa.int32()), pa.array(~fresh.ok), fresh.groups, links],
                        names=["n_a", "n_b", "n_links", "bad", "groups", "links"],
                    )
                    if old:
                        seen[0] += total
                        table = pa.Table.from_batches([known, table]).combine_chunks().to_batches()[0]
                    ids = np.arange(len(segments)) + sid
                    if len(segments) > 1:
                        yield _distinct_rows(ids[:-1], seen[:-1], table.slice(0, len(segments) - 1))
                    sid, total, last, known = int(ids[-1]), int(seen[-1]), segments[-1], table.slice(len(segments) - 1)
                    nothing = [pa.nulls(len(some), f.type) for f in _ALIGNED][3:]
                    yield pa.RecordBatch.from_arrays([some.column("block"), some.column("local"), pa.array(ids[codes]), *nothing], schema=_ALIGNED)
        if last is not None:
            yield _distinct_rows(np.array([sid]), np.array([total]), known)
        release()

    return rows.mapInArrow(run, _ALIGNED_SQL)


def _lost(blocks: DataFrame, bad: DataFrame) -> DataFrame:
    """(block, local, n): how often documents without tokens hold each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                codes = unpack_codes(row["codes"], int(counts.sum()))
                broken = np.zeros(int(codes.max(initial=0)) + 1, bool)
                broken[row["bad"]] = True
                docs = np.repeat(np.arange(len(counts)), counts)
                gone = np.zeros(len(counts), bool)
                gone[docs[broken[codes]]] = True
                local, n = np.unique(codes[gone[docs]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(local), row["block"])), pa.array(local, pa.int32()), pa.array(n, pa.int64())], names=["block", "local", "lost"])

    return blocks.select("block", "counts", "codes").join(bad, "block").mapInArrow(run, "block long, local int, lost long")


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())]
)
_RESULT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _compose(block: pa.Table, held: pa.Table) -> pa.Table:
    """The documents of one block from their codes and the block's alignments."""
    if not block.num_rows:
        return _RESULT.empty_table()
    row = block.select(["counts", "codes"]).to_pylist()[0]
    ids = block.column("doc_ids").combine_chunks().flatten()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    counts = np.array(row["counts"], np.int64)
    codes = unpack_codes(row["codes"], int(counts.sum()))
    held = held.sort_by("local")
    sides = held.column("sides").to_numpy()
    value = {"n_a": sides >> 32, "n_b": sides & 0xFFFFFFFF, "bad": pc.is_null(held.column("groups")).to_numpy().astype(np.int64)}
    value["n_links"] = pc.fill_null(pc.count_substring(held.column("groups"), "|"), 0).to_numpy().astype(np.int64)
    value |= {c: pc.fill_null(held.column(c), 0).to_numpy().astype(np.int64) for c in ("n_best", "count_sum")}
    ends = np.cumsum(counts)
    begins = ends - counts
    broken = prefix(value["bad"][codes])
    whole = (broken[ends] == broken[begins]) & (counts > 0)
    columns = []
    for name in ("n_a", "n_b", "n_links", "n_links", "n_best", "count_sum"):
        sums = prefix(value[name][codes])
        columns.append(pa.array(np.where(whole, sums[ends] - sums[begins], 0)))
    texts = held.column("groups").to_pylist()
    groups = [";".join([texts[c] for c in codes[i:j].tolist()]) if ok else "" for i, j, ok in zip(begins.tolist(), ends.tolist(), whole.tolist(), strict=True)]
    found = pa.Table.from_arrays([ids, *columns, pa.array(groups, pa.string())], schema=_RESULT)
    release()
    return found


#: Spark's setting that drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that write tables need their shuffle files no longer than they run."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row of ``docs`` (doc_id, text).

    groups: ids of A, a bar, ids of B between two common ends, such groups joined by semicolons.  A link is a token of A and
    one of B that end together; its count is how many links of all documents have its two ids; n_best
    counts links whose count is the highest of their B id; count_sum adds up the counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    cut = scratch.save(cut_blocks(ids_and_text(docs), a_path, b_path, block_bytes), "blocks", ["part"])
    blocks = cut.where(F.col("part") == DOCUMENTS).select("block", "doc_ids", "counts", "codes")
    each = cut.where(F.col("part") == SEGMENTS).select("block", F.posexplode("segments").alias("local", "held")).select("block", "local", "held.segment", "held.n")
    buckets = buckets_for(docs, BUCKET_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with dropping_shuffles(spark):
        found = scratch.save(align_segments(each.repartition(buckets, "segment").sortWithinPartitions("segment"), a_path, b_path), "aligned")
    scratch.drop(f"blocks/part={SEGMENTS}")
    aligned, distinct = found.where("block IS NOT NULL").select("block", "local", "sid"), found.where("block IS NULL")
    # links of all documents: occurrences of distinct segments, less those in documents without tokens
    bad = aligned.join(distinct.where("bad").select("sid"), "sid").groupBy("block").agg(F.collect_list("local").alias("bad"))
    lost = _lost(blocks, bad).join(aligned, ["block", "local"]).groupBy("sid").agg(F.sum("lost").alias("lost"))
    links = distinct.select("sid", "n", F.explode("links").alias("link"))
    gone = lost.join(distinct.select("sid", "links"), "sid").select((-F.col("lost")).alias("n"), F.explode("links").alias("link"))
    pairs = links.select("n", "link").union(gone).groupBy("link").agg(F.sum("n").alias("count"))
    with dropping_shuffles(spark):
        pairs = scratch.save(pairs.withColumn("b", F.col("link").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    counted = pairs.join(best, "b").select("link", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    if pairs.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(counted), "link")
    else:
        salted = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = links.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int")).join(salted, ["link", "salt"])
    worth = met.groupBy("sid").agg(F.sum("count").alias("count_sum"), F.sum("best").cast("int").alias("n_best"))
    sides = F.shiftleft(F.col("n_a").cast("long"), 32).bitwiseOR(F.col("n_b")).alias("sides")
    known = distinct.select("sid", sides, F.when(~F.col("bad"), F.col("groups")).alias("groups")).join(worth, "sid", "left")
    with dropping_shuffles(spark):
        priced = scratch.save(aligned.join(known, "sid").drop("sid"), "priced")
    scratch.drop("aligned")
    return blocks.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(_compose, _RESULT_SQL)

"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document is the set of its word shingles.  Two sets of sizes a and b with similarity of
at least 3/4 differ in at most (a + b) / 7 shingles, so of a set of n in at most n / 3.

Index.  Sizes fall into bands (u/2, u].  A band's universe is dealt by hash into m
segments, and a set's signatures are hashes of what it has in each segment; a set also
signs for the band below if it is within 4/3 of its top.  A set with N segments that are
not empty and at most H differences shares at least N - H signatures with each partner.

Elimination.  Signatures meet by bucket in packed form.  A set of which fewer than N - H
signatures occur in another set has no partner and goes; as a rule that leaves a few
percent, however many frequent passages the corpus has.

Allocation by cost.  For those that stay, each segment costs the number of sets that share
its signature.  A set takes the H + 1 cheapest; segments nobody shares are free.  A set
with N <= H has too few segments for that.  Its universe is cut finer: each of its shingles
is a segment, of which it takes the H + 1 cheapest, and it meets the other sets of that kind
there (a pair is found if one of the two has enough segments).  It also takes the one-deletion
neighbourhoods of its segments, two units of the pigeonhole each; as the single shingles let
such partners meet already, the neighbourhoods add no pair.

Verification is exact, on the shingles.  Each set is compared with the central member that
most of the groups it takes have, then with the central members of its other groups that
are not in its component yet.  A group whose members those links connect is done.  In the others the pairs that are not known to be connected are compared by parity
sketches, a lower bound on the difference, and what passes is verified.  Pairs inside a
known component are skipped: they cannot change components.  A group of more than
``GROUP_ROWS`` members is cut into parts, each two of which meet in a task of their own.

Sets, shingles and signatures are 64-bit (shingles 52-bit) hashes.  Defined results: texts
without words, or null, have the empty set and are alone; rows with equal doc_id are documents
of their own, each with the component of its own text; a null doc_id never names a component
unless all members are null; very long texts are taken whole, one at a time; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm._common import LOWER, Scratch, Words, buckets_for, free_names, ids_and_text, mix64, prefix, ragged, size_hint, slices, text_buffer
from threadloom.sources.shared import dropping_shuffles

WORDS = 5
_U = np.uint64
_MULTIPLIERS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]
_SEGMENT, _MEMBER, _WHOLE = _U(0x8CB92BA72F3D8DD7), _U(0x2545F4914F6CDD1D), _U(0x58C965F4A2B3D1E7)
_LOW40 = _U((1 << 40) - 1)
#: Rows of a slice: their number fits the 12 bits beside a 52-bit shingle.
SLICE_ROWS = 4096
#: Members of an open group that one task compares; larger groups are cut into parts.
GROUP_ROWS = 2048
#: Input that is looked through for the sets that stay at a time, at least, and most such slices: the texts cross the shuffle slice by slice.
TEXT_BYTES, TEXT_SLICES = 128 << 20, 8
#: Kinds of signatures: of segments, of single shingles, and of segments without one member; the last two for sets with too few segments.
_EXACT, _SINGLE, _WITHOUT = 0, 1, 2


def shingle_sets(text: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, one text after the other, and offsets (n + 1)."""
    data, offsets = text_buffer(text)
    n = len(offsets) - 1
    w = Words(LOWER[data], offsets)
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    value = mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, w.vocabulary.to_pylist()), np.uint64, len(w.vocabulary)))[w.codes]
    count = np.diff(w.first)
    multipliers = [_MULTIPLIERS[i % 5] + _U(2 * (i // 5)) for i in range(words)]
    rolled = np.zeros(len(value), np.uint64)
    for j, c in enumerate(multipliers):
        rolled[: len(value) - j] += value[j:] * c
    at = np.arange(len(value))
    whole = at + words <= w.first[1:][w.doc]
    few = (count > 0) & (count < words)
    keys = [(w.doc[whole].astype(np.uint64) << _U(52)) | (mix64(rolled[whole]) >> _U(12))]
    if few.any():
        heads = w.first[:-1][few]
        sums = np.zeros(len(heads), np.uint64)
        for j, c in enumerate(multipliers[:-1]):
            inside = j < count[few]
            sums[inside] += value[heads[inside] + j] * c
        sums += count[few].astype(np.uint64) * _WHOLE
        keys.append((np.flatnonzero(few).astype(np.uint64) << _U(52)) | (mix64(sums) >> _U(12)))
    key = np.unique(np.concatenate(keys))
    doc = (key >> _U(52)).astype(np.int64)
    return key & _U((1 << 52) - 1), prefix(np.bincount(doc, minlength=n))


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[_U(0)], np.cumsum(mix64(tokens + _WHOLE), dtype=np.uint64)])
    return mix64(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * _WHOLE)


def bands(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tops of the band of each size, and of the band below where the set signs for that too (else 0)."""
    top = np.ones(len(n), np.int64)
    big = n > 1
    top[big] = 1 << np.ceil(np.log2(n[big])).astype(np.int64)
    low = top // 2
    return top, np.where((n > 2) & (3 * n <= 4 * low), low, 0)


def limits(n: np.ndarray, top: np.ndarray, below: bool) -> np.ndarray:
    """Most differences between a set of n and a partner in the band: in its own, or in the one below with that top."""
    return (n + top) // 7 if below else n // 3


class Signatures:
    """Segment hashes of some sets in a band: slots (set, segment), with sums and counts of members."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, top: np.ndarray):
        """Sets with top 0 take no part."""
        n = np.diff(offsets)
        self.segments = np.where(top > 0, np.maximum(4, top // 2), 0)
        self.base = prefix(self.segments)
        takes = np.repeat(top > 0, n)
        self.tokens = tokens[takes]
        owner = np.repeat(np.arange(len(n)), n)[takes]
        m = self.segments[owner].astype(np.uint64)
        self.slot = self.base[owner] + (((mix64(self.tokens ^ _SEGMENT) >> _U(32)) * m) >> _U(32)).astype(np.int64)
        self.member = mix64(self.tokens + _MEMBER)
        total = int(self.base[-1])
        self.sums = np.zeros(total, np.uint64)
        np.add.at(self.sums, self.slot, self.member)
        self.counts = np.bincount(self.slot, minlength=total)
        self.owner = np.repeat(np.arange(len(n)), self.segments)
        within = np.arange(total) - self.base[self.owner]
        self.tag = mix64((top[self.owner].astype(np.uint64) << _U(32)) + within.astype(np.uint64))
        self.filled = np.bincount(self.owner, self.counts > 0, len(n)).astype(np.int64)

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """(set, signature) of the segments that are not empty."""
        pick = self.counts > 0
        return self.owner[pick], mix64(self.sums[pick] + self.tag[pick])

    def singles(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, signature) of each member of ``sets`` (a mask), a segment of its own."""
        pick = sets[self.owner[self.slot]]
        owner = self.owner[self.slot[pick]]
        return owner, mix64(self.member[pick] + self.tag[self.base[owner]])

    def deletions(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, signature) of each segment of ``sets`` (a mask) without one of its members, if others are left."""
        pick = sets[self.owner[self.slot]] & (self.counts[self.slot] > 1)
        slot = self.slot[pick]
        return self.owner[slot], mix64(self.sums[slot] - self.member[pick] + self.tag[slot])


def _parts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            yield from slices(batch.slice(at, SLICE_ROWS))


# ---- elimination -----------------------------------------------------------------------

_PACKED = "bucket int, doc_id long, set_id long, n int, filled int, filled_below int, signatures binary, owners binary"


def _pack(docs: DataFrame, buckets: int, words: int) -> DataFrame:
    """A row for each document, and rows of packed signatures for each slice and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            tokens, offsets = shingle_sets(part.column("text"), words)
            ids, n = set_ids(tokens, offsets), np.diff(offsets)
            top, low = bands(n)
            _, first = np.unique(ids, return_index=True)
            once = np.zeros(len(n), dtype=bool)
            once[first] = True
            once &= n > 2  # sets of one or two have no partner but themselves
            filled, owners, signs = [], [], []
            for level, tops in ((0, np.where(n > 2, top, 0)), (1, low)):
                got = Signatures(tokens, offsets, tops)
                filled.append(got.filled)
                owner, sign = got.exact()
                keep = once[owner]
                owners.append(owner[keep] * 2 + level)
                signs.append(sign[keep])
            owner, sign = np.concatenate(owners), np.concatenate(signs)
            bucket = (((sign >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            owner, sign, bucket = owner[order], sign[order] & _LOW40, bucket[order]
            short = np.ascontiguousarray(sign.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows_b, blobs, held = [], [], []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                a, z = edges[b], edges[b + 1]
                some, counts = np.unique(owner[a:z], return_counts=True)
                rows_b.append(b)
                blobs.append(short[a:z].tobytes())
                held.append(b"".join([np.uint32(len(some)).tobytes(), ids[some // 2].tobytes(), (some % 2).astype(np.uint8).tobytes(), counts.astype(np.uint32).tobytes()]))
            k = len(blobs)
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([(ids % _U(buckets)).astype(np.int32), np.array(rows_b, np.int32)])),
                    pa.concat_arrays([part.column("doc_id"), pa.nulls(k, pa.int64())]),
                    pa.concat_arrays([pa.array(ids.view(np.int64)), pa.nulls(k, pa.int64())]),
                    pa.concat_arrays([pa.array(n.astype(np.int32)), pa.nulls(k, pa.int32())]),
                    pa.concat_arrays([pa.array(filled[0].astype(np.int32)), pa.nulls(k, pa.int32())]),
                    pa.concat_arrays([pa.array(filled[1].astype(np.int32)), pa.nulls(k, pa.int32())]),
                    pa.concat_arrays([none, pa.array(blobs, pa.binary())]),
                    pa.concat_arrays([none, pa.array(held, pa.binary())]),
                ],
                names=[x.split()[0] for x in _PACKED.split(", ")],
            )

    return docs.mapInArrow(run, _PACKED)


_MET = "doc_id long, set_id long, n int, filled int, filled_below int, below int, shared int"


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: its document rows, and for each set and band how many of its signatures another set has."""
    rows = table.filter(pc.is_null(table["signatures"]))
    packed = table.filter(pc.is_valid(table["signatures"]))
    signs, sets, levels = [], [], []
    for blob, held in zip(packed["signatures"], packed["owners"], strict=True):
        raw = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        signs.append(wide.view("<u8").ravel())
        held = held.as_buffer()
        k = int(np.frombuffer(held, np.uint32, 1)[0])
        counts = np.frombuffer(held, np.uint32, k, 4 + 9 * k) if (4 + 9 * k) % 4 == 0 else np.frombuffer(bytes(held)[4 + 9 * k :], np.uint32, k)
        sets.append(np.repeat(np.frombuffer(bytes(held)[4 : 4 + 8 * k], np.uint64), counts))
        levels.append(np.repeat(np.frombuffer(held, np.uint8, k, 4 + 8 * k), counts))
    out = {"set_id": np.zeros(0, np.int64), "below": np.zeros(0, np.int32), "shared": np.zeros(0, np.int32)}
    if signs:
        sign, who, level = np.concatenate(signs), np.concatenate(sets), np.concatenate(levels)
        order = np.argsort(sign, kind="stable")
        sign, who, level = sign[order], who[order], level[order]
        starts = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
        lengths = np.diff(np.append(starts, len(sign)))
        mixed = np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)
        many = np.repeat(mixed, lengths)
        # a set met in several slices counts a signature once
        trio = np.stack([sign[many], who[many], level[many].astype(np.uint64)], axis=1)
        trio = trio[np.lexsort((trio[:, 2], trio[:, 1], trio[:, 0]))]
        if len(trio) > 1:
            trio = trio[np.concatenate([[True], (trio[1:] != trio[:-1]).any(axis=1)])]
        pair = trio[np.lexsort((trio[:, 2], trio[:, 1]))][:, 1:]
        if len(pair):
            heads = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1)]))
            out = {"set_id": np.ascontiguousarray(pair[heads, 0]).view(np.int64), "below": pair[heads, 1].astype(np.int32), "shared": np.diff(np.append(heads, len(pair))).astype(np.int32)}
    k = len(out["set_id"])
    names = ("n", "filled", "filled_below")
    first = {c: pa.concat_arrays([pa.array([], rows[c].type), *rows[c].chunks]) for c in ("doc_id", "set_id", *names)}
    return pa.table(
        {
            "doc_id": pa.concat_arrays([first["doc_id"], pa.nulls(k, pa.int64())]),
            "set_id": pa.concat_arrays([first["set_id"], pa.array(out["set_id"])]),
            **{c: pa.concat_arrays([first[c], pa.nulls(k, pa.int32())]) for c in names},
            "below": pa.concat_arrays([pa.nulls(len(rows), pa.int32()), pa.array(out["below"])]),
            "shared": pa.concat_arrays([pa.nulls(len(rows), pa.int32()), pa.array(out["shared"])]),
        }
    )


# ---- the sets that stay ----------------------------------------------------------------

_SETS = "set_id long, n int, tokens array<long>, signs array<struct<sign:long,below:boolean,kind:int,filled:int>>, sketch binary, sketch_below binary"


def _sketches(tokens: np.ndarray, offsets: np.ndarray, top: np.ndarray) -> list[bytes]:
    """Parities of the members' number in each of 256 to 16384 hash bins: differing bits bound the difference from below.

    With four bins for each member the bound comes within a tenth of the difference itself.
    """
    bits = np.clip(4 * top, 256, 16384)
    base = prefix(bits)
    owner = np.repeat(np.arange(len(top)), np.diff(offsets))
    at = base[owner] + ((mix64(tokens + _SEGMENT) >> _U(40)) % bits[owner].astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)
    packed = np.packbits(odd)
    return [packed[a // 8 : z // 8].tobytes() for a, z in zip(base.tolist(), base.tolist()[1:], strict=False)]


def _expand(texts: DataFrame, words: int) -> DataFrame:
    """Sets of texts (set_id, text) with all their signatures; filled: how many of a kind a set has in a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            tokens, offsets = shingle_sets(part.column("text"), words)
            ids, n = set_ids(tokens, offsets), np.diff(offsets)
            right = ids.view(np.int64) == part.column("set_id").to_numpy(zero_copy_only=False)
            top, low = bands(n)
            owners, signs, below, kinds, filled = [], [], [], [], []
            for level, tops in ((False, np.where(n > 2, top, 0)), (True, low)):
                got = Signatures(tokens, offsets, tops)
                poor = (tops > 0) & (got.filled <= limits(n, tops, level))
                found = [(*got.exact(), _EXACT)]
                if poor.any():
                    found += [(*got.singles(poor), _SINGLE), (*got.deletions(poor), _WITHOUT)]
                for owner, sign, kind in found:
                    owners.append(owner)
                    signs.append(mix64(sign + _U(kind) * _WHOLE) if kind else sign)
                    below.append(np.full(len(owner), level))
                    kinds.append(np.full(len(owner), kind, np.int32))
                    filled.append(np.bincount(owner, minlength=len(n))[owner].astype(np.int32))
            owner, sign, low_, kind, many = map(np.concatenate, (owners, signs, below, kinds, filled))
            order = np.argsort(owner, kind="stable")
            at = prefix(np.bincount(owner, minlength=len(n)))
            struct = pa.StructArray.from_arrays([pa.array(sign[order].view(np.int64)), pa.array(low_[order]), pa.array(kind[order]), pa.array(many[order])], names=["sign", "below", "kind", "filled"])
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids.view(np.int64)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), struct), pa.array(_sketches(tokens, offsets, top), pa.binary()), pa.array(_sketches(tokens, offsets, np.maximum(low, 1)), pa.binary()),
                ],
                names=["set_id", "n", "tokens", "signs", "sketch", "sketch_below"],
            )
            yield batch.filter(pa.array(right))

    return texts.mapInArrow(run, _SETS)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets have a similarity of at least 3/4, exactly."""
    left = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(100 * both >= 75 * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _open_pairs(table: pa.Table) -> pa.Table:
    """Pairs of one bucket of (parts of) groups that may link and are not known to be connected.

    A part's number is the same in all rows of a group that meets itself, and one of two in a group of two parts.
    """
    sign, ids, n, label, part, pair = (table[c].to_numpy() for c in ("sign", "set_id", "n", "label", "part", "pair"))
    probe = table["probe"].to_numpy()
    sketch = table["sketch"].to_pylist()
    order = np.lexsort((pair, sign))
    found = [np.zeros((0, 2), np.int64)]
    for group in np.split(order, np.flatnonzero((np.diff(sign[order]) != 0) | (np.diff(pair[order]) != 0)) + 1):
        size = len(sketch[group[0]])
        group = group[[len(sketch[i]) == size for i in group.tolist()]] if any(len(sketch[i]) != size for i in group.tolist()) else group
        bits = np.frombuffer(b"".join(sketch[i] for i in group.tolist()), np.uint64).reshape(len(group), -1)
        two = len(np.unique(part[group])) > 1
        for k in np.flatnonzero(probe[group]).tolist():
            i = group[k]
            a, b = np.minimum(n[i], n[group]), np.maximum(n[i], n[group])
            may = (label[group] != label[i]) & (4 * a >= 3 * b)
            some = np.flatnonzero(may & (part[group] != part[i]) if two else may)
            if len(some):
                apart = np.bitwise_count(bits[some] ^ bits[k]).sum(axis=1)
                near = ids[group[some[apart <= (n[i] + n[group[some]]) // 7]]]
                found.append(np.stack([np.minimum(near, ids[i]), np.maximum(near, ids[i])], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _in_parts(rows: DataFrame, buckets: int, most: int) -> DataFrame:
    """Rows of open groups (with their group's size) dealt so that each two parts of a group meet once."""
    parts = F.ceil(F.col("size") / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("part")).cast("long") * F.col("parts") + F.greatest(j, F.col("part")))
    dealt = rows.withColumn("parts", parts).withColumn("part", own).withColumn("pair", F.explode(others))
    return dealt.withColumn("bucket", F.pmod(F.xxhash64("sign", "pair"), F.lit(buckets)))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) that ``labels`` (node, label) do not put into one component."""
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels`` after ``links`` have joined components: only one edge for each pair of components is followed."""
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    links = scratch.save(links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct(), f"{name}-links")
    over = components(links, scratch, name)
    new = over.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    moved = labels.join(new, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    # nodes that had no label before are components of their own
    fresh = over.join(labels.select("node"), "node", "left_anti")
    return scratch.save(moved.union(fresh), f"{name}-labels")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the least node that ``edges`` (a, b) connect to each node that has an edge.

    Each round takes the least label among neighbours and then the label of the label; a
    round is a written table, so nothing depends on one executor.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        moved = lower.join(jump, F.col("low") == F.col("_n")).select("node", F.least("low", "_l").alias("label"), (F.least("low", "_l") != F.col("label")).alias("changed"))
        fresh = scratch.save(moved, f"{name}-{step + 1}")
        done = fresh.where("changed").limit(1).count() == 0
        labels, step = fresh.select("node", "label"), step + 1
        scratch.drop(f"{name}-{step - 1}")
        if done:
            return labels


def _staying_sets(base: DataFrame, stays: DataFrame, words: int, scratch: Scratch, cuts: int) -> DataFrame:
    """Sets of the texts of ``stays`` (set_id, _d), each once; ``cuts`` slices by a hash of doc_id are worked through one after the other."""
    parts = []
    for k in range(cuts):
        texts, some = (df.where(F.pmod(F.xxhash64(c), F.lit(cuts)) == k) if cuts > 1 else df for df, c in ((base, "doc_id"), (stays, "_d")))
        parts.append(_expand(texts.join(some, F.col("doc_id").eqNullSafe(F.col("_d"))).select("set_id", "text"), words))
    sets = scratch.save_parts(parts, "sets/all")
    # a set comes twice only from rows with equal doc_id
    if sets.groupBy("set_id").count().where("count > 1").limit(1).count():
        sets = scratch.save(sets.dropDuplicates(["set_id"]), "sets/once")
        scratch.drop("sets/all")
    return sets


def jaccard_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    with dropping_shuffles(docs.sparkSession):
        return _components_of(docs, words)


def _components_of(docs: DataFrame, words: int) -> DataFrame:
    spark = docs.sparkSession
    base = ids_and_text(docs)
    scratch = Scratch(spark, "ngram-join")
    buckets = buckets_for(docs, 8 << 20, least=64)
    met = scratch.save(_pack(base, buckets, words).groupBy("bucket").applyInArrow(lambda t: _meet(t), _MET), "met")
    rows = met.where("n IS NOT NULL").select("doc_id", "set_id", "n", "filled", "filled_below")
    nodes = scratch.save(rows.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("filled").alias("filled"), F.first("filled_below").alias("filled_below")).where("n > 0"), "nodes")

    # a set stays if, in a band, all but H of its signatures are shared, or it has no more than H
    shared = met.where("shared IS NOT NULL").groupBy("set_id").agg(
        F.coalesce(F.sum(F.when(F.col("below") == 0, F.col("shared"))), F.lit(0)).alias("own"), F.coalesce(F.sum(F.when(F.col("below") == 1, F.col("shared"))), F.lit(0)).alias("under")
    )
    low_top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))) - 1).cast("long")
    limit, limit_low = F.floor(F.col("n") / 3), F.floor((F.col("n") + low_top) / 7)
    stays = nodes.where("n > 2").join(shared, "set_id", "left").where(
        (F.coalesce("own", F.lit(0)) >= F.col("filled") - limit) | ((F.col("filled_below") > 0) & (F.coalesce("under", F.lit(0)) >= F.col("filled_below") - limit_low))
    )
    stays = scratch.save(stays.select("set_id", F.col("least").alias("_d")), "stays")
    rows = scratch.save(rows.select("doc_id", "set_id", "n"), "rows")
    scratch.drop("met")
    sets = _staying_sets(base, stays, words, scratch, min(TEXT_SLICES, size_hint(docs) // TEXT_BYTES + 1))

    # groups of the sets that stay
    signs = sets.select("set_id", "n", F.explode("signs").alias("s")).select("set_id", "n", "s.sign", "s.below", "s.kind", "s.filled")
    counts = signs.groupBy("sign").agg(F.count(F.lit(1)).alias("cost")).where("cost > 1")
    members = signs.join(counts, "sign")
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))).cast("long")
    most = F.when(F.col("below"), F.floor((F.col("n") + top / 2) / 7)).otherwise(F.floor(F.col("n") / 3))
    own = W.partitionBy("set_id", "below", "kind")
    # units to buy: H + 1, less the segments that nobody shares; neighbourhoods are taken whole
    members = members.withColumn("alone", F.col("filled") - F.count(F.lit(1)).over(own)).withColumn("place", F.row_number().over(own.orderBy("cost", "sign")))
    members = scratch.save(members.withColumn("probe", (F.col("kind") == _WITHOUT) | (F.col("place") <= most + 1 - F.col("alone"))).withColumn("central", 1 - F.col("alone") / F.col("filled")), "members")
    # a group none of whose members takes it needs no look
    heads = members.groupBy("sign").agg(F.max("probe").alias("taken"), F.max_by("set_id", F.struct("central", "set_id")).alias("head")).where("taken")
    heads = scratch.save(heads.select("sign", "head"), "heads")
    star = members.where("probe").select("sign", "set_id").join(heads, "sign").where("set_id <> head").groupBy(F.col("set_id").alias("a"), F.col("head").alias("b")).agg(F.count(F.lit(1)).alias("often"))
    sizes = sets.select("set_id", "n")
    star = star.join(sizes.select(F.col("set_id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("set_id").alias("b"), F.col("n").alias("nb")), "b")
    star = star.where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
    star = scratch.save(star.select("a", "b", F.row_number().over(W.partitionBy("a").orderBy(F.col("often").desc(), "b")).alias("turn")), "star")
    # first the head that a set meets most often, then those of other components
    labels = components(_verified(star.where("turn = 1").select("a", "b"), sets), scratch, "first")
    labels = _merged(labels, _verified(_apart(star.where("turn > 1").select("a", "b"), labels), sets), scratch, "second")
    scratch.drop("star")

    # groups whose members those links do not connect are open
    known = labels.select(F.col("node").alias("_id"), F.col("label").alias("_label"))
    labelled = members.join(heads, "sign").join(known, F.col("set_id") == F.col("_id"), "left").withColumn("label", F.coalesce("_label", "set_id"))
    labelled = scratch.save(labelled.select("sign", "set_id", "below", "label", "probe"), "labelled")
    scratch.drop("members")
    scratch.drop("heads")
    split = labelled.groupBy("sign").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("probe").alias("p"), F.count(F.lit(1)).alias("size")).where("x <> y AND p").select("sign", "size")
    rest = labelled.join(split, "sign").join(sets.select("set_id", "n", "sketch", "sketch_below"), "set_id")
    rest = rest.select("sign", "size", "set_id", "n", "label", "probe", F.when(F.col("below"), F.col("sketch_below")).otherwise(F.col("sketch")).alias("sketch"))
    pairs = _in_parts(rest, 4 * buckets, GROUP_ROWS).groupBy("bucket").applyInArrow(lambda t: _open_pairs(t), "a long, b long").distinct()
    pairs = scratch.save(pairs, "pairs")
    scratch.drop("labelled")
    labels = _merged(labels, _verified(pairs, sets), scratch, "third")
    scratch.drop("sets")
    named = nodes.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(least, "label").select(F.col("set_id").alias("_s"), "component")
    out = rows.join(named, F.col("set_id") == F.col("_s"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each component; rows without doc_id stay."""
    (gone_id,) = free_names(docs, "gone")
    gone = jaccard_components(docs, words).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")

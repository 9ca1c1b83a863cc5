"""Exact substring dedup: bytes covered by a string of ``width`` bytes that also starts earlier.

Cutting into shards.  Each window of ``width`` bytes is owned by its minimizer, the k-gram
in it with the least hash, which depends on the window's bytes alone: equal windows have
equal minimizers.  Neighbouring windows with one minimizer are a run; a run's windows and
what it shares go to the bucket of its minimizer, so windows of different buckets differ.

Collapsing.  Runs with the same bytes are first reduced to their earliest occurrence, in
each map task and then in the bucket: all windows of the later ones also start earlier.
What a third of all documents repeat costs one entry for each map task.  A minimizer whose
runs all have the same bytes is done; most have one run only.

Sorting.  The bytes of the runs that are left (different runs with one minimizer) are
fetched and stream into their shard in document order.  Windows whose 64-bit hash no other
window of the shard has start nowhere else, so they leave before the sorting; what is left
of the runs is collapsed as above, as long as that takes a tenth of the text away.  The
suffixes of what stays are put in order by external induced sorting
(:mod:`threadloom.llm._induced`): disk-backed priority queues carry suffixes and common prefixes.  Neighbours that share ``width`` bytes are a
class, of which all but the earliest are marked.  A shard may be larger than the memory.

Defined results: a null or empty text has no bytes and loses none; documents rank by
doc_id, null last; rows equal in doc_id and text are one document, rows with equal doc_id
and other texts are documents that rank by a hash; a text of more than ``PACK_BYTES`` is
hashed in pieces that overlap by a window; doc_id 2^63 - 1 stands for null inside and is
refused; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._common import Scratch, buckets_for, ids_and_text, mix64, prefix, ragged, release, slices, text_buffer
from threadloom.llm._induced import BLOCK, Room, later_windows
from threadloom.sources.shared import dropping_shuffles

WIDTH, GRAM = 100, 32
PACK_BYTES = 1 << 20  # text packed at once, of long ones a piece: its windows take some 100 times as much
CACHE_BYTES = 1 << 18  # text hashed at once, if not one document's: its arrays stay in the processor's cache
_U = np.uint64
_STEP, _UNSTEP = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_PLACE = 28  # bits of a position in a slice
_LAST = (1 << 63) - 1
_ENTRY = np.dtype([("mini", "<u8"), ("body", "<u8"), ("owner", "<u4"), ("pos", "<u4"), ("run", "u1")])
_OWNER = np.dtype([("doc", "<i8"), ("mark", "<u8")])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i : i + w] for each i."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    grid = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(doc, pos, run, minimizer, body) of the runs of windows: pos is in the text, body hashes the run's bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    power = np.full(len(data) + 1, _STEP, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(len(data) + 1, _UNSTEP, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    grams = mix64((sums[gram:] - sums[:-gram]) * back[: len(data) - gram + 1])
    keyed = ((grams >> _U(_PLACE)) << _U(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(keyed, width - gram + 1)
    at = (least & _U((1 << _PLACE) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.arange(len(at)) + width <= offsets[1:][doc]
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(head)
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    stop = np.minimum(np.append(start[1:], len(at)), offsets[1:][doc[start]] - width + 1)
    run = stop - start
    end = stop + width - 1
    body = mix64((sums[end] - sums[start]) * back[start] + mix64(run.astype(np.uint64)) + mix64((at[start] - start).astype(np.uint64) << _U(20)))
    return doc[start], start - offsets[doc[start]], run, grams[at[start]], body


def _runs_of(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """:func:`runs`, a few documents at a time."""
    found, a = [], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CACHE_BYTES, side="right")) - 1)
        doc, *rest = runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, gram)
        found.append((doc + a, *rest))
        a = b
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _marks(text: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(text)
    raw = memoryview(data.tobytes())
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offsets.tolist(), offsets.tolist()[1:], strict=False)], np.uint64)


def _first_of_equal(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """For rows in ``order``: whether a row's keys differ from those of the row before."""
    fresh = np.ones(len(order), dtype=bool)
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in keys:
        ranked = k[order]
        same &= ranked[1:] == ranked[:-1]
    fresh[1:] = ~same
    return fresh


_PACKED = "bucket int, entries binary, owners binary"
_FOUND = "doc_id long, mark long, need boolean, pos array<int>, run array<int>, mini array<long>"


def _pieces(text: pa.Array, width: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, place of the first byte): all texts at once, or one long text in pieces; each window is in one of them."""
    data, offsets = text_buffer(text)
    if len(offsets) > 2 or len(data) <= 2 * limit:
        yield data, offsets, 0
        return
    for start in range(0, max(1, len(data) - width + 1), limit):
        piece = data[start : start + limit + width - 1]
        yield piece, np.array([0, len(piece)]), start


def _blobs(doc: np.ndarray, pos: np.ndarray, length: np.ndarray, mini: np.ndarray, body: np.ndarray, ids: np.ndarray, marks: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs of one slice, packed by bucket."""
    order = np.lexsort((pos, marks[doc], ids[doc], body, mini))
    first = _first_of_equal([mini, body], order)
    # later ones are certain already; they travel with run 0 of a marker minimizer
    # low bits: a minimizer is a least hash, so its high bits are mostly 0
    bucket = (((mini & _U(0xFFFFFFFF)) * _U(buckets)) >> _U(32)).astype(np.int64)
    entry = np.zeros(len(doc), _ENTRY)
    entry["mini"], entry["body"], entry["owner"], entry["pos"], entry["run"] = mini, body, doc, pos, length
    sure = np.zeros(len(doc), dtype=bool)
    sure[order[~first]] = True
    entry["body"][sure] = 0
    entry["mini"][sure] = 0
    sort = np.lexsort((doc, bucket))
    entry, bucket = entry[sort], bucket[sort]
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    keys, blobs, owners = bucket[heads].tolist(), [], []
    edges = [*heads.tolist(), len(bucket)]
    for a, b in zip(edges, edges[1:], strict=False):
        some = entry[a:b].copy()
        who, some["owner"] = np.unique(some["owner"], return_inverse=True)
        held = np.zeros(len(who), _OWNER)
        held["doc"], held["mark"] = ids[who], marks[who]
        blobs.append(b"".join(some[c].tobytes() for c in _ENTRY.names))
        owners.append(held.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary()), pa.array(owners, pa.binary())], names=["bucket", "entries", "owners"])


def _pack(docs: DataFrame, buckets: int, width: int, gram: int, limit: int) -> DataFrame:
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=limit):
                marks = _marks(part.column("text"))
                ids = part.column("doc_id").fill_null(_LAST).to_numpy()
                for data, offsets, start in _pieces(part.column("text"), width, limit):
                    doc, pos, length, mini, body = _runs_of(data, offsets, width, gram)
                    yield _blobs(doc, pos + start, length, mini, body, ids, marks, buckets)

    return docs.mapInArrow(run_, _PACKED)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts, owners, shift = [], [], 0
    for blob, held in zip(table["entries"], table["owners"], strict=True):
        raw, at = bytes(blob.as_buffer()), 0
        got = np.zeros(len(raw) // _ENTRY.itemsize, _ENTRY)
        for c in _ENTRY.names:
            size = _ENTRY[c].itemsize * len(got)
            got[c] = np.frombuffer(raw[at : at + size], _ENTRY[c])
            at += size
        got["owner"] += shift
        who = np.frombuffer(bytes(held.as_buffer()), _OWNER)
        shift += len(who)
        parts.append(got)
        owners.append(who)
    return (np.concatenate(parts), np.concatenate(owners)) if parts else (np.zeros(0, _ENTRY), np.zeros(0, _OWNER))


def _rows(doc: np.ndarray, mark: np.ndarray, need: np.ndarray, pos: np.ndarray, run: np.ndarray, mini: np.ndarray) -> pa.Table:
    """One row for each document and kind."""
    order = np.lexsort((pos, need, mark, doc))
    doc, mark, need, pos, run, mini = (x[order] for x in (doc, mark, need, pos, run, mini))
    head = np.flatnonzero(_first_of_equal([doc, mark, need], np.arange(len(doc))))
    edges = pa.array(np.append(head, len(doc)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (pos.astype(np.int32), run.astype(np.int32), mini.view(np.int64))]
    return pa.table([pa.array(doc[head]), pa.array(mark[head].view(np.int64)), pa.array(need[head].astype(bool)), *lists], names=["doc_id", "mark", "need", "pos", "run", "mini"])


def _classify(table: pa.Table) -> pa.Table:
    """Of one bucket: runs that surely repeat, and earliest runs whose minimizer has other bytes too."""
    release()
    e, owners = _unpack(table)
    doc, mark = owners["doc"][e["owner"]], owners["mark"][e["owner"]]
    sure = (e["mini"] == 0) & (e["body"] == 0)
    order = np.lexsort((e["pos"], mark, doc, e["body"], e["mini"]))
    fresh = _first_of_equal([e["mini"], e["body"]], order)
    sure[order[~fresh]] = True
    firsts = order[fresh]
    firsts = firsts[~sure[firsts]]
    mini = e["mini"][firsts]
    mixed = np.zeros(len(firsts), dtype=bool)
    mixed[1:] |= mini[1:] == mini[:-1]
    mixed[:-1] |= mini[:-1] == mini[1:]
    pick = np.concatenate([np.flatnonzero(sure), firsts[mixed]])
    need = np.concatenate([np.zeros(int(sure.sum()), dtype=bool), np.ones(int(mixed.sum()), dtype=bool)])
    return _rows(doc[pick], mark[pick], need, e["pos"][pick], e["run"][pick], e["mini"][pick])


_RUN = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("pos", "<i8"), ("size", "<i8")])


def _room(folder: str) -> Room:
    """The shared folder if it is mounted here, else the folders where this executor spills."""
    path = folder.removeprefix("file://") if folder.startswith(("file:///", "/")) else folder.removeprefix("file:")
    if os.path.isdir(path):
        return Room(folder=path)
    return Room(folder=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


def substring_hashes(text: np.ndarray, place: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of text[p : p + size] for each place."""
    power, back = (np.full(len(text) + 1, x, np.uint64) for x in (_STEP, _UNSTEP))
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * power[:-1], out=sums[1:])
    return mix64((sums[place + size] - sums[place]) * back[place])


def met_again(hashes: np.ndarray, room: Room) -> np.ndarray:
    """Whether a hash stands at two places or more; those of one range at a time are sorted, so that they fit the room's memory."""
    again = room.array(len(hashes), np.bool_)
    ranges = max(1, -(-hashes.nbytes // room.memory))
    for k in range(ranges):
        if ranges == 1:
            some = np.sort(hashes)
        else:
            blocks = (np.asarray(hashes[a : a + BLOCK]) for a in range(0, len(hashes), BLOCK))
            some = np.sort(np.concatenate([b[b % _U(ranges) == k] for b in blocks]))
        twice = np.unique(some[1:][some[1:] == some[:-1]])
        if not len(twice):
            continue
        bits = max(16, int(8 * len(twice)).bit_length())
        may = np.zeros(1 << bits, dtype=bool)
        may[twice >> _U(64 - bits)] = True
        for a in range(0, len(hashes), BLOCK):
            block = np.asarray(hashes[a : a + BLOCK])
            maybe = np.flatnonzero(may[block >> _U(64 - bits)])
            found = np.minimum(np.searchsorted(twice, block[maybe]), len(twice) - 1)
            again[a + maybe[twice[found] == block[maybe]]] = True
    return again


def _stretches(place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number of places, owner) of neighbouring places with one owner."""
    head = np.ones(len(place), dtype=bool)
    head[1:] = (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    return place[first], np.diff(np.append(first, len(place))), owner[first]


class _Shard:
    """Runs of one shard in document order; what exceeds the room's memory is on disk."""

    def __init__(self, room: Room):
        self.room, self.last = room, None
        self.text, self.runs = (tempfile.SpooledTemporaryFile(room.memory, dir=room.folder) for _ in range(2))  # noqa: SIM115

    def add(self, batch: pa.RecordBatch) -> None:
        runs = np.empty(len(batch), _RUN)
        for c in ("doc", "mark", "pos"):
            runs[c] = batch.column("doc_id" if c == "doc" else c).to_numpy()
        fresh = np.ones(len(runs), dtype=bool)  # rows repeat where documents do
        same = np.ones(len(runs) - 1, dtype=bool)
        for c in ("doc", "mark", "pos"):
            same &= runs[c][1:] == runs[c][:-1]
        fresh[1:] = ~same
        last, self.last = self.last, tuple(runs[["doc", "mark", "pos"]][-1].tolist())
        fresh[0] = tuple(runs[["doc", "mark", "pos"]][0].tolist()) != last
        data, offsets = text_buffer(batch.column("body").filter(pa.array(fresh)))
        runs = runs[fresh]
        runs["size"] = np.diff(offsets)
        self._put(data + np.uint8(2), runs)  # UTF-8 has no byte above 244

    def _put(self, data: np.ndarray, runs: np.ndarray) -> None:
        """Symbols of some runs, one after the other; a separator goes behind each."""
        out = np.ones(len(data) + len(runs), np.uint8)
        out[np.arange(len(data)) + np.repeat(np.arange(len(runs)), runs["size"])] = data
        self.text.write(out.tobytes())
        self.runs.write(runs.tobytes())

    def _array(self, file: tempfile.SpooledTemporaryFile, dtype: np.dtype) -> np.ndarray:
        size = file.tell()
        file.seek(0)
        if size <= self.room.memory:
            return np.frombuffer(file.read(), dtype)
        file.rollover()
        file.flush()
        return np.memmap(file._file, dtype, "r", shape=(size // dtype.itemsize,))

    def _places(self, runs: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(runs, their starts in the text, starts of their windows, the windows' runs), block by block."""
        start = 0
        for a in range(0, len(runs), 1 << 12):
            some = np.array(runs[a : a + (1 << 12)])
            begin = start + prefix(some["size"] + 1)
            start = int(begin[-1])
            length = some["size"] - width + 1
            yield some, begin, ragged(begin[:-1], length), np.repeat(np.arange(len(some)), length)

    def shared(self, width: int) -> tuple[_Shard, list[pa.Table]]:
        """What is left of the runs without windows whose hash no other window has, and without later ones of equal stretches; the windows of these."""
        text, runs = self._array(self.text, np.dtype(np.uint8)), self._array(self.runs, _RUN)
        total = sum(int((runs["size"][a : a + BLOCK] - width + 1).sum()) for a in range(0, len(runs), BLOCK))
        hashes, at = self.room.array(total, np.uint64), 0
        for _, begin, place, _ in self._places(runs, width):
            hashes[at : at + len(place)] = substring_hashes(np.asarray(text[begin[0] : begin[-1]]), place - begin[0], width)
            at += len(place)
        again = met_again(hashes, self.room)
        left, sure, at, seen = _Shard(self.room), [], 0, np.zeros(0, np.uint64)
        for some, begin, place, owner in self._places(runs, width):
            keep = np.flatnonzero(again[at : at + len(place)])
            at += len(place)
            first, run, who = _stretches(place[keep], owner[keep])
            if not len(first):
                continue
            here = np.asarray(text[begin[0] : begin[-1]])
            rest = np.empty(len(first), _RUN)
            rest["doc"], rest["mark"], rest["pos"], rest["size"] = some["doc"][who], some["mark"][who], some["pos"][who] + first - begin[who], run + width - 1
            whole = substring_hashes(here, first - begin[0], rest["size"]) + mix64(rest["size"].view(np.uint64))
            fresh = np.zeros(len(rest), dtype=bool)
            fresh[np.unique(whole, return_index=True)[1]] = True
            fresh &= ~np.isin(whole, seen, kind="sort")
            # stretches that are not remembered any more go to the sorting, which tells them too
            seen = np.concatenate([seen, whole[fresh]])[-(self.room.memory >> 6) :]
            if not fresh.all():
                later = rest[~fresh]
                sure.append(_rows(later["doc"], later["mark"].view(np.uint64), np.zeros(len(later), dtype=bool), later["pos"], later["size"] - width + 1, np.zeros(len(later), np.uint64)))
            rest, first = rest[fresh], first[fresh]
            left.last = ()
            left._put(here[ragged(first - begin[0], rest["size"])], rest)
        return left, sure

    def repeats(self, width: int) -> Iterator[pa.Table]:
        """Windows that equal one of an earlier run or place, as runs."""
        shard, before = self, None
        while shard.last is not None and (before is None or 10 * shard.text.tell() < 9 * before):
            before = shard.text.tell()
            left, sure = shard.shared(width)
            shard.text.close()
            shard.runs.close()
            shard = left
            yield from sure
        release()
        yield from shard._sorted(width)

    def _sorted(self, width: int) -> Iterator[pa.Table]:
        if self.last is None:
            return
        self.text.write(b"\0")
        release()
        later = later_windows(self._array(self.text, np.dtype(np.uint8)), width, self.room)
        for some, begin, place, owner in self._places(self._array(self.runs, _RUN), width):
            keep = np.flatnonzero(later[place])
            first, run, who = _stretches(place[keep], owner[keep])
            if len(first):
                yield _rows(some["doc"][who], some["mark"][who].view(np.uint64), np.zeros(len(who), dtype=bool), some["pos"][who] + first - begin[who], run, np.zeros(len(who), np.uint64))


def _sort_shards(pieces: DataFrame, width: int, folder: str) -> DataFrame:
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, shard, number = _room(folder), None, None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                if a == b:
                    continue
                if numbers[a] != number:
                    if shard is not None:
                        for t in shard.repeats(width):
                            yield from t.to_batches()
                    shard, number = _Shard(room), numbers[a]
                shard.add(batch.slice(a, b - a))
        if shard is not None:
            for t in shard.repeats(width):
                yield from t.to_batches()

    unsigned = F.col("mark").bitwiseXOR(F.lit(-(1 << 63)))
    return pieces.repartition("shard").sortWithinPartitions("shard", "doc_id", unsigned, "pos").mapInArrow(run_, _FOUND)


def _own(found: pa.Array, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, *lists) of array<struct<mark, lists of one length>>: a place for each element of the structs with their row's mark."""
    counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    mark, *lists = found.flatten().flatten()
    row = np.repeat(np.arange(len(found)), counts)
    right = mark.to_numpy(zero_copy_only=False).view(np.uint64) == marks[row]
    each = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False) if len(mark) else np.zeros(0, np.int64)
    keep = np.repeat(right, each)
    return np.repeat(row, each)[keep], *(x.flatten().to_numpy(zero_copy_only=False)[keep] for x in lists)


def _fetch(rows: DataFrame, shards: int, width: int) -> DataFrame:
    """Bytes of the wanted runs of (text, wanted array<struct<mark,pos,run,mini>>)."""
    names = ["shard", "doc_id", "mark", "pos", "body"]

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                marks, ids = _marks(part.column("text")), part.column("doc_id").fill_null(_LAST).to_numpy()
                data, offsets = text_buffer(part.column("text"))
                doc, pos, run, mini = _own(part.column("wanted"), marks)
                for a in range(0, len(doc), 1 << 14):
                    d, p, size = doc[a : a + (1 << 14)], pos[a : a + (1 << 14)], run[a : a + (1 << 14)].astype(np.int64) + width - 1
                    shard = ((mini[a : a + len(d)].view(np.uint64) >> _U(20)) % _U(shards)).astype(np.int32)
                    body = data[ragged(offsets[d] + p, size)]
                    bodies = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(prefix(size).astype(np.int32)), pa.py_buffer(body)])
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids[d]), pa.array(marks[d].view(np.int64)), pa.array(p), bodies], names=names)

    return rows.mapInArrow(run_, "shard int, doc_id long, mark long, pos int, body binary")


def _cut(rows: DataFrame, width: int) -> DataFrame:
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_buffer(part.column("text"))
                n = len(part)
                doc, pos, run = _own(part.column("gone"), _marks(part.column("text")))
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, offsets[doc] + pos, 1)
                np.add.at(step, offsets[doc] + pos + run + width - 1, -1)
                covered = np.cumsum(step[:-1], dtype=np.int32) > 0
                edge = np.zeros(len(data) + 1, dtype=bool)  # a span ends with its document
                edge[offsets] = True
                head, tail = covered.copy(), covered.copy()
                head[1:] &= ~covered[:-1] | edge[1:-1]
                tail[:-1] &= ~covered[1:] | edge[1:-1]
                start, stop = np.flatnonzero(head), np.flatnonzero(tail) + 1
                owner = np.searchsorted(offsets, start, side="right") - 1
                n_spans = np.bincount(owner, minlength=n)
                removed = prefix(stop - start)[prefix(n_spans)]
                kept, at = memoryview(data[~covered]), (offsets - removed).tolist()
                shas = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                shown = [f"{x}-{y}" for x, y in zip((start - offsets[owner]).tolist(), (stop - offsets[owner]).tolist(), strict=True)]
                bounds, spans = prefix(n_spans).tolist(), [""] * n
                for d in np.flatnonzero(n_spans).tolist():
                    spans[d] = ",".join(shown[bounds[d] : bounds[d + 1]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(n_spans.astype(np.int64)), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
                )

    return rows.mapInArrow(run_, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of ``docs`` (doc_id, text).

    spans: "start-end" of each maximal removed run, in bytes, end exclusive, joined by commas.
    """
    with dropping_shuffles(docs.sparkSession):
        return _without_repeats(docs, width, gram)


def _without_repeats(docs: DataFrame, width: int, gram: int) -> DataFrame:
    refused = F.raise_error(F.lit(f"doc_id {_LAST} cannot be taken")).cast("long")
    base = ids_and_text(docs).withColumn("doc_id", F.when(F.col("doc_id") == _LAST, refused).otherwise(F.col("doc_id")))
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    buckets = buckets_for(docs, 4 << 20, least=64)
    found = scratch.save(_pack(base, buckets, width, gram, PACK_BYTES).groupBy("bucket").applyInArrow(lambda t: _classify(t), _FOUND), "found")
    real = F.when(F.col("doc_id") != _LAST, F.col("doc_id"))
    wanted = found.where("need").groupBy(real.alias("_d")).agg(F.collect_list(F.struct("mark", "pos", "run", "mini")).alias("wanted"))
    # a shard has the bytes of several buckets, as a sort of little text costs nearly as much as one of more
    pieces = _fetch(base.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "text", "wanted"), buckets // 4 + 1, width)
    sorted_ = scratch.save(_sort_shards(pieces, width, scratch.root.rsplit("/", 1)[0]), "sorted")
    gone = found.where("NOT need").select("doc_id", "mark", "pos", "run").union(sorted_.select("doc_id", "mark", "pos", "run"))
    gone = gone.groupBy(real.alias("_d")).agg(F.collect_list(F.struct("mark", "pos", "run")).alias("gone"))
    return _cut(base.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")), "left").select("doc_id", "text", "gone"), width)

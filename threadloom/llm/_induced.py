"""External induced sorting of suffixes with common-prefix values, in blocks of numpy arrays.

The scheme is that of induced sorting in external memory.  Suffixes are of type S (less than
the next suffix) or L; a star is an S suffix behind an L suffix.  Substrings between stars are
sorted by one round of induction and named; the string of names is sorted by recursion (in
memory once it is short).  From the sorted stars a first priority queue yields all L suffixes
in ascending order: the least tuple (first symbol, order of arrival) is taken out, and the
suffix one to the left, if it is L, goes in with its own first symbol.  A second queue yields
the S suffixes in descending order likewise.  A tuple carries the suffix and the prefix it has
in common with the tuple before it in its bucket: one symbol more than the least such value
among the sources in between.

Tuples come and go in blocks, as all tuples of a bucket that wait at one time are in order.
A queue holds ``memory`` bytes and writes the rest to an unnamed file of the task, which goes
with the task; texts and flags of more than ``memory`` bytes are files mapped into memory.
"""

from __future__ import annotations

import heapq
import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

_TUPLE = np.dtype([("pos", "<i8"), ("lcp", "u1")])
BLOCK = 1 << 18


class Room:
    """Where arrays live: in memory up to ``memory`` bytes each, else in unnamed files below ``folder``."""

    def __init__(self, memory: int = 64 << 20, folder: str | None = None, base: int = 1 << 21):
        """base: names that are sorted in memory at most."""
        self.memory, self.folder, self.base = memory, folder, base

    def file(self):
        return tempfile.TemporaryFile(dir=self.folder)

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.zeros(n, dtype)
        return np.memmap(self.file(), dtype, "w+", shape=(n,))


class DiskQueue:
    """Priority queue of blocks of tuples: by symbol, then by arrival; blocks beyond the memory are on disk."""

    def __init__(self, room: Room, sign: int = 1):
        """sign: 1 if the least symbol comes first, -1 if the greatest does."""
        self.room, self.sign = room, sign
        self.blocks: dict[int, deque] = {}
        self.heap: list[int] = []
        self.held, self.out, self.end = 0, None, 0

    def __contains__(self, symbol: int) -> bool:
        return symbol in self.blocks

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        block = np.empty(len(pos), _TUPLE)
        block["pos"], block["lcp"] = pos, lcp
        if symbol not in self.blocks:
            self.blocks[symbol] = deque()
            heapq.heappush(self.heap, self.sign * symbol)
        self.blocks[symbol].append(block)
        self.held += block.nbytes
        if self.held > self.room.memory:
            self._spill()

    def _spill(self) -> None:
        self.out = self.out or self.room.file()
        self.out.seek(self.end)
        for waiting in self.blocks.values():
            for i, block in enumerate(waiting):
                if isinstance(block, np.ndarray):
                    self.out.write(block.tobytes())
                    waiting[i] = (self.end, len(block))
                    self.end += block.nbytes
        self.held = 0

    def _load(self, block) -> np.ndarray:
        if isinstance(block, np.ndarray):
            self.held -= block.nbytes
            return block
        self.out.seek(block[0])
        return np.frombuffer(self.out.read(block[1] * _TUPLE.itemsize), _TUPLE)

    def symbol(self) -> int | None:
        """First symbol that has not been closed."""
        return self.sign * self.heap[0] if self.heap else None

    def close(self, symbol: int) -> None:
        if self.heap and self.heap[0] == self.sign * symbol:
            heapq.heappop(self.heap)
            del self.blocks[symbol]

    def take(self, symbol: int, last: bool = False) -> np.ndarray | None:
        """The next tuples of a symbol, a block or more; from the end, a block at a time, if ``last``."""
        waiting = self.blocks.get(symbol)
        if not waiting:
            return None
        if last:
            return self._load(waiting.pop())
        some = [self._load(waiting.popleft())]
        total = len(some[0])
        while waiting and total < BLOCK:
            some.append(self._load(waiting.popleft()))
            total += len(some[-1])
        return some[0] if len(some) == 1 else np.concatenate(some)


def _least_between(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """min(values[start:stop]) of each range, none of them empty."""
    length = stop - start
    level = np.frexp(length)[1] - 1
    out = np.empty(len(start), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[start[here]], table[stop[here] - (1 << k)])
        if (1 << k) < len(table):
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


class _Bucket:
    """Hands the suffixes left of one bucket's sources on to a queue, with their common prefixes."""

    def __init__(self, text: np.ndarray, queue: DiskQueue, symbol: int, cap: int):
        self.text, self.queue, self.symbol, self.cap = text, queue, symbol, cap
        self.since: dict[int, int] = {}  # least value behind the last source of each target

    def feed(self, pos: np.ndarray, lcp: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> None:
        left = self.text[np.maximum(pos - 1, 0)].astype(np.int64)
        keep = np.flatnonzero((pos > 0) & wanted(left))
        low = int(lcp.min())
        if not len(keep):
            self.since = {t: min(v, low) for t, v in self.since.items()}
            return
        target = left[keep]
        order = np.argsort(target, kind="stable")
        keep, target = keep[order], target[order]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        start = np.empty(len(keep), np.int64)
        start[1:] = keep[:-1] + 1
        start[heads] = 0
        value = _least_between(lcp, start, keep + 1).astype(np.int64)
        ends = np.append(heads[1:], len(keep))
        moved, after = {}, np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(self.cap))
        for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
            t = int(target[h])
            value[h] = min(int(value[h]), self.since.get(t, 0)) if t in self.queue else -1
            moved[t] = int(after[keep[e - 1] + 1])
        self.since = {t: min(v, low) for t, v in self.since.items()} | moved
        value = np.minimum(value + 1, self.cap).astype(np.uint8)
        where = pos[keep] - 1
        for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
            self.queue.push(int(target[h]), where[h:e], value[h:e])


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, done: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, added to ``done``, ``cap`` at most."""
    out = np.minimum(done, cap).astype(np.int64)
    live = np.flatnonzero(out < cap)
    step = 0
    while len(live):
        live = live[text[a[live] + step] == text[b[live] + step]]
        out[live] += 1
        step += 1
        live = live[out[live] < cap]
    return out


def _pair(text: np.ndarray, a: int, b: int, cap: int) -> int:
    return int(common_prefix(text, np.array([a]), np.array([b]), np.zeros(1, np.int64), cap)[0])


def _upward(text: np.ndarray, stars: DiskQueue, cap: int, room: Room) -> DiskQueue:
    """All L suffixes by symbol, ascending, from the stars."""
    queue, found = DiskQueue(room), DiskQueue(room, -1)
    while (c := min((q.symbol() for q in (queue, stars) if q.symbol() is not None), default=None)) is not None:
        bucket, last = _Bucket(text, queue, c, cap), None
        while (block := queue.take(c)) is not None:
            found.push(c, block["pos"], block["lcp"])
            last = int(block["pos"][-1])
            bucket.feed(block["pos"], block["lcp"], lambda left, c=c: left >= c)
        while (block := stars.take(c)) is not None:
            lcp = block["lcp"].copy()
            if last is not None:
                lcp[0], last = _pair(text, last, int(block["pos"][0]), cap), None
            bucket.feed(block["pos"], lcp, lambda left, c=c: left > c)
        queue.close(c)
        stars.close(c)
    return found


def _downward(text: np.ndarray, larger: DiskQueue, cap: int, room: Room) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(suffixes, common prefix with the one before, whether S) of all but the last suffix, descending."""
    queue = DiskQueue(room, -1)
    while (c := max((q.symbol() for q in (queue, larger) if q.symbol() is not None), default=None)) is not None:
        bucket, last = _Bucket(text, queue, c, cap), None
        while (block := queue.take(c)) is not None:
            bucket.feed(block["pos"], block["lcp"], lambda left, c=c: left <= c)
            yield block["pos"], block["lcp"], True
            last = int(block["pos"][-1])
        carried = None
        while (block := larger.take(c, last=True)) is not None:
            pos, lcp = block["pos"][::-1], np.empty(len(block), np.uint8)
            lcp[1:] = block["lcp"][:0:-1]
            lcp[0] = carried if carried is not None else 0 if last is None else _pair(text, last, int(pos[0]), cap)
            carried = block["lcp"][0]
            bucket.feed(pos, lcp, lambda left, c=c: left < c)
            yield pos, lcp, False
        queue.close(c)
        larger.close(c)


def _stars(text: np.ndarray, room: Room) -> np.ndarray:
    """Starts of the stars, ascending, the last symbol's included."""
    n = len(text)
    small = room.array(n, np.bool_)
    small[n - 1] = True
    at = n - 1
    while at > 0:  # from right to left; equal symbols take the type of the first other one
        low = max(0, at - BLOCK)
        here, after = text[low:at].astype(np.int64), text[low + 1 : at + 1].astype(np.int64)
        other = here != after
        place = np.where(other, np.arange(at - low), at - low)
        place = np.minimum.accumulate(place[::-1])[::-1]
        kinds = np.append(here < after, small[at])
        small[low:at] = kinds[place]
        at = low
    found = [np.flatnonzero(small[max(1, a) : a + BLOCK] & ~small[max(1, a) - 1 : min(a + BLOCK, n) - 1]) + max(1, a) for a in range(0, n, BLOCK)]
    out = room.array(sum(map(len, found)), np.int64)
    np.concatenate(found, out=out)
    return out


def _by_symbol(text: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None, room: Room) -> DiskQueue:
    """Stars as a queue; within a symbol they keep their order."""
    queue = DiskQueue(room)
    for a in range(0, len(pos), BLOCK):
        some = np.asarray(pos[a : a + BLOCK])
        symbol = text[some].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], symbol[order][1:] != symbol[order][:-1]]))
        value = np.zeros(len(some), np.uint8) if lcp is None else np.asarray(lcp[a : a + BLOCK])
        for h, e in zip(edges.tolist(), np.append(edges[1:], len(some)).tolist(), strict=True):
            queue.push(int(symbol[order[h]]), some[order[h:e]], value[order[h:e]])
    return queue


def _in_memory(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``cap`` names, and common prefixes, by doubling."""
    rank, size = names.astype(np.int64), 1
    while size < cap and int(rank.max()) + 1 < len(rank):
        other = np.zeros(len(rank), np.int64)
        other[:-size] = rank[size:] + 1
        _, rank = np.unique(rank * (int(other.max()) + 1) + other, return_inverse=True)
        size *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefix(names, order[:-1], order[1:], lcp[1:], cap)
    return order, lcp


def _sorted_stars(text: np.ndarray, stars: np.ndarray, cap: int, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Stars in ascending order, and the common prefix of each with the one before."""
    m = len(stars)
    order = room.array(m, np.int64)  # places in ``stars``
    at = m
    for pos, _, is_small in _downward(text, _upward(text, _by_symbol(text, stars, None, room), 1, room), 1, room):
        if is_small:
            place = np.searchsorted(stars, pos)
            place = place[(place < m) & (stars[np.minimum(place, m - 1)] == pos)]
            order[at - len(place) : at] = place[::-1]
            at -= len(place)
    order[0] = m - 1
    # names: equal substrings, from star to star inclusive, have one name
    names, name = room.array(m, np.int64), 0
    for a in range(0, m, BLOCK):
        here = np.asarray(order[a : a + BLOCK])
        before = np.asarray(order[max(a, 1) - 1 : a + len(here) - 1])
        later = here[len(here) - len(before) :]
        fresh = np.zeros(len(here), np.int64)
        if len(before):
            size = np.minimum(stars[np.minimum(later + 1, m - 1)] - stars[later], 1 << 40)
            same = np.flatnonzero((later < m - 1) & (before < m - 1))
            same = same[size[same] == stars[before[same] + 1] - stars[before[same]]]
            step, x, y = 0, stars[later], stars[before]
            changed = np.ones(len(before), np.int64)
            while len(same):
                same = same[text[x[same] + step] == text[y[same] + step]]
                changed[same[size[same] == step]] = 0
                same = same[size[same] > step]
                step += 1
            fresh[len(here) - len(before) :] = changed
        told = name + np.cumsum(fresh)
        names[here] = told
        name = int(told[-1])
    if name + 1 == m:
        shared = np.zeros(m, np.int64)
    elif m <= room.base:
        order, shared = _in_memory(np.asarray(names), cap)
    else:
        order, shared, at = room.array(m, np.int64), room.array(m, np.uint8), m
        for pos, lcp in suffixes(names, cap, room):
            order[at - len(pos) : at] = pos[::-1]
            # descending: the value of a suffix stands with the one before it, which is greater
            stop = min(at + 1, m)
            shared[at - len(pos) + 1 : stop] = lcp[::-1][: stop - (at - len(pos) + 1)]
            at -= len(pos)
        order[0] = m - 1
    out, lcp = room.array(m, np.int64), room.array(m, np.uint8)
    for a in range(0, m, BLOCK):
        here = np.asarray(order[a : a + BLOCK])
        out[a : a + len(here)] = stars[here]
        before = np.asarray(order[max(a, 1) - 1 : a + len(here) - 1])
        later = here[len(here) - len(before) :]
        h = np.asarray(shared[a + len(here) - len(before) : a + len(here)]).astype(np.int64)
        h = np.minimum(h, m - 1 - np.maximum(later, before))
        both = common_prefix(text, stars[later + h], stars[before + h], stars[later + h] - stars[later], cap)
        lcp[a + len(here) - len(before) : a + len(here)] = np.where(text[stars[later]] == text[stars[before]], both, 0)
    return out, lcp


def suffixes(text: np.ndarray, cap: int, room: Room) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the last, descending by their first ``cap`` symbols, in blocks: starts, common prefix with the one before.

    The last symbol of ``text`` is 0 and stands nowhere else.  cap: 255 at most.
    """
    if len(text) < 2:
        return
    stars = _stars(text, room)
    order, lcp = _sorted_stars(text, stars, cap, room)
    for pos, common, _ in _downward(text, _upward(text, _by_symbol(text, order, lcp, room), cap, room), cap, room):
        yield pos, common


def later_windows(text: np.ndarray, width: int, room: Room) -> np.ndarray:
    """Whether the ``width`` symbols at a place also start at an earlier one."""
    later = room.array(len(text), np.bool_)
    least = None
    for pos, lcp in suffixes(text, width, room):
        fresh = lcp < width
        fresh[0] |= least is None
        heads = np.flatnonzero(fresh)
        edges = heads if fresh[0] else np.concatenate([[0], heads])
        firsts = np.minimum.reduceat(pos, edges)
        later[pos] = True
        if not fresh[0]:
            if least < firsts[0]:
                firsts[0] = least
            else:
                later[least] = True
        later[firsts] = False
        least = int(firsts[-1])
    return later

"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their log scores come from a model file.  Encoding maps a space to the
whitespace marker, puts one marker in front, and finds the segmentation with the highest
sum of scores; of equal ones, that whose last differing piece starts earliest.  A
character that is no piece of its own costs the least score less 10 and becomes its bytes'
pieces.  Decoding joins pieces, turns byte pieces back into bytes and markers into spaces,
and takes off the one in front.

The search runs over distinct units.  A unit is a run of spaces and what follows it up to
the next space, or a single newline: no piece has a marker after another character, and
none holds a newline (the model is checked for both), so the best segmentation of a text
is that of its units, one after the other.  A unit also ends between two characters that
stand side by side in no piece, as nothing can span them; that is looked up where one of
them has three bytes or more, so Chinese, Japanese or Thai lines are short units too.
Units of one length go through the trie together in numpy, whatever their length.

Defined results: a null or empty text has no ids and decodes to the empty text; a literal
marker character in a text is taken as a space, as the format has it; repeated rows are
encoded one by one; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._common import SpanPool, own_columns, prefix, ragged, slices, text_buffer

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Units of one length that go through the trie at once, times their length.
GRID = 1 << 21


@dataclass
class PieceTable:
    """A vocabulary: bytes of each piece (marker as a space), its log score, and the byte pieces' ids."""

    pieces: list[bytes]
    scores: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray
    unknown_id: int


def load_pieces(model_file: str) -> PieceTable:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)])
    byte_ids = np.full(256, model.unk_id(), np.int32)
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[3:-1], 16)] = i
    for i in np.flatnonzero(usable):
        if MARKER in names[i].lstrip(MARKER) or "\n" in names[i] or " " in names[i]:
            raise ValueError(f"piece {i} can cross the border of a unit")
    pieces = [x.replace(MARKER, " ").encode() for x in names]
    for b, i in enumerate(byte_ids):
        if i != model.unk_id():
            pieces[i] = bytes([b])
    for i in range(n):
        if model.is_control(i):
            pieces[i] = b""
    scores = np.array([model.get_score(i) for i in range(n)])
    return PieceTable(pieces, scores, usable, byte_ids, model.unk_id())


class DoubleArray:
    """A trie in two arrays: from node s, byte c leads to t = base[s] + c + 1 if check[t] == s.  value[t]: a piece's id, or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        taken = np.zeros(size, dtype=bool)
        taken[0] = True
        self.check[0] = 0
        todo, low_end = [(0, 0, len(order), 0)], 0
        while todo:
            node, low, high, depth = todo.pop()
            edges: list[tuple[int, int, int]] = []
            i = low
            if i < high and len(keys[order[i]]) == depth:
                self.value[node] = values[order[i]]
                i += 1
            while i < high:
                c, j = keys[order[i]][depth], i
                while j < high and keys[order[j]][depth] == c:
                    j += 1
                edges.append((c, i, j))
                i = j
            if not edges:
                continue
            codes = np.array([c + 1 for c, _, _ in edges])
            # the first place, a window at a time, where all children fit; full windows are left behind
            at, window = low_end, 4096
            while True:
                while at + window + 258 >= len(taken):
                    grow = len(taken)
                    taken = np.concatenate([taken, np.zeros(grow, dtype=bool)])
                    self.base, self.check, self.value = (np.concatenate([x, np.full(grow, f, np.int32)]) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
                clash = taken[at + codes[0] : at + codes[0] + window]
                for c in codes[1:]:
                    clash = clash | taken[at + c : at + c + window]
                spot = int(np.argmin(clash))
                if not clash[spot]:
                    at += spot
                    break
                if at == low_end and len(codes) == 1:
                    low_end += window
                at += window
            self.base[node] = at
            for (_, i, j), c in zip(edges, codes.tolist(), strict=True):
                taken[at + c] = True
                self.check[at + c] = node
                todo.append((at + c, i, j, depth + 1))
        # a step from any node may look 257 cells on
        pad = 600
        self.base, self.check, self.value = (np.concatenate([x, np.full(pad, f, np.int32)]) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters of valid UTF-8 that begin at ``at``."""
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (wide[at + k] for k in range(4))
    low = [b & 0x3F for b in (b1, b2, b3)]
    two, three = (b0 & 0x1F) << 6 | low[0], (b0 & 0x0F) << 12 | low[0] << 6 | low[1]
    return np.select([b0 < 0x80, b0 < 0xE0, b0 < 0xF0], [b0, two, three], (b0 & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2])


def neighbours(pieces: list[bytes]) -> np.ndarray:
    """Sorted distinct pairs of characters (first << 21 | second) that stand side by side in a piece."""
    text = [p.decode() for p in pieces]
    return np.array(sorted({ord(a) << 21 | ord(b) for t in text for a, b in zip(t, t[1:], strict=False)}), np.int64)


class Viterbi:
    """Best segmentations of byte strings over a double-array trie."""

    def __init__(self, table: PieceTable):
        ids = np.flatnonzero(table.usable)
        self.table = table
        self.trie = DoubleArray([table.pieces[i] for i in ids], ids.tolist())
        self.unknown = float(table.scores[ids].min() if len(ids) else 0.0) - UNKNOWN_PENALTY
        self.pool = SpanPool(self._encode)
        self.pairs = neighbours([table.pieces[i] for i in ids])

    def _apart(self, data: np.ndarray) -> np.ndarray:
        """Positions of characters that no piece joins to the one before, where one of both has three bytes or more."""
        if not len(data) or data.max() < 0xE0:
            return np.zeros(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        wide = data[at] >= 0xE0
        second = np.flatnonzero(wide[1:] | wide[:-1]) + 1
        pair = code_points(data, at[second - 1]) << 21 | code_points(data, at[second])
        if not len(self.pairs):
            return at[second]
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return at[second[self.pairs[place] != pair]]

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        flat = np.frombuffer(b"".join(units), np.uint8)
        starts = np.cumsum(lengths) - lengths
        counts = np.zeros(len(units), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, bounds):
            size = int(lengths[group[0]]) if len(group) else 0
            if not size:
                continue
            step = max(1, GRID // size)
            for k in range(0, len(group), step):
                some = group[k : k + step]
                ids, n = self._best(flat[starts[some][:, None] + np.arange(size)])
                counts[some] = n
                parts.append((some, ids))
        out = np.zeros(int(counts.sum()), np.int32)
        where = np.cumsum(counts) - counts
        for some, ids in parts:
            out[ragged(where[some], counts[some])] = ids
        return out, counts

    def _best(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """grid: n units of one length.  Ids one unit after the other, and how many each has."""
        n, size = grid.shape
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.table.scores
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((size + 1, n), np.int32)
        piece = np.full((size + 1, n), -1, np.int32)
        cols = np.ascontiguousarray(grid.T).astype(np.int32)
        lead = (cols & 0xC0) != 0x80
        width = np.where(cols < 0xC0, 1, np.where(cols < 0xE0, 2, np.where(cols < 0xF0, 3, 4)))
        for i in range(size):
            alive = np.flatnonzero(lead[i] & (best[i] > -np.inf))
            if not len(alive):
                continue
            at_i, wide = best[i][alive], np.minimum(width[i][alive], size - i)
            single = np.zeros(len(alive), dtype=bool)
            node, rows, which = np.zeros(len(alive), np.int32), alive, np.arange(len(alive))
            for j in range(i, size):
                to = base[node] + cols[j][rows] + 1
                ok = check[to] == node
                if j == i:
                    ok &= to > 0
                node, rows, which = to[ok], rows[ok], which[ok]
                if not len(rows):
                    break
                v = value[node]
                hit = v >= 0
                if hit.any():
                    r, w, v = rows[hit], which[hit], v[hit]
                    score = at_i[w] + scores[v]
                    better = score > best[j + 1][r]
                    r2 = r[better]
                    best[j + 1][r2], back[j + 1][r2], piece[j + 1][r2] = score[better], i, v[better]
                    single[w[wide[w] == j + 1 - i]] = True
            lone = ~single
            if lone.any():
                r, end = alive[lone], i + wide[lone]
                score = at_i[lone] + self.unknown
                better = score > best[end, r]
                r, end = r[better], end[better]
                best[end, r], back[end, r], piece[end, r] = score[better], i, -1
        # walk back; unknown characters are bytes
        ends, live = np.full(n, size), np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts = np.zeros(n, np.int64)
        while len(live):
            e = ends[live]
            b, p = back[e, live], piece[e, live]
            took = np.where(p >= 0, 1, e - b)
            counts[live] += took
            steps.append((live, e, b))
            ends[live] = b
            live = live[b > 0]
        out = np.zeros(int(counts.sum()), np.int32)
        last = np.cumsum(counts)
        for rows, e, b in steps:
            p = piece[e, rows]
            known = p >= 0
            last[rows[known]] -= 1
            out[last[rows[known]]] = p[known]
            rows, e, b = rows[~known], e[~known], b[~known]
            most = int((e - b).max()) if len(rows) else 0
            for k in range(1, most + 1):
                r = rows[e - b >= k]
                last[r] -= 1
                out[last[r]] = self.table.byte_ids[grid[r, e[e - b >= k] - k]]
        return out, counts

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and offsets (n + 1)."""
        data, offsets = text_buffer(text)
        n = len(offsets) - 1
        raw = data.tobytes()
        if MARKER.encode() in raw:  # a marker in a text stands for a space
            pieces = [raw[a:b].replace(MARKER.encode(), b" ") for a, b in zip(offsets.tolist(), offsets.tolist()[1:], strict=False)]
            raw, offsets = b"".join(pieces), prefix(np.array([len(x) for x in pieces]))
            data = np.frombuffer(raw, np.uint8)
        full = np.flatnonzero(np.diff(offsets))
        front = offsets[full]
        # one marker in front of each text that is not empty
        data = np.insert(data, front, 32)
        offsets = offsets + np.searchsorted(full, np.arange(n + 1))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        space, line = data == 32, data == 10
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        cut[offsets] = True
        cut[self._apart(data)] = True
        edges = np.flatnonzero(cut)
        units = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        slots = self.pool.look_up(units.dictionary.to_pylist())[units.indices.to_numpy(zero_copy_only=False)]
        ids, lengths = self.pool.expand(slots)
        return ids, prefix(lengths)[np.searchsorted(edges, offsets)]


class Decoder:
    """Texts from ids."""

    def __init__(self, table: PieceTable):
        self.lengths = np.array([len(p) for p in table.pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table.pieces), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        lengths = self.lengths[ids]
        data = self.flat[ragged(self.starts[ids], lengths)] if len(ids) else np.zeros(0, np.uint8)
        ends = prefix(lengths)[offsets]
        full = np.diff(ends) > 0
        heads = ends[:-1][full]
        heads = heads[data[heads] == 32]  # the marker in front
        data = np.delete(data, heads)
        ends = ends - np.searchsorted(heads, ends)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def encode_pieces(docs: DataFrame, model_file: str, with_text: bool = True) -> DataFrame:
    """``docs`` with piece_ids array<int>, n_pieces, pieces_crc32, and decoded (what the ids decode to) if asked for."""
    from threadloom.llm.token_output import list_crc32

    made = ["piece_ids", "n_pieces", "pieces_crc32", "decoded"]
    passed = own_columns(docs, made)
    docs = docs.select(*[F.col(f"`{c}`") for c in passed])
    place = [c.lower() for c in passed].index("text")
    viterbi = docs.sparkSession.sparkContext.broadcast(Viterbi(load_pieces(model_file)))  # grows with the vocabulary alone
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", piece_ids array<int>, n_pieces long, pieces_crc32 long" + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = viterbi.value
        decoder = Decoder(coder.table)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = coder.encode(part.column(place))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                columns = [*part.columns, lists, pa.array(np.diff(offsets)), pa.array(list_crc32(lists), pa.int64())]
                if with_text:
                    columns.append(decoder.decode(ids, offsets))
                yield pa.RecordBatch.from_arrays(columns, names=[*passed, *made[: len(columns) - len(passed)]])

    return docs.mapInArrow(run, schema)

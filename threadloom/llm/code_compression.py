"""Vectors as short codes: one codebook for each of equal parts, trained by Lloyd rounds with Hamerly's bounds.

Components become integers floor(scale * x); a vector is cut into ``parts`` equal parts.  A codebook begins as
that part of the vectors with the smallest ids; a round assigns every part to its nearest entry and moves entries
to the floor of their parts' mean.

Between rounds each vector keeps, for each part, its entry, an upper bound of the distance to it and a lower bound of
the distance to the second nearest.  Moved entries widen the bounds; only where the upper bound, made exact once, is
not strictly below the lower bound (or half of the way to the entry's nearest neighbour) are all entries looked at,
in integers, ties to the lower index.  Bounds are rounded away from each other, so rounding never hides a tie.

A round is one pass over the vectors' state, which is written as Parquet: a lost executor costs its tasks alone.
Entries move by sums of the parts that changed entry, so a round sends a few hundred numbers a task to one
aggregation; the codebooks (parts x entries x width numbers) are all that the driver holds.

Defined results: rows whose vector is null or holds null or non-finite components are left out; a null id comes after all
others; of rows alike in id the vector decides the order; shorter vectors count as filled up with zeros to the greatest
length, rounded up to a multiple of ``parts``; fewer vectors than entries give as many entries; components beyond 62
bits and errors beyond 64 bits are held to the nearest end; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._common import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6

#: Rows that a step handles at once, and the labels up to which their sums are broadcast.
STEP_ROWS, BROADCAST_LABELS, SALTS = 8192, 100_000, 64

#: Float arithmetic on integers is exact below this.
_EXACT = float(1 << 52)
_END = float(1 << 62)

_STATE = "vec_id long, label string, v binary, code binary, upper binary, lower binary, moved array<decimal(38,0)>"
_STATE_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.binary()), ("code", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("moved", pa.list_(pa.decimal128(38, 0)))])


def _unpack(column: pa.Array, kind) -> np.ndarray:
    """Binary values of one length as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.zeros((0, 0), kind)


def _pack(matrix: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(matrix)
    n, step = len(data), data.strides[0] if len(data) else 0
    offsets = np.arange(n + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def integer_vectors(rows: DataFrame, scale: int, width: int) -> DataFrame:
    """(vec_id, label, v): v packs floor(scale * x) of each component, as integers of 64 bits, filled up to ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                out = np.zeros((len(part), width))
                for i, x in enumerate(part.column("embedding").to_pylist()):
                    out[i, : len(x)] = x
                whole = np.clip(np.floor(out * float(scale)), -_END, _END)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), _pack(whole.astype(np.int64))], names=["vec_id", "label", "v"])

    return rows.mapInArrow(run, "vec_id long, label string, v binary")


class Codebooks:
    """Entries of each part as Python integers, and what a pass needs of them."""

    def __init__(self, entries: list[list[list[int]]], moved: list[list[float]] | None = None):
        self.entries = entries
        self.k = len(entries[0])
        self.most = max((abs(c) for part in entries for e in part for c in e), default=0)
        self.floats = np.array(entries, dtype=float) if self.most < 1 << 52 else None
        self.moved = np.array(moved) if moved is not None else None
        self.half = np.full((len(entries), self.k), np.inf)
        for p, part in enumerate(entries):
            for a in range(self.k):
                for b in range(self.k):
                    if a != b:
                        way = math.sqrt(sum((x - y) ** 2 for x, y in zip(part[a], part[b], strict=True)))
                        self.half[p, a] = min(self.half[p, a], way / 2 * (1 - 1e-12))

    def update(self, sums: dict[int, int], width: int) -> Codebooks:
        """Each entry at the floor of its parts' mean; sums: by (part, entry, 0 for the count or 1 + component)."""
        step = width + 1
        new, moved = [], []
        for p, part in enumerate(self.entries):
            row, ways = [], []
            for e, old in enumerate(part):
                at = (p * self.k + e) * step
                n = sums.get(at, 0)
                entry = [sums.get(at + 1 + i, 0) // n for i in range(width)] if n else old
                row.append(entry)
                ways.append(math.sqrt(sum((x - y) ** 2 for x, y in zip(entry, old, strict=True))) * (1 + 1e-12))
            new.append(row)
            moved.append(ways)
        return Codebooks(new, moved)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.entries for e in part for c in e).encode()).hexdigest()


def _distances(x: np.ndarray, books: Codebooks, p: int, which: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of rows ``x`` (integers) to all entries of part ``p``, or to entry ``which`` of each row; exact."""
    top = max(int(np.abs(x).max(initial=0)), books.most)
    if books.floats is not None and 4.0 * float(top) * float(top) * max(1, x.shape[1]) < _EXACT:
        c = books.floats[p]
        if which is not None:
            return ((x - c[which]) ** 2).sum(axis=1)
        f = x.astype(float)
        return (f**2).sum(axis=1)[:, None] - 2 * (f @ c.T) + (c**2).sum(axis=1)
    wide = x.astype(object)
    c = np.array(books.entries[p], dtype=object).reshape(books.k, x.shape[1])
    if which is not None:
        return ((wide - c[which]) ** 2).sum(axis=1)
    return np.stack([((wide - c[j]) ** 2).sum(axis=1) for j in range(books.k)], axis=1)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


def _scan(x: np.ndarray, books: Codebooks, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index), its distance rounded up and that of the second rounded down."""
    squares = _distances(x, books, p)
    code = np.argmin(squares, axis=1) if squares.dtype != object else np.array([min(range(books.k), key=row.__getitem__) for row in squares], dtype=np.int64)
    rows = np.arange(len(x))
    near = _roots(squares[rows, code]) * (1 + 1e-12)
    if books.k == 1:
        return code, near, np.full(len(x), np.inf)
    rest = squares.copy()
    rest[rows, code] = rest.max(initial=0)
    return code, near, _roots(rest.min(axis=1)) * (1 - 1e-12)


def _reassign(x, code, upper, lower, books: Codebooks, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One part of some rows after the entries have moved; the last value counts full scans."""
    moved = books.moved[p]
    upper = (upper + moved[code]) * (1 + 1e-12)
    if books.k > 1:
        order = np.argsort(moved)
        others = np.full(books.k, moved[order[-1]])
        others[order[-1]] = moved[order[-2]]
        lower = lower - others[code]
        lower -= np.abs(lower) * 1e-12
    bound = np.maximum(lower, books.half[p][code])
    open_ = np.flatnonzero(~(upper < bound))
    if len(open_):
        upper[open_] = _roots(_distances(x[open_], books, p, code[open_])) * (1 + 1e-12)
        open_ = open_[~(upper[open_] < bound[open_])]
    if len(open_):
        code = code.copy()
        code[open_], upper[open_], lower[open_] = _scan(x[open_], books, p)
    return code, upper, lower, len(open_)


def _pass(rows: DataFrame, books: Codebooks, parts: int, width: int, first: bool) -> DataFrame:
    """The state after an assignment, and one row a task (v null) with the sums of parts that changed entry."""
    step, k = width + 1, books.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros(parts * k * step, dtype=object)
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                some = batch.slice(at, STEP_ROWS)
                n = len(some)
                v = _unpack(some.column("v"), np.int64).reshape(n, parts, width)
                code = np.zeros((n, parts), np.uint8) if first else _unpack(some.column("code"), np.uint8).copy()
                upper, lower = (np.zeros((n, parts)) if first else _unpack(some.column(c), np.float64).copy() for c in ("upper", "lower"))
                for p in range(parts):
                    x, old = v[:, p], code[:, p].astype(np.int64)
                    if first:
                        new, upper[:, p], lower[:, p] = _scan(x, books, p)
                        changed = np.arange(n)
                    else:
                        new, upper[:, p], lower[:, p], _ = _reassign(x, old, upper[:, p].copy(), lower[:, p].copy(), books, p)
                        changed = np.flatnonzero(new != old)
                    code[:, p] = new
                    for e in range(k) if len(changed) else ():
                        base = (p * k + e) * step
                        for sign, whose in ((1, new), (-1, old)):
                            if first and sign < 0:
                                continue
                            mine = changed[whose[changed] == e]
                            if len(mine):
                                big = int(np.abs(x[mine]).max(initial=0)) >= 1 << 46
                                total = x[mine].astype(object).sum(axis=0) if big else x[mine].sum(axis=0)
                                moved[base] += sign * len(mine)
                                moved[base + 1 : base + step] += sign * np.array([int(t) for t in total], dtype=object)
                columns = [some.column("vec_id"), some.column("label"), some.column("v"), _pack(code), _pack(upper), _pack(lower), pa.nulls(n, _STATE_ARROW.field("moved").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=_STATE_ARROW)
        if any(moved):
            sums = pa.array([[int(m) for m in moved]], _STATE_ARROW.field("moved").type)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in _STATE_ARROW][:-1] + [sums], schema=_STATE_ARROW)

    return rows.mapInArrow(run, _STATE)


def _moved(state: DataFrame) -> dict[int, int]:
    """Sums of all tasks by place: parts x entries x (1 + width) numbers."""
    each = state.where("moved IS NOT NULL").select(F.posexplode("moved").alias("at", "x")).where("x <> 0")
    return {r["at"]: int(r["x"]) for r in each.groupBy("at").agg(F.sum("x").alias("x")).collect()}


def _finish(state: DataFrame, books: Codebooks, parts: int, width: int) -> DataFrame:
    """(vec_id, label, code, error) with exact errors; code in hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                some = batch.slice(at, STEP_ROWS)
                n = len(some)
                v, code = _unpack(some.column("v"), np.int64).reshape(n, parts, width), _unpack(some.column("code"), np.uint8)
                error = [0] * n
                for p in range(parts):
                    error = [a + int(b) for a, b in zip(error, _distances(v[:, p], books, p, code[:, p].astype(np.int64)).tolist(), strict=True)]
                texts = pa.array([row.tobytes().hex() for row in code], pa.string())
                errors = pa.array([min(e, (1 << 63) - 1) for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), texts, errors], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label string, code string, error long")


def train_codes(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of the kept rows of ``vectors`` (vec_id, embedding, label), and the codebooks.

    Without any kept row the codebooks are None.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte for each part: 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession, "codes")
    usable = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    kept = kept.where(F.col("embedding").isNotNull() & usable)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    width = -(-longest // parts)
    state = scratch.save(integer_vectors(kept, scale, width * parts), "state-0")
    least = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("vec_id", "v").collect()  # as many rows as entries
    seeds = sorted(((r["vec_id"] is None, r["vec_id"] or 0, np.frombuffer(r["v"], np.int64).tolist()) for r in least), key=lambda r: r[:2])
    books = Codebooks([[v[p * width : (p + 1) * width] for _, _, v in seeds] for p in range(parts)])
    sums: dict[int, int] = {}
    for i in range(rounds + 1):
        state = scratch.save(_pass(state.where("v IS NOT NULL"), books, parts, width, i == 0), f"state-{i + 1}")
        scratch.drop(f"state-{i}")
        if i < rounds:
            for at, x in _moved(state).items():
                sums[at] = sums.get(at, 0) + x
            books = books.update(sums, width)
    return _finish(state.where("v IS NOT NULL"), books, parts, width), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors summed over rows of an equal label, nulls together.

    The sums go to every task while there are few labels; else rows and sums meet under a label and a
    salt, so that the rows of one label spread over many tasks.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    spread = sums.withColumn("salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    return rows.join(spread, (F.col("salt") == F.col("salted")) & F.col("label").eqNullSafe(F.col("of"))).drop("of", "salt", "salted")


def compress(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the kept rows of ``vectors`` (vec_id, embedding, label)."""
    coded, books = train_codes(vectors, **options)
    coded = Scratch(vectors.sparkSession, "codes").save(coded, "coded")
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))

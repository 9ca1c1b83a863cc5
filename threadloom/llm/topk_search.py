"""Exact top-k by inner product with multi-resolution segment statistics.

Each vector is cut into 1, 4, 16 equal segments, and each segment keeps its mean and the
norm of its deviations from it.  For a query q and a vector x, in each segment

    sum(q * x) <= length * mean_q * mean_x + deviation_q * deviation_x

(Cauchy-Schwarz on the deviations), which is the lower bound on the squared distance
|q|^2 + |x|^2 - 2 q.x in another form.  Coarse to fine, vectors whose bound lies below the
query's k-th score so far are left out; survivors get their exact integer score.

Layout.  Vectors are dealt into blocks of about ``data_block`` rows by a hash of their id;
each is shuffled once.  A query goes to every block, as a row behind the block's vectors:
a task holds one block with its statistics and takes the queries in batches, so memory is
bounded for any number of either.  A query brings the k-th score that it reaches among
``SEED_ROWS`` rows of the table; that bound below prunes from the first vector on and
loses nothing, as those rows are candidates themselves.  The k best of each block are merged
by a rank within the query.

Defined results: scores are exact; one outside the range of a long is held to its nearest
end.  Vectors that are null, or hold null or non-finite components, take no part, nor do rows
with a null vec_id; vectors of unequal length count missing components as 0; equal scores
rank by vec_id; rows with equal vec_id are rows of their own: each query row has a ranking
of its own, in which the others of its id are candidates; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BATCH, DATA_BLOCK, SUB_BLOCK, SEED_ROWS, K, LEVELS = 1024, 131_072, 2048, 2048, 10, (1, 4, 16)
_EXACT = float(1 << 53)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) for each component; rows that take no part are left out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor as double: a whole number of any size, where the long of F.floor would overflow
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: _floor(x * scale) if scale else x).alias("v"))


def _floor(x):
    return F.when(F.abs(x) >= _EXACT, x).otherwise(F.floor(x).cast("double"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0)
    out = np.zeros((len(lists), width))
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and norms of deviations by segment (n x segments), and the segments' lengths."""
    parts = np.array_split(np.arange(x.shape[1]), segments)
    means = np.stack([x[:, p].mean(axis=1) if len(p) else np.zeros(len(x)) for p in parts], axis=1)
    spread = np.stack([np.sqrt(((x[:, p] - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, means.T, strict=True)], axis=1)
    return means, spread, np.array([len(p) for p in parts], float)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as int64, held to its range; in double, in int64 or in Python's integers, as size demands."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < _EXACT:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    whole = [[int(c) for c in row] for row in x]
    rows = [[int(c) for c in row] for row in q]
    return np.array([[max(_LOW, min(_HIGH, sum(a * b for a, b in zip(u, w, strict=True)))) for w in whole] for u in rows], np.int64).reshape(len(q), len(x))


class Block:
    """Vectors of one block, in sub-blocks from long to short, with their statistics."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: tuple[int, ...] = LEVELS):
        norms = np.sqrt((x**2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.x, self.norms = ids[order], x[order], norms[order]
        self.levels = [s for s in levels if s <= max(1, x.shape[1])]
        self.parts = [slice(a, a + SUB_BLOCK) for a in range(0, len(ids), SUB_BLOCK)]
        self.stats = [segment_statistics(self.x, s) for s in self.levels]

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score) of the k best for each query, its own row left out; floor: scores below it need not be found."""
        floor = floor.astype(float).copy()
        own = [segment_statistics(q, s) for s in self.levels]
        length = np.sqrt((q**2).sum(axis=1))
        best: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]
        met = np.zeros(len(q), dtype=bool)  # its own row was left out
        for part in self.parts:
            rows, cols = np.arange(len(q)), np.arange(part.start, min(part.stop, len(self.ids)))
            alive = np.ones((len(rows), len(cols)), dtype=bool)
            slack = 1e-9 * (1 + length * self.norms[cols[0]])
            for (qm, qs, sizes), (xm, xs, _) in zip(own, self.stats, strict=True):
                bound = (qm[rows] * sizes) @ xm[cols].T + qs[rows] @ xs[cols].T
                alive &= bound + slack[rows, None] >= floor[rows, None]
                keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
                rows, cols, alive = rows[keep_rows], cols[keep_cols], alive[np.ix_(keep_rows, keep_cols)]
                if not len(rows):
                    break
            if not len(rows):
                continue
            scores = exact_scores(q[rows], self.x[cols])
            alive &= scores >= floor[rows, None]
            for at in np.flatnonzero(alive.any(axis=1)).tolist():
                i = int(rows[at])
                picked = np.flatnonzero(alive[at])
                ids, found = self.ids[cols[picked]], scores[at][picked]
                if not met[i]:
                    same = np.flatnonzero(ids == q_ids[i])
                    same = [j for j in same.tolist() if np.array_equal(self.x[cols[picked[j]]], q[i])][:1]
                    if same:
                        met[i] = True
                        ids, found = np.delete(ids, same), np.delete(found, same)
                if len(ids) > k:
                    order = np.lexsort((ids, -found))[:k]
                    ids, found = ids[order], found[order]
                merged = sorted(best[i] + list(zip((-found).tolist() if len(found) and found.min() > _LOW else [-s for s in found.tolist()], ids.tolist(), strict=True)))[:k]
                best[i] = merged
                if len(merged) == k:
                    floor[i] = max(floor[i], float(-merged[-1][0]) if abs(merged[-1][0]) < _EXACT else np.nextafter(float(-merged[-1][0]), -np.inf))
        out = [(i, v, -s) for i, rows_ in enumerate(best) for s, v in rows_]
        cols_ = list(zip(*out, strict=True)) if out else [(), (), ()]
        return np.array(cols_[0], np.int64), np.array(cols_[1], np.int64), np.array(cols_[2], np.int64)


_SIDE = "db long, q_row long, vec_id long, v array<double>, floor double"
_FOUND = pa.schema([("q_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(rows: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks one after the other: the vectors of each (q_row null), then its queries."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    block, number = None, None
    for batch in rows:
        numbers = batch.column("db").to_numpy()
        vectors = np.asarray(batch.column("q_row").is_null())
        steps = np.flatnonzero((np.diff(numbers) != 0) | (vectors[1:] != vectors[:-1])) + 1
        for a, b in zip([0, *steps.tolist()], [*steps.tolist(), len(numbers)], strict=True):
            if a == b:
                continue
            if numbers[a] != number:
                held, block, number = [], None, numbers[a]
            part = batch.slice(a, b - a)
            if vectors[a]:
                held.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"), width)))
                continue
            if block is None:
                if not held:
                    continue
                block = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held = []
            for at in range(0, len(part), QUERY_BATCH):
                some = part.slice(at, QUERY_BATCH)
                ids = some.column("vec_id").to_numpy()
                i, found, score = block.search(ids, _matrix(some.column("v"), width), some.column("floor").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(some.column("q_row").to_numpy()[i]), pa.array(ids[i]), pa.array(found), pa.array(score)], schema=_FOUND)


def _seeded(queries: DataFrame, seeds: list, width: int, k: int) -> DataFrame:
    """``queries`` (q_row, vec_id, v) with floor: the k-th score among the seeds, less than which no result has."""
    block = None if len(seeds) <= k else (np.array([r["vec_id"] for r in seeds], np.int64), np.array([(list(r["v"]) + [0.0] * width)[:width] for r in seeds]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = np.full(len(batch), -np.inf)
            if block is not None:
                for at in range(0, len(batch), QUERY_BATCH):
                    some = batch.slice(at, QUERY_BATCH)
                    scores = exact_scores(_matrix(some.column("v"), width), block[1])
                    # one seed may be the query's own row: the next one down is certain
                    kth = np.partition(scores, len(block[0]) - k - 1, axis=1)[:, len(block[0]) - k - 1].astype(float)
                    floor[at : at + len(some)] = np.where(np.abs(kth) < _EXACT, kth, np.nextafter(kth, -np.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=["q_row", "vec_id", "v", "floor"])

    return queries.mapInArrow(run, "q_row long, vec_id long, v array<double>, floor double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, data_block: int = DATA_BLOCK, seed_rows: int = SEED_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors but itself.

    ``vectors`` and ``queries`` are (vec_id, v array<double>) as :func:`quantise` makes them.
    ``seed_rows``: how many rows, the least by a hash of their id, the queries' first bounds come from.
    """
    n_rows, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(width or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    blocks = -(-n_rows // data_block) or 1
    seeds = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(seed_rows).collect()  # a bounded number of rows
    # rows of one id are numbered, so that each has a ranking of its own
    numbered = queries.select((F.row_number().over(W.partitionBy("vec_id").orderBy("v")) - 1).cast("long").alias("q_row"), "vec_id", "v")
    asked = _seeded(numbered, seeds, width, k)
    # a block is an even share by a hash of the id, not of the content, so equal vectors spread
    left = vectors.select(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).alias("db"), F.lit(None).cast("long").alias("q_row"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("db"), "q_row", "vec_id", "v", "floor")
    tasks = max(blocks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = left.union(right).repartition(tasks, "db").sortWithinPartitions("db", F.col("q_row").asc_nulls_first())
    found = dealt.mapInArrow(lambda rows: _search(rows, width, k), "q_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "q_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

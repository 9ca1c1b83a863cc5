"""Exact nearest neighbours without reading all vectors: cells around pivots, with the distances to them.

Every row lies in the cell of its nearest pivot, in a folder of its own, sorted by its distance to the pivot.  By the
triangle inequality a row whose distance to its pivot differs from the query's by more than the k-th best distance
cannot be among the k nearest; so a search reads a ring of each cell that the bound leaves, and results are those of
:func:`threadloom.functions.vectors.knn`.  Pivots come from a bounded sample of rows, and only how much is read depends
on them.  Updates write a segment with the same pivots and tombstones for the ids that they replace.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.vectors import doubles, is_comparable, is_zero, l2_distance, query_literal
from threadloom.sources.shared import fresh_dir

#: Rows that pivots are drawn from, rows of a cell about, most cells, steps that move pivots, rows that the first look reads for each wanted one.
SAMPLE, CELL_ROWS, MOST_CELLS, STEPS, FIRST = 20_000, 2_000, 4096, 4, 16
#: Rows of a cell that one task of a batch search compares, and what rounding may change of a distance.
BLOCK_ROWS, SLACK = 50_000, 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)
    return np.argmin(squares, axis=1)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows to one vector, summed in order of components as the column function does."""
    return np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x))


def draw_pivots(rows: np.ndarray, cells: int) -> np.ndarray:
    """Pivots from a sample: evenly spread rows, moved a few steps to the means of what is nearest."""
    pivots = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(STEPS):
        near = _nearest(rows, pivots)
        for c in np.unique(near):
            pivots[c] = rows[near == c].mean(axis=0)
    return pivots


@dataclass(frozen=True)
class VectorIndex:
    """Cells below ``path``: pivots, and for each segment (folder, has tombstones) and cell its rows and least and greatest distance to the pivot."""

    spark: SparkSession
    path: str
    dim: int
    id_column: str
    id_type: str
    carry: tuple[str, ...]
    carry_types: tuple[str, ...]
    pivots: np.ndarray
    segments: tuple[tuple[str, bool], ...]
    rings: tuple[dict[int, tuple[int, float, float]], ...]

    @classmethod
    def build(cls, df: DataFrame, id_column: str, vector: str, dim: int, carry: Sequence[str] = (), path: str | None = None, keep_zero: bool = False) -> VectorIndex:
        """An index of the rows of ``df`` with a comparable vector; zero vectors are left out as in knn."""
        spark = df.sparkSession
        types = dict(df.dtypes)
        rows = cls._usable(df, id_column, vector, dim, carry, keep_zero)
        n = rows.count()
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow() if n else None  # a bounded sample
        sample = _matrix(drawn.column("v"), dim) if n else np.zeros((1, dim))
        pivots = draw_pivots(sample, max(1, min(MOST_CELLS, n // CELL_ROWS + 1 if n > 64 * CELL_ROWS else max(1, int(np.sqrt(n))))))
        index = cls(spark, path or fresh_dir(spark, "vector-index"), dim, id_column, types[id_column], tuple(carry), tuple(types[c] for c in carry), pivots, (), ())
        return index._append(rows, None)

    @staticmethod
    def _usable(df: DataFrame, id_column: str, vector: str, dim: int, carry: Sequence[str], keep_zero: bool) -> DataFrame:
        rows = df.where(is_comparable(F.col(vector), dim))
        rows = rows if keep_zero else rows.where(~is_zero(F.col(vector)))
        return rows.select(F.col(id_column).alias("id"), doubles(F.col(vector)).alias("v"), *[F.col(f"`{c}`") for c in carry])

    def _columns(self) -> str:
        return ", ".join([f"id {self.id_type}", "v array<double>", *(f"`{c}` {t}" for c, t in zip(self.carry, self.carry_types, strict=True)), "away double", "cell int"])

    def _append(self, rows: DataFrame, dead: DataFrame | None) -> VectorIndex:
        name, dim, pivots = f"segment-{uuid.uuid4().hex[:12]}", self.dim, self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    part = batch.slice(at, 4096)
                    x = _matrix(part.column("v"), dim)
                    cell = _nearest(x, pivots)
                    away = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(away), pa.array(cell, pa.int32())], names=[*part.schema.names, "away", "cell"])

        placed = rows.mapInArrow(run, self._columns())
        # a cell is cut by distance where it is large: its rings stay together
        placed.repartitionByRange(max(1, len(pivots) // 16), "cell", "away").sortWithinPartitions("cell", "away").write.partitionBy("cell").parquet(f"{self.path}/{name}/rows")
        if dead is not None:
            dead.write.parquet(f"{self.path}/{name}/dead")
        written = self.spark.read.schema(self._columns()).parquet(f"{self.path}/{name}/rows")
        rings = {r["cell"]: (r["n"], r["low"], r["high"]) for r in written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}  # a row a cell
        return replace(self, segments=(*self.segments, (name, dead is not None)), rings=(*self.rings, rings))

    def update(self, df: DataFrame | None = None, vector: str = "embedding", deleted: DataFrame | None = None, keep_zero: bool = False) -> VectorIndex:
        """The index after rows of ``df`` take the place of those with their ids and rows of ``deleted`` (id) go; only what is new is read."""
        parts = [d.select(F.col(c).cast(self.id_type).alias("id")) for d, c in ((df, self.id_column), (deleted, "id")) if d is not None]
        if not parts:
            return self
        rows = self._usable(df, self.id_column, vector, self.dim, self.carry, keep_zero) if df is not None else self._rows([len(self.segments) - 1]).where("false").drop("away", "cell", "at")
        return self._append(rows, reduce(DataFrame.union, parts).distinct())

    def compact(self) -> VectorIndex:
        """One segment with pivots drawn anew."""
        rows = self.rows()
        again = VectorIndex.build(rows.withColumnRenamed("id", "_id_").withColumnRenamed("_id_", self.id_column), self.id_column, "v", self.dim, self.carry, keep_zero=True)
        return again

    def _rows(self, places: Sequence[int], where: dict[int, Column] | None = None) -> DataFrame:
        found = None
        for at in places:
            rows = self.spark.read.schema(self._columns()).parquet(f"{self.path}/{self.segments[at][0]}/rows")
            rows = (rows if where is None else rows.where(where[at])).withColumn("at", F.lit(at))
            found = rows if found is None else found.union(rows)
        return found

    def _living(self, rows: DataFrame) -> DataFrame:
        tombs = [self.spark.read.schema(f"id {self.id_type}").parquet(f"{self.path}/{name}/dead").select(F.col("id").alias("_dead"), F.lit(at).alias("_until")) for at, (name, dead) in enumerate(self.segments) if dead]
        if not tombs:
            return rows
        until = reduce(DataFrame.union, tombs).groupBy("_dead").agg(F.max("_until").alias("_until"))
        return rows.join(until, (F.col("id") == F.col("_dead")) & (F.col("at") < F.col("_until")), "left_anti")

    def rows(self) -> DataFrame:
        """(id, v, carried columns) of all rows that count."""
        return self._living(self._rows(range(len(self.segments)))).drop("away", "cell", "at")

    # ---- one query ----------------------------------------------------------------------

    def _ring(self, at: int, ways: np.ndarray, reach: float) -> list[tuple[int, float, float]]:
        """Cells of a segment that may hold rows within ``reach``, with the least and greatest distance to the pivot."""
        found = []
        for cell, (_, low, high) in self.rings[at].items():
            a, b = ways[cell] - reach - SLACK * (1 + ways[cell]), ways[cell] + reach + SLACK * (1 + ways[cell])
            if a <= high and b >= low:
                found.append((cell, a, b))
        return found

    def _near(self, query: Sequence[float], rings: dict[int, list[tuple[int, float, float]]]) -> DataFrame:
        where = {}
        for at, cells in rings.items():
            whole = [c for c, a, b in cells if a <= self.rings[at][c][1] and b >= self.rings[at][c][2]]
            cut = [(F.col("cell") == c) & (F.col("away") >= a) & (F.col("away") <= b) for c, a, b in cells if c not in set(whole)]
            where[at] = reduce(lambda x, y: x | y, [F.col("cell").isin(whole), *cut])
        return self._living(self._rows(list(rings), where)).withColumn("dist", l2_distance(F.col("v"), query_literal(query)))

    def _reach(self, query: Sequence[float], ways: np.ndarray, k: int) -> float:
        """An upper bound of the k-th distance, from the cells that the query is nearest to."""
        order = sorted(((ways[c], at, c, n) for at, ring in enumerate(self.rings) for c, (n, _, _) in ring.items()), key=lambda x: x[:3])
        picked: dict[int, list] = {}
        seen = 0
        for _, at, cell, n in order:
            if seen >= FIRST * k:
                break
            picked.setdefault(at, []).append((cell, -np.inf, np.inf))
            seen += n
        if not picked:
            return np.inf
        dists = [r["dist"] for r in self._near(query, picked).orderBy("dist").limit(k).select("dist").collect()]
        return dists[-1] if len(dists) == k else np.inf

    def _plan(self, query: Sequence[float], k: int) -> dict[int, list[tuple[int, float, float]]]:
        q = np.asarray(query, float)
        if len(q) != self.dim:
            raise ValueError(f"expected {self.dim} components, got {len(q)}")
        ways = np.sqrt(((self.pivots - q) ** 2).sum(axis=1))
        reach = self._reach(query, ways, k)
        return {at: found for at in range(len(self.segments)) if (found := self._ring(at, ways, reach))}

    def knn(self, query: Sequence[float], k: int) -> DataFrame:
        """(id column, carried columns, dist) of the k nearest, ties by id; the same as a scan of all vectors gives."""
        rings = self._plan(query, k)
        if not rings:
            types = ", ".join([f"`{self.id_column}` {self.id_type}", *(f"`{c}` {t}" for c, t in zip(self.carry, self.carry_types, strict=True)), "dist double"])
            return self.spark.createDataFrame([], types)
        near = self._near(query, rings).orderBy("dist", "id").limit(k)
        return near.select(F.col("id").alias(self.id_column), *[F.col(f"`{c}`") for c in self.carry], "dist")

    def scanned(self, query: Sequence[float], k: int) -> float:
        """The share of rows whose distance a search computes."""
        rings = self._plan(query, k)
        total = sum(n for ring in self.rings for n, _, _ in ring.values())
        return self._near(query, rings).count() / total if rings and total else 0.0

    # ---- many queries -------------------------------------------------------------------

    def knn_many(self, queries: DataFrame, k: int) -> DataFrame:
        """(question, id, dist, rank) of the k nearest to each of ``queries`` (question, vector); queries without a comparable vector have none.

        A query first meets its nearest cells, which bounds its k-th distance, and then the cells that the bound leaves.  Queries and
        rows meet by cell and block of the cell, so neither is compared with all of the other.
        """
        dim, pivots, rings = self.dim, self.pivots, self.rings
        kind = dict(queries.dtypes)["question"]
        asked = queries.where(is_comparable(F.col("vector"), dim)).select("question", doubles(F.col("vector")).alias("q"))
        cells: dict[int, list] = {}
        for ring in rings:
            for c, (n, low, high) in ring.items():
                known = cells.get(c, (0, np.inf, -np.inf))
                cells[c] = (known[0] + n, min(known[1], low), max(known[2], high))
        order = np.array(sorted(cells), np.int64)
        count, low, high = (np.array([cells[c][i] for c in order]) for i in range(3)) if len(order) else (np.zeros(0), np.zeros(0), np.zeros(0))
        blocks = np.maximum(1, -(-count.astype(np.int64) // BLOCK_ROWS))

        def send(first: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    q = _matrix(batch.column("q"), dim)
                    ways = np.sqrt(np.maximum(0, ((q[:, None, :] - pivots[order][None]) ** 2).sum(axis=2)))
                    if first:
                        rank = np.argsort(ways, axis=1, kind="stable")
                        before = np.cumsum(count[rank], axis=1) - count[rank]
                        wanted = np.zeros(ways.shape, bool)
                        np.put_along_axis(wanted, rank, before < FIRST * k, axis=1)
                    else:
                        reach = np.where(np.isnan(r := batch.column("reach").to_numpy(zero_copy_only=False).astype(float)), np.inf, r)[:, None]
                        slack = SLACK * (1 + ways)
                        wanted = (ways - reach - slack <= high) & (ways + reach + slack >= low)
                    row, col = np.nonzero(wanted)
                    times = blocks[col]
                    row, col = np.repeat(row, times), np.repeat(col, times)
                    block = np.arange(len(col)) - np.repeat(np.cumsum(times) - times, times)
                    take = pa.array(row)
                    reach_ = pa.nulls(len(row), pa.float64()) if first else batch.column("reach").take(take)
                    yield pa.RecordBatch.from_arrays([batch.column("question").take(take), batch.column("q").take(take), reach_, pa.array(order[col], pa.int32()), pa.array(block, pa.int64())], names=["question", "q", "reach", "cell", "block"])

            return run

        sent = f"question {kind}, q array<double>, reach double, cell int, block long"
        sizes = F.create_map(*[F.lit(int(x)) for c, b in zip(order, blocks, strict=True) for x in (c, b)]) if len(order) else F.create_map(F.lit(0), F.lit(1))
        vectors = self._living(self._rows(range(len(self.segments)))).select("id", "v", "cell", F.pmod(F.xxhash64("id"), sizes[F.col("cell")]).cast("long").alias("block"))

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            schema = pa.schema([("question", left.schema.field("question").type), ("id", right.schema.field("id").type), ("dist", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            q, x = _matrix(left.column("q"), dim), _matrix(right.column("v"), dim)
            out_q, out_x, out_d = [], [], []
            for i in range(len(q)):
                d = _distances(x, q[i])
                near = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                out_q.append(np.full(len(near), i)), out_x.append(near), out_d.append(d[near])
            take_q, take_x = pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_x))
            return pa.table([left.column("question").take(take_q), right.column("id").take(take_x), pa.array(np.concatenate(out_d))], schema=schema)

        def compared(pairs: DataFrame) -> DataFrame:
            return pairs.groupBy("cell", "block").cogroup(vectors.groupBy("cell", "block")).applyInArrow(met, f"question {kind}, id {self.id_type}, dist double")

        place = F.row_number().over(W.partitionBy("question").orderBy("dist", "id"))
        begun = compared(asked.mapInArrow(send(True), sent)).withColumn("rank", place).where(F.col("rank") <= k)
        reach = begun.groupBy("question").agg(F.when(F.count(F.lit(1)) == k, F.max("dist")).alias("reach"))
        bounded = asked.join(reach, "question", "left").select("question", "q", F.coalesce("reach", F.lit(float("nan"))).alias("reach"))
        return compared(bounded.mapInArrow(send(False), sent)).withColumn("rank", place.cast("long")).where(F.col("rank") <= k)

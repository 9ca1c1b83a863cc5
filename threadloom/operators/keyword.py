"""Keyword search on a written inverted index: BM25, phrases, top-k by tiers, one row for each thread, LIKE fallback.

An index is a list of segments below one folder, published by a manifest a version.  A segment holds

* ``postings``: blocks of the texts that hold a term, in partition folders by a hash of the term, sorted by term and tier.
  A block is of the texts that one task met together, in arrays.  A tier is a step of the term's weight in the row (frequency against length); tier 0 is the best.
  A term that few of these texts hold has one block, in the tier of its best row.
* ``terms``: for each term and tier the number of postings and a weight that none exceeds, so that counting needs no postings;
* ``forward``: for each row its length and terms, in folders by a hash of the id;
* ``dead``: ids whose rows in earlier segments no longer count, and ``lost``: how many postings of a term each
  earlier segment lost by that.

:meth:`KeywordIndex.update` writes one segment from the new rows and the forward rows of the ids that they replace; rows,
mean length and document frequencies are kept up by sums, so scores are those of a fresh build.  When ``FAN`` segments at
the end have one level they are merged, which leaves out dead rows; so there are some FAN segments a level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.stem import query_phrases, stem, words
from threadloom.sources.shared import LARGE, TASK_BYTES, dropping_shuffles, expected_bytes, fresh_dir

#: BM25 parameters and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Bytes of texts that one bucket holds, about.
BUCKET_BYTES, LEAST_BUCKETS = 256 << 20, 8
#: While a segment is written: slices at most, bytes of texts of one slice, of one sorting task, and from which on tasks sort by term and tier and not by bucket.
SLICES, SLICE_BYTES, SORT_BYTES, SPREAD_BYTES = 8, 16 << 20, 64 << 20, 8 << 20
#: Bytes of texts of one task at best, and of those whose postings are packed together; postings of a term among these from which on it has tiers; entries of arrays in one batch.
TEXT_BYTES, GROUP_BYTES, TIERED, BATCH_ENTRIES = 8 << 20, 16 << 20, 64, 1 << 17
#: Segments of one level that are merged; tiers of a term; postings that a search reads without looking at tiers; terms whose counts an index remembers; ids that a search names in a filter.
FAN, TIERS, SMALL, REMEMBERED, NAMED = 4, 16, 100_000, 10_000, 1000


#: Columns of rows on their way to a segment, beside id and carried ones: a block of postings of one term, or, with a null term, one text.
RAW = "term string, tier int, most double, mean double, length array<int>, ends array<int>, positions array<int>, terms string"


def blocks(df: DataFrame, id_column: str, *texts: str, carry: Sequence[str] = (), mean: float | None = None) -> DataFrame:
    """Blocks of postings of some texts each, and a row with a null term for each text.

    A block is of one term and tier: id, carried columns and length are arrays with an entry a posting; positions has the places of one
    posting after another, ends where each posting's places end.  most is the highest weight in the block at the length ``mean``, by default
    that of the texts met together.  The row of a text has its id and length alone in their arrays, and its distinct terms, joined by a space.
    Positions go on from column to column with a gap, so that no phrase goes over its edge.  Null texts are empty.
    """
    rows = df.select(F.col(id_column).alias("id"), *[F.col(f"`{c}`") for c in carry], F.array(*[F.col(t) for t in texts]).alias("_texts"))
    kept = ["id", *carry]
    schema = ", ".join(f"`{c}` array<{t}>" for c, t in rows.select(*kept).dtypes) + f", {RAW}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for part in _together(batches):
            if len(codes) > 1 << 19:
                codes = _Codes()
            found, lengths, total = [], np.zeros(len(part), np.int64), []
            for i, columns in enumerate(part.column("_texts").to_pylist()):
                at = 0
                for text in columns:
                    got = words(text)
                    found.extend(map(codes.__getitem__, got))
                    total.append((i, at, len(got)))
                    at += len(got) + 1
                    lengths[i] += len(got)
            runs = np.array(total, np.int64).reshape(-1, 3)
            count = runs[:, 2]
            owner = np.repeat(runs[:, 0], count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - runs[:, 1], count)
            term = np.array(found, np.int64)
            del found
            owner, place, term = _ordered(term, owner, place)
            first = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(term) != 0))) if len(owner) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(owner)))
            owner, term = owner[first], term[first]
            middle = mean or (float(lengths.mean()) if len(part) else 0.0) or 1.0
            tier, weight = _tiers(tf, lengths[owner], middle)
            # what few texts hold stays in one block, in its best tier
            begins = np.flatnonzero(np.append(True, np.diff(term) != 0)) if len(term) else np.zeros(0, np.int64)
            held = np.diff(np.append(begins, len(term)))
            if len(begins):
                tier = np.where(np.repeat(held, held) < TIERED, np.repeat(np.minimum.reduceat(tier, begins), held), tier)
            # each text's terms, in the order of the texts
            of_text = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[of_text], np.arange(len(part) + 1))
            known = pa.array(codes.known, pa.string())
            for start, stop in _pieces(edges):
                here = known.take(pa.array(term[of_text[edges[start] : edges[stop]]]))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges[start : stop + 1] - edges[start], pa.int32()), here), " ")
                alone = pa.array(np.arange(stop - start + 1), pa.int32())
                nothing = lambda kind, n=stop - start: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.ListArray.from_arrays(alone, part.column(c).slice(start, stop - start)) for c in kept], nothing(pa.string()), nothing(pa.int32()), nothing(pa.float64()), nothing(pa.float64()),
                     pa.ListArray.from_arrays(alone, pa.array(lengths[start:stop], pa.int32())), nothing(pa.list_(pa.int32())), nothing(pa.list_(pa.int32())), joined],
                    names=[*kept, *NAMES],
                )
            # by term, tier and text
            order = np.argsort(term * TIERS + tier, kind="stable")
            spots = np.repeat(first[order] - (np.cumsum(tf[order]) - tf[order]), tf[order]) + np.arange(len(place))
            columns = [part.column(c).take(pa.array(owner[order])) for c in kept]
            yield from _packed(kept, columns, term[order], known, tier[order], weight[order], middle, lengths[owner[order]], tf[order], place[spots])

    return rows.mapInArrow(run, schema)


#: The names in RAW.
NAMES = [x.split(" ")[0] for x in RAW.split(", ")]


class _Codes(dict):
    """Of a word, the number of its stem; ``known``: the stems."""

    def __init__(self) -> None:
        self.known: list[str] = []
        self.stems: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        s = stem(word)
        code = self.stems.get(s)
        if code is None:
            code = self.stems[s] = len(self.known)
            self.known.append(s)
        self[word] = code
        return code


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some GROUP_BYTES: the more texts a block is of, the fewer rows go to a segment."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, len(batch) * GROUP_BYTES // (4 * max(1, batch.nbytes)))
        for start in range(0, len(batch), rows):
            part = batch.slice(start, rows)
            held.append(part)
            size += part.nbytes
            if size >= GROUP_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _ordered(term: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, place and term by term, owner and place; packed into one number each where they fit."""
    bits = [int(x.max(initial=0)).bit_length() for x in (term, owner, place)]
    if sum(bits) > 63:
        order = np.lexsort((place, owner, term))
        return owner[order], place[order], term[order]
    key = np.sort((term << (bits[1] + bits[2])) | (owner << bits[2]) | place)
    return (key >> bits[2]) & ((1 << bits[1]) - 1), key & ((1 << bits[2]) - 1), key >> (bits[1] + bits[2])


def _tiers(tf: np.ndarray, length: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    weight = tf / (tf + K1 * (1 - B + B * length / mean))
    return np.minimum(np.floor(TIERS * (1 - weight)), TIERS - 1).astype(np.int64), weight


def _pieces(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold some BATCH_ENTRIES entries each, or one row."""
    start, rows = 0, len(edges) - 1
    while start < rows:
        stop = int(np.searchsorted(edges, edges[start] + BATCH_ENTRIES, "right")) - 1
        stop = min(max(stop, start + 1), start + BATCH_ENTRIES // 8)
        yield start, min(stop, rows)
        start = min(stop, rows)


def _packed(kept: list[str], columns: list[pa.Array], term: np.ndarray, known: pa.Array, tier: np.ndarray, weight: np.ndarray, mean: float, length: np.ndarray, tf: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that are in order of term (a number in ``known``) and tier."""
    if not len(term):
        return
    begins = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(tier) != 0)))
    edges = np.append(begins, len(term))
    until = np.append(0, np.cumsum(tf))  # in place, where postings begin
    ends = until[1:] - np.repeat(until[begins], np.diff(edges))
    most = np.maximum.reduceat(weight, begins)
    for start, stop in _pieces(edges):
        low, high = edges[start], edges[stop]
        of = pa.array(edges[start : stop + 1] - low, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*[pa.ListArray.from_arrays(of, c.slice(low, high - low)) for c in columns], known.take(pa.array(term[begins[start:stop]])), pa.array(tier[begins[start:stop]], pa.int32()), pa.array(most[start:stop]), pa.array(np.full(stop - start, mean)),
             pa.ListArray.from_arrays(of, pa.array(length[low:high], pa.int32())), pa.ListArray.from_arrays(of, pa.array(ends[low:high], pa.int32())),
             pa.ListArray.from_arrays(pa.array(until[edges[start : stop + 1]] - until[low], pa.int32()), pa.array(place[until[low] : until[high]], pa.int32())), pa.nulls(stop - start, pa.string())],
            names=[*kept, *NAMES],
        )


def _repacked(rows: DataFrame, kept: list[str], schema: str, mean: float) -> DataFrame:
    """Blocks of postings (id, carried columns, length, term, tf, positions) that are in order of term, tier and id within their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term = batch.column("term").dictionary_encode()
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            length, tf = number("length"), number("tf")
            _, weight = _tiers(tf, length, mean)
            code = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            place = batch.column("positions").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield from _packed(kept, [batch.column(c) for c in kept], code, term.dictionary, number("tier"), weight, mean, length, tf, place)

    return rows.mapInArrow(run, schema)


def _shifted(places: Column, step: int) -> Column:
    return F.transform(places, lambda p: p - step)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _weight(tf: Column, length: Column, mean: float) -> Column:
    """The share of its greatest weight that a term has in a row."""
    return tf / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over tasks for its texts, each of enough of them to pack."""
    size = expected_bytes(df)
    tasks = max(size // TEXT_BYTES, min(size // TASK_BYTES + 1, 2 * df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(tasks) if TASK_BYTES < size < LARGE else df


@dataclass(frozen=True)
class Segment:
    """One batch of rows: folder, level (how often it was merged), mean length when written, whether it has tombstones."""

    name: str
    level: int
    mean: float
    dead: bool


@dataclass(frozen=True)
class KeywordIndex:
    """Segments below ``path`` in ``buckets`` folders each; ``rows`` and ``total`` (terms) are those of all rows that count."""

    spark: SparkSession
    path: str
    buckets: int
    rows: int
    total: int
    version: int
    segments: tuple[Segment, ...]
    id_column: str
    texts: tuple[str, ...]
    carry: tuple[str, ...]
    schema: str
    _counts: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def mean(self) -> float:
        return self.total / self.rows if self.rows else 0.0

    # ---- writing ------------------------------------------------------------------------

    @classmethod
    def build(cls, df: DataFrame, id_column: str, *texts: str, carry: Sequence[str] = (), path: str | None = None) -> KeywordIndex:
        """An index of ``df`` alone, at a new path; columns named in ``carry`` stand in postings."""
        spark = df.sparkSession
        kept = df.select(F.col(id_column).alias("id"), *[F.col(f"`{c}`") for c in carry])
        schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
        buckets = max(LEAST_BUCKETS, expected_bytes(df) // BUCKET_BYTES)
        empty = cls(spark, path or fresh_dir(spark, "keyword-index"), buckets, 0, 0, 0, (), id_column, tuple(texts), tuple(carry), schema)
        return empty.update(df)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeywordIndex:
        """The last published version below ``path``."""
        paths = spark._jvm.org.apache.hadoop.fs.Path
        folder = paths(f"{path}/manifest")
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        versions = [int(n) for n in names if n.isdigit()]
        if not versions:
            raise FileNotFoundError(f"no index in {path}")
        text = spark.read.text(f"{path}/manifest/{max(versions)}").first()["value"]
        held = json.loads(text)
        segments = tuple(Segment(**s) for s in held.pop("segments"))
        return cls(spark, path, segments=segments, **{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})

    def _publish(self) -> KeywordIndex:
        """Writes the manifest of this version; of two writers of one version the second fails."""
        held = {k: getattr(self, k) for k in ("buckets", "rows", "total", "version", "id_column", "texts", "carry", "schema")}
        held["segments"] = [vars(s) for s in self.segments]
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        fresh, final = paths(f"{self.path}/draft-{uuid.uuid4().hex}"), paths(f"{self.path}/manifest/{self.version}")
        files = fresh.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(final.getParent())
        out = files.create(fresh, False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if files.exists(final) or not files.rename(fresh, final):
            raise OSError(f"version {self.version} of the index is published already")
        return self

    def _at(self, segment: Segment | str, table: str) -> str:
        return f"{self.path}/{segment if isinstance(segment, str) else segment.name}/{table}"

    def _id_bucket(self, c: str | Column = "id") -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, size: int | None, mean: float | None = None) -> tuple[tuple[int, int], float]:
        """postings, terms and forward of a segment from rows as :func:`blocks` makes them; ((rows, their terms), mean length used).

        Rows are written once, dealt to slices: those with a term by its bucket, those of texts by the bucket of the id.  A slice is sorted into
        its folders and then deleted, so shuffle files are those of one slice.  ``size``: bytes of the texts, where known.  The mean is that of the
        rows unless one is given or they are few beside those of the index.
        """
        raw = self._at(name, "rows")
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        slices = self._slices(expected_bytes(rows) if size is None else size)
        id_bucket = self._id_bucket(F.get("id", 0))
        dealt = F.when(F.col("term").isNull(), slices + id_bucket % slices).otherwise(bucket % slices)
        rows.withColumn("slice", dealt).write.option("compression", "zstd").partitionBy("slice").parquet(raw)
        held = self.spark.read.schema(f"{self._arrays()}, {RAW}, slice int").parquet(raw)
        if size is None:
            size = expected_bytes(held)
        n, total = held.where(F.col("slice") >= slices).agg(F.count(F.lit(1)), F.sum(F.get("length", 0))).first()
        if mean is None:
            mean = (total or 0) / n or 1.0 if n and self.rows <= 10 * n else self.mean or 1.0
        parquet = lambda df, table: df.write.option("compression", "zstd").mode("append").partitionBy("bucket" if table == "postings" else "id_bucket").parquet(self._at(name, table))
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-size // SORT_BYTES // slices))
        for i in range(slices):
            part = held.where(F.col("slice") == i).drop("slice", "terms").withColumn("bucket", bucket)
            if size >= SPREAD_BYTES:
                # a hot term goes over several files by its tiers
                part = part.repartition(tasks, "term", "tier")
            else:
                part = part.repartition(-(-self.buckets // slices), "bucket")
            parquet(part.sortWithinPartitions("bucket", "term", "tier", F.get("id", 0)), "postings")
            self._remove(f"{raw}/slice={i}")
            bare = held.where(F.col("slice") == slices + i).select(F.get("id", 0).alias("id"), F.get("length", 0).alias("length"), "terms", id_bucket.alias("id_bucket")).repartition(-(-self.buckets // slices), "id_bucket")
            terms = F.when(F.col("terms") == "", F.array().cast("array<string>")).otherwise(F.split("terms", " "))
            parquet(bare.sortWithinPartitions("id_bucket", "id").select("id", "length", terms.alias("terms"), F.lit(1).cast("long").alias("rows"), "id_bucket"), "forward")
            self._remove(f"{raw}/slice={slices + i}")
        self._remove(raw)
        found = self.spark.read.schema(self._schema()).parquet(self._at(name, "postings"))
        # what the highest weight of a block is at most, at this mean
        most = 1 / (1 + (1 - F.col("most")) / F.col("most") * F.least(F.lit(1.0), F.col("mean") / F.lit(mean)))
        terms = found.groupBy("term", "tier").agg(F.sum(F.size("length")).alias("n"), F.max(most).alias("most"))
        terms.repartition(max(1, size // BUCKET_BYTES), "term").sortWithinPartitions("term", "tier").write.parquet(self._at(name, "terms"))
        return (n, total or 0), mean

    def _slices(self, size: int) -> int:
        return max(1, min(SLICES, self.buckets, size // SLICE_BYTES))

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def update(self, rows: DataFrame | None = None, deleted: DataFrame | None = None) -> KeywordIndex:
        """The index after ``rows`` (columns as at :meth:`build`) take the place of those with their ids, and rows of ``deleted`` (id) go.

        Reads the new rows, and of earlier segments the forward folders and tombstones that the touched ids may be in.
        This version stays as it is: readers of it go on.
        """
        name = f"segment-{self.version + 1}-{uuid.uuid4().hex[:8]}"
        added = gone = (0, 0)
        touched, mean = None, self.mean or 1.0
        if self.segments:
            parts = [r.select(F.col(c).alias("id")) for r, c in ((rows, self.id_column), (deleted, "id")) if r is not None]
            if not parts:
                return self
            ids = self._at(name, "touched")
            reduce(DataFrame.union, parts).where("id IS NOT NULL").distinct().write.parquet(ids)
            touched = self.spark.read.schema(self._id_schema()).parquet(ids)
        if rows is not None:
            with dropping_shuffles(self.spark):
                added, mean = self._write(name, blocks(_spread(rows), self.id_column, *self.texts, carry=self.carry, mean=self.mean or None), expected_bytes(rows))
        if touched is not None:
            gone = self._bury(name, touched)
            self._remove(self._at(name, "touched"))
        if rows is None:
            self._write_nothing(name)
        segments = (*self.segments, Segment(name, 0, mean, touched is not None))
        grown = replace(self, rows=self.rows + added[0] - gone[0], total=self.total + added[1] - gone[1], version=self.version + 1, segments=segments, _counts={})
        return grown._merged()._publish()

    def _id_schema(self) -> str:
        return self.schema.split(", `")[0]

    def _arrays(self) -> str:
        """The schema of id and carried columns in blocks."""
        return ", `".join("` array<".join(x.rsplit("` ", 1)) + ">" for x in self.schema.split(", `"))

    def _columns(self) -> list[str]:
        return ["id", *self.carry]

    def _write_nothing(self, name: str) -> None:
        self._write(name, self.spark.createDataFrame([], f"{self._arrays()}, {RAW}"), 0, 1.0)

    def _forward(self, buckets: list[int] | None = None) -> DataFrame:
        """(id, length, terms, rows, at) of all segments that count, at being the segment's place."""
        found = None
        for at, segment in enumerate(self.segments):
            rows = self.spark.read.schema(f"{self._id_schema()}, length int, terms array<string>, rows long, id_bucket int").parquet(self._at(segment, "forward"))
            if buckets is not None:
                rows = rows.where(F.col("id_bucket").isin(buckets))
            rows = rows.drop("id_bucket").withColumn("at", F.lit(at))
            found = rows if found is None else found.union(rows)
        return self._living(found)

    def _dead(self) -> DataFrame | None:
        """(dead_id, until): rows of that id in segments before ``until`` no longer count."""
        found = None
        for at, segment in enumerate(self.segments):
            if segment.dead:
                rows = self.spark.read.schema(self._id_schema()).parquet(self._at(segment, "dead")).select(F.col("id").alias("dead_id"), F.lit(at).alias("until"))
                found = rows if found is None else found.union(rows)
        return None if found is None else found.groupBy("dead_id").agg(F.max("until").alias("until"))

    def _living(self, rows: DataFrame) -> DataFrame:
        dead = self._dead()
        return rows if dead is None else rows.join(dead, (F.col("id") == F.col("dead_id")) & (F.col("at") < F.col("until")), "left_anti")

    def _bury(self, name: str, touched: DataFrame) -> tuple[int, int]:
        """Writes dead and lost of a new segment; (rows, terms) that no longer count."""
        buckets = sorted(r[0] for r in touched.select(self._id_bucket().alias("b")).distinct().collect())  # at most one row a bucket
        old = self._forward(buckets).join(touched, "id", "left_semi")
        held = self._at(name, "old")
        old.write.parquet(held)
        old = self.spark.read.schema(f"{self._id_schema()}, length int, terms array<string>, rows long, at int").parquet(held)
        old.select("id").distinct().write.parquet(self._at(name, "dead"))
        names = F.create_map(*[F.lit(x) for i, s in enumerate(self.segments) for x in (i, s.name)])
        old.select(names[F.col("at")].alias("segment"), F.explode("terms").alias("term")).groupBy("segment", "term").agg(F.count(F.lit(1)).alias("n")).coalesce(max(1, self.buckets // 8)).write.parquet(self._at(name, "lost"))
        n, total = old.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("length"))).first()
        self._remove(held)
        return n or 0, total or 0

    def _merged(self) -> KeywordIndex:
        """While the last ``FAN`` segments have one level, they become one of the next level."""
        held = self
        while len(held.segments) >= FAN and len({s.level for s in held.segments[-FAN:]}) == 1:
            held = held.merge(len(held.segments) - FAN)
        return held

    def merge(self, start: int = 0) -> KeywordIndex:
        """Segments from ``start`` on as one, without rows that no longer count; not yet published."""
        merged = self.segments[start:]
        name = f"segment-{self.version}-{uuid.uuid4().hex[:8]}"
        mean = self.mean or 1.0
        tier = F.least(F.floor(TIERS * (1 - _weight(F.col("tf"), F.col("length"), mean))), F.lit(TIERS - 1)).cast("int")
        living = self._living(self._postings(range(start, len(self.segments)))).select(*[F.col(f"`{c}`") for c in self._columns()], "length", "term", "tf", "positions", tier.alias("tier"))
        kept = living.repartition(max(self.buckets, self.spark.sparkContext.defaultParallelism), "term", "tier").sortWithinPartitions("term", "tier", "id")
        kept = _repacked(kept, self._columns(), f"{self._arrays()}, {RAW}", mean)
        # one row without a term for each text, as blocks() makes them
        each = self._forward().where(F.col("at") >= start).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_r"))
        made = {"id": F.array("id"), "length": F.array("length"), "terms": F.when(F.col("_r") == 1, F.array_join("terms", " ")).otherwise("")}
        bare = each.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kept.schema])
        with dropping_shuffles(self.spark):
            self._write(name, kept.unionByName(bare), None, mean)
        older = [s.name for s in self.segments[:start]]
        dead = bool(older) and any(s.dead for s in merged)
        if dead:
            tombs = [self.spark.read.schema(self._id_schema()).parquet(self._at(s, "dead")) for s in merged if s.dead]
            reduce(DataFrame.union, tombs).distinct().write.parquet(self._at(name, "dead"))
            lost = [self.spark.read.schema(LOST).parquet(self._at(s, "lost")) for s in merged if s.dead]
            reduce(DataFrame.union, lost).where(F.col("segment").isin(older)).groupBy("segment", "term").agg(F.sum("n").alias("n")).write.parquet(self._at(name, "lost"))
        level = max(s.level for s in merged) + 1
        return replace(self, segments=(*self.segments[:start], Segment(name, level, self.mean or 1.0, dead)), _counts={})

    def compact(self) -> KeywordIndex:
        """The next version, of one segment."""
        return self if len(self.segments) < 2 else replace(self, version=self.version + 1).merge()._publish()

    # ---- reading ------------------------------------------------------------------------

    def _schema(self) -> str:
        return f"{self._arrays()}, {RAW.rsplit(', ', 1)[0]}, bucket int"

    def _blocks(self, places) -> DataFrame:
        found = None
        for at in places:
            rows = self.spark.read.schema(self._schema()).parquet(self._at(self.segments[at], "postings")).withColumn("at", F.lit(at))
            found = rows if found is None else found.union(rows)
        return found if found is not None else self.spark.createDataFrame([], f"{self._schema()}, at int")

    def _postings(self, places, wanted: DataFrame | None = None) -> DataFrame:
        """(tier, at, id, carried columns, length, term, tf, positions) of some segments; ``wanted`` (term): of those terms alone."""
        rows = self._blocks(places)
        return self._each(rows if wanted is None else rows.join(wanted, "term", "left_semi"))

    def _each(self, rows: DataFrame, positions: bool = True) -> DataFrame:
        """The postings of blocks."""
        begin = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
        held = [F.col(f"`{c}`") for c in [*self._columns(), "length"]]
        rows = rows.select("term", "tier", "at", *held, F.transform("ends", lambda e, i: e - begin(i)).alias("tf"), *([F.transform("ends", lambda e, i: F.slice("positions", begin(i) + 1, e - begin(i))).alias("positions")] if positions else []))
        return rows.select("term", "tier", "at", F.inline(F.arrays_zip(*held, "tf", *["positions"] * positions)))

    def _read(self, wanted: Sequence[str], positions: bool = True) -> DataFrame:
        """Postings of some terms that count, with tier: only their folders and row groups are read."""
        at = {_signed(xxhash.xxh64_intdigest(t.encode(), 42)) % self.buckets for t in wanted}  # as Spark's xxhash64
        rows = self._blocks(range(len(self.segments))).where(F.col("bucket").isin(sorted(at)) & F.col("term").isin(list(wanted)))
        return self._living(self._each(rows, positions)).drop("at")

    def postings(self, wanted: Sequence[str], positions: bool = True) -> DataFrame:
        """Postings of some terms."""
        return self._read(wanted, positions).drop("tier")

    def tiers(self, wanted: Sequence[str]) -> dict[str, list[tuple[int, int, float]]]:
        """For each term, (tier, postings, highest weight) from the best tier on; from the dictionaries alone, and remembered.

        Postings count rows that tombstones have taken since; :meth:`frequencies` does not.
        """
        self._look_up(wanted)
        return {t: self._counts[t][1] for t in wanted}

    def frequencies(self, wanted: Sequence[str]) -> dict[str, int]:
        """How many rows hold each term, from the dictionaries alone."""
        self._look_up(wanted)
        return {t: self._counts[t][0] for t in wanted}

    def _look_up(self, wanted: Sequence[str]) -> None:
        missing = [t for t in dict.fromkeys(wanted) if t not in self._counts]
        if not missing:
            return
        if len(self._counts) > REMEMBERED:
            kept = {t: self._counts[t] for t in wanted if t in self._counts}
            self._counts.clear()
            self._counts.update(kept)
        found = None
        for at, segment in enumerate(self.segments):
            rows = self.spark.read.schema("term string, tier int, n long, most double").parquet(self._at(segment, "terms")).withColumn("at", F.lit(at))
            found = rows if found is None else found.union(rows)
            if segment.dead:
                lost = self.spark.read.schema(LOST).parquet(self._at(segment, "lost")).where(F.col("segment").isin([s.name for s in self.segments]))
                found = found.union(lost.select("term", F.lit(-1).alias("tier"), -F.col("n"), F.lit(0.0), F.lit(at)))
        counts = {t: [0, {}] for t in missing}
        for r in found.where(F.col("term").isin(missing)).collect() if found is not None else ():  # a few rows a term and segment
            held = counts[r["term"]]
            held[0] += r["n"]
            if r["tier"] >= 0:
                # the weight that the mean length of today gives at most
                drift = min(1.0, self.segments[r["at"]].mean / self.mean) if self.mean else 1.0
                rest = (1 - r["most"]) / r["most"] * drift
                n, most = held[1].get(r["tier"], (0, 0.0))
                held[1][r["tier"]] = (n + r["n"], max(most, 1 / (1 + rest)))
        for t, (n, of_tier) in counts.items():
            # a tier's bound holds for those below it too: their steps may be of another mean length
            best, listed = 0.0, []
            for tier in sorted(of_tier, reverse=True):
                best = max(best, of_tier[tier][1])
                listed.append((tier, of_tier[tier][0], best))
            self._counts[t] = (n, listed[::-1])

    def _phrase(self, found: DataFrame, phrase: Sequence[str]) -> DataFrame:
        """Rows that hold the phrase, as postings with tf the number of its places."""
        if len(phrase) == 1:
            return found.where(F.col("term") == phrase[0]).drop("term", "positions")
        kept = [c for c in found.columns if c not in ("term", "tf", "positions")]
        words_ = list(dict.fromkeys(phrase))
        places = [F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"_p{i}") for i, w in enumerate(words_)]
        rows = found.where(F.col("term").isin(words_)).groupBy(*kept).agg(*places)
        starts = F.col(f"_p{words_.index(phrase[0])}")
        for step, w in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, _shifted(F.col(f"_p{words_.index(w)}"), step))
        return rows.select(*kept, F.size(starts).alias("tf")).where("tf > 0")

    def _idf(self, n: int) -> float:
        return max(float(np.log((self.rows - n + 0.5) / (n + 0.5))), IDF_FLOOR)

    def hits(self, query: str) -> list[tuple[tuple[str, ...], DataFrame]]:
        """For each distinct phrase of a search text, the rows that hold it (id, carried columns, length, tf)."""
        phrases = list(dict.fromkeys(tuple(p) for p in query_phrases(query)))
        if not phrases or not self.rows:
            return []
        found = self.postings([*dict.fromkeys(t for p in phrases for t in p)], any(len(p) > 1 for p in phrases))
        return [(p, self._phrase(found, p)) for p in phrases]

    def bm25(self, query: str) -> DataFrame:
        """(id, carried columns, score) of the rows that hold a phrase of ``query``; a higher score is better."""
        phrases = self.hits(query)
        if not phrases:
            return self.empty()
        counts = {i: n for i, n in enumerate(self.frequencies([p[0] for p, _ in phrases]).values())} if all(len(p) == 1 for p, _ in phrases) else None
        marked = reduce(DataFrame.unionByName, [h.withColumn("_phrase", F.lit(i)) for i, (_, h) in enumerate(phrases)])
        if counts is None:
            # phrases of several terms stand in no dictionary; one row a phrase comes back: how many rows hold it
            counts = {r[0]: r[1] for r in marked.groupBy("_phrase").agg(F.count(F.lit(1))).collect()}
        weight = F.lit(0.0)
        for i, n in counts.items():
            weight = F.when(F.col("_phrase") == i, F.lit(self._idf(n))).otherwise(weight)
        part = weight * (K1 + 1) * _weight(F.col("tf"), F.col("length"), self.mean)
        kept = [c for c in marked.columns if c not in ("length", "tf", "_phrase")]
        return marked.groupBy(*kept).agg(F.round(F.sum(part), 9).alias("score"))

    def top_k(self, query: str, limit: int) -> DataFrame:
        """The ``limit`` best rows of :meth:`bm25`, ties by id; of hot terms only the tiers that can matter are read.

        The best tiers give the limit-th score so far.  Tiers are then read down to where all that is unread of
        the query's terms together stays below it: rows first met there cannot come up.  What rows met above have further
        down is added by their ids.  Phrases of several terms are read whole.
        """
        phrases = list(dict.fromkeys(tuple(p) for p in query_phrases(query)))
        asked = [p[0] for p in phrases]
        if not self.rows or not phrases or any(len(p) > 1 for p in phrases) or limit < 1:
            return top(self.bm25(query), max(limit, 0))
        tiers, counts = self.tiers(asked), self.frequencies(asked)
        if sum(counts.values()) <= SMALL:
            return top(self.bm25(query), limit)
        weights = {t: self._idf(counts[t]) * (K1 + 1) for t in asked}
        cut = {}
        for t in asked:
            cut[t], seen = 0, 0
            while cut[t] < len(tiers[t]) and seen < max(4 * limit, 256):
                seen += tiers[t][cut[t]][1]
                cut[t] += 1
        unread = lambda t: weights[t] * tiers[t][cut[t]][2] if cut[t] < len(tiers[t]) else 0.0
        best = [r["score"] for r in self._scored(asked, weights, self._upper(tiers, cut)).orderBy(F.col("score").desc()).limit(limit).select("score").collect()]
        floor = best[-1] if len(best) == limit else 0.0
        while sum(map(unread, asked)) >= floor - 1e-8 and any(cut[t] < len(tiers[t]) for t in asked):
            # the term that gives away most of the bound for each posting read
            t = max((t for t in asked if cut[t] < len(tiers[t])), key=lambda t: unread(t) / (1 + tiers[t][cut[t]][1]))
            cut[t] += 1
        upper = self._upper(tiers, cut)
        if len(asked) == 1 or upper is None or all(cut[t] == len(tiers[t]) for t in asked):
            return top(self._scored(asked, weights, upper), limit)
        hope = self._scored(asked, weights, upper).where(F.col("score") >= floor - 1e-8 - sum(map(unread, asked))).select(F.col("id").alias("_id"))
        some = [r["_id"] for r in hope.limit(NAMED + 1).collect()]
        if len(some) <= NAMED:
            return top(self._scored(asked, weights, F.col("id").isin(some)), limit)
        return top(self._scored(asked, weights, None, hope.distinct()), limit)

    def _upper(self, tiers: dict, cut: dict[str, int]) -> Column | None:
        """The tiers above the cuts."""
        found = [(F.col("term") == t) & (F.col("tier") <= tiers[t][cut[t] - 1][0]) for t in cut if cut[t]]
        return reduce(lambda a, b: a | b, found) if found else None

    def _scored(self, asked: Sequence[str], weights: dict[str, float], where: Column | None, ids: DataFrame | None = None) -> DataFrame:
        rows = self._read(asked, False)
        if where is not None:
            rows = rows.where(where)
        if ids is not None:
            rows = rows.join(ids, F.col("id") == F.col("_id"), "left_semi")
        weight = F.lit(0.0)
        for t, w in weights.items():
            weight = F.when(F.col("term") == t, F.lit(w)).otherwise(weight)
        kept = [c for c in rows.columns if c not in ("length", "term", "tf", "positions", "tier")]
        return rows.groupBy(*kept).agg(F.round(F.sum(weight * _weight(F.col("tf"), F.col("length"), self.mean)), 9).alias("score"))

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.schema}, score double")


#: Postings of a term that a segment lost to tombstones.
LOST = "segment string, term string, n long"


def phrase_rows(index: KeywordIndex, phrase: str) -> DataFrame:
    """(id, hits) of rows in which the phrase's terms stand side by side; none for a phrase without terms."""
    asked = [t for p in query_phrases(phrase) for t in p]
    if not asked:
        return index.empty().select("id", F.lit(0).cast("long").alias("hits"))
    return index._phrase(index.postings(list(dict.fromkeys(asked))), asked).select("id", F.col("tf").cast("long").alias("hits"))


def top(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), "id").limit(limit)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """(id, score, rank): the best ``limit`` rows; the rank window stands on those alone."""
    return top(scored, limit).withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "id")).cast("long"))


def best_per_thread(scored: DataFrame, thread: str = "thread_id") -> DataFrame:
    """The best row of each thread, by score then id."""
    place = F.row_number().over(W.partitionBy(thread).orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("_place", place).where("_place = 1").drop("_place")


def like_match(text: str, columns: Sequence[str]) -> Column:
    """Whether one of the columns contains ``text``, case aside; % and _ in it are wild as in LIKE."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns])


def like_fallback(df: DataFrame, text: str, columns: Sequence[str], newest: str, id_column: str, limit: int) -> DataFrame:
    """Rows with ``text`` in one of the columns, newest first."""
    return df.where(like_match(text, columns)).orderBy(F.col(newest).desc(), id_column).limit(limit)

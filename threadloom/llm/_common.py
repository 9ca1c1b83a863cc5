"""Pieces that several operators share: scratch tables, text buffers, words, ragged arrays."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker; one longer document is a slice of its own.
SLICE_BYTES = 2 << 20

#: ASCII white space, [\x20\x09-\x0D].
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and leaves all other bytes, so UTF-8 stays valid.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Intermediate tables, written as Parquet below :func:`shared_dir`.

    A written table cuts the lineage and survives lost executors.  Tables that a lazy
    result still reads stay until the process ends; others go with :meth:`drop`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._forget)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_parts(self, parts: list[DataFrame], name: str) -> DataFrame:
        """One table of ``parts``, which are made and written one after the other."""
        for k, df in enumerate(parts):
            self.save(df, f"{name}/{k}")
        return self.spark.read.schema(parts[0].schema).parquet(*(self.path(f"{name}/{k}") for k in range(len(parts))))

    def drop(self, name: str = "") -> None:
        path = _hadoop_path(self.spark, self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _forget(self) -> None:
        try:
            self.drop()
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass


#: From here on a size is the optimizer's way to say that it knows none.
UNKNOWN_SIZE = 1 << 60


def size_hint(df: DataFrame) -> int:
    """Bytes that the optimizer expects of ``df``; for files, their size; where it knows none, the bytes of the texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN_SIZE:
        return size
    return df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def buckets_for(df: DataFrame, bytes_each: int, least: int = 12) -> int:
    """Number of hash buckets, in proportion to the input, so that one bucket stays bounded."""
    return int(max(least, size_hint(df) // bytes_each + 1))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Row slices of ``batch`` with at most ``limit`` bytes of text each (one row at least)."""
    text = batch.column(column)
    if len(batch) == 0:
        return
    lengths = _lengths(text)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)
    release()


@functools.cache
def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Hands memory that is free back to the system: Python workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    if (trim := _trimmer()) is not None:
        trim(0)


def _lengths(text: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and offsets (n + 1); null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "")
    n = len(text)
    wide = pa.types.is_large_string(text.type)
    _, off, data = text.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, dictionary-encoded.

    codes: a number for each word, equal for equal words; vocabulary: the distinct words
    as a binary Arrow array; first: for each text the index of its first word (n + 1);
    starts, ends: byte positions in the slice's buffer.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None):
        """cuts: a mask of bytes at which a word is cut, a new one beginning there."""
        solid = ~WHITE[data]
        before = np.ones(len(data), dtype=bool)
        before[1:] = ~solid[:-1]
        if cuts is not None:
            before |= cuts
        edges = offsets[:-1]
        before[edges[edges < len(data)]] = True
        self.starts = np.flatnonzero(solid & before)
        after = np.ones(len(data), dtype=bool)
        after[:-1] = ~solid[1:]
        if cuts is not None:
            after[:-1] |= cuts[1:]
        edges = offsets[1:] - 1
        after[edges[(edges >= 0) & (edges < len(data))]] = True
        self.ends = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        packed = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(lengths, out=packed[1:])
        words = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(packed), pa.py_buffer(data[solid])])
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary = coded.dictionary
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.codes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums before each position, and the total at the end."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0]+lengths[0]-1, starts[1] .., one after the other."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


class SpanPool:
    """A bounded cache from a byte string to a run of integers, held in one flat array.

    ``encode(list[bytes]) -> (flat, lengths)`` is asked for strings that are not held.
    The cache empties itself when it holds ``most`` strings; results never depend on it.
    """

    def __init__(self, encode, most: int = 400_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        if len(self.slots) > self.most:
            self._clear()
        slots = self.slots
        found = list(map(slots.get, words))
        missing = [i for i, s in enumerate(found) if s is None]
        if missing:
            new = [words[i] for i in missing]
            flat, lengths = self.encode(new)
            if self.used + len(flat) > len(self.flat):
                grown = np.zeros(2 * (self.used + len(flat)), np.int32)
                grown[: self.used] = self.flat[: self.used]
                self.flat = grown
            self.flat[self.used : self.used + len(flat)] = flat
            n = len(self.starts)
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used += len(flat)
            slots.update(zip(new, range(n, n + len(new)), strict=True))
            for k, i in enumerate(missing, n):
                found[i] = k
        return np.asarray(found, np.int64)

    def expand(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ``slots`` one after the other, and their lengths."""
        lengths = self.lengths[slots]
        return self.flat[ragged(self.starts[slots], lengths)], lengths


def own_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` that an operator's own result columns do not replace."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names from ``stems`` that ``df`` does not have."""
    taken, found = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name in taken:
            name += "_"
        found.append(name)
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_text(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

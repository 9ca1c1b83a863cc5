"""Substring search by index: LIKE patterns find rows by their trigrams, and only candidates' texts are read and compared.

An index holds, for each row, the distinct trigrams of its texts in lower case, in folders by a hash of the trigram and
sorted by it, and the rows themselves in folders by a hash of their id.  A pattern's literal runs of three ASCII characters
or more give trigrams that each match must hold; candidates hold all of them, and are compared with the pattern itself.
A pattern without such a run is compared with all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.lookups import people, ranked_contacts
from threadloom.sources.shared import expected_bytes, fresh_dir, spread

#: Bytes of rows in a folder, fewest folders, trigrams of a pattern that are looked up, candidates that are named in a filter.
FOLDER_BYTES, LEAST_FOLDERS, LOOKED_UP, NAMED = 256 << 20, 8, 12, 1000


def required_trigrams(pattern: str) -> list[str]:
    """Trigrams that every text LIKE ``%pattern%`` holds in lower case: those of its ASCII runs between wild cards and escapes."""
    runs = re.findall(r"[^%_\\\u0080-\U0010ffff]{3,}", pattern)
    return list(dict.fromkeys(run.lower()[i : i + 3] for run in runs for i in range(len(run) - 2)))


def _trigrams(text: str) -> list[str]:
    """Distinct trigrams of ASCII characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return []
    codes = (points[:-2] << 14) | (points[1:-1] << 7) | points[2:]
    plain = points < 128
    found = np.unique(codes[plain[:-2] & plain[1:-1] & plain[2:]]).tolist()
    return [chr(c >> 14) + chr((c >> 7) & 127) + chr(c & 127) for c in found]


@dataclass(frozen=True)
class SubstringIndex:
    """Trigrams and rows below ``path``; ``texts`` are the columns that patterns are compared with."""

    spark: SparkSession
    path: str
    folders: int
    id_column: str
    texts: tuple[str, ...]
    schema: str

    @classmethod
    def build(cls, df: DataFrame, id_column: str, texts: Sequence[str], path: str | None = None) -> SubstringIndex:
        spark, path = df.sparkSession, path or fresh_dir(df.sparkSession, "substring-index")
        folders = max(LEAST_FOLDERS, expected_bytes(df) // FOLDER_BYTES)
        held = spread(df).withColumn("_folder", F.pmod(F.xxhash64(id_column), F.lit(folders)).cast("int"))
        held.repartition(folders, "_folder").sortWithinPartitions("_folder", id_column).write.partitionBy("_folder").parquet(f"{path}/rows")
        schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        index = cls(spark, path, folders, id_column, tuple(texts), schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    grams = [list(dict.fromkeys(g for t in row if t for g in _trigrams(t))) for row in part.column("t").to_pylist()]
                    owner = np.repeat(np.arange(len(part)), [len(g) for g in grams])
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), pa.array([g for row in grams for g in row], pa.string())], names=["id", "gram"])

        rows = index.rows()
        kind = dict(df.dtypes)[id_column]
        grams = rows.select(F.col(id_column).alias("id"), F.array(*[F.lower(F.col(t).cast("string")) for t in texts]).alias("t")).mapInArrow(run, f"id {kind}, gram string")
        grams = grams.withColumn("_folder", F.pmod(F.xxhash64("gram"), F.lit(folders)).cast("int"))
        grams.repartitionByRange(folders * 2, "_folder", "gram", "id").sortWithinPartitions("_folder", "gram", "id").write.partitionBy("_folder").parquet(f"{path}/grams")
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _folder int").parquet(f"{self.path}/rows").drop("_folder")

    def candidates(self, pattern: str) -> DataFrame | None:
        """(id) of rows that hold all trigrams of a pattern; None where it has none."""
        grams = required_trigrams(pattern)
        if not grams:
            return None
        grams = grams[:: -(-len(grams) // LOOKED_UP)]
        kind = next(t for c, t in (x.split(" ", 1) for x in self.schema.split(", `")) if c.strip("`") == self.id_column)
        rows = self.spark.read.schema(f"id {kind}, gram string, _folder int").parquet(f"{self.path}/grams")
        folders = F.array(*[F.pmod(F.xxhash64(F.lit(g)), F.lit(self.folders)).cast("int") for g in grams])
        asked = [x for x in self.spark.range(1).select(folders.alias("f")).first()["f"]]
        found = rows.where(F.col("_folder").isin(sorted(set(asked))) & F.col("gram").isin(grams))
        return found.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id")

    def search(self, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows with ``pattern`` in one of the columns, case aside; % and _ in it are wild: as ``ilike('%pattern%')`` finds them."""
        match = reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{pattern}%") for c in columns or self.texts])
        near = self.candidates(pattern)
        if near is None:
            return self.rows().where(match)
        some = [r["id"] for r in near.limit(NAMED + 1).collect()]
        rows = self.spark.read.schema(f"{self.schema}, _folder int").parquet(f"{self.path}/rows")
        if len(some) > NAMED:
            ids = near.select(F.col("id").alias("_id"), F.pmod(F.xxhash64("id"), F.lit(self.folders)).cast("int").alias("_at"))
            return rows.join(ids, (F.col("_folder") == F.col("_at")) & (F.col(self.id_column) == F.col("_id")), "left_semi").where(match).drop("_folder")
        return rows.where(F.col(self.id_column).isin(some)).where(match).drop("_folder")

    def newest(self, pattern: str, order: str, limit: int, columns: Sequence[str] | None = None) -> DataFrame:
        """The ``limit`` rows that match with the greatest ``order``, ties by id."""
        return self.search(pattern, columns).orderBy(F.col(order).desc(), self.id_column).limit(limit)


def contact_index(threads: DataFrame, addresses: str = "participants") -> SubstringIndex:
    """An index of :func:`threadloom.operators.lookups.people`."""
    return SubstringIndex.build(people(threads, addresses).withColumn("entry", F.xxhash64("thread_id", "at", "email")), "entry", ["label"])


def find_contact(index: SubstringIndex, query: str, limit: int = 10) -> DataFrame:
    """As :func:`threadloom.operators.lookups.find_contact`, from a :func:`contact_index`."""
    wanted = query.strip().lower()
    near = index.search(re.sub(r"([%_\\])", "_", wanted))  # a wild card finds itself too
    return ranked_contacts(near.where(F.col("label").contains(wanted)), limit)

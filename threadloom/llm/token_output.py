"""Token ids as ORC: run-length encoded integers, row indexes, Bloom filters on doc_id.

Texts are encoded, range-partitioned and sorted by doc_id, and written as ORC.  ORC's
integer columns are run-length encoded; each stripe has a row index (least and largest
doc_id every ``row_index_stride`` rows) and a Bloom filter on doc_id, so a reader of some
documents (:func:`read_documents`) skips files, stripes and row groups by metadata, and the
stripes of a file can be read in parallel.  A document's position in the whole stream of ids is its file's base plus its
position in the file; bases are prefix sums over one row for each file.

Encoding works on distinct words: the tokenizer maps white space away, so the ids of a
text are those of its white-space-free runs, and each distinct run is encoded once per
cache.  Special-token strings in a text are treated as the tokenizer treats them.

Defined results: a null or empty text has only the end id; very long texts are taken whole,
one at a time; rows with equal doc_id follow
each other in any order of theirs; a null doc_id comes first; an empty table gives an
empty file set and an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm._common import LOWER, SpanPool, Words, buckets_for, ids_and_text, prefix, ragged, slices, text_buffer

END_ID = 1
ROW_INDEX_STRIDE, STRIPE_BYTES, STRIPE_CHECK_ROWS, BLOOM_FPP = 1000, 8 << 20, 1000, 0.01


#: ASCII letters; and ASCII signs before which a word may be cut, since the tokenizer always cuts between a letter and them.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_SPECIAL = b"<|"
#: A word of ASCII and Latin-1 letters (UTF-8; the signs for times and division are none).
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_JOINED = 20_000


class WordEncoder:
    """Ids of texts by a tokenizer file, one distinct run of non-white bytes at a time.

    The tokenizer lower-cases, so runs are lower-cased (A-Z) first, and they are cut between
    a letter and a sign; neither is done where a special token's string could begin.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.pool = SpanPool(self._encode)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone are one word to the tokenizer too: they go through it as lines, and come apart at word ends.

        Each has one end at least, so as many ends as words means one end each.
        """
        plain = np.fromiter((_PLAIN(w) is not None for w in words), bool, len(words))
        lengths = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        where = np.flatnonzero(plain)
        for k in range(0, len(where), _JOINED):
            some = where[k : k + _JOINED]
            line = b" ".join([words[i] for i in some.tolist()]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # another kind of vocabulary: one by one
                plain[some] = False
                continue
            lengths[some] = np.diff(ends, prepend=0)
            parts.append((some, ids))
        where = np.flatnonzero(~plain)
        if len(where):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([words[i].decode() for i in where.tolist()], add_special_tokens=False)]
            lengths[where] = np.fromiter(map(len, got), np.int64, len(got))
            parts.append((where, np.fromiter((i for ids in got for i in ids), np.int32, int(lengths[where].sum()))))
        out = np.zeros(int(lengths.sum()), np.int32)
        starts = np.cumsum(lengths) - lengths
        for some, ids in parts:
            out[ragged(starts[some], lengths[some])] = ids
        return out, lengths

    def encode(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with ``end_id`` at its end, and offsets (n + 1)."""
        data, offsets = text_buffer(text)
        n = len(offsets) - 1
        if _SPECIAL in data.tobytes():
            words = Words(data, offsets)
        else:
            cuts = np.zeros(len(data), dtype=bool)
            cuts[1:] = _LETTER[data[:-1]] & _SIGN[data[1:]]
            words = Words(LOWER[data], offsets, cuts)
        slots = self.pool.look_up(words.vocabulary.to_pylist())[words.codes] if len(words) else np.zeros(0, np.int64)
        ids, lengths = self.pool.expand(slots)
        per = prefix(lengths)[words.first]
        ends = per[1:] + np.arange(1, n + 1)
        out = np.full(len(ids) + n, end_id, np.int32)
        body = np.ones(len(out), dtype=bool)
        body[ends - 1] = False
        out[body] = ids
        return out, np.concatenate([[0], ends])


@lru_cache(maxsize=4)
def encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder, with its cache of words, for all tasks of a worker process."""
    return WordEncoder(tokenizer_file)


#: Columns of the files: part is the file's place in doc_id order, local the ids before the document in its file.
LAYOUT = "doc_id long, n_tokens long, local long, part int, ids array<int>"


def encode_ordered(docs: DataFrame, tokenizer_file: str, parts: int, end_id: int = END_ID) -> DataFrame:
    """Rows of :data:`LAYOUT`, in ``parts`` partitions of ascending doc_id; only texts are shuffled."""
    ordered = ids_and_text(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, part = encoder(tokenizer_file), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch):
                ids, offsets = coder.encode(piece.column("text"), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                columns = [piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(offsets[:-1] + before), pa.array(np.full(len(piece), part, np.int32)), lists]
                before += len(ids)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "local", "part", "ids"])

    return ordered.mapInArrow(run, LAYOUT)


def _bases(path: str) -> str:
    return f"{path.rstrip('/')}-bases"


def write_orc(rows: DataFrame, path: str) -> None:
    """Writes rows of :data:`LAYOUT`, one file of several stripes for each partition, and once for all readers each file's base, beside it.

    Bases are prefix sums over one row for each file.
    """
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP, "orc.row.index.stride": ROW_INDEX_STRIDE, "orc.stripe.size": STRIPE_BYTES, "orc.rows.between.memory.checks": STRIPE_CHECK_ROWS}
    writer.options(**options).orc(path)
    spark = rows.sparkSession
    totals = spark.read.schema(LAYOUT).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("t"))
    bases = totals.select("part", (F.sum("t").over(W.orderBy("part")) - F.col("t")).alias("base"))
    bases.coalesce(1).write.mode("overwrite").parquet(_bases(path))


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start is the number of ids of all documents before.

    The broadcast table of bases has as many rows as there are files.
    """
    return _started(spark, spark.read.schema(LAYOUT).orc(path), path)


def _started(spark: SparkSession, table: DataFrame, path: str) -> DataFrame:
    base = spark.read.schema("part int, base long").parquet(_bases(path)).select(F.col("part").alias("_p"), "base")
    joined = table.join(F.broadcast(base), F.col("part") == F.col("_p"))
    return joined.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """As :func:`read_orc` for some documents: files, stripes and row groups whose statistics or Bloom filters exclude them are not read."""
    return _started(spark, spark.read.schema(LAYOUT).orc(path).where(F.col("doc_id").isin([int(i) for i in doc_ids])), path)


def token_table(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = END_ID, bytes_each: int = 24 << 20) -> DataFrame:
    """Writes the ids of ``docs`` to ``path`` as ORC and returns what :func:`read_orc` reads back."""
    write_orc(encode_ordered(docs, tokenizer_file, buckets_for(docs, bytes_each), end_id), path)
    return read_orc(docs.sparkSession, path)


def with_crc(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = list_crc32(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def list_crc32(lists: pa.Array) -> list[int]:
    offsets = lists.offsets.to_numpy()
    raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    view = memoryview(raw)
    return [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), offsets.tolist()[1:], strict=False)]

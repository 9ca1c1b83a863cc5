"""Lines as units: digests of normalised lines, and texts without some of their lines."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._common import LOWER, free_names, own_columns, slices, text_buffer

#: The white space [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
_RUN = re.compile(rb"[ \t\n\x0b\x0c\r]+")


def strip_key(line: bytes) -> bytes:
    """Lower-cased already; white space goes at both ends."""
    return line.strip(SPACES)


def squeeze_key(line: bytes) -> bytes:
    """As :func:`strip_key`, and inner runs of white space become one space."""
    return _RUN.sub(b" ", line.strip(SPACES))


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def raw_lines(text: pa.Array) -> Iterator[tuple[bytes, list[bytes], list[bytes]]]:
    """For each text: its bytes, its lines, and the lines in lower case (A-Z only)."""
    data, offsets = text_buffer(text)
    plain, low = data.tobytes(), LOWER[data].tobytes()
    ends = offsets.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        whole = plain[a:b]
        yield whole, whole.split(b"\n"), low[a:b].split(b"\n")


def unit_digests(docs: DataFrame, key_of: Callable[[bytes], bytes], wanted: Callable[[bytes], bool]) -> DataFrame:
    """(doc_id, key binary, at int): the distinct wanted keys of each row, with the first line index of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, keys, places = [], [], []
                for doc_id, (_, _, low) in zip(part.column("doc_id").to_pylist(), raw_lines(part.column("text")), strict=True):
                    seen: dict[bytes, int] = {}
                    for i, line in enumerate(low):
                        key = key_of(line)
                        if wanted(key):
                            seen.setdefault(digest(key), i)
                    ids += [doc_id] * len(seen)
                    keys += seen.keys()
                    places += seen.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.int32())], names=["doc_id", "key", "at"])

    return docs.mapInArrow(run, "doc_id long, key binary, at int")


#: Columns that :func:`cut_lines` adds.
CUT = {"n_lines": pa.int64(), "n_dropped": pa.int64(), "spans": pa.string(), "kept_sha256": pa.string()}


def cut_lines(docs: DataFrame, dropped: DataFrame, key_of: Callable[[bytes], bytes], wanted: Callable[[bytes], bool]) -> DataFrame:
    """``docs`` without the lines that ``dropped`` (doc_id, keys) names, and the columns of :data:`CUT`.

    keys: digests whose lines go.  spans: "start-end" of each line that went, in code points
    of the original text, end exclusive, joined by commas.  Other columns pass through.
    """
    passed = own_columns(docs, list(CUT))
    id_, keys_ = free_names(docs, "id", "keys")
    right = dropped.select(F.col("doc_id").alias(id_), F.col("keys").alias(keys_))
    joined = docs.select(*[F.col(f"`{c}`") for c in passed]).join(right, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left").drop(id_)
    place = [c.lower() for c in passed].index("text")
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*[F.col(f"`{c}`") for c in passed]).dtypes)
    schema += ", n_lines long, n_dropped long, spans string, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, passed[place]):
                texts, rows = [], []
                for (whole, lines, low), gone in zip(raw_lines(part.column(place)), part.column(keys_).to_pylist(), strict=True):
                    rest, cut = whole, []
                    if gone:
                        gone, kept, at = set(gone), [], 0
                        for line, low_line in zip(lines, low, strict=True):
                            size = len(line.decode("utf-8", "replace"))
                            key = key_of(low_line)
                            mark = digest(key) if wanted(key) else None
                            if mark in gone:
                                cut.append(f"{at}-{at + size}")
                            else:
                                kept.append(line)
                            at += size + 1
                        rest = b"\n".join(kept)
                    texts.append(rest)
                    rows.append((len(lines), len(cut), ",".join(cut), hashlib.sha256(rest).hexdigest()))
                columns = [part.column(i) for i in range(len(passed))]
                columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
                columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(CUT.values())]
                yield pa.RecordBatch.from_arrays(columns, names=[*passed, *CUT])

    return joined.mapInArrow(run, schema)

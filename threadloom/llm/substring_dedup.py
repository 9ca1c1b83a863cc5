"""Substring dedup by hashing paragraphs: runs of whole sentences or lines.

A text is cut behind line ends and behind sentence ends (. ! ? and white space, or an
ideographic full stop), with the white space that follows.  Every unit is normalised (A-Z
lower-cased, white space squeezed).  A paragraph begins at each unit and is the shortest run
of units from there that weighs ``min_words`` words; its digest is grouped globally by an
aggregation that combines on the map side, so a paragraph that a third of all rows hold costs
one row for each map task.  The occurrence of the lowest rank (doc_id, then position) stays;
the units of all later ones go, their offsets in the original text are returned, and what
stays is joined as it stood.  As paragraphs begin everywhere, a passage is found wherever it
was put, whatever stands before it and however its lines were broken.

Weights: a unit weighs its words, where in scripts without spaces two code points count as a
word; one with few spaces (a URL, a table, an encoded block) weighs a word for eight code points.
Runs below ``min_words`` repeat by chance in clean text.

Defined results: a null or empty text has no unit, and a text below ``min_words`` no paragraph;
of rows with equal doc_id, each keeps the paragraph that they are the first to hold; a null
doc_id ranks last; very long texts are taken whole, one at a time; an empty table gives an
empty table; other columns pass through, those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._common import LOWER, Scratch, free_names, ids_and_text, own_columns, slices, text_buffer
from threadloom.llm._lines import digest, squeeze_key

#: The least weight of a paragraph, and the code points that weigh a word where there are few spaces.
MIN_WORDS, WORD_CHARS = 20, 8
#: What ends a unit (UTF-8; the ideographic full stop, exclamation and question mark are three bytes each).
_END = re.compile(rb"(?:[.!?][ \t\x0b\x0c\r]|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\n)[ \t\n\x0b\x0c\r]*")
#: Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")

#: Columns that :func:`dedup_units` adds.
RESULT = {"n_units": pa.int64(), "n_dropped": pa.int64(), "spans": pa.string(), "kept_sha256": pa.string()}


def units(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the units of a text, which follow each other without gaps."""
    start = 0
    for m in _END.finditer(text):
        yield start, m.end()
        start = m.end()
    if start < len(text):
        yield start, len(text)


def weight(key: bytes) -> int:
    """Words of a normalised unit."""
    if not key:
        return 0
    words, chars = key.count(b" ") + 1, len(key)
    if not key.isascii():
        text = key.decode("utf-8", "replace")
        words, chars = words + len(_UNSPACED.findall(text)) // 2, len(text)
    return max(words, chars // WORD_CHARS)


def paragraphs(low: bytes, min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int]], list[tuple[int, bytes | None]]]:
    """Units of a text in lower case, and for each the end (exclusive) and digest of the paragraph that begins with it.

    The digest is None where no paragraph begins: at a blank unit, or too near to the end.
    """
    cut = list(units(low))
    keys = [squeeze_key(low[a:b]) for a, b in cut]
    weights = [weight(k) for k in keys]
    found, end, total = [], 0, 0
    for i, own in enumerate(weights):
        while end < len(cut) and total < min_words:
            total += weights[end]
            end += 1
        whole = own and total >= min_words
        found.append((end, digest(keys[i] if end == i + 1 else b" ".join(keys[i:end])) if whole else None))
        total -= own
    return cut, found


def _texts(part: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """Each text, and the same in lower case (A-Z only)."""
    data, offsets = text_buffer(part)
    plain, low = data.tobytes(), LOWER[data].tobytes()
    ends = offsets.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        yield plain[a:b], low[a:b]


def _digests(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key): the distinct paragraphs of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, keys = [], []
                for doc_id, (_, low) in zip(part.column("doc_id").to_pylist(), _texts(part.column("text")), strict=True):
                    found = {key for _, key in paragraphs(low, min_words)[1] if key is not None}
                    ids += [doc_id] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return docs.mapInArrow(run, "doc_id long, key binary")


def _cut(docs: DataFrame, later: DataFrame, min_words: int) -> DataFrame:
    """``docs`` without the paragraphs whose digests ``later`` (doc_id, keys) names for them, and without a document's own repeats."""
    passed = own_columns(docs, list(RESULT))
    id_, keys_ = free_names(docs, "id", "keys")
    right = later.select(F.col("doc_id").alias(id_), F.col("keys").alias(keys_))
    kept = docs.select(*[F.col(f"`{c}`") for c in passed])
    joined = kept.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left").drop(id_)
    place = [c.lower() for c in passed].index("text")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", n_units long, n_dropped long, spans string, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, passed[place]):
                texts, rows = [], []
                for (text, low), gone in zip(_texts(part.column(place)), part.column(keys_).to_pylist(), strict=True):
                    known, rest, spans, at, until = set(gone or ()), [], [], 0, 0
                    cut, found = paragraphs(low, min_words)
                    for i, ((a, b), (end, key)) in enumerate(zip(cut, found, strict=True)):
                        if key is not None:
                            if key in known:
                                until = end
                            known.add(key)
                        size = len(text[a:b].decode("utf-8", "replace"))
                        if i < until:
                            spans.append(f"{at}-{at + size}")
                        else:
                            rest.append(text[a:b])
                        at += size
                    whole = b"".join(rest)
                    texts.append(whole)
                    rows.append((len(cut), len(spans), ",".join(spans), hashlib.sha256(whole).hexdigest()))
                columns = [part.column(i) for i in range(len(passed))]
                columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
                columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(RESULT.values())]
                yield pa.RecordBatch.from_arrays(columns, names=[*passed, *RESULT])

    return joined.mapInArrow(run, schema)


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated paragraphs, and n_units, n_dropped, spans ("start-end" in code points) and kept_sha256."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    found = scratch.save(_digests(ids_and_text(docs), min_words), "paragraphs")
    rank = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    firsts = found.groupBy("key").agg(F.min(rank).alias("first_doc"), F.count(F.lit(1)).alias("n"))
    # the first holder keeps the paragraph once; whether it repeats inside that document shows when it is cut
    firsts = scratch.save(firsts.where("n > 1").select("key", "first_doc"), "firsts")
    later = found.join(firsts, "key").where(rank != F.col("first_doc")).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    return _cut(docs, later, min_words)

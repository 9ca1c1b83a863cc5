"""Quality rules by repetition coverage.

Rolling hashes over word n-grams of several lengths, in numpy, measure which characters
lie inside duplicated n-grams, and line hashes measure duplicated lines.  All figures are
of one document, so the operator is a single map over the input: no shuffle, and memory
is bounded by a slice of texts (or one document, if it is longer).

Defined results: a null or empty text has no words and fails the base rules; repeated
rows are judged one by one; an empty table gives an empty table; other columns pass
through, except those whose names (in any case) are result columns here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._common import Words, mix64, own_columns, prefix, slices, text_buffer

#: Characters counted as symbols.
SYMBOLS = b"[#*$%&|<>]"[1:-1]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RepetitionRules:
    """Largest shares that a kept document may have; all of characters in words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    dup_lines: float = 0.30
    dup_line_chars: float = 0.20
    top_ngram: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    dup_ngram: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, dup_line_frac double, dup_line_char_frac double, top_ngram_frac double, dup_ngram_frac double, failed_rule string"
)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts ``keys``, and starts and lengths of runs of equal keys."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.ones(len(ranked), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(fresh)
    return order, starts, np.diff(np.append(starts, len(ranked)))


def measure(text: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The figures and the verdict for each text of a slice."""
    data, offsets = text_buffer(text)
    n = len(offsets) - 1
    words = Words(data, offsets)
    n_words = np.diff(words.first)
    lead = (data & 0xC0) != 0x80
    points = prefix(lead)
    chars = points[words.ends] - points[words.starts]
    word_chars = np.bincount(words.doc, chars, n).astype(np.int64)
    symbols = prefix(_SYMBOL[data])
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]

    # lines: cut at \n and at the ends of texts
    cuts = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    line_end = np.sort(np.concatenate([cuts, offsets[1:]]), kind="stable")
    line_doc = np.searchsorted(offsets[1:], line_start, side="right")
    if len(line_start):
        # a text's own start sorts before those of later texts at the same byte (empty texts)
        owner = np.concatenate([np.arange(n), np.searchsorted(offsets[1:], cuts, side="right")])
        line_doc = owner[np.lexsort((owner, np.concatenate([offsets[:-1], cuts + 1])))]
        line_end = np.append(line_start[1:] - 1, offsets[-1])
        last = np.append(line_doc[1:] != line_doc[:-1], True)
        line_end[last] = offsets[1:][line_doc[last]]
    line_words = np.searchsorted(words.starts, line_end) - np.searchsorted(words.starts, line_start)
    solid = prefix(np.bincount(words.starts, chars, len(data)).astype(np.int64) if len(words) else np.zeros(len(data), np.int64))
    line_chars = solid[line_end] - solid[line_start]
    has = line_words > 0
    l_start, l_end, l_doc, l_chars = line_start[has], line_end[has], line_doc[has], line_chars[has]
    n_lines = np.bincount(l_doc, minlength=n)
    n_dup_lines = np.zeros(n, np.int64)
    dup_line_chars = np.zeros(n)
    if len(l_start):
        lengths = l_end - l_start
        packed = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=packed[1:])
        keep = np.zeros(len(data) + 1, np.int32)
        np.add.at(keep, l_start, 1)
        np.add.at(keep, l_end, -1)
        body = data[np.cumsum(keep[:-1]) > 0]
        lines = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(packed), pa.py_buffer(body)])
        codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order, starts, _ = _groups(l_doc * (int(codes.max()) + 1) + codes)
        later = np.ones(len(codes), dtype=bool)
        later[order[starts]] = False  # the sort is stable, so the first of a run is the earliest line
        n_dup_lines = np.bincount(l_doc[later], minlength=n)
        dup_line_chars = np.bincount(l_doc[later], l_chars[later], n)

    # word n-grams: each longer hash rolls on from the shorter one, only where that was repeated
    value = mix64(words.codes.astype(np.uint64) + np.uint64(1))
    salt = mix64(np.arange(n, dtype=np.uint64) + np.uint64(0x51ED2701))
    ends = words.first[1:]
    char_sum = prefix(chars)
    at = np.arange(len(words))
    rolled = value.copy()
    top, dup = np.zeros(n), {}
    worst_top = {}
    n_repeat = np.zeros(n, np.int64)
    total = np.maximum(word_chars, 1)
    longest = max([3, *rules.top_ngram, *rules.dup_ngram])
    for size in range(2, longest + 1):
        fits = at + size <= ends[words.doc[at]] if len(at) else np.zeros(0, dtype=bool)
        at, rolled = at[fits], rolled[fits]
        rolled = rolled * _BASE + value[at + size - 1] if len(at) else rolled
        if len(at):
            order, starts, counts = _groups(rolled ^ salt[words.doc[at]])
            many = counts > 1
            if size in rules.top_ngram:
                head = at[order[starts[many]]]
                share = counts[many] * (char_sum[head + size] - char_sum[head])
                best = np.zeros(n)
                np.maximum.at(best, words.doc[head], share)
                worst_top[size] = best / total
            again = np.zeros(len(at), dtype=bool)
            again[order[np.repeat(many, counts)]] = True
            at, rolled = at[again], rolled[again]
        else:
            worst_top[size] = np.zeros(n)
        if size == 3 or size in rules.dup_ngram:
            step = np.zeros(len(words) + 1, np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + size, -1)
            covered = np.cumsum(step[:-1]) > 0
            if size == 3:
                n_repeat = np.bincount(words.doc[covered], minlength=n)
            if size in rules.dup_ngram:
                dup[size] = np.bincount(words.doc[covered], chars[covered], n) / total

    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    line_frac = n_dup_lines / np.maximum(n_lines, 1)
    line_char_frac = dup_line_chars / total
    failed = np.full(n, None, dtype=object)
    found = [("base", base_failed), ("dup_lines", line_frac > rules.dup_lines), ("dup_line_chars", line_char_frac > rules.dup_line_chars)]
    found += [(f"top_{k}gram", worst_top[k] > v) for k, v in rules.top_ngram.items()]
    found += [(f"dup_{k}gram", dup[k] > v) for k, v in rules.dup_ngram.items()]
    for name, hit in reversed(found):
        failed[hit] = name
    top = np.max([worst_top[k] for k in rules.top_ngram], axis=0) if rules.top_ngram else top
    worst = np.max([dup[k] for k in rules.dup_ngram], axis=0) if rules.dup_ngram else np.zeros(n)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": np.array([x is None for x in failed], dtype=bool), "dup_line_frac": line_frac,
        "dup_line_char_frac": line_char_frac, "top_ngram_frac": top, "dup_ngram_frac": worst, "failed_rule": failed,
    }


def score_quality(docs: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """``docs`` (with ``text``) and the columns of :data:`RESULT`."""
    rules = rules or RepetitionRules()
    result = [x.split()[0] for x in RESULT.split(", ")]
    passed = own_columns(docs, result)
    docs = docs.select(*[F.col(f"`{c}`") for c in passed])
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", " + RESULT

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = measure(part.column("text"), rules)
                extra = [pa.array(got[c], pa.string()) if c == "failed_rule" else pa.array(got[c]) for c in result]
                extra = [x.cast(pa.int64()) if pa.types.is_integer(x.type) else x for x in extra]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*passed, *result])

    return docs.mapInArrow(score, schema)


def filter_quality(docs: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return score_quality(docs, rules).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])

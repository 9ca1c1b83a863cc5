"""Deterministic chunks: paragraphs, cut by sentence, word or token where too long, packed with overlap.

A chunk is a slice of its source: ``source[start:end] == text``.  Token counts come from a counter that can be
given: :class:`Tokens` counts runs of letters and digits and single other signs, :class:`TokenizerCounter`
the tokens of a tokenizer file.
"""

from __future__ import annotations

import hashlib
import re
import time
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from threadloom.sources.shared import spread

CHUNK = "key string, chunk_id string, chunk_index int, text string, char_start int, char_end int, token_est int"
_PARAGRAPH = re.compile(r"\S(?:.*?\S)?(?=\s*\n\s*\n|\s*\Z)", re.S)
#: Fixed value: the end of a sentence.
_SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)")
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"\w+|[^\w\s]")

Span = tuple[int, int]


class Tokens:
    """A text's tokens: how many any slice of it holds, in logarithmic time.

    A slice that begins or ends inside a token counts what of the token it holds as one.
    """

    def __init__(self, source: str):
        marks = [m.span() for m in _TOKEN.finditer(source)]
        self.starts, self.ends = [a for a, _ in marks], [b for _, b in marks]

    def count(self, start: int, end: int) -> int:
        return max(0, bisect_left(self.starts, end) - bisect_right(self.ends, start))

    def within(self, start: int, end: int) -> list[Span]:
        """Tokens of a slice, cut at its edges."""
        some = range(bisect_right(self.ends, start), bisect_left(self.starts, end))
        return [(max(start, self.starts[i]), min(end, self.ends[i])) for i in some]


class TokenizerCounter:
    """Makes counts of a text's slices in tokens of a tokenizer that cuts texts into words first.

    ``file``: a JSON file of the tokenizers library with a pre-tokenizer.  A word's tokens do not depend on its neighbours, so
    distinct words are encoded once and kept; a slice counts by sums of whole words, and its first and last word
    by what of them it holds: at its start a word stands without the space before it.  Counts are those of the slice encoded alone.
    """

    #: Words kept.
    MOST = 200_000

    def __init__(self, file: str):
        self.file = file

    def __call__(self, source: str) -> TokenizerMarks:
        return TokenizerMarks(source, *_tokenizer(self.file))


@lru_cache(maxsize=4)
def _tokenizer(file: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(file)
    made.encode_special_tokens = True
    if made.pre_tokenizer is None:
        raise ValueError(f"{file}: a tokenizer that cuts words first is needed")
    return made, {}


class TokenizerMarks:
    """Counts of one text's slices; see :class:`TokenizerCounter`."""

    def __init__(self, source: str, tokenizer, known: dict[str, int]):
        self.source, self.tokenizer, self.known = source, tokenizer, known
        spans = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(source)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        counts = self._counts([source[a:b] for a, b in spans])
        self.before = [0]
        for n in counts:
            self.before.append(self.before[-1] + n)

    def _counts(self, words: list[str]) -> list[int]:
        if len(self.known) > TokenizerCounter.MOST:
            self.known.clear()
        missing = [w for w in dict.fromkeys(words) if w not in self.known]
        if missing:
            self.known.update((w, len(e.ids)) for w, e in zip(missing, self.tokenizer.encode_batch(missing, add_special_tokens=False), strict=True))
        return [self.known[w] for w in words]

    def count(self, start: int, end: int) -> int:
        first, last = bisect_right(self.ends, start), bisect_left(self.starts, end) - 1
        if last < first:
            return 0
        if first == last:
            return self._counts([self.source[start:end]])[0]
        head = self.before[first + 1] - self.before[first] if self.starts[first] >= start else self._counts([self.source[start : self.ends[first]]])[0]
        tail = self.before[last + 1] - self.before[last] if self.ends[last] <= end else self._counts([self.source[self.starts[last] : end]])[0]
        return head + self.before[last] - self.before[first + 1] + tail

    def within(self, start: int, end: int) -> list[Span]:
        """Tokens of a slice: their characters, without those that a token shares with the one before."""
        out: list[Span] = []
        for a, b in self.tokenizer.encode(self.source[start:end], add_special_tokens=False).offsets:
            a = max(a, out[-1][1] - start if out else 0)
            if b > a:
                out.append((start + a, start + b))
        return out


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def _trim(source: str, span: Span) -> Span | None:
    piece = source[span[0] : span[1]]
    body = piece.strip()
    start = span[0] + len(piece) - len(piece.lstrip())
    return (start, start + len(body)) if body else None


def _joined(pieces: list[Span], limit: int, count: Callable[[int, int], int]) -> Iterator[Span]:
    """Neighbouring pieces joined while their slice holds at most ``limit`` tokens."""
    at = 0
    while at < len(pieces):
        stop = at + 1
        while stop < len(pieces) and count(pieces[at][0], pieces[stop][1]) <= limit:
            stop += 1
        yield pieces[at][0], pieces[stop - 1][1]
        at = stop


def _sentences(source: str, span: Span) -> list[Span]:
    cuts = sorted({span[0], *(m.end() for m in _SENTENCE_END.finditer(source, *span)), span[1]})
    return [s for s in (_trim(source, c) for c in zip(cuts, cuts[1:], strict=False)) if s]


def _within_limit(source: str, span: Span, limit: int, tokens) -> list[Span]:
    """A span of whole tokens, halved while it holds more than ``limit`` of them by itself: cut words may have more tokens than they had."""
    if span[1] - span[0] < 2 or tokens.count(*span) <= limit:
        return [span]
    middle = (span[0] + span[1]) // 2
    return [p for s in ((span[0], middle), (middle, span[1])) for t in [_trim(source, s)] if t for p in _within_limit(source, t, limit, tokens)]


def _fitting(source: str, span: Span, limit: int, tokens) -> list[Span]:
    """Spans of at most ``limit`` tokens: by sentences, what is longer by words, what is longer still by tokens."""
    parts = [span]
    for cut in (lambda s: _sentences(source, s), lambda s: [m.span() for m in _WORD.finditer(source, *s)]):
        parts = [p for s in parts for p in ([s] if tokens.count(*s) <= limit else _joined(cut(s), limit, tokens.count))]
    step, out = max(1, limit - 8), []
    for s in parts:
        marks = tokens.within(*s) if tokens.count(*s) > limit else None
        if marks is None:
            out.append(s)
            continue
        cut = [_trim(source, (marks[i][0], marks[min(i + step, len(marks)) - 1][1])) for i in range(0, len(marks), step)]
        out += [p for c in cut if c for p in _within_limit(source, c, limit, tokens)]
    return out


def chunk_spans(source: str, target: int = 350, limit: int = 500, overlap: int = 60, counter: Callable = Tokens) -> list[Span]:
    """Spans of the chunks of a text: neighbouring spans up to ``target`` tokens or more, never over ``limit``.

    A chunk begins again with the last spans of the one before, as many as ``overlap`` tokens hold, one at least,
    never all of them; where they would push the next span over the limit they are left out.
    """
    return [span for span, _ in _chunks(source, target, limit, overlap, counter)]


def _chunks(source: str, target: int, limit: int, overlap: int, counter: Callable) -> list[tuple[Span, int]]:
    """Spans of the chunks, and how many tokens each holds."""
    if not 0 < target <= limit or not 0 <= overlap < target:
        raise ValueError("0 < target <= limit and 0 <= overlap < target are needed")
    tokens = counter(source)
    spans = [s for m in _PARAGRAPH.finditer(source) for s in _fitting(source, m.span(), limit, tokens)]
    # a chunk is spans[first:stop]; fresh is the first span that no chunk holds yet
    chunks, first, fresh = [], 0, 0
    while fresh < len(spans):
        if tokens.count(spans[first][0], spans[fresh][1]) > limit:
            first = fresh
        stop = fresh + 1
        while stop < len(spans) and tokens.count(spans[first][0], spans[stop - 1][1]) < target and tokens.count(spans[first][0], spans[stop][1]) <= limit:
            stop += 1
        chunks.append((spans[first][0], spans[stop - 1][1]))
        end = spans[stop - 1][1]
        back = stop
        if overlap and stop - first > 1:
            back = stop - 1
            while back - 1 > first and tokens.count(spans[back - 1][0], end) <= overlap:
                back -= 1
        first, fresh = back, stop
    return [(c, tokens.count(*c)) for c in chunks]


def chunk_key(key: str, index: int, text: str) -> str:
    return hashlib.sha256(b"\0".join([key.encode(), str(index).encode(), text.encode()])).hexdigest()


def chunk_messages(df: DataFrame, key: str, body: str, target: int = 350, limit: int = 500, overlap: int = 60, counter: Callable = Tokens) -> DataFrame:
    """Rows of :data:`CHUNK` for each message; one without a key has no chunk ids and is left out.

    ``counter``: :class:`Tokens`, a :class:`TokenizerCounter`, or what makes such objects of a text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["k"], b["t"], strict=True):
                for i, ((start, end), n) in enumerate(_chunks(text or "", target, limit, overlap, counter)):
                    piece = text[start:end]
                    rows.append((k, chunk_key(k, i, piece), i, piece, start, end, n))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNK.split(", ")])

    return spread(df.selectExpr(f"CAST(`{key}` AS string) AS k", f"`{body}` AS t").where("k IS NOT NULL")).mapInPandas(run, CHUNK)


class TransientError(RuntimeError):
    """A backend's failure that may pass: a lost connection, a server's error."""


#: Tries of one request, and the shortest and longest wait between them in seconds.
TRIES, WAIT, LONGEST_WAIT = 3, 2.0, 10.0


def _retried(backend: Callable[[list[str]], list[list[float]]], texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """The backend's answer; after a failure that may pass it is asked again, each time after a longer wait."""
    for attempt in range(1, TRIES + 1):
        try:
            return backend(texts)
        except (TransientError, ConnectionError, TimeoutError):
            if attempt == TRIES:
                raise
            sleep(min(LONGEST_WAIT, WAIT * 2 ** (attempt - 1)))
    raise AssertionError


def embed(df: DataFrame, key: str, text: str, backend: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 64) -> DataFrame:
    """(key, embedding) by a backend that takes lists of texts; its answer must have their number and ``dim`` components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                got = _retried(backend, [t or "" for t in part["t"]])
                if len(got) != len(part) or any(len(v) != dim for v in got):
                    raise ValueError("the backend's answer has another size")
                yield pd.DataFrame({"key": part["k"].tolist(), "embedding": got})

    return df.selectExpr(f"CAST(`{key}` AS string) AS k", f"`{text}` AS t").mapInPandas(run, "key string, embedding array<float>")


def hash_embedder(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in: signed counts of hashed tokens, of unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for token in _TOKEN.findall(t.lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else v)
        return out

    return run

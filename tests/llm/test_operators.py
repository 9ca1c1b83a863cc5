"""Each operator against brute force on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import _common, _induced, license_scan, line_dedup, mixing, ngram_join, quality, sentencepiece_codec, substring_dedup, suffix_dedup, token_output, topk_search
from threadloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows():
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    common = "The Common Line that many documents of this corpus have, word for word."
    passage = say(60)
    rows = [(0, None), (1, ""), (2, "\n\n \n"), (3, "one"), (4, "a b c d"), (5, "A b C d"), (6, say(3000)), (7, "x" * 700), (8, "ab" * 300 + " " + "ab" * 300)]
    for i in range(10, 60):
        text = "\n".join(say(r.randint(3, 40)) for _ in range(r.randint(1, 8)))
        if i % 3 == 0:
            text += "\n  " + (common.upper() if i % 2 else common) + " \n" + say(4)
        if i % 4 == 0:
            text = text + " " + passage + " " + say(3)
        rows.append((i, text))
    base = say(120).split()
    for i in range(60, 80):
        copy = list(base)
        for _ in range(i % 5):
            copy[r.randrange(len(copy))] = r.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(90, rows[20][1]), (91, rows[20][1])]
    return [(i, t, "en", ["b", "a", None, "ç"][i % 4], None if t is None else len(t)) for i, t in rows]


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, and columns whose names the operators use themselves."""
    rows = [(None, "some text here to keep as it is", 1), (None, None, 2), (5, "again and again the same", 3), (5, "again and again the same", 3), (6, "again and again the same", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumn("N_WORDS", F.lit("x")).withColumn("source", F.lit("s")).withColumn("spans", F.lit(1)).withColumn("piece_ids", F.lit(1))


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_quality_matches_brute_force(docs, nothing, odd):
    got = {r.doc_id: r for r in quality.score_quality(docs.select("doc_id", "text")).collect()}
    for i, text, *_ in ROWS:
        w, seen, dup = words(text), set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.score_quality(nothing).count() == 0
    assert quality.filter_quality(odd).columns == odd.columns
    assert quality.score_quality(odd).count() == 5


def quality_by_hand(text, rules=quality.RepetitionRules()):
    """(kept, dup_line_frac, dup_line_char_frac, top_ngram_frac, dup_ngram_frac)"""
    w = words(text)
    total = max(1, sum(map(len, w)))
    lines = [x for x in (text or "").split("\n") if words(x)]
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    line_frac, line_chars = len(later) / max(1, len(lines)), sum(len(y) for x in later for y in words(x)) / total
    grams = {n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(2, 11)}
    top = {n: max((c * sum(map(len, g)) for g, c in grams[n].items() if c > 1), default=0) / total for n in rules.top_ngram}
    dup = {}
    for n in rules.dup_ngram:
        cover = {i + k for i in range(len(w) - n + 1) if grams[n][tuple(w[i : i + n])] > 1 for k in range(n)}
        dup[n] = sum(len(w[i]) for i in cover) / total
    cover = {i + k for i in range(len(w) - 2) if grams[3][tuple(w[i : i + 3])] > 1 for k in range(3)}
    bad = len(w) < rules.min_words or 100 * len(cover) > rules.max_repeat_percent * len(w) or line_frac > rules.dup_lines or line_chars > rules.dup_line_chars
    bad = bad or any(top[n] > v for n, v in rules.top_ngram.items()) or any(dup[n] > v for n, v in rules.dup_ngram.items())
    return not bad, line_frac, line_chars, max(top.values()), max(dup.values())


def test_quality_verdict_matches_brute_force(spark):
    r = random.Random(8)
    pool = ["é" * r.randint(1, 3) + str(i) for i in range(40)]
    texts = [t for _, t, *_ in ROWS]
    for _ in range(120):
        lines = [" ".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 14))]
        texts.append("\n".join(r.choice(lines) if r.random() < 0.3 else x for x in lines) + " " + " ".join(str(r.random()) for _ in range(r.randint(0, 120))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = Counter()
    for x in quality.score_quality(df).collect():
        want = quality_by_hand(texts[x.doc_id])
        assert x.kept == want[0], x.failed_rule
        assert (x.dup_line_frac, x.dup_line_char_frac, x.top_ngram_frac, x.dup_ngram_frac) == pytest.approx(want[1:])
        kept[x.kept] += 1
    assert min(kept.values()) > 20


def test_ngram_coverage_by_hand():
    text = " ".join(["p q r s t u v"] * 2 + [f"w{i}" for i in range(60)])
    got = quality.measure(pa.array([text]), quality.RepetitionRules())
    assert got["dup_ngram_frac"][0] == pytest.approx(14 / (14 + sum(len(f"w{i}") for i in range(60))))


def test_jaccard_components_match_brute_force(docs, nothing, odd):
    sets = {}
    for i, text, *_ in ROWS:
        w = words(lower(text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert len(set(map(find, ids))) < len(ids) - 10
    assert ngram_join.jaccard_components(nothing).count() == 0
    rows = ngram_join.jaccard_components(odd).collect()
    assert len(rows) == 5 and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert sorted(r.text or "" for r in ngram_join.keep_one(odd).collect()) == sorted(["some text here to keep as it is", "", "again and again the same", "again and again the same"])


def test_jaccard_of_short_texts_and_large_open_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 5)
    r = random.Random(5)
    texts = [" ".join(r.choice("pqrstuv") for _ in range(r.randint(5, 12))) for _ in range(120)]
    base = [r.choice("abcdefgh") + str(i) for i in range(60)]
    for i in range(40):
        start = r.randint(0, 20)
        texts.append(" ".join(base[start : start + 40]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[130]), (3, texts[131]), (None, texts[0])]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], 10**9 if d is None else d)
    want = Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == want


def test_poor_sets_meet_by_single_shingles_and_deletions():
    tokens = np.arange(1, 9, dtype=np.uint64) * np.uint64(977)
    got = ngram_join.Signatures(np.concatenate([tokens[:-1], tokens]), np.array([0, 7, 15]), np.array([8, 8]))
    both = np.array([True, True])
    owner, sign = got.singles(both)
    assert len(set(sign[owner == 0]) & set(sign[owner == 1])) == 7
    owner, sign = got.deletions(both)
    exact_owner, exact = got.exact()
    assert set(sign[owner == 1]) & (set(exact[exact_owner == 0]) | set(sign[owner == 0]))


def test_suffix_dedup_matches_brute_force(docs, nothing, odd):
    seen, want = set(), {}
    for i, text in sorted((r[0], (r[1] or "").encode()) for r in ROWS):
        cover = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        kept = bytes(b for b, c in zip(text, cover) if not c)
        spans = sum(1 for j, c in enumerate(cover) if c and (not j or not cover[j - 1]))
        want[i] = (len(text), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 3000
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert suffix_dedup.remove_repeats(odd).count() == 5


def test_suffix_dedup_of_long_texts_and_repeated_ids(spark, monkeypatch):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(700))
    noise = lambda n: "".join(r.choice("qrstuvwxyz ") for _ in range(n))
    rows = [(1, noise(9000) + passage + noise(5000) + passage[:400]), (2, noise(200) + passage), (3, noise(50)), (4, noise(300) + passage[100:350] + "é" * 80), (4, "é" * 80)]
    want, seen = Counter(), set()
    mark = lambda t: __import__("xxhash").xxh3_64_intdigest(t.encode())
    for i, t in sorted(rows, key=lambda x: (x[0], mark(x[1]))):
        raw, cover = t.encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                cover |= set(range(p, p + 100))
            seen.add(raw[p : p + 100])
        want[i, len(raw), len(cover), hashlib.sha256(bytes(b for j, b in enumerate(raw) if j not in cover)).hexdigest()] += 1
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 1000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in suffix_dedup.remove_repeats(df).collect()) == want
    with pytest.raises(Exception, match="cannot be taken"):
        suffix_dedup.remove_repeats(spark.createDataFrame([(2**63 - 1, "x")], "doc_id long, text string")).collect()


def line_units(text):
    return (text or "").split("\n")


def test_line_dedup_matches_brute_force(docs, nothing, odd):
    strip = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text, *_ in ROWS:
        for line in line_units(text):
            if len(strip(line)) >= 40:
                holders[strip(line)].add(i)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    dropped = 0
    for i, text, *_ in ROWS:
        kept = [x for x in line_units(text) if len(holders[strip(x)]) < 5 or max(holders[strip(x)]) == i]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(line_units(text)), len(line_units(text)) - len(kept))
        assert got[i].kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        dropped += got[i].n_dropped
    assert dropped > 5
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert line_dedup.filter_lines(odd).columns == odd.columns and line_dedup.filter_lines(odd).count() == 5


def test_line_runs_anti_join_and_compact(spark):
    from threadloom.llm._common import Scratch

    runs = line_dedup.LineRuns(spark, Scratch(spark, "t"), fan_out=2)
    batch = lambda *rows: spark.createDataFrame([(d, k.encode()) for d, k in rows], "doc_id long, key binary")
    for b in (batch((1, "a"), (1, "b")), batch((2, "b"), (3, "c")), batch((4, "c"))):
        runs.add(b)
    assert [len(x) for x in runs.levels] == [1, 1]
    fresh = runs.new_keys(spark.createDataFrame([(b"c", 1, 9), (b"z", 1, 9)], "key binary, n_docs long, last_doc long"))
    assert [bytes(r.key) for r in fresh.collect()] == [b"z"]
    # stored tables meet without a shuffle, and without a sort where their scans count as sorted
    with line_dedup._ordered_scans(spark):
        plan = runs.new_keys(spark.table(runs.names()[0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == len(runs.names()) and "Exchange" not in plan and "Sort [" not in plan
    assert "Exchange" not in runs.totals()._jdf.queryExecution().executedPlan().toString()
    assert {(bytes(r.key), r.n_docs, r.last_doc) for r in runs.totals().collect()} == {(b"a", 1, 1), (b"b", 2, 2), (b"c", 2, 4)}


def test_line_dedup_goes_by_the_anti_join(docs, monkeypatch):
    calls, own = [], line_dedup.LineRuns.new_keys
    monkeypatch.setattr(line_dedup.LineRuns, "new_keys", lambda self, rows: calls.append(len(self.names())) or own(self, rows))
    line_dedup.dedup_lines(docs).count()
    assert len(calls) == line_dedup.BATCHES - 1 and min(calls) > 0


def test_line_runs_hold_each_key_once(spark):
    from threadloom.llm._common import Scratch

    runs = line_dedup.LineRuns(spark, Scratch(spark, "t"), fan_out=3)
    for rows in ([(1, b"a"), (2, b"b")], [(3, b"b"), (4, b"c")], [(5, b"b"), (6, b"c")], [(7, b"a"), (8, b"d")]):
        runs.add(spark.createDataFrame(rows, "doc_id long, key binary"))
    assert sorted(bytes(r.key) for n in runs.names() for r in spark.table(n).collect()) == [b"a", b"b", b"c", b"d"]
    assert {(bytes(r.key), r.n_docs, r.last_doc) for r in runs.totals().collect()} == {(b"a", 2, 7), (b"b", 3, 5), (b"c", 2, 6), (b"d", 1, 8)}


def sentence_units(text):
    """Pieces of a text, cut behind sentence and line ends and the white space after them."""
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] in "\n。！？" or (text[i] in ".!?" and text[i + 1 : i + 2] in set(" \t\x0b\x0c\r")):
            i += 1
            while i < len(text) and text[i] in " \t\n\x0b\x0c\r":
                i += 1
            out.append(text[start:i])
            start = i
        else:
            i += 1
    return out + ([text[start:]] if start < len(text) else [])


def test_substring_dedup_matches_brute_force(spark, docs, nothing, odd):
    r = random.Random(11)
    pool = [" ".join(r.choice(["alpha", "Beta", "gamma", "delta-x", "eps"]) for _ in range(r.randint(3, 30))) + r.choice([". ", "!\t", "?\n", "\n", ".x ", "。"]) for _ in range(40)]
    rows = ROWS + [(100 + i, "".join(r.choice(pool) for _ in range(r.randint(1, 12))), "en", "a", 1) for i in range(60)]
    key = lambda x: " ".join(words(lower(x)))
    size = lambda k: max(len(k.split(" ")), len(k) // substring_dedup.WORD_CHARS) if k else 0
    seen, dropped, single = set(), 0, 0
    got = {r.doc_id: r for r in substring_dedup.dedup_units(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        cut = sentence_units(text or "")
        keys, gone = [key(u) for u in cut], set()
        for a in range(len(cut)):
            ends = [b for b in range(a + 1, len(cut) + 1) if sum(map(size, keys[a:b])) >= substring_dedup.MIN_WORDS]
            if ends and keys[a]:
                run = " ".join(keys[a : ends[0]])
                if run in seen:
                    gone |= set(range(a, ends[0]))
                    single += ends[0] == a + 1
                seen.add(run)
        places = [sum(map(len, cut[:a])) for a in range(len(cut))]
        spans = [f"{places[a]}-{places[a] + len(cut[a])}" for a in sorted(gone)]
        kept = "".join(u for a, u in enumerate(cut) if a not in gone)
        assert (got[i].text, got[i].spans, got[i].n_units) == (kept, ",".join(spans), len(cut)) or (text is None and got[i].text == "")
        dropped += len(spans)
    assert single > 20 and dropped > single
    assert substring_dedup.dedup_units(nothing).count() == 0
    got = substring_dedup.dedup_units(odd).collect()
    assert len(got) == 5 and all(r.text == (t or "") for r, t in zip(sorted(got, key=lambda r: r.kept), ["some text here to keep as it is", "", *["again and again the same"] * 2, "again and again the same"], strict=False))


def test_substring_dedup_takes_units_without_spaces(spark):
    han, thai = "人工智能正在改变世界" * 4, "ประเทศไทยมีชาย" * 3
    units = [han, thai, "https://example.com/" + "a/very/long/path" * 10, "QUJD" * 50 + "=="]
    short = ["人工", "one two three four", "x" * 159, " ".join("w" * 15)]
    own = lambda i, k: f"only in row {i} at {k} of this table"
    df = spark.createDataFrame([(i, "\n".join(x for k, u in enumerate([*units, *short]) for x in (own(i, k), u))) for i in (1, 2)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup_units(df).collect()}
    assert (got[1].n_dropped, got[2].n_dropped) == (0, len(units))
    assert got[2].text.split("\n") == [*[own(2, k) for k in range(4)], *[x for k, u in enumerate(short, 4) for x in (own(2, k), u)]]


def test_substring_dedup_finds_passages_wherever_they_stand(spark):
    """A passage of 51 words that another document has before is caught; documents without a repeated one of 20 words stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((x.doc_id, words(lower(x.text or ""))) for x in docs.collect())
    windows = lambda w, n: {hash(tuple(w[k : k + n])) for k in range(len(w) - n + 1)}
    held, later, often, seen = set(), set(), set(), set()
    for i, w in rows:
        here = windows(w, 51)
        if here & held:
            later.add(i)
        held |= here
        short = [hash(tuple(w[k : k + 20])) for k in range(len(w) - 19)]
        if len(set(short)) < len(short) or seen & set(short):
            often.add(i)
        seen |= set(short)
    cut = {x.doc_id for x in substring_dedup.dedup_units(docs).where("n_dropped > 0").collect()}
    assert len(later) > 50 and len(cut & later) >= 0.95 * len(later)
    assert len(cut - often) <= 0.01 * len(rows)


def test_token_output_round_trip(spark, docs, nothing, odd, tmp_path):
    from tokenizers import Tokenizer

    file = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(file)
    rows = token_output.with_crc(token_output.token_table(docs, file, str(tmp_path / "orc"), bytes_each=2000)).collect()
    at = 0
    for r, (i, text, *_) in zip(sorted(rows, key=lambda r: r.doc_id), sorted(ROWS, key=lambda r: r[0]), strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(list((tmp_path / "orc").glob("*.orc"))) > 1
    assert token_output.token_table(nothing, file, str(tmp_path / "none")).count() == 0
    assert token_output.with_crc(token_output.token_table(odd, file, str(tmp_path / "odd"))).count() == 5


def test_token_files_have_stripes_and_skip_row_groups(spark, tmp_path, monkeypatch):
    import pyarrow.orc

    monkeypatch.setattr(token_output, "ROW_INDEX_STRIDE", 1000)
    monkeypatch.setattr(token_output, "STRIPE_BYTES", 10_000)
    monkeypatch.setattr(token_output, "STRIPE_CHECK_ROWS", 250)
    r = random.Random(1)
    rows = [(3 * i, " ".join(r.choice(["alpha", "beta", "<|endoftext|>", "漢字", "a.b,c"]) for _ in range(60))) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    file, path = tokenizer_path("word_bpe_49k.json"), str(tmp_path / "orc")
    whole = {x.doc_id: x for x in token_output.token_table(df, file, path, bytes_each=1 << 30).collect()}
    files = list((tmp_path / "orc").glob("*.orc"))
    assert max(pyarrow.orc.ORCFile(f).nstripes for f in files) > 1

    def scanned(frame):
        rows_ = frame.collect()
        leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size()) if "FileScan orc" in leaves.apply(i).toString()]
        return rows_, sum(x.metrics().apply("numOutputRows").value() for x in scans)

    ids = [300, 301, 21_000]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got, read = scanned(token_output.read_documents(spark, path, ids))
        assert {x.doc_id: x for x in got} == {i: whole[i] for i in (300, 21_000)}
        assert 2 <= read <= 4000  # some row groups of a thousand out of eight thousand rows
        # no row group can hold these: beyond all statistics, and within them but in no Bloom filter
        assert scanned(token_output.read_documents(spark, path, [10**9]))[1] == 0
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(f.stat().st_size for f in files) // 3))
        assert token_output.read_orc(spark, path).rdd.getNumPartitions() > len(files)
        assert {x.doc_id: x for x in token_output.read_orc(spark, path).collect()} == whole
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_very_long_texts(spark, tmp_path):
    """Texts above the slice size, one with copies of a passage, through each operator on texts."""
    from tokenizers import Tokenizer

    r = random.Random(6)
    words_ = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    long_ = "\n".join(" ".join(r.choice(words_) for _ in range(30)) for _ in range(14_000))
    assert len(long_) > _common.SLICE_BYTES
    texts = {1: long_, 2: long_ + "\nReleased under the MIT License.", 3: "short " + long_[:150]}
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    n = {i: len(words(t)) for i, t in texts.items()}
    assert {x.doc_id: (x.n_words, x.n_dup_lines) for x in quality.score_quality(df).collect()} == {i: (n[i], 0) for i in texts}
    sets = {i: len(set(zip(*(words(t)[k:] for k in range(5))))) for i, t in texts.items()}
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df).collect()} == {1: (sets[1], 1), 2: (sets[2], 1), 3: (sets[3], 3)}
    assert {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 0, 3: 0}
    assert {x.doc_id: x.n_dropped for x in substring_dedup.dedup_units(df).collect()} == {1: 0, 2: 14_000, 3: 0}
    removed = {x.doc_id: x.n_removed for x in suffix_dedup.remove_repeats(df).collect()}
    assert removed == {1: 0, 2: len(long_), 3: 150}
    assert {x.doc_id: x.licenses for x in license_scan.scan_licenses(df).collect()} == {1: "", 2: "MIT", 3: ""}
    assert {x.doc_id: x.size for x in mixing.sizes(df).collect()} == n
    coded = sentencepiece_codec.encode_pieces(df, tokenizer_path("piece_bpe_32k.model"))
    assert coded.where("decoded = text").count() == 3
    file = tokenizer_path("word_bpe_49k.json")
    ids = Tokenizer.from_file(file).encode(long_, add_special_tokens=False).ids + [1]
    got = token_output.with_crc(token_output.token_table(df, file, str(tmp_path / "orc"))).where("doc_id = 1").first()
    assert (got.n_tokens, got.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_sentencepiece_cuts_scripts_without_spaces():
    """Ids equal those of the search over whole runs; a line of Chinese is many short units."""
    import time

    coder = sentencepiece_codec.Viterbi(sentencepiece_codec.load_pieces(tokenizer_path("piece_bpe_32k.model")))
    r = random.Random(4)
    signs = ["的一是不了人我在有他这中大来上个国", "ประเทศไทยมีชาย", "カタカナひらがな", "abcDEF123", "éüß", "“”…—", "😀🎉", " \n\t", "абвг"]
    texts = ["".join(r.choice(r.choice(signs)) for _ in range(r.randint(1, 80))) for _ in range(400)] + ["中" * 300, "", "的 的\n的", "\u2581中\u2581"]
    got, offsets = coder.encode(pa.array(texts))
    whole = sentencepiece_codec.Viterbi(coder.table)
    whole._apart = lambda data: np.zeros(0, np.int64)
    want, ends = whole.encode(pa.array(texts))
    assert got.tolist() == want.tolist() and offsets.tolist() == ends.tolist()
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    points = sentencepiece_codec.code_points(data, np.flatnonzero((data & 0xC0) != 0x80))
    assert points.tolist() == [ord(c) for c in "".join(texts)]

    def rate(make) -> float:
        text = "\n".join(make() for _ in range(2000))
        start = time.process_time()
        coder.encode(pa.array([text]))
        return len(text.encode()) / (time.process_time() - start)

    english = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    assert rate(lambda: "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(r.randint(30, 900)))) > 0.1 * rate(lambda: " ".join(r.choice(english) for _ in range(150)))


def test_sentencepiece_viterbi_and_round_trip(docs, nothing, odd):
    file = tokenizer_path("piece_bpe_32k.model")
    table = sentencepiece_codec.load_pieces(file)
    known = {table.pieces[i]: int(i) for i in np.flatnonzero(table.usable)}
    lone_score = table.scores[table.usable].min() - sentencepiece_codec.UNKNOWN_PENALTY

    def brute(text):
        if not text:
            return []
        s = " " + text
        best, back = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + 16) + 1):
                v = known.get(s[i:j].encode())
                if v is not None and best[i] + table.scores[v] > best[j]:
                    best[j], back[j] = best[i] + table.scores[v], (i, [v])
            if s[i].encode() not in known and best[i] + lone_score > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + lone_score, (i, [int(table.byte_ids[b]) for b in s[i].encode()])
        out, e = [], len(s)
        while e:
            e, ids = back[e][0], back[e][1]
            out[:0] = ids
        return out

    got = {r.doc_id: r for r in sentencepiece_codec.encode_pieces(docs, file).collect()}
    for i, text, *_ in ROWS:
        assert got[i].piece_ids == brute(text)
        assert got[i].decoded == (text or "")
    assert sentencepiece_codec.encode_pieces(nothing, file).count() == 0
    assert sentencepiece_codec.encode_pieces(odd, file).count() == 5


def test_license_rules(spark, nothing, odd):
    texts = {
        1: "Intro.\nReleased under the MIT License.\nMore text", 2: "Licensed under the Apache License, Version 2.0.", 3: "This work is licensed under the GNU General Public License, version 3.",
        4: "Licensed under CC BY-NC 4.0.", 5: "no rights at all", 6: None, 7: "SPDX-License-Identifier: BSD-3-Clause",
        8: "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list.\n"
        "Redistributions in binary form must reproduce the above copyright notice, this list.",
        9: "Released under the MIT License. Licensed under CC BY-NC 4.0.", 10: "The license office is closed.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(df).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "GPL-3.0-only", 4: "CC-BY-NC-4.0", 5: "", 6: "", 7: "BSD-3-Clause", 8: "BSD-2-Clause", 9: "MIT CC-BY-NC-4.0", 10: ""}
    plan = license_scan.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert license_scan.scan_licenses(nothing).count() == 0
    assert license_scan.scan_licenses(odd).count() == 5


APACHE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
BSL = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software"""
CC = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
BSD4 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software.
4. Neither the name of the Institute nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def licenses_by_hand(text):
    """The tables of sentences and rules, walked through by loops over identifiers."""
    text = text.translate(str.maketrans("|~<>", "    "))
    text = re.sub(r"(?i)(SPDX-License-Identifier:[^\r\n]*)|:[ \t]*(?=\r?\n)", lambda m: (m[1] or "") + " . ", text)
    text = re.sub(r"(?m)^[ \t]*(?:dnl|DNL|rem|REM)[ \t]", "", text)
    text = re.sub(r"\n[ \t]*(?:(?://+|/?\*+|#+|;+|%+|--+)[ \t]*)?([a-z])", r" \1", text)
    text = re.sub(r"[.;!?]+(?=[ \t\n\x0b\f\r]|$)", " | ", text).replace("\n", " ~ ")
    text = re.sub(r"(?<![0-9])\.|\.(?![0-9])", "", text.lower())
    text = re.sub(r"[^a-z0-9.+|~]+", " ", "| " + text + " |").replace("licence", "license")
    for name, pattern in license_scan.SENTENCES.items():
        text = re.sub(license_scan._whole(pattern), lambda m, name=name: f"<{name}@{(m[1] if m.re.groups else '') or ''}> |", text)
    ids = [tuple(x.strip().replace(" ", "-").split("@")) for x in re.findall("<([^>]*)>", text)]
    for rule in license_scan.RULES:
        i, k = 0, len(rule.sequence)
        while i + k <= len(ids):
            if tuple(x[0] for x in ids[i : i + k]) == rule.sequence:
                version = next((v for n, v in ids[i : i + k] if "([" in license_scan.SENTENCES[n]), "")
                ids[i : i + k] = [("=", rule.licence.replace("*", version))]
            i += 1
    names, out = {n.lower(): n for n in license_scan.SPDX_NAMES}, []
    for name in (x[1] for x in ids if x[0] == "="):
        name = re.sub(r"^((?:A|L)?GPL-[0-9])-", r"\1.0-", name)
        out += [names.get(w, w) for w in re.split(r"-(?:or-(?!later(?:-|$))|and-|with-)", name[5:]) if w] if name.startswith("SPDX:") else [name]
    return " ".join(out)


def test_license_scan_matches_brute_force(spark):
    standard = [APACHE, GPL2, GPL3, LGPL, GPL2_ONLY, MPL, MIT, BSD2, BSD3, BSD4, ISC, ZLIB, BSL, CC, AGPL, "SPDX-License-Identifier: MIT", "Released under the MIT License.", "Licensed under CC BY 4.0."]
    r = random.Random(2)
    mixed = ["\n".join(r.choice(["", "Some words. ", "# "]) + r.choice(standard) for _ in range(r.randint(1, 6))) for _ in range(150)]
    mixed += [" ".join(s.split()[: r.randint(3, 60)]) for s in standard for _ in range(5)] + ["long " * 20_000 + MIT + " long" * 20_000]
    df = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string").withColumn("__licenses", F.lit(1))
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for rows in (df, table):
        texts = {x.doc_id: x.text or "" for x in rows.collect()}
        got = {x.doc_id: x.licenses for x in license_scan.scan_licenses(rows).collect()}
        assert got == {i: licenses_by_hand(t) for i, t in texts.items()}
        assert len(set(got.values())) >= 5


def test_standard_license_headers(spark):
    headers = {
        APACHE: "Apache-2.0", GPL2: "GPL-2.0-or-later", GPL3: "GPL-3.0-or-later", LGPL: "LGPL-2.1-or-later", GPL2_ONLY: "GPL-2.0-only", MPL: "MPL-2.0", MIT: "MIT", BSD2: "BSD-2-Clause", BSD3: "BSD-3-Clause",
        "SPDX-License-Identifier: MIT\npackage main": "MIT",
        "SPDX-License-Identifier: GPL-2.0-or-later OR (Apache-2.0 AND BSD-3-Clause)\nx": "GPL-2.0-or-later Apache-2.0 BSD-3-Clause", ISC: "ISC", ISC.partition(", provided")[0] + ".": "0BSD", ZLIB: "Zlib", BSL: "BSL-1.0", CC: "CC-BY-SA-4.0", BSD4: "BSD-4-Clause", AGPL: "AGPL-3.0-or-later",
        "This file is not\nlicensed under the MIT License": "", "It is not released under the MIT License.": "",
        "Released under the MIT License\n" + GPL3: "MIT GPL-3.0-or-later",
    }
    marks = ["", "// ", " * ", "# ", "dnl ", ";; ", "-- "]
    texts = [(i, "\n".join(mark + line for line in text.split("\n")), want) for i, (text, want, mark) in enumerate((t, w, m) for t, w in headers.items() for m in marks)]
    texts += [(len(texts) + i, text.replace("\n", "\r\n"), want) for i, (text, want) in enumerate(headers.items())]
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: want for i, _, want in texts}


def test_mixing_targets_and_copies(spark, docs, nothing, odd):
    got = mixing.mix(mixing.sizes(docs)).collect()
    again = mixing.mix(mixing.sizes(docs.repartition(5))).collect()
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again}
    size = defaultdict(int)
    for _, text, _, source, _ in ROWS:
        size[source] += len(words(text))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.copies <= 2
    for s in names:
        taken = sum(r.size * (r.copies * r.n + r.more) for r in got if r.source == s)
        assert abs(taken - target[s]) <= max(10, min(r.size for r in got if r.source == s and r.size))
    assert mixing.mix(mixing.sizes(nothing)).count() == 0
    assert mixing.mix_documents(nothing).count() == 0
    assert mixing.mix_documents(odd).columns == odd.columns


def test_mixing_rounds_each_of_repeated_rows(spark, monkeypatch):
    rows = [(1, "ten words " * 5, "a")] * 100 + [(None, "x " * 7, "a")] * 31 + [(i, "y " * 40, "b") for i in range(10, 60)] + [(i, "z " * 9, None) for i in range(70, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__doc", F.lit("kept"))
    taken, want = Counter(), {}
    for r in mixing.mix(mixing.sizes(df)).collect():
        taken[r.source] += r.size * (r.copies * r.n + r.more)
        want[r.source] = r.target
        assert 0 <= r.copies and r.copies + (r.more > 0) <= 2
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and {r["__doc"] for r in out.collect()} == {"kept"}
    again = Counter(r.source for r in out.collect() for _ in words(r.text))
    assert again == taken
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="has not come within"):
        mixing.mix(mixing.sizes(df)).count()


def test_topk_matches_brute_force(spark):
    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)]) for i in range(300)] + [(400, None), (500, [float("nan")] * 8), (301, [0.5] * 8), (302, [0.5] * 8), (600, [0.25] * 8), (700, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    q = topk_search.quantise(df)
    got = defaultdict(list)
    for row in topk_search.top_k(q, q.where("vec_id % 100 = 0"), data_block=50, seed_rows=40).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    exact = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in vectors if v is not None and not any(np.isnan(v))}
    for i in [k for k in exact if k % 100 == 0]:
        want = sorted(((-sum(a * b for a, b in zip(exact[i], exact[j])), j) for j in exact if j != i))[:10]
        assert got[i] == [(j, -s) for s, j in want]
    none = topk_search.quantise(df.where("vec_id < 0"))
    assert topk_search.top_k(none, none).count() == 0
    few = topk_search.quantise(df.where("vec_id IN (0, 1, 2)"))
    assert topk_search.top_k(few, few.where("vec_id = 0")).count() == 2


def test_topk_ties_repeated_and_null_ids_and_large_components(spark):
    same = [float(i % 3) for i in range(20)]
    rows = [(100, same), (100, same), (100, [2.0] * 20), (None, [9.0] * 20), (200, [1e18] * 20), (201, [-1e18, 1.0]), (300, [5e9] * 20), (301, [3e8] * 20)] + [(i, same) for i in range(400, 499)] + [(500, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = topk_search.quantise(df)
    ids = [(i, [int(np.floor(1024 * x)) if abs(1024 * x) < 2**53 else int(1024 * x) for x in v] + [0] * (20 - len(v))) for i, v in rows if i is not None]
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = []
    for n, (i, v) in enumerate(ids):
        if i % 100 == 0:
            found = sorted((-held(sum(a * b for a, b in zip(v, w))), j) for m, (j, w) in enumerate(ids) if m != n)[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    for block, seeds in ((1 << 17, 2048), (7, 30)):
        got = [tuple(r) for r in topk_search.top_k(q, q.where("vec_id % 100 = 0"), data_block=block, seed_rows=seeds).select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(got) == sorted(want)


def lines_by_hand(rows):
    strip = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        for key in {strip(x) for x in line_units(text)}:
            if len(key) >= 40:
                holders[key].append((-1 if i is None else i, n))
    out = []
    for i, text in rows:
        keep = [x for x in line_units(text) if len(holders[strip(x)]) < 5 or max(holders[strip(x)])[0] == (-1 if i is None else i)]
        out.append((i, "\n".join(keep)))
    return out


def one_of_each_by_hand(rows):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    gone = {i for n, (i, _) in enumerate(rows) if i is not None and i != least[find(n)]}
    return [(i, t) for i, t in rows if i not in gone]


def test_pipeline_matches_brute_force(spark, tmp_path, nothing):
    import corpus_pipeline

    r = random.Random(12)
    common = "This line stands in many of the documents of the small test corpus."
    rows = []
    for i in range(70):
        lines = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(r.randint(5, 12))) for _ in range(r.randint(6, 12))]
        if i % 3 == 0:
            lines.insert(2, common if i % 2 else common.upper())
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, t + " more") for i, (_, t) in enumerate(rows[:12])] + [(7, rows[7][1]), (None, rows[20][1]), (None, rows[21][1] + " x"), (200, None), (201, ""), (202, "too short"), (203, "again and again " * 60)]
    data = [(i, t, "en", ["a", None, "b"][n % 3], None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    want = [(i, t) for i, t in rows if quality_by_hand(t)[0]]
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    check = lambda frame, rows_: sorted(((x.doc_id is None, x.doc_id or 0, x.text) for x in frame.collect())) == sorted((i is None, i or 0, t) for i, t in rows_)
    for name, by_hand in (("quality rules", lambda x: x), ("line dedup", lines_by_hand), ("n-gram Jaccard join", one_of_each_by_hand)):
        want = by_hand(want)
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns and check(out, want), name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    assert 30 < len(want) < len(rows) - 15
    assert all(x.n_chars == len(x.text) for x in docs.collect())
    mixed = Counter((x.doc_id, x.text) for x in stages["mixing to target weights"](spark, docs, folder).collect())
    kept = Counter(want)
    assert set(mixed) <= set(kept) and all(n <= 2 * kept[k] for k, n in mixed.items())
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((x.doc_id, x.decoded) for x in got) == mixed
    assert all(x.n_pieces == len(x.piece_ids) for x in got)
    nothing.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_induced_sorting_recurses_and_spills(monkeypatch):
    rng = np.random.default_rng(3)
    for trial in range(60):
        n, letters, width = int(rng.integers(1, 160)), int(rng.integers(1, 5)), int(rng.integers(1, 9))
        text = rng.integers(1, letters + 1, n).astype(np.uint8)
        text = np.append(np.tile(text[: n // 5 + 1], 6) if trial % 3 == 0 else text, 0).astype(np.uint8)
        monkeypatch.setattr(_induced, "BLOCK", int(rng.choice([3, 7, 1 << 18])))
        room = _induced.Room(int(rng.choice([40, 1 << 20])), None, int(rng.choice([2, 1 << 20])))
        raw, found = text.tobytes(), []
        for pos, lcp in _induced.suffixes(text, width, room):
            found += zip(pos.tolist(), lcp.tolist(), strict=True)
        assert sorted(p for p, _ in found) == list(range(len(text) - 1))
        for (p, _), (q, common) in zip(found, found[1:], strict=False):
            assert raw[p : p + width] >= raw[q : q + width]
            assert common == next((k for k in range(width) if raw[p + k : p + k + 1] != raw[q + k : q + k + 1]), width)
        seen, later = set(), _induced.later_windows(text, width, room)
        for i in range(len(text) - width):
            assert later[i] == (raw[i : i + width] in seen)
            seen.add(raw[i : i + width])

"""Sharding, token alignment and code compression against brute force, with nulls, ties, repeats, long and empty input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import code_compression, sharding, token_alignment
from threadloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, shard string, slot string, size int, segment string, block int"


def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 7))) for _ in range(80)]
    gaps = [" ", " ", " ", "  ", "\n", "\r\n", "\t", " ", "  ", "　", " \n ", "\x0b", " "]
    say = lambda n: "".join(r.choice(words) + r.choice(gaps) for _ in range(n))
    rows = [(0, None), (1, ""), (2, " "), (3, "\n\n \n"), (4, "one"), (5, "x" * 3000), (6, "a▁b c"), (7, "ab <|endoftext|> </s> <unk> <0x41> it's we'll"), (8, "   lead"), (9, "tail   ")]
    rows += [(10 + i, say(r.randint(1, 120))) for i in range(60)] + [(80, "a b"), (81, "a b"), (81, "a b"), (None, "a b"), (None, None), (90, "zero\x00byte  x"), (91, "中文没有空格的文字" * 200), (92, "a, b, c, d."), (93, ";\r\n{ }\r\n")]
    return [(i, t, "s", "t", 7, "u", 3) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(5)


# sharding ------------------------------------------------------------------------------------------------


def test_sharding_counts_and_slots(spark, docs):
    rows = sharding.place_documents(docs, shards=4, slots=512).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in texts())
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    again = sharding.place_documents(docs.repartition(2), shards=4, slots=512).collect()
    assert Counter((r["doc_id"], r["size"], r["shard"]) for r in again) == Counter((r["doc_id"], r["size"], r["shard"]) for r in rows)


def test_sharding_is_even_with_hot_copies(spark):
    hot = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("copy " * 40)).otherwise(F.repeat(F.concat(F.lit("w "), F.col("id").cast("string")), (F.col("id") % 60).cast("int"))).alias("text"))
    loads = Counter()
    for r in sharding.place_documents(hot.withColumnRenamed("id", "doc_id")).collect():
        loads[r["shard"]] += r["size"]
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 16


def test_sharding_of_one_repeated_row_and_of_nothing(spark, docs):
    rows = spark.range(0, 500, 1, 7).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    found = sharding.place_documents(rows).collect()
    assert len({r["shard"] for r in found}) == 1 and sorted(r["slot"] for r in found) == list(range(500))
    assert sharding.place_documents(docs.where("false")).count() == 0


def test_map_versions_and_growth(spark, docs, tmp_path):
    store = sharding.MapStore(spark, f"file://{tmp_path}/map")
    r = random.Random(1)
    sizes, rows = [r.randint(0, 1000) for _ in range(512)], [1] * 512
    first = store.save(sharding.build_map(sizes, rows, 8))
    grown = store.save(sharding.edit_map(first, sizes, rows, 9))
    moved = [(a, b) for a, b in zip(first.shard_of, grown.shard_of, strict=True) if a != b]
    assert moved and {b for _, b in moved} == {8}
    fair = sum(sizes) / 9
    assert all(abs(x - fair) < 0.05 * fair for x in grown.loads())
    closed = store.save(sharding.edit_map(grown, sizes, rows, 6))
    assert all(a == b for a, b in zip(grown.shard_of, closed.shard_of, strict=True) if a < 6) or max(closed.loads()) < 1.03 * sum(sizes) / 6
    assert set(closed.shard_of) == set(range(6))
    later = [s * (3 if i % 7 == 0 else 1) for i, s in enumerate(sizes)]
    edited = sharding.edit_map(first, later, rows)
    assert max(edited.loads()) < 1.03 * sum(later) / 8
    stayed = sum(a == b for a, b in zip(first.shard_of, edited.shard_of, strict=True))
    assert stayed > 400
    assert sharding.edit_map(first, sizes, rows).shard_of == first.shard_of
    assert store.versions() == [1, 2, 3] and store.read() == closed and store.read(1) == first
    with pytest.raises(Exception, match="(?i)exist"):
        store.save(first)


def test_a_stored_map_is_kept_to(spark, docs, tmp_path):
    store = sharding.MapStore(spark, f"file://{tmp_path}/map")
    rows = sharding.place_documents(docs, shards=4, slots=256, store=store).collect()
    some = sharding.place_documents(docs.where("doc_id % 2 = 0"), shards=4, slots=256, store=store).collect()
    place = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in rows}
    assert all(place[r["doc_id"], r["text_crc32"]] == r["shard"] for r in some)
    seen = sharding.with_shard(docs, store.read())
    assert seen.columns == ["doc_id", "text", "slot", "size", "segment", "block", "shard"]
    assert Counter((r["doc_id"], r["shard"]) for r in seen.collect()) == Counter((r["doc_id"], r["shard"]) for r in rows)
    sharding.write_shards(docs, store.read(), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == docs.count()


# alignment -----------------------------------------------------------------------------------------------


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = token_alignment._byte_letters()
    a_of = {i: bytes(letters[c] for c in k) for k, i in a_model.get_vocab(with_added_tokens=False).items() if k != "<|endoftext|>"}

    def b_of(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    found, count = [], Counter()
    for i, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        wanted = (" " + (text or "")).encode()
        if b"".join(a_of[x] for x in a) != wanted or b"".join(map(b_of, b)) != wanted:
            found.append((i, [], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(a_of[x]) for x in a]).tolist(), np.cumsum([len(b_of(x)) for x in b]).tolist()
        links, at, groups, pa_, pb_ = [], dict(zip(b_ends, b, strict=True)), [], 0, 0
        for k, end in enumerate(a_ends):
            if end in at:
                m = b_ends.index(end)
                links.append((a[k], b[m]))
                groups.append(",".join(map(str, a[pa_ : k + 1])) + "|" + ",".join(map(str, b[pb_ : m + 1])))
                pa_, pb_ = k + 1, m + 1
        count.update(links)
        found.append((i, a, b, groups, links))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return Counter((i, len(a), len(b), len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), ";".join(g)) for i, a, b, g, k in found)


def test_alignment(spark, docs, monkeypatch):
    for block_bytes, few in ((200, 0), (4 << 20, 400_000)):
        monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", few)
        rows = token_alignment.align_tokens(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), block_bytes).collect()
        assert Counter(tuple(r) for r in rows) == brute_alignment([(i, t) for i, t, *_ in texts()])


def test_alignment_of_nothing(spark, docs):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    assert token_alignment.align_tokens(docs.where("false"), *paths).count() == 0
    empty = token_alignment.align_tokens(docs.where("text is null"), *paths).collect()
    assert sorted(tuple(r)[1:] for r in empty) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_safe_starts_follow_the_vocabularies():
    assert token_alignment.safe_starts([b"a", b" a", b"a\rb"], [b"  ", b" a"]) == b"\t\n\x0b\x0c "
    assert token_alignment.safe_starts([b"a b"], [b" \n"]) == b"\t\x0b\x0c\r"
    assert 32 in token_alignment.safe_starts(["  ".encode()], [])


# codes ---------------------------------------------------------------------------------------------------


def brute_codes(rows, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // 8)
    kept = [(i, v + [0] * (8 * width - len(v)), label) for i, v, label in kept]
    pieces = [[tuple(v[p * width : (p + 1) * width]) for p in range(8)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0))[:entries]
    books = [[list(pieces[j][p]) for j in order] for p in range(8)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(x[p], books[p][e]), e)) for p in range(8)] for x in pieces]
    for _ in range(rounds):
        code = assign()
        for p in range(8):
            for e in range(len(books[p])):
                mine = [x[p] for x, c in zip(pieces, code, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    code = assign()
    errors = [sum(far(x[p], books[p][c[p]]) for p in range(8)) for x, c in zip(pieces, code, strict=True)]
    by = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(c) for part in books for e in part for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in cs), e, by[label], digest) for (i, _, label), cs, e in zip(kept, code, errors, strict=True))


@pytest.mark.parametrize("kind", ["gauss", "grid", "equal", "few", "large", "ragged"])
def test_codes(spark, kind):
    r = random.Random(5)
    if kind == "gauss":
        rows = [(i, [r.gauss(i % 5, 1) / 8 for _ in range(32)], i % 4) for i in range(400)]
    elif kind == "grid":  # many ties
        rows = [(i, [float(r.randint(-1, 1)) for _ in range(16)], None if i % 3 else 1) for i in range(300)]
    elif kind == "equal":
        rows = [(i, [0.5] * 8, 1) for i in range(50)]
    elif kind == "few":
        rows = [(i, [r.random() for _ in range(8)], i) for i in range(5)]
    elif kind == "large":
        rows = [(i, [r.choice([1e5, -2e5, 3e4, 1e-9]) * r.random() for _ in range(16)], 1) for i in range(60)]
    else:
        rows = [(i, [r.random() for _ in range(8 + i % 9)], 1) for i in range(60)]
    rows += [(1000, None, 1), (1001, [math.nan] * 8, 1), (1002, [None, *[1.0] * 7], 1), (1003, [math.inf] * 8, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found = code_compression.compress(vectors)
    assert Counter(tuple(x) for x in found.collect()) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    rows = [(None, [1.0] * 8, 1), (3, [2.0] * 8, None), (3, [2.0] * 8, None), (1, [float("1e30")] * 8, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).withColumn("v", F.lit(1))
    found = code_compression.compress(vectors).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in found) == [(False, 1), (False, 3), (False, 3), (True, 0)]
    assert all(r["error"] == 0 for r in found)
    assert code_compression.compress(vectors.where("vec_id = 9")).collect() == []


def test_label_errors_salted(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else str(i % 5), "00", i) for i in range(200)]
    coded = spark.createDataFrame(rows, "vec_id long, label string, code string, error long")
    plain = sorted(map(tuple, code_compression.label_errors(coded).collect()), key=str)
    monkeypatch.setattr(code_compression, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, code_compression.label_errors(coded).collect()), key=str) == plain
    assert len(plain) == 200


def test_bounds_spare_full_scans():
    r = np.random.default_rng(1)
    x = (r.normal(size=(2000, 4)) * 4096).astype(np.int64)
    books = code_compression.Codebooks([[v.tolist() for v in x[:16]]])
    code, upper, lower = code_compression._scan(x, books, 0)
    scans = []
    for _ in range(6):
        sums = {}
        for e in range(16):
            sums[e * 5] = int((code == e).sum())
            for i in range(4):
                sums[e * 5 + 1 + i] = int(x[code == e, i].sum())
        books = books.update(sums, 4)
        code, upper, lower, n = code_compression._reassign(x, code, upper, lower, books, 0)
        scans.append(n)
        assert np.array_equal(code, np.argmin(code_compression._distances(x, books, 0), axis=1))
    assert scans[-1] < 1500


# mixing --------------------------------------------------------------------------------------------------


def test_mixing_keeps_large_ids_beside_null_ones(spark):
    from threadloom.llm import mixing

    big = [None, (1 << 53) + 1, (1 << 53) + 3, 1, -(1 << 62) - 1, (1 << 63) - 1]
    rows = spark.createDataFrame([(i, "a b c", s) for i in big for s in ("x", None)], "doc_id long, text string, source string").coalesce(1)
    plan = mixing.mix(mixing.sizes(rows)).collect()
    assert Counter((r["doc_id"], r["source"]) for r in plan) == Counter((i, s) for i in big for s in ("x", None))
    taken = mixing.mix_documents(rows).collect()
    assert {r["doc_id"] for r in taken} <= set(big) and len(taken) == sum(r["copies"] * r["n"] + r["more"] for r in plan)


def test_ngram_join_drops_its_shuffle_files(spark):
    """op2_ngram_join leaves no shuffle files of its tables behind, and the session's setting as it was."""
    import time

    from threadloom.llm.ngram_join import jaccard_components
    from threadloom.sources.shared import CLEANUP

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, setting = blocks.getAllBlocks().size(), spark.conf.get(CLEANUP, None)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:58])), (3, " ".join(words[::-1])), (4, None)], "doc_id long, text string")
    out = jaccard_components(docs)
    until = time.time() + 20
    while blocks.getAllBlocks().size() > before and time.time() < until:
        time.sleep(0.2)
    assert blocks.getAllBlocks().size() <= before and spark.conf.get(CLEANUP, None) == setting
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_suffix_dedup_sorts_only_what_may_repeat(spark, monkeypatch, tmp_path):
    """op3_suffix_dedup: windows that stand once, and copies of what is left, do not reach the suffix sorting."""
    import random

    import numpy as np
    import pyarrow as pa

    from threadloom.llm import suffix_dedup
    from threadloom.llm._induced import Room, later_windows

    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh \u00e9", k=n))
    passage, other = text(300), text(250)
    bodies = [(text(200) + (passage if i % 3 else other[i % 40 :]) + text(200)).encode() for i in range(60)]
    names = ["doc_id", "mark", "pos", "body"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([0] * 60, pa.int64()), pa.array([0] * 60, pa.int32()), pa.array(bodies)], names=names)
    sizes = []
    monkeypatch.setattr(suffix_dedup, "later_windows", lambda text, width, room: sizes.append(len(text)) or later_windows(text, width, room))
    for memory in (64 << 20, 1 << 10):
        shard = suffix_dedup._Shard(Room(memory, str(tmp_path)))
        shard.add(batch.slice(0, 25))
        shard.add(batch.slice(24))  # a row that repeats is one
        got = {(d, p + k) for t in shard.repeats(100) for d, ps, rs in zip(*(t[c].to_pylist() for c in ("doc_id", "pos", "run")), strict=True) for p, r in zip(ps, rs, strict=True) for k in range(r)}
        seen, want = set(), set()
        for d, b in enumerate(bodies):
            for p in range(len(b) - 99):
                if (w := b[p : p + 100]) in seen:
                    want.add((d, p))
                seen.add(w)
        assert got == want
    assert sizes and max(sizes) < sum(map(len, bodies)) / 2
    hashes = np.array([rng.choice([rng.getrandbits(64), 7, 2**63 + 1]) for _ in range(5000)], np.uint64)
    value, count = np.unique(hashes, return_counts=True)
    for memory in (1 << 20, 1 << 10):
        assert (suffix_dedup.met_again(hashes, Room(memory)) == np.isin(hashes, value[count > 1])).all()


def test_ngram_join_takes_its_texts_slice_by_slice(spark, monkeypatch):
    """op2_ngram_join: texts of the sets that stay cross the shuffle in slices, and sets with all their signatures not at all."""
    from threadloom.llm import _common, ngram_join

    monkeypatch.setattr(ngram_join, "TEXT_BYTES", 1, raising=False)
    written, save = {}, _common.Scratch.save
    monkeypatch.setattr(_common.Scratch, "save", lambda self, df, name, *a, **k: written.update({name: df._jdf.queryExecution().executedPlan().toString()}) or save(self, df, name, *a, **k))
    words = [f"w{i}" for i in range(60)]
    rows = [(10 * i + j, " ".join([f"g{i}", *words[i:], *[f"x{i}.{k}" for k in range(40)]][: 99 - j])) for i in range(6) for j in range(4)]
    once = {10 * i + j: 10 * i for i in range(6) for j in range(4)}
    near = [(None, f"{rows[0][1]} end"), (100, "one two three"), (100, rows[8][1]), (100, None)]
    for more, twice in ((near, False), ([*near, rows[0], rows[0], (100, rows[8][1])], True)):
        written.clear()
        docs = spark.createDataFrame([*rows, *more], "doc_id long, text string")
        got = Counter((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
        want = Counter(once.items()) + Counter({(None, 0): 1, (100, 100): 2, (100, 20): 1})
        want += Counter({(0, 0): 2, (100, 20): 1}) if twice else Counter()
        assert got == want
        assert ("sets/once" in written) == twice
        assert sum(name.startswith("sets/all") for name in written) == ngram_join.TEXT_SLICES
        assert not any("hashpartitioning(set_id" in written[name] for name in written if name.startswith("sets/all"))

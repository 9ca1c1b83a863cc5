"""Registered queries of the subpackage, their SQL where SQL can say it, and the pipeline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import code_compression, license_scan, line_dedup, mixing, ngram_join, quality, sentencepiece_codec, sharding, substring_dedup, suffix_dedup
from threadloom.llm import token_alignment, token_output, topk_search
from threadloom.llm._common import Scratch, documents, ids_and_text


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the folder can be set by TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(ids_and_text(documents(spark, sf_dir))).drop("text")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(ids_and_text(documents(spark, sf_dir)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(ids_and_text(documents(spark, sf_dir))).drop("spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_units(ids_and_text(documents(spark, sf_dir))).drop("text")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-output").path("orc")
    return token_output.with_crc(token_output.token_table(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), path))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_pieces(ids_and_text(documents(spark, sf_dir)), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_pieces", "pieces_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(ids_and_text(documents(spark, sf_dir))).drop("text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(mixing.sizes(documents(spark, sf_dir)))
    rows = plan.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("copies") + F.when(F.col("again") <= F.col("more"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "rate")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(ids_and_text(documents(spark, sf_dir))).drop("text", "spans")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_documents(documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") + F.col("n_b") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_output": op5_token_output,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_topk": op9_topk,
    "op10_line_dedup": op10_line_dedup,
    "op11_sharding": op11_sharding,
    "op12_alignment": op12_alignment,
    "op13_codes": op13_codes,
}

_SPACES = r"chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

ORACLE_SQL = {
    "op2_ngram_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
""",
    "op9_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op10_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
""",
    "op4_substring_dedup": f"""
WITH l AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '((?:[.!?][ \\t\\v\\f\\r]|[\\x{{3002}}\\x{{FF01}}\\x{{FF1F}}]|\\n)[ \\t\\n\\v\\f\\r]*)', '\\1' || chr(1), 'g'), chr(1)) AS u FROM documents
), p AS (SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS i FROM l
), k AS (
  SELECT doc_id, i, unit, regexp_replace(translate(trim(unit, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS key,
    CAST(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(unit) AS pos FROM p WHERE length(unit) > 0
), s AS (
  SELECT *, length(key) - length(replace(key, ' ', '')) + 1 AS words,
    length(regexp_replace(key, '[^\\x{{0E00}}-\\x{{0EFF}}\\x{{1000}}-\\x{{109F}}\\x{{1780}}-\\x{{17FF}}\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{20000}}-\\x{{3FFFF}}]', '', 'g')) AS dense FROM k
), w AS (
  SELECT *, CASE WHEN key = '' THEN 0 ELSE greatest(words + dense // 2, length(key) // {substring_dedup.WORD_CHARS}) END AS own FROM s
), c AS (SELECT *, CAST(sum(own) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM w
), e AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM c a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.upto - a.own + {substring_dedup.MIN_WORDS} <= b.upto
  WHERE a.own > 0 GROUP BY ALL
), g AS (
  SELECT c.*, e.j, md5(string_agg(key, ' ') OVER (PARTITION BY c.doc_id ORDER BY c.i ROWS BETWEEN CURRENT ROW AND (coalesce(e.j, c.i) - c.i) FOLLOWING)) AS run
  FROM c LEFT JOIN e USING (doc_id, i)
), h AS (SELECT *, j IS NOT NULL AND row_number() OVER (PARTITION BY j IS NULL, run ORDER BY doc_id, i) > 1 AS again FROM g
), d AS (
  SELECT *, coalesce(max(CASE WHEN again THEN j END) OVER (PARTITION BY doc_id ORDER BY i) >= i, false) AS gone FROM h
)
SELECT t.doc_id, count(d.i) AS n_units, count(*) FILTER (WHERE gone) AS n_dropped,
  coalesce(string_agg(CAST(pos AS VARCHAR) || '-' || CAST(pos + length(unit) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE gone), '') AS spans,
  sha256(coalesce(string_agg(unit, '' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents t LEFT JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id
""",
}


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of op13 one after the other: x are parts, c0, c1, .. codebooks, a0, a1, .. assignments."""
    assign = """a{i} AS MATERIALIZED (
  SELECT vec_id, p, list_min(list(d))::BIGINT AS d, list_position(list(d ORDER BY e), list_min(list(d)))::BIGINT - 1 AS e FROM (
    SELECT x.vec_id, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT AS d
    FROM x JOIN c{i} c ON c.p = x.p) GROUP BY vec_id, p
)"""
    update = """c{j} AS MATERIALIZED (
  SELECT p, e, list(coalesce((s - ((s % n) + n) % n) // n, o) ORDER BY pos) AS v FROM (
    SELECT u.p, u.e, u.pos, u.o, m.n, m.s FROM (SELECT p, e, unnest(v) AS o, generate_subscripts(v, 1) AS pos FROM c{i}) u LEFT JOIN (
      SELECT p, e, pos, sum(z)::BIGINT AS s, count(*) AS n FROM (
        SELECT a.p, a.e, unnest(x.v) AS z, generate_subscripts(x.v, 1) AS pos FROM a{i} a JOIN x USING (vec_id, p)) GROUP BY p, e, pos
    ) m ON m.p = u.p AND m.e = u.e AND m.pos = u.pos) GROUP BY p, e
)"""
    steps = []
    for i in range(rounds + 1):
        steps.append(assign.format(i=i))
        if i < rounds:
            steps.append(update.format(i=i, j=i + 1))
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS i
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, p, i, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) r(p)
), c0 AS MATERIALIZED (SELECT p, i AS e, v FROM x WHERE i < {entries}
), {", ".join(steps)}
, f AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
), l AS (SELECT label, sum(error)::BIGINT AS label_error FROM f JOIN k USING (vec_id) GROUP BY label
), h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT f.vec_id, f.code, f.error, l.label_error, h.codebooks_sha256 FROM f JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, h
"""


ORACLE_SQL["op13_codes"] = _codes_sql()

"""Registered queries over the driver's tables, each by its operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import vectors as V
from threadloom.operators import attachments, chunking, fusion, keyword, lookups, merge, queue, rag, reconcile, threads
from threadloom.operators.keyword import KeywordIndex
from threadloom.sources.mail import html_column
from threadloom.sources.shared import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BUILT: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build):
    """What ``build`` makes of the tables of a folder, made at the first call of a session: an index, a mailbox."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def document_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    return once(spark, sf_dir, "documents", lambda: KeywordIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text", carry=("source", "lang")))


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made of conversation turns."""
    c = table(spark, sf_dir, "conversations")
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return c.select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("message_id"), F.concat(F.lit("c"), "conv_id").alias("thread_id"),
        F.concat(F.initcap("role"), F.lit(" <"), "role", F.lit("@Example.com>")).alias("from_addr"), F.element_at(F.array(F.lit("INBOX"), F.lit("Sent"), F.lit("Archive")), (F.col("conv_id") % 3 + 1).cast("int")).alias("folder"),
        (day + F.make_dt_interval(days=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))).alias("date"), F.col("text").alias("body"),
        F.concat(F.lit("Re: Topic "), (F.col("conv_id") % 7).cast("string")).alias("subject"), (F.col("turn") % 4 == 3).alias("has_attachments"),
    )


MAIL = """mail AS (
  SELECT 'c' || conv_id || '-' || turn AS message_id, 'c' || conv_id AS thread_id, upper(role[1:1]) || role[2:] || ' <' || role || '@Example.com>' AS from_addr, role || '@example.com' AS addr,
    (['INBOX', 'Sent', 'Archive'])[CAST(conv_id % 3 AS INTEGER) + 1] AS folder, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS BIGINT)) AS date,
    text AS body, 'Re: Topic ' || (conv_id % 7) AS subject, turn % 4 = 3 AS has_attachments FROM conversations
)"""
THREADS = f"""{MAIL}, threads AS (
  SELECT thread_id, min(date) AS date_first, max(date) AS date_last, count(*) AS messages, string_agg(message_id, ',' ORDER BY date, message_id) AS message_ids,
    arg_min(subject, (date, message_id)) AS display_subject, arg_max(replace(substr(body, 1, 200), chr(10), ' '), (date, message_id)) AS snippet,
    bool_or(has_attachments) AS has_attachments, arg_min(folder, (date, message_id)) AS folder FROM mail GROUP BY thread_id
)"""


def mail_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.rollup(mail(spark, sf_dir))


@query(f"WITH {THREADS} SELECT * FROM threads")
def thread_rollup(spark, d):
    return mail_threads(spark, d)


@query(f"""WITH {MAIL}, f AS (SELECT thread_id, addr, min((date, message_id)) AS m, min(from_addr) AS who FROM mail GROUP BY ALL)
SELECT thread_id, string_agg(who, '; ' ORDER BY m) AS participants FROM f GROUP BY thread_id""")
def thread_participants(spark, d):
    found = threads.participants(mail(spark, d).withColumn("addresses", F.array("from_addr")), "thread_id", "addresses")
    return found.select("thread_id", F.array_join("participants", "; ").alias("participants"))


BLOCK = "'From: ' || from_addr || chr(10) || 'Date: ' || strftime(date, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) || substr(body, 1, {})"
BODIES = f"""people AS (SELECT thread_id, list(who ORDER BY m) AS participants FROM (SELECT thread_id, addr, min((date, message_id)) AS m, arg_min(from_addr, (date, message_id)) AS who FROM mail GROUP BY thread_id, addr) GROUP BY thread_id),
bodies AS (SELECT thread_id, 'Subject: ' || regexp_replace(lower(arg_min(subject, (date, message_id))), '^re: ', '') || chr(10) || 'Participants: ' || array_to_string(any_value(participants), ', ') || chr(10) || chr(10) ||
  string_agg({BLOCK.format(500)} || chr(10), chr(10) ORDER BY date, message_id) AS body_text FROM mail JOIN people USING (thread_id) GROUP BY thread_id)"""


@query(f"WITH {MAIL}, {BODIES} SELECT thread_id, body_text AS text FROM bodies")
def thread_embedding_text(spark, d):
    return threads.embedding_text(mail(spark, d).withColumn("addresses", F.array("from_addr")))


@query(f"WITH {THREADS} SELECT thread_id, display_subject, date_last FROM threads WHERE folder = 'INBOX' ORDER BY date_last DESC, thread_id LIMIT 20 OFFSET 5")
def list_threads_page(spark, d):
    return lookups.list_threads(mail_threads(spark, d), "INBOX", 20, 5).select("thread_id", "display_subject", "date_last")


@query("SELECT source AS folder, count(*) AS count FROM documents GROUP BY source")
def list_folders(spark, d):
    return lookups.list_folders(table(spark, d, "documents"), "source")


@query(f"WITH {THREADS} SELECT * FROM threads WHERE thread_id = 'c7'")
def get_thread(spark, d):
    return lookups.get_by_id(mail_threads(spark, d), "thread_id", "c7")


@query(f"WITH {THREADS} SELECT (SELECT count(*) FROM threads) AS threads, (SELECT min(date_first) FROM threads) AS earliest, (SELECT max(date_last) FROM threads) AS latest, (SELECT count(*) FROM mail) AS messages")
def index_stats(spark, d):
    return lookups.stats(mail_threads(spark, d), mail(spark, d))


@query("""SELECT s AS status, count(e.event_type) AS count FROM (SELECT unnest(['purchase', 'error', 'view', 'queued', 'dead']) AS s) LEFT JOIN events e ON e.event_type = s GROUP BY s""")
def queue_stats(spark, d):
    return lookups.counts_by_status(table(spark, d, "events"), "event_type", ["purchase", "error", "view", "queued", "dead"])


@query(f"""WITH {MAIL} SELECT addr AS email, min(trim(split_part(from_addr, '<', 1))) AS names, count(DISTINCT thread_id) AS threads FROM mail
WHERE lower(trim(split_part(from_addr, '<', 1)) || ' ' || addr) LIKE '%example%' GROUP BY addr""")
def find_contact(spark, d):
    rows = mail(spark, d).groupBy("thread_id").agg(F.collect_set("from_addr").alias("participants"))
    return lookups.find_contact(rows, "Example")


TERMS = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+')"


def bm25_sql(name: str, units: str, forms: list[str]) -> str:
    """CTEs that score units (id, owner, text), the last one ``name`` (id, owner, score); a form is a pattern of the words of one stem."""
    n, k = name, range(len(forms))
    counts = ", ".join(f"len(list_filter(w, lambda x: regexp_full_match(x, '{f}'))) AS a{i}" for i, f in enumerate(forms))
    score = " + ".join(f"greatest(ln((n - f{i} + 0.5) / (f{i} + 0.5)), 1e-6) * a{i} * 2.2 / (a{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in k)
    return f"""{n}_t AS (SELECT id, owner, {TERMS} AS w FROM {units}), {n}_s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {n}_t),
{n}_h AS (SELECT id, owner, len(w) AS dl, {counts} FROM {n}_t), {n}_f AS (SELECT {", ".join(f"count(*) FILTER (WHERE a{i} > 0) AS f{i}" for i in k)} FROM {n}_h),
{n} AS (SELECT id, owner, round({score}, 9) AS score FROM {n}_h, {n}_s, {n}_f WHERE {" OR ".join(f"a{i} > 0" for i in k)})"""


#: Words of the stems that the searches below meet.
LICENSE, RELEASED = "licens(e|es|ed|ing)?", "releas(e|es|ed|ing)?"
BM25 = bm25_sql("bm", "(SELECT doc_id AS id, source AS owner, text FROM documents)", [LICENSE, RELEASED])


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25_top10(spark, d):
    return document_index(spark, d).top_k("license released", 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25}, r AS (SELECT id, owner AS source, round(score, 6) AS score, row_number() OVER (PARTITION BY owner ORDER BY score DESC, id) AS p FROM bm) SELECT id, source, score FROM r WHERE p = 1")
def bm25_best_per_thread(spark, d):
    found = keyword.best_per_thread(document_index(spark, d).bm25("license released"), "source")
    return found.select("id", "source", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT doc_id AS id, unnest({TERMS}) AS w FROM documents), s AS (SELECT id, CASE WHEN regexp_full_match(w, '{LICENSE}') THEN 'licens' WHEN regexp_full_match(w, '{RELEASED}') THEN 'releas'
  WHEN regexp_full_match(w, 'apaches?') THEN 'apach' WHEN regexp_full_match(w, 'copyright(s|ed|ing)?') THEN 'copyright' END AS term FROM t)
SELECT id, term, CAST(count(*) AS INTEGER) AS tf FROM s WHERE term IS NOT NULL GROUP BY ALL""")
def postings_terms(spark, d):
    return document_index(spark, d).postings(["licens", "releas", "apach", "copyright"]).select("id", "term", "tf")


@query(f"""WITH t AS (SELECT doc_id AS id, {TERMS} AS w FROM documents), e AS (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t)
SELECT id, count(*) AS hits FROM e WHERE w[i] = 'under' AND w[i + 1] = 'the' AND w[i + 2] = 'mit' GROUP BY id""")
def phrase_match(spark, d):
    return keyword.phrase_rows(document_index(spark, d), "under the MIT")


@query("SELECT doc_id, source, n_chars FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%license%' ORDER BY n_chars DESC, doc_id LIMIT 25")
def like_fallback(spark, d):
    return keyword.like_fallback(table(spark, d, "documents"), "license", ["text", "source"], "n_chars", "doc_id", 25).select("doc_id", "source", "n_chars")


PROBE = [round(((i * 37) % 64 - 31.5) / 150, 6) for i in range(64)]
DIST = f"d AS (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), CAST({PROBE} AS DOUBLE[])) AS dist FROM embeddings)"


@query(f"WITH {DIST} SELECT vec_id, round(dist, 6) AS dist FROM d ORDER BY d.dist, vec_id LIMIT 10")
def vector_knn(spark, d):
    return V.knn(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE, 10).select("vec_id", F.round("dist", 6).alias("dist"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def vector_normalize(spark, d):
    scaled = table(spark, d, "embeddings").select("vec_id", V.l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return scaled.select("vec_id", F.round(V.norm(F.col("v")), 5).alias("norm"), F.round(F.element_at("v", 1), 5).alias("first"))


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, i, round(m, 6) AS m FROM (SELECT label, CAST(i AS INTEGER) AS i, avg(x) AS m FROM x GROUP BY ALL)""")
def vector_mean(spark, d):
    found = V.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("embedding").alias("i", "m"))
    return found.select("label", (F.col("i") + 1).alias("i"), F.round("m", 6).alias("m"))


def _chunk_ranks(spark, d) -> DataFrame:
    lane = fusion.vector_lane(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE, 60)
    return lane.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("thread_id")), "id")


CHUNKS = f"{DIST}, cr AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS thread_id, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d QUALIFY rank <= 60)"


@query(f"WITH {CHUNKS} SELECT thread_id AS id, min(rank) AS rank FROM cr GROUP BY thread_id")
def chunk_lift(spark, d):
    return fusion.lift_chunks(_chunk_ranks(spark, d), "thread_id")


@query(f"WITH {CHUNKS}, e AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY rank) AS place FROM cr) SELECT id, thread_id, rank, place FROM e WHERE place <= 3")
def evidence_top3(spark, d):
    return fusion.evidence(_chunk_ranks(spark, d), "thread_id")


KW = f"{BM25}, kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 40), {DIST}, vl AS (SELECT vec_id AS id, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d QUALIFY rank <= 40)"


def _two_lanes(spark, d):
    return fusion.keyword_lane(document_index(spark, d), "license released", 40), fusion.vector_lane(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE, 40)


@query(f"WITH {KW}, u AS (SELECT *, 0 AS lane FROM kw UNION ALL SELECT *, 1 FROM vl) SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY id")
def rrf_two_lane(spark, d):
    return fusion.rrf(_two_lanes(spark, d)).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH {KW}, cr AS (SELECT CAST(label AS BIGINT) AS id, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d QUALIFY rank <= 60),
u AS (SELECT * FROM kw UNION ALL SELECT * FROM vl UNION ALL SELECT id, min(rank) FROM cr GROUP BY id) SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY id""")
def rrf_three_lane(spark, d):
    return fusion.rrf([*_two_lanes(spark, d), fusion.lift_chunks(_chunk_ranks(spark, d), "thread_id")]).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH {BM25}, {DIST}, lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm JOIN documents ON doc_id = id WHERE lang IN ('en', 'de') QUALIFY rank <= 40),
vl AS (SELECT vec_id AS id, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d QUALIFY rank <= 40),
u AS (SELECT *, 0 AS lane FROM lex UNION ALL SELECT *, 1 FROM vl), g AS (SELECT id, sum(1.0 / (60 + rank)) AS score, min((lane, rank)) AS first FROM u GROUP BY id)
SELECT g.id, source, lang, round(score, 9) AS score FROM g JOIN documents ON doc_id = id WHERE lang IN ('en', 'de') ORDER BY round(g.score, 12) DESC, first, g.id LIMIT 10""")
def hybrid_search(spark, d):
    docs, filters = table(spark, d, "documents"), fusion.Filters(folders=("en", "de"))
    rows = docs.select(F.col("doc_id").alias("thread_id"), "source", "lang", F.col("lang").alias("folder"))
    words = fusion.keyword_lane(document_index(spark, d), "license released", 40, threads=rows, filters=filters)
    vectors = fusion.vector_lane(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE, 40)
    found = fusion.hybrid_search([words], vectors, None, rows, filters, 10, fusion.fetch_limit(10, 10, filters))
    return found.select("id", "source", "lang", F.round("score", 9).alias("score"))


@query("""SELECT o_custkey AS thread_id, min(o_orderdate) AS date_first, max(o_orderdate) AS date_last FROM orders GROUP BY o_custkey
HAVING max(o_orderdate) >= TIMESTAMP '1995-06-01' AND min(o_orderdate) < TIMESTAMP '1995-09-02'""")
def filter_date_overlap(spark, d):
    alive = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("thread_id")).agg(F.min("o_orderdate").alias("date_first"), F.max("o_orderdate").alias("date_last"))
    return fusion.apply_filters(alive, fusion.Filters(date_from="1995-06-01", date_to="1995-09-01"))


@query(f"WITH {MAIL} SELECT DISTINCT thread_id FROM mail WHERE addr = 'assistant@example.com' UNION SELECT DISTINCT thread_id FROM mail WHERE lower(from_addr) LIKE '%syst%'")
def filter_sender(spark, d):
    rows = mail(spark, d).groupBy("thread_id").agg(F.collect_set("from_addr").alias("senders"))
    full = rows.where(fusion.matches_sender(F.col("senders"), "Assistant@example.com"))
    return full.union(rows.where(fusion.matches_sender(F.col("senders"), "syst"))).select("thread_id").distinct()


# each line of a text is followed by a quoted one, and a signature ends it: what is left are the lines that no rule drops, trimmed
@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, text, lines, list_position(list_transform(lines, lambda x: regexp_matches(x, '^(-- |(?i:-{2,}[ \t]*(original|forwarded) message[ \t]*-{2,}[ \t]*)|(?i:begin forwarded message:[ \t]*)|On( .*)? wrote:[ \t]*)$')), true) AS cut FROM l),
k AS (SELECT doc_id, text, trim(array_to_string(list_filter(CASE WHEN coalesce(cut, 0) > 0 THEN lines[1:cut - 1] ELSE lines END, lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS kept FROM c)
SELECT doc_id, md5(CASE WHEN length(kept) > 0 THEN kept ELSE replace(text, chr(10), chr(10) || '> quoted' || chr(10)) || chr(10) || '> quoted' || chr(10) || '-- ' || chr(10) || 'signature' END) AS stripped FROM k""")
def strip_quotes(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    body = F.concat(F.replace("text", F.lit("\n"), F.lit("\n> quoted\n")), F.lit("\n> quoted\n-- \nsignature"))
    return docs.select("doc_id", F.md5(T.strip_quotes(body)).alias("stripped"))


@query("SELECT doc_id, md5(regexp_replace(text, '^\\n+|\\n+$', '', 'g')) AS body FROM documents")
def normalize_body(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_body(F.concat(F.lit("\r\n"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\n\n")))).alias("body"))


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || chr(0) || '0' || chr(0) || text) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || chr(0) || sha256(text) || chr(0) || source || '.txt' || chr(0) || '1') AS occurrence_id FROM documents")
def occurrence_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.occurrence_id(F.col("doc_id").cast("string"), F.sha2("text", 256), F.concat("source", F.lit(".txt")), F.lit(1)).alias("occurrence_id"))


@query()
def chunk_messages(spark, d):
    return chunking.chunk_messages(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT p_partkey, p_name AS subject FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS p_name FROM part)")
def normalize_subject(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_subject(F.concat(F.lit("Re: FWD: [re] "), "p_name")).alias("subject"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderdate) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)))
SELECT o_orderkey, CAST(sum(CASE WHEN date_diff('day', before, o_orderdate) > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS subject_thread FROM o""")
def subject_threads(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Re: customer "), "o_custkey").alias("subject"), F.lit("INBOX").alias("folder"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").cast("string").alias("message_id"))
    return threads.subject_gaps(rows).select("o_orderkey", "subject_thread")


def _linked_mail(spark, d) -> DataFrame:
    rows = mail(spark, d).withColumn("turn", F.split("message_id", "-")[1].cast("int"))
    parent = F.when(F.col("turn") > 0, F.concat("thread_id", F.lit("-"), (F.col("turn") - 1).cast("string"))).otherwise("")
    return rows.withColumn("in_reply_to", parent).withColumn("references", F.array().cast("array<string>")).withColumn("addresses", F.array("from_addr")).withColumn("arrival", F.col("date"))


@query(f"WITH {MAIL} SELECT message_id, first_value(message_id) OVER (PARTITION BY thread_id ORDER BY date, message_id) AS thread_id FROM mail")
def linked_threads(spark, d):
    return threads.linked_threads(_linked_mail(spark, d))


@query()
def arrival_threads(spark, d):
    return threads.arrival_threads(_linked_mail(spark, d))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_dedupe(spark, d):
    return merge.by_content(table(spark, d, "documents"), "text", F.col("doc_id"))


@query()
def html_to_text(spark, d):
    return html_column(table(spark, d, "pages"), "page_id", "html")


@query("""WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE n_chars > 300), n AS (SELECT doc_id, md5(text) AS h FROM documents WHERE n_chars < 2000)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.h, n.h) AS h, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' ELSE 'keep' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.h = n.h""")
def chunk_diff(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "n_chars")
    return merge.diff(rows.where("n_chars > 300"), rows.where("n_chars < 2000"), ["doc_id", "h"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def map_last_write(spark, d):
    return merge.last_write(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


def _halves(spark, d):
    rows = mail(spark, d).withColumn("early", F.split("message_id", "-")[1].cast("int") < 2)
    out = []
    for part in (rows.where("early"), rows.where("NOT early")):
        r = threads.rollup(part).withColumn("message_ids", F.split("message_ids", ",")).withColumn("participants", F.array(F.col("folder"))).withColumn("subject", F.col("display_subject"))
        out.append(r)
    return out


@query(f"WITH {THREADS} SELECT thread_id, display_subject AS subject, folder, message_ids, date_first, date_last, has_attachments FROM threads")
def thread_merge(spark, d):
    old, new = _halves(spark, d)
    merged = merge.merge_threads(old, new)
    return merged.select("thread_id", "subject", "folder", F.array_join("message_ids", ",").alias("message_ids"), "date_first", "date_last", "has_attachments")


@query("SELECT doc_id, source FROM documents WHERE n_chars > 500 UNION ALL SELECT doc_id, source FROM documents WHERE n_chars <= 500 AND lang = 'en'")
def attachment_upsert(spark, d):
    docs = table(spark, d, "documents")
    return merge.insert_if_absent(docs.where("n_chars > 500").select("doc_id", "source"), docs.where("n_chars > 500 OR lang = 'en'").select("doc_id", "source"), ["doc_id"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber")
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return merge.cascade({"lines": lines}, "key", gone)["lines"].withColumnRenamed("key", "l_orderkey")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND ts <= TIMESTAMP '2030-01-01' ORDER BY ts, CAST(event_id AS VARCHAR) LIMIT 50")
def claim_batch(spark, d):
    jobs = table(spark, d, "events").select(F.when(F.col("event_type") == "click", "queued").otherwise("dead").alias("status"), F.col("ts").alias("next_attempt_at"), F.col("event_id").cast("string").alias("filepath"), "event_id", "user_id")
    return queue.claim(jobs, F.lit("2030-01-01").cast("timestamp_ntz"), 50).select("event_id", "user_id")


@query("""SELECT event_id, CASE WHEN event_id % 6 + 1 >= 5 THEN 'dead' ELSE 'queued' END AS status, CAST(event_id % 6 + 1 AS INTEGER) AS attempts,
CASE WHEN event_id % 6 + 1 >= 5 THEN ts ELSE TIMESTAMP '2024-06-01' + to_seconds(CAST(least(30 * pow(2, event_id % 6), 21600) AS BIGINT)) END AS next_attempt_at FROM events""")
def retry_backoff(spark, d):
    jobs = table(spark, d, "events").select("event_id", F.lit("queued").alias("status"), (F.col("event_id") % 6).cast("int").alias("attempts"), F.col("ts").alias("next_attempt_at"))
    return queue.mark_failed(jobs, F.lit("2024-06-01 00:00:00").cast("timestamp"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 3 <> 0 AND vec_id % 2 <> 0")
def recover_zero_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("v"))
    return queue.unembedded(rows, "v", rows.where("vec_id % 3 = 0"), rows.where("vec_id % 2 = 0"), "vec_id").select("vec_id")


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'trashed' WHEN doc_id % 10 = 2 THEN 'renamed' WHEN doc_id % 10 = 3 THEN 'restored' ELSE 'none' END AS action FROM documents) GROUP BY action""")
def sweep_counts(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unique"), (F.col("doc_id") % 10).alias("m"))
    indexed = ids.select("unique", F.concat(F.lit("/cur/"), "unique").alias("filepath"), "m")
    listing = ids.where("m <> 0").select("unique", F.concat(F.when(F.col("m") == 2, "/new/").otherwise("/cur/"), "unique").alias("path"), (F.col("m") == 1).alias("trashed"))
    return reconcile.sweep(indexed.drop("m"), listing, indexed.where("m = 3").select("filepath")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_REAPED = """SELECT doc_id, '{0}' AS marked FROM documents WHERE doc_id % {1} <> 1 OR (SELECT count(*) FILTER (WHERE doc_id % {1} = 1) > greatest(10, floor(count(*) * 5 / 100)) FROM documents)"""


@query(f"{_REAPED.format('few', 40)} UNION ALL {_REAPED.format('many', 10)}")
def reap_brake(spark, d):
    """A fortieth of the messages may go; a tenth is too many at once, so all stay."""
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("filepath"))
    old, now = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")

    def left(marked: str, every: int) -> DataFrame:
        marks = rows.where(F.col("doc_id") % every == 1).select("filepath", old.alias("marked_at"))
        return reconcile.reap(rows, marks, now).select("doc_id", F.lit(marked).alias("marked"))

    return left("few", 40).unionByName(left("many", 10))


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY event_type")
def stage_percentiles(spark, d):
    found = lookups.stage_percentiles(table(spark, d, "events"), "event_type", "value")
    return found.select("stage", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "max")])


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200")
def rolling_last200(spark, d):
    return lookups.last_n(table(spark, d, "events"), ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_type", "event_id", "value")


@query("""WITH r AS (SELECT source AS question, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
x AS (SELECT source AS question, doc_id AS id FROM documents WHERE doc_id % 9 = 0), h AS (SELECT x.question, min(r.rank) AS rank FROM x LEFT JOIN r ON r.question = x.question AND r.id = x.id AND r.rank <= 10 GROUP BY x.question)
SELECT avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END) AS recall, avg(coalesce(1.0 / rank, 0.0)) AS mrr FROM h""")
def recall_mrr(spark, d):
    docs = table(spark, d, "documents")
    place = F.row_number().over(W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    results = docs.select(F.col("source").alias("question"), F.col("doc_id").alias("id"), place.alias("rank"))
    return lookups.recall_mrr(results, docs.where("doc_id % 9 = 0").select(F.col("source").alias("question"), F.col("doc_id").alias("id")))


#: Written by hand, one replacement a kind of secret in the order in which they are looked for.
REDACTED = r"""WITH a AS (SELECT doc_id, regexp_replace(text, 'sk-ant-[\w-]+', '[REDACTED]', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(?i)(x-api-key[\x27":=\s]+)[^\s,\x27"}]+', '\1[REDACTED]', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(?i)(authorization[\x27":=\s]+bearer\s+)[^\s,\x27"}]+', '\1[REDACTED]', 'g') AS t FROM b),
k AS (SELECT doc_id, regexp_replace(t, 'AKIA[0-9A-Z]{16}', '[key]', 'g') AS t FROM c),
g AS (SELECT doc_id, regexp_replace(t, 'gh(p|o|u|s|r)_[a-zA-Z0-9]{20}[a-zA-Z0-9]*', '[token]', 'g') AS t FROM k),
s AS (SELECT doc_id, regexp_replace(t, 'sk-[\w-]{16}[\w-]*', '[key]', 'g') AS t FROM g),
r AS (SELECT doc_id, regexp_replace(t, '(B|b)earer [\w.~+/=-]{8}[\w.~+/=-]*', 'Bearer [token]', 'g') AS t FROM s),
m AS (SELECT doc_id, regexp_replace(t, '[\w.%+-]+@([a-zA-Z0-9-]+\.)+[a-zA-Z0-9-]+', '[email]', 'g') AS t FROM r)
SELECT doc_id, md5(regexp_replace(t, '(?i)(passw(or)?d|secret|api_key|token)\s*(=|:)\s*[^\s,;]+', '[secret]', 'g')) AS redacted FROM m"""


@query(REDACTED)
def redact_secrets(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN coalesce(TIMESTAMP '2024-01-20 12:30:00' < ts + INTERVAL 7 DAY, false) WHEN 1 THEN event_id % 2 = 0 WHEN 2 THEN true WHEN 3 THEN event_id % 2 = 0 ELSE false END AS stands FROM events""")
def cache_short_circuit(spark, d):
    rows = table(spark, d, "events").withColumn("status", F.element_at(F.array(*map(F.lit, ("failed", "success", "empty", "unsupported", "other"))), (F.col("event_id") % 5 + 1).cast("int")))
    text, error = F.when(F.col("event_id") % 2 == 0, "text"), F.when(F.col("event_id") % 2 == 1, attachments.NO_OCR)
    return rows.select("event_id", attachments.cache_stands(F.col("status"), F.col("ts"), F.lit("2024-01-20 12:30:00").cast("timestamp_ntz"), text, error, ocr=True).alias("stands"))


@query("""WITH s AS (SELECT p_partkey, p_name, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+')) AS w FROM part)
SELECT p_partkey, p_name, CAST(len(list_intersect(w, ['small', 'ring'])) AS BIGINT) AS overlap FROM s WHERE len(list_intersect(w, ['small', 'ring'])) > 0 ORDER BY overlap DESC, p_partkey LIMIT 1""")
def subject_overlap_pick(spark, d):
    found = rag.pick_by_subject(table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name").alias("p_name")), "the small ring", "p_name", "p_partkey")
    return found.select("p_partkey", "p_name", "overlap")


@query("""WITH r AS (SELECT source AS thread_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, '[chunk 0 chars 0-' || length(text) || ']' AS head, text FROM documents WHERE text IS NOT NULL AND length(text) < 700),
s AS (SELECT *, 2000 - coalesce(sum(length(head) + length(text) + 2) OVER (PARTITION BY thread_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - length(head) - 2 AS room FROM r)
SELECT thread_id, md5(string_agg(head || chr(10) || substr(text, 1, CAST(room AS BIGINT)), chr(10) || chr(10) ORDER BY rank)) AS context FROM s WHERE room > 0 GROUP BY thread_id""")
def rag_context(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL AND length(text) < 700")
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    rows = docs.select(F.col("source").alias("thread_id"), place.alias("rank"), F.lit(0).alias("chunk_index"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
    return rag.context(rows, "thread_id").withColumn("context", F.md5("context"))


@query()
def embed_messages(spark, d):
    return chunking.embed(table(spark, d, "documents"), "doc_id", "text", chunking.hash_embedder(32), 32)


@query()
def extract_attachments(spark, d):
    pages = table(spark, d, "pages").select(F.sha2("html", 256).alias("content_hash"), F.encode("html", "utf-8").alias("payload"), F.lit("text/html").alias("content_type"), F.lit("page.html").alias("filename"))
    return attachments.extract(pages)

"""Queries that write, stream and study: stores, ingestion, expiring histories, index variants and
synthetic questions. Each writes to the shared folder and reads back what it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import variants as va
from ..operators.generate import generate_questions
from ..sources.shared import shared_dir, written
from ..sources.store import HashStore
from ..streaming import history, ingest
from .base import query, table
from .evaluation import relevance_of
from .search import NAMED, TOKENS, items


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- variants of the index

#: SQL: the texts of every variant, searched and judged, as m(variant, hit, mrr, ndcg).
VARIANTS = f"""va AS (SELECT 'baseline' AS variant, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'keywords', doc_id, coalesce(text, '') || ' ' || array_to_string(list_slice(string_split_regex(coalesce(text, ''), '\\s+'), 1, 8), ' ') FROM documents
  UNION ALL SELECT 'summary', doc_id, left(coalesce(text, ''), 300) FROM documents),
toks AS MATERIALIZED (SELECT variant, doc_id, {TOKENS.format(c="text")} AS t FROM va),
stats AS (SELECT variant, count(*) AS n, avg(len(t)) AS a FROM toks GROUP BY variant),
post AS MATERIALIZED (SELECT variant, doc_id, token, len, count(*) AS tf FROM (SELECT variant, doc_id, len(t) AS len, unnest(t) AS token FROM toks) GROUP BY ALL),
df AS (SELECT variant, token, count(*) AS df FROM post GROUP BY ALL),
q AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, token FROM (SELECT item_id, unnest({TOKENS.format(c="text")}) AS token FROM benchmark)),
s AS (SELECT variant, query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * (len / a)))), 6) AS score
  FROM q JOIN post USING (token) JOIN df USING (variant, token) JOIN stats USING (variant) GROUP BY ALL),
t AS (SELECT variant, query_id, doc_id, row_number() OVER (PARTITION BY variant, query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5),
g AS (SELECT item_id AS query_id, left(text, 60) AS phrase, 'src' || (item_id % 20) || '.pdf' AS expected, list_slice({TOKENS.format(c="text")}, 1, 3) AS kw FROM benchmark),
j AS (SELECT variant, query_id, rank,
  CASE WHEN contains(replace(replace(lower({NAMED}), '.pdf', ''), '.md', ''), replace(expected, '.pdf', '')) OR contains(lower(d.text), lower(phrase))
    OR len(list_filter(kw, lambda k: contains(lower(d.text), k))) >= least(2, greatest(1, len(kw))) THEN 1 ELSE 0 END AS rel
  FROM t JOIN documents d USING (doc_id) JOIN g USING (query_id)),
p AS (SELECT variant, query_id, CASE WHEN sum(rel) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0.0) AS mrr,
  coalesce(sum(rel / log2(rank + 1)) / nullif(list_sum(list_transform(range(1, CAST(sum(rel) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0), 0.0) AS ndcg FROM j GROUP BY ALL),
m AS (SELECT variant, sum(hit) / (SELECT count(*) FROM benchmark) AS hit, sum(mrr) / (SELECT count(*) FROM benchmark) AS mrr, sum(ndcg) / (SELECT count(*) FROM benchmark) AS ndcg FROM p GROUP BY variant)"""


def studied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, hit, mrr, ndcg) of three indexes, of which one is built again after the others."""
    text = F.coalesce("text", F.lit(""))
    texts = {"baseline": [text], "keywords": [text, F.array_join(F.slice(F.split(text, r"\s+", 9), 1, 8), " ")], "summary": [text]}
    d, path = table(spark, sf_dir, "documents"), _new_path(spark, "variants")
    va.write_tokens(va.variant_tokens(d, texts), path)
    va.write_variants(va.variant_rows(d, {"summary": F.left(text, F.lit(300))}), path)  # re-ingested by itself
    q = items(spark, sf_dir)
    found = va.search_variants(spark, path, q, 5)
    return va.judged_variants(relevance_of(found, spark, sf_dir).select("variant", "query_id", "rank", "rel"), q.count(), 5)


@query(f"WITH {VARIANTS} SELECT variant, round(hit, 6) AS hit, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the index, each built, searched and judged (CF2, CF3, CF5, CF6, CF7, CF10)."""
    return studied(spark, sf_dir).select("variant", *[F.round(m, 6).alias(m) for m in ("hit", "mrr", "ndcg")])


@query(f"WITH {VARIANTS}, w AS (SELECT variant, round(mrr, 6) AS mrr FROM m) SELECT variant, mrr, round(mrr - (SELECT mrr FROM w WHERE variant = 'baseline'), 6) AS delta, row_number() OVER (ORDER BY mrr DESC, variant) = 1 AS wins FROM w")
def variant_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same variants against the baseline, and which wins (CF5, CF9, AG28, AG29)."""
    return va.winner(studied(spark, sf_dir), "mrr", baseline="baseline")


# ---------------------------------------------------------------- stores and ingestion


@query("""WITH f AS (SELECT DISTINCT substr(sha256(text), 1, 16) AS h, doc_id % 3 = 0 AS first FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS a, count(*) AS b FROM documents),
i AS (SELECT count(DISTINCT h) FILTER (WHERE first) AS a, count(DISTINCT h) AS b FROM f)
SELECT 'first' AS batch, n.a::BIGINT AS attempted, i.a::BIGINT AS inserted, (n.a - i.a)::BIGINT AS skipped, i.a::BIGINT AS stored FROM n, i
UNION ALL SELECT 'all', n.b, i.b - i.a, n.b - (i.b - i.a), i.b FROM n, i UNION ALL SELECT 'again', n.b, 0, n.b, i.b FROM n, i""")
def content_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents into the content store, then all, then all again (SK7, ST5, J22)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", tx.content_hash(F.col("text")).alias("content_hash"))
    store, rows = HashStore(spark, _new_path(spark, "contents"), digits=1), []
    for name, batch in (("first", d.where("doc_id % 3 = 0")), ("all", d), ("again", d)):
        n = store.insert_new(batch, "doc_id")
        rows.append((name, n["attempted"], n["inserted"], n["skipped"], store.rows().count()))
    return spark.createDataFrame(rows, "batch string, attempted long, inserted long, skipped long, stored long")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT user_id, event_id, event_type FROM r WHERE n = 1""")
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record of each key, put in by four batches of which each replaces the partitions it
    falls into (SK15, SK16)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.md5(F.col("user_id").cast("string")).alias("identity"))
    store = HashStore(spark, _new_path(spark, "runs"), key="identity", digits=1)
    for k in (2, 0, 3, 1):  # not in their order
        store.replace_latest(e.where(F.col("event_id") % 4 == k), "event_id")
    return store.rows().select("user_id", "event_id", "event_type")


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS batch, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, first_value(page_id) OVER (PARTITION BY h ORDER BY batch, page_id) AS page FROM p)
SELECT page_id, batch::INTEGER AS batch, CASE WHEN page = page_id THEN 'ok' ELSE 'alias' END AS status, CASE WHEN page <> page_id THEN page END AS alias_of FROM f""")
def folder_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing folder taken in twice, each run its new files alone, with a manifest that names copies
    (ST6, SC3, SK12)."""
    pages, path = table(spark, sf_dir, "pages").select("page_id", "html"), _new_path(spark, "ingest")
    for rest in (0, 1):
        pages.where(F.col("page_id") % 2 == rest).repartition(4).write.mode("append").parquet(f"{path}/landing")
        ingest.ingest(spark.readStream.schema("page_id long, html string").parquet(f"{path}/landing"), path, "page_id", "html", digits=1)
    m = ingest.manifest(spark, path)
    return m.select(F.col("id").cast("long").alias("page_id"), F.col("batch").cast("int").alias("batch"), "status", F.col("alias_of").cast("long").alias("alias_of"))


# ---------------------------------------------------------------- histories that expire

#: SQL: each user's events as messages; a gap of over an hour begins a history anew.
HISTORY = """e AS (SELECT CAST(user_id AS VARCHAR) AS session, ts, event_type || ': ' || props AS line FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
t AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, line) AS turn FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, line) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM e)),
l AS (SELECT *, max(turn) OVER (PARTITION BY session) AS last FROM t),
h AS (SELECT session, ts, line FROM l WHERE turn = last QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, line DESC) <= 20),
s AS (SELECT session, count(*) AS messages, string_agg(line, chr(10) ORDER BY ts, line) AS context, max(ts) AS updated_at FROM h GROUP BY session)"""


@query(f"WITH {HISTORY} SELECT session, messages::BIGINT AS messages, md5(context) AS context_md5 FROM s WHERE updated_at + INTERVAL 6 HOUR >= (SELECT max(ts) FROM events)")
def live_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped histories of the sessions that are alive at the last event (ST1, ST3, WN9)."""
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return history.histories(e, "user_id", "ts", "event_type", "props", now, ttl_s=6 * 3600, cap=20).select("session", "messages", F.md5("context").alias("context_md5"))


@query(f"""WITH {HISTORY} SELECT session, CASE WHEN gone THEN 0 ELSE messages END::BIGINT AS messages, md5(CASE WHEN gone THEN '' ELSE context END) AS context_md5, gone AS expired
FROM (SELECT *, updated_at + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS gone FROM s)""")
def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream: the last that it says of each session, cleared by a timer once the
    watermark has passed its time to live (ST1, ST3)."""
    path, (key, store) = _new_path(spark, "history"), history.STATE_STORE
    source = table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kept = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        out = history.history_stream(events, "user_id", "ts", "event_type", "props", ttl_s=6 * 3600, cap=20, late="1 hour")
        save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        q = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, kept)
    last = Window.partitionBy("session").orderBy(F.col("batch").desc(), F.col("expired").desc())
    rows = spark.read.parquet(f"{path}/out").withColumn("n", F.row_number().over(last)).where("n = 1")
    return rows.select("session", "messages", F.md5("context").alias("context_md5"), "expired")


# ---------------------------------------------------------------- synthetic questions


@query(r"""WITH seeds AS (SELECT coalesce(lang, '') AS stratum, doc_id, text AS c, coalesce(source, '') AS source,
    row_number() OVER (PARTITION BY lang ORDER BY (CAST(CAST('0x' || substr(md5('11:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE, doc_id) AS place FROM documents WHERE length(trim(text, ' ')) > 0 QUALIFY place <= 40),
a AS (SELECT *, attempt, trim(left(c, 40), ' ') AS ev FROM seeds, (VALUES (1), (2), (3)) AS t(attempt)),
q AS (SELECT *, CASE WHEN attempt = 1 THEN ev ELSE 'What is said of ' || string_split(c, ' ')[-1] || ' in part ' || attempt || '?' || CASE WHEN attempt = 2 AND length(c) % 3 = 0 THEN ' See ' || source || '.pdf' ELSE '' END END AS question FROM a),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS qt, list_distinct(regexp_extract_all(lower(ev), '[a-z0-9]+')) AS et FROM q),
r AS (SELECT *, CASE WHEN trim(question, ' ') = '' THEN 'empty_question' WHEN ev = '' OR NOT contains(c, ev) THEN 'invalid_evidence_span'
  WHEN contains(lower(question), coalesce(nullif(array_to_string(list_slice(list_filter(string_split(regexp_replace(regexp_replace(lower(source), '\.(pdf|md|html)$', ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), 1, 3), ' '), ''), 'unknown')) OR contains(lower(question), '.pdf') OR contains(lower(question), '.md') THEN 'source_title_leakage'
  WHEN len(qt) > 0 AND len(et) > 0 AND len(list_intersect(qt, et))::DOUBLE / len(qt) > 0.8 THEN 'question_too_copied' ELSE 'accepted' END AS reason FROM w),
f AS (SELECT stratum, doc_id, min(attempt) FILTER (WHERE reason = 'accepted') AS hit FROM r GROUP BY ALL),
done AS (SELECT stratum, n.attempt, count(*) FILTER (WHERE hit <= n.attempt) AS accepted FROM f, (VALUES (0), (1), (2)) AS n(attempt) GROUP BY ALL),
made AS (SELECT r.stratum, r.doc_id, r.place, r.attempt, r.reason FROM r JOIN f USING (stratum, doc_id) JOIN done ON done.stratum = r.stratum AND done.attempt = r.attempt - 1
  WHERE coalesce(hit, 99) >= r.attempt AND (r.attempt = 1 OR done.accepted < 20)),
k AS (SELECT stratum, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY place) <= 20 AS kept FROM made WHERE reason = 'accepted')
SELECT stratum, doc_id AS id, place::BIGINT AS place, attempt::INTEGER AS attempt, CASE WHEN reason = 'accepted' THEN 'accepted' ELSE 'rejected' END AS status, reason, reason = 'accepted' AND coalesce(kept, false) AS kept
FROM made LEFT JOIN k USING (stratum, doc_id)""")
def synthetic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from drawn documents of each language, checked, with the log of all tries until a
    language has twenty (UD17, UD21, PF7, TK8)."""
    d = table(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit("")))
    log = generate_questions(d, "lang", "doc_id", "text", "source", quota=20, spare=2, tries=3, seed=11)
    return written(log.select("stratum", "id", "place", "attempt", "status", "reason", "kept"), "question-log")

"""Evaluation queries: benchmark items against BM25 results, gates, deltas and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..sources.shared import written
from .base import query, table
from .search import ALL_DOCS, BM25, NAMED, TOKENS, best_documents, file_name, items

#: SQL: ranked and judged results of every item, as j(query_id, doc_id, rank, source, content, rel).
JUDGED = f"""{ALL_DOCS}, {BM25},
g AS (SELECT item_id AS query_id, text, left(text, 60) AS phrase, 'src' || (item_id % 20) || '.pdf' AS expected, list_slice({TOKENS.format(c="text")}, 1, 3) AS kw FROM benchmark),
t AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS BIGINT) AS rank FROM s QUALIFY rank <= 5),
j AS (SELECT query_id, doc_id, rank, {NAMED} AS source, d.text AS content,
  CASE WHEN contains(replace(replace(lower({NAMED}), '.pdf', ''), '.md', ''), replace(expected, '.pdf', '')) OR contains(lower(d.text), lower(phrase))
    OR len(list_filter(kw, lambda k: contains(lower(d.text), k))) >= least(2, greatest(1, len(kw))) THEN 1 ELSE 0 END AS rel
  FROM t JOIN documents d USING (doc_id) JOIN g USING (query_id))"""
METRIC = """
m AS (SELECT query_id, CASE WHEN sum(rel) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, sum(rel)::DOUBLE / count(*) AS precision, least(sum(rel), 1)::DOUBLE AS recall,
  coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0.0) AS mrr,
  coalesce(sum(rel / log2(rank + 1)) / nullif(list_sum(list_transform(range(1, CAST(sum(rel) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0), 0.0) AS ndcg FROM j GROUP BY query_id)"""

#: Results that are broadcast to where the documents' texts lie, at most.
FEW_RESULTS = 50_000


def relevance_of(found: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results (query_id, doc_id, ...) with their document's source and content, and ``rel``."""
    q = items(spark, sf_dir)
    golden = q.select("query_id", F.substring("query", 1, 60).alias("phrase"), F.array(F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"), F.lit(".pdf"))).alias("expected"), F.slice(tx.plain_tokens(F.col("query")), 1, 3).alias("kw"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), file_name().alias("source"))
    results = written(found.join(golden, "query_id"), "results")
    # a few results a query: texts are shuffled only if queries are many
    both = docs.join(F.broadcast(results) if results.count() <= FEW_RESULTS else results, "doc_id")
    return both.withColumn("rel", ev.is_relevant(F.col("source"), F.col("content"), F.col("expected"), F.col("phrase"), F.col("kw")).cast("int"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance_of(best_documents(spark, sf_dir, 5), spark, sf_dir)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).select("query_id", "rank", "rel")
    return ev.query_metrics(j, j.select("query_id").distinct().withColumn("expected", F.lit(1)), 5)


@query(f"WITH {JUDGED} SELECT query_id, doc_id, rank, CAST(rel AS INTEGER) AS rel FROM j")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which results are relevant by source, phrase or keywords (J14, PF10)."""
    return judged(spark, sf_dir).select("query_id", "doc_id", "rank", "rel")


@query(f"WITH {JUDGED}, {METRIC} SELECT query_id, round(hit, 6) AS hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: hit, precision, recall, reciprocal rank and nDCG at 5 (AG9-AG13)."""
    return measured(spark, sf_dir).select("query_id", *[F.round(m, 6).alias(m) for m in ev.METRICS])


@query(f"""WITH {JUDGED}, u AS (SELECT query_id, rel, rank FROM j QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1),
v AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM u)
SELECT query_id, CAST(count(*) AS BIGINT) AS sources, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0.0), 6) AS mrr FROM v GROUP BY query_id""")
def dedup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank when a source counts once (AG14, AG35)."""
    u = ev.unique_by(judged(spark, sf_dir).select("query_id", "rank", "rel", "source"), F.col("source"))
    return u.groupBy("query_id").agg(F.count("*").alias("sources"), F.round(F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


@query(f"""WITH {JUDGED}, {METRIC},
x AS (SELECT m.*, CASE WHEN query_id % 3 = 0 THEN 'easy' WHEN query_id % 3 = 1 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN query_id % 2 = 0 THEN 'anchor' ELSE 'paraphrase' END AS category FROM m)
SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'category' END AS dimension, coalesce(difficulty, category) AS value, CAST(count(*) AS BIGINT) AS queries,
round(avg(hit), 6) AS hit, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM x GROUP BY GROUPING SETS ((difficulty), (category))""")
def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by difficulty and by category (AG16)."""
    i = F.col("query_id")
    m = measured(spark, sf_dir).withColumns({"difficulty": F.when(i % 3 == 0, "easy").when(i % 3 == 1, "medium").otherwise("hard"), "category": F.when(i % 2 == 0, "anchor").otherwise("paraphrase")})
    return ev.slices(m, ["difficulty", "category"]).select("dimension", "value", "queries", *[F.round(x, 6).alias(x) for x in ev.METRICS])


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS queries, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by linear interpolation (AG5)."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("queries"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query(f"""WITH {JUDGED}, {METRIC}, a AS (SELECT avg(hit) AS hit, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM m),
v AS (UNPIVOT a ON hit, mrr, ndcg INTO NAME metric VALUE value), h AS (SELECT * FROM (VALUES ('hit', 'min', 0.5), ('ndcg', 'min', 0.99), ('mrr', 'max', 2.0), ('absent', 'min', 0.0)) AS x(metric, op, threshold))
SELECT metric, round(value, 6) AS value, op, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN op = 'max' THEN value <= threshold ELSE value >= threshold END AS passed FROM v JOIN h USING (metric)""")
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means against their gates; metrics without a gate and gates without a metric are left out (J15, PF11)."""
    h = spark.createDataFrame([("hit", "min", 0.5), ("ndcg", "min", 0.99), ("mrr", "max", 2.0), ("absent", "min", 0.0)], "metric string, op string, threshold double")
    return ev.gate(ev.long_form(ev.totals_of(measured(spark, sf_dir)), ["hit", "mrr", "ndcg"]), h).select("metric", F.round("value", 6).alias("value"), "op", "threshold", "passed")


VARIANTS = "v AS (SELECT event_type AS variant, avg(value) AS ndcg, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY event_type)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant")).agg(F.avg("value").alias("ndcg"), F.percentile("value", 0.5).alias("p50"))


@query(f"WITH {VARIANTS}, b AS (SELECT * FROM v WHERE variant = (SELECT min(variant) FROM v)) SELECT v.variant, round(v.ndcg, 6) AS ndcg, round(v.p50, 6) AS p50, round(round(v.ndcg, 6) - round(b.ndcg, 6), 4) AS delta_ndcg, round(round(v.p50, 6) - round(b.p50, 6), 4) AS delta_p50 FROM v, b")
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants against a baseline."""
    v = variants(spark, sf_dir).select("variant", F.round("ndcg", 6).alias("ndcg"), F.round("p50", 6).alias("p50"))
    return ev.deltas(v, v.agg(F.min("variant")).first()[0], ["ndcg", "p50"])


@query(f"WITH {VARIANTS} SELECT variant FROM v ORDER BY round(ndcg, 6) DESC, p50, variant LIMIT 1")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant with the best metric, ties to the quicker (AG28)."""
    return ev.winner(variants(spark, sf_dir), [F.round("ndcg", 6).desc(), F.col("p50"), F.col("variant")]).select("variant")


@query(f"""WITH {ALL_DOCS}, {BM25}, t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 20),
g AS (SELECT a::DOUBLE AS mmr_lambda, b AS overfetch, c AS per_page, d AS per_source FROM (SELECT unnest([0.6, 0.75, 0.9]) AS a), (SELECT unnest([2, 4]) AS b), (SELECT unnest([1, 2]) AS c), (SELECT unnest([2, 3]) AS d)),
p AS (SELECT g.*, query_id, rank, row_number() OVER (PARTITION BY mmr_lambda, overfetch, per_page, per_source, query_id, source ORDER BY rank) AS n FROM g, t JOIN documents USING (doc_id) WHERE rank <= 5 * overfetch)
SELECT mmr_lambda, overfetch, per_page, per_source, CAST(count(*) FILTER (WHERE n <= per_source) AS BIGINT) AS results FROM p GROUP BY mmr_lambda, overfetch, per_page, per_source""")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of diversity parameters, and how many results each leaves by overfetch and source cap
    (J19, CF1)."""
    grid = ev.sweep_grid(spark)
    found = best_documents(spark, sf_dir, 20).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rows = found.join(F.broadcast(grid), F.col("rank") <= 5 * F.col("overfetch"))  # 24 rows
    keys = ["mmr_lambda", "overfetch", "per_page", "per_source"]
    n = F.row_number().over(Window.partitionBy(*keys, "query_id", "source").orderBy("rank"))
    return rows.withColumn("n", n).groupBy(*keys).agg(F.count_if(F.col("n") <= F.col("per_source")).alias("results"))


@query("""WITH s AS (SELECT event_type AS metric, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS score FROM events)
SELECT metric, round(coalesce(avg(score), 0.0), 6) AS mean, CAST(count(score) AS BIGINT) AS scored, round((count(*) - count(score))::DOUBLE / (SELECT count(*) FROM events), 6) AS error_rate, count(*) > count(score) AS degraded FROM s GROUP BY metric""")
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, counts and error rates of supplied scores (AG25)."""
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("event_type").alias("metric"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("score"))
    return ev.answer_quality(s, e.count()).select("metric", F.round("mean", 6).alias("mean"), "scored", F.round("error_rate", 6).alias("error_rate"), "degraded")


@query("""SELECT doc_id, CAST(round(least(quality * 60 + 20, 100) * 0.4 + 70 * 0.3 + 50 * 0.2 + 80 * 0.1) AS INTEGER) AS overall,
CASE WHEN round(least(quality * 60 + 20, 100) * 0.4 + 70 * 0.3 + 50 * 0.2 + 80 * 0.1) >= 75 THEN 'high' WHEN round(least(quality * 60 + 20, 100) * 0.4 + 70 * 0.3 + 50 * 0.2 + 80 * 0.1) >= 40 THEN 'medium' ELSE 'low' END AS level FROM labels""")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's confidence from its parts (AG36)."""
    c = ev.confidence(F.least(F.col("quality") * 60 + 20, F.lit(100)), F.lit(70), F.lit(50), F.lit(80))
    return table(spark, sf_dir, "labels").select("doc_id", c.alias("c")).select("doc_id", "c.*")

"""Retrieval evaluation: relevance, ranked metrics, slices, gates, deltas and winners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("hit", "precision", "recall", "mrr", "ndcg")


def label_of(source: Column) -> Column:
    """A source's name without its kinds' endings, wherever they stand (SF22)."""
    out = F.lower(source)
    for end in (".pdf", ".md", ".html"):
        out = F.replace(out, F.lit(end), F.lit(""))
    return out


def is_relevant(source: Column, content: Column, expected_sources: Column, phrase: Column, keywords: Column) -> Column:
    """The source is expected, or the phrase occurs, or enough keywords do (PF10)."""
    name, low = label_of(source), F.lower(content)
    by_source = F.exists(expected_sources, lambda s: (label_of(s) != "") & F.contains(name, label_of(s)))
    by_phrase = (F.coalesce(phrase, F.lit("")) != "") & F.contains(low, F.lower(phrase))
    hits = F.size(F.filter(keywords, lambda k: (k != "") & F.contains(low, F.lower(k))))
    return by_source | by_phrase | (hits >= F.least(F.lit(2), F.greatest(F.lit(1), F.size(keywords))))


def query_metrics(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Per query of ``totals`` (query_id, expected): hit, precision, recall, reciprocal rank and nDCG
    of its rows (query_id, rank, rel 0/1) up to rank ``k`` (AG9-AG13). Precision divides by the rows
    returned; nDCG's ideal has the relevant rows that were found; no rows give zeros."""
    top = ranked.where(F.col("rank") <= k)
    found = top.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.sum("rel").alias("pos"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.when(F.col("pos") > 0, F.sequence(F.lit(1), F.col("pos").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    zero = F.lit(0.0)
    rows = totals.join(found, "query_id", "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    return rows.select(
        "query_id",
        (F.col("pos") > 0).cast("double").alias("hit"),
        F.coalesce(F.try_divide("pos", "n"), zero).alias("precision"),
        (F.least("pos", F.greatest(F.lit(1), "expected")) / F.greatest(F.lit(1), "expected")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.try_divide(F.col("dcg"), ideal), zero).alias("ndcg"),
    )


def unique_by(ranked: DataFrame, key: Column) -> DataFrame:
    """The first row of each key, ranked anew (AG14)."""
    first = ranked.withColumn("key", key).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("rank"))).where("n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("n", "key")


def slices(metrics: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, queries, metrics...): each dimension by itself, in one pass (AG16)."""
    sets = ", ".join(f"({d})" for d in dimensions)
    metrics.createOrReplaceTempView("query_metrics_to_slice")
    which = "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dimensions) + " END"
    value = "coalesce(" + ", ".join(f"CASE WHEN grouping({d}) = 0 THEN {d} END" for d in dimensions) + ")"
    aggs = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
    return metrics.sparkSession.sql(f"SELECT {which} AS dimension, {value} AS value, count(*) AS queries, {aggs} FROM query_metrics_to_slice GROUP BY GROUPING SETS ({sets})")


def totals_of(metrics: DataFrame, latency: str | None = None) -> DataFrame:
    """One row: means, and percentiles of the latency by linear interpolation (AG4, AG5, AG15)."""
    aggs = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS if m in metrics.columns]
    if latency:
        aggs += [F.coalesce(F.percentile(latency, p / 100), F.lit(0.0)).alias(f"p{p}") for p in (50, 95)]
    return metrics.agg(F.count("*").alias("queries"), *aggs)


def long_form(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, value) rows of the named columns (AG31, AG38)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select("m.*")


def gate(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, op, threshold, passed) of metrics that have a threshold (J15, PF11)."""
    ok = F.when(F.col("op") == "max", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return values.join(thresholds, "metric").withColumn("passed", F.coalesce(ok, F.lit(False)))


def deltas(variants: DataFrame, baseline: str, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Variants with their difference from the baseline's row."""
    base = variants.where(F.col("variant") == baseline).select(*[F.col(c).alias(f"base_{c}") for c in columns]).limit(1)
    return variants.crossJoin(F.broadcast(base)).select("variant", *columns, *[F.round(F.col(c) - F.col(f"base_{c}"), digits).alias(f"delta_{c}") for c in columns])


def winner(variants: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first variant in the given order (AG28, AG29)."""
    return variants.orderBy(*order).limit(1)


def sweep_grid(spark, lambdas=(0.6, 0.75, 0.9), overfetch=(2, 4), per_page=(1, 2), per_source=(2, 3)) -> DataFrame:
    """All combinations of the parameters, one row each."""
    out = spark.range(1).select(F.lit(None).alias("none"))
    for name, values in (("mmr_lambda", lambdas), ("overfetch", overfetch), ("per_page", per_page), ("per_source", per_source)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("none")


def answer_quality(scores: DataFrame, total: int) -> DataFrame:
    """(metric, mean, scored, error_rate, degraded) of (metric, score or null) rows (AG25)."""
    return scores.groupBy("metric").agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"),
        F.count("score").alias("scored"),
        (F.count_if(F.col("score").isNull()) / F.greatest(F.lit(1), F.lit(total))).alias("error_rate"),
    ).withColumn("degraded", F.col("error_rate") > 0)


def confidence(retrieval: Column, sources: Column, context: Column, generation: Column) -> Column:
    """struct<overall, level> of an answer (AG36)."""
    overall = F.round(retrieval * 0.4 + sources * 0.3 + context * 0.2 + generation * 0.1).cast("int")
    return F.struct(overall.alias("overall"), F.when(overall >= 75, "high").when(overall >= 40, "medium").otherwise("low").alias("level"))


#: Measures of a query's results whose means the aggregate holds, by the aggregate's names.
MEANS = {
    "hit_rate_at_k": "hit", "precision_at_k": "precision", "recall_at_k": "recall", "mrr": "mrr", "ndcg_at_k": "ndcg", "source_hit_rate": "source_hit",
    "dedup_hit_rate_at_k": "dedup_hit", "dedup_precision_at_k": "dedup_precision", "dedup_mrr": "dedup_mrr", "unique_source_hit_rate_at_k": "unique_source_hit", "unique_source_precision_at_k": "unique_source_precision",
    "duplicate_source_ratio_mean": "duplicate_source_ratio", "duplicate_doc_ratio_mean": "duplicate_doc_ratio", "exact_chunk_hit_rate": "exact_chunk_hit", "evidence_hit_rate": "evidence_hit", "topic_false_positive_rate": "topic_false_positive",
    "medical_expansion_term_count_mean": "expansion_terms", "rerank_candidates_mean": "rerank_candidates", "rerank_output_mean": "rerank_output", "rerank_filtered_out_mean": "rerank_filtered_out",
}
SURE = {"hit_rate_at_k_high_conf": "hit", "mrr_high_conf": "mrr", "exact_chunk_hit_rate_high_conf": "exact_chunk_hit", "evidence_hit_rate_high_conf": "evidence_hit"}
LATENCIES = {"latency": "latency_ms", "query_embedding_latency": "embedding_ms", "rerank_latency": "rerank_ms"}


def query_rows(docs: DataFrame) -> DataFrame:
    """A row a query from its results (query_id, rank, doc_id, source, page, rel, source_hit, exact,
    evidence, off_topic): the measures of :data:`MEANS` that results decide (AG9-AG14, AG35)."""
    by = lambda *key: F.row_number().over(Window.partitionBy("query_id", *key).orderBy("rank"))
    marked = docs.withColumns({"first_doc": by("doc_id") == 1, "first_source": by("source", "page") == 1})
    n_doc, n_source = (F.count_if(c) for c in ("first_doc", "first_source"))
    own = Window.partitionBy("query_id").orderBy("rank")
    marked = marked.withColumn("doc_rank", F.sum(F.col("first_doc").cast("int")).over(own))
    hit = lambda c: F.max(c.cast("int")).cast("double")
    rel = F.col("rel") == 1
    return marked.groupBy("query_id").agg(
        hit(F.col("source_hit")).alias("source_hit"),
        hit(rel & F.col("first_doc")).alias("dedup_hit"),
        (F.count_if(rel & F.col("first_doc")) / n_doc).alias("dedup_precision"),
        F.coalesce(1.0 / F.min(F.when(rel & F.col("first_doc"), F.col("doc_rank"))), F.lit(0.0)).alias("dedup_mrr"),
        hit(rel & F.col("first_source")).alias("unique_source_hit"),
        (F.count_if(rel & F.col("first_source")) / n_source).alias("unique_source_precision"),
        (1.0 - n_source / F.count("*")).alias("duplicate_source_ratio"),
        (1.0 - n_doc / F.count("*")).alias("duplicate_doc_ratio"),
        hit(F.col("exact")).alias("exact_chunk_hit"),
        hit(F.col("evidence")).alias("evidence_hit"),
        F.avg(F.col("off_topic").cast("int")).alias("topic_false_positive"),
    )


def retrieval_aggregate(rows: DataFrame) -> DataFrame:
    """One row over all queries (AG15): means, of which no rows give 0; percentiles of the latencies;
    the same of queries labelled with high confidence (of all, if none is); figures of the queries
    that hypothetical answers, expansions or reranking took part in, null if there are none."""
    zero, sure, hyde = F.lit(0.0), F.col("label_confidence") == "high", F.col("hyde")
    aggs = [F.count("*").alias("query_count"), *[F.coalesce(F.avg(c), zero).alias(n) for n, c in MEANS.items()]]
    aggs += [F.coalesce(F.avg(F.when(sure, F.col(c))), F.avg(c), zero).alias(n) for n, c in SURE.items()]
    aggs += [F.coalesce(F.percentile(c, p / 100), zero).alias(f"{n}_p{p}_ms") for n, c in LATENCIES.items() for p in (50, 95)]
    aggs += [F.count_if(hyde).alias("hyde_queries_count"), *[F.avg(F.when(hyde, F.col(c))).alias(f"hyde_{n}") for n, c in (("hit_rate", "hit"), ("mrr", "mrr"), ("source_hit_rate", "source_hit"))]]
    aggs += [F.count_if("expansion").alias("medical_expansion_queries_count"), (F.count_if("reranked") > 0).alias("reranking_enabled")]
    out = rows.agg(*aggs)
    return out.withColumns({"hyde_enabled": F.col("hyde_queries_count") > 0, "medical_expansion_enabled": F.col("medical_expansion_queries_count") > 0})


def contributions(docs: DataFrame) -> DataFrame:
    """(ranking, hits): exact hits of the queries of which a result has a place in that ranking (AG17)."""
    names = ("semantic_rank", "bm25_rank", "fused_rank")
    per = docs.groupBy("query_id").agg(F.max(F.col("exact").cast("int")).alias("exact"), *[F.max(F.col(n).isNotNull().cast("int")).alias(n) for n in names])
    one = per.agg(*[F.coalesce(F.sum(F.col("exact") * F.col(n)), F.lit(0)).alias(n) for n in names])
    return long_form(one, names).select(F.replace("metric", F.lit("_rank"), F.lit("_ranked_hits")).alias("ranking"), F.col("value").cast("long").alias("hits"))


def latency_summary(runs: DataFrame, group: str, seconds: str, order: str, percentiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(group, n, p50, p95, cold, warm, speed_up) of timed runs: percentiles by linear interpolation;
    cold is the first run, warm the mean of the others, and the speed-up their ratio (AG37)."""
    t, n = F.col(seconds), F.count(seconds)
    cold = F.min_by(t, F.struct(order))
    g = runs.where(t.isNotNull()).groupBy(group).agg(n.alias("n"), *[F.percentile(seconds, p).alias(f"p{round(p * 100)}") for p in percentiles], cold.alias("cold"), F.try_divide(F.sum(t) - cold, n - 1).alias("warm"))
    return g.withColumn("speed_up", F.try_divide("cold", "warm"))

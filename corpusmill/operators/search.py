"""Ranking: exact nearest neighbours, rank fusion, merging of query variants and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Query vectors that go out with one broadcast, at most.
QUERY_BLOCK = 1024


def top_k(rows: DataFrame, k: int, by: list[Column], partition: str = "query_id", name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each partition, numbered. Spark cuts each input partition to ``k``
    rows a group before the shuffle."""
    w = Window.partitionBy(partition).orderBy(*by)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 12) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` rows nearest to each query by cosine rounded to ``digits``
    places, ties to smaller ids (J4). Queries go out in blocks of at most QUERY_BLOCK; a task keeps its ``k`` best of each query,
    so what is shuffled does not grow with the table's rows but with its partitions."""
    spark = vectors.sparkSession
    out = None
    block: list[tuple[int, list[float]]] = []

    def scan(items: list[tuple[int, list[float]]]) -> DataFrame:
        ids = np.array([i for i, _ in items], np.int64)
        q = np.array([v for _, v in items], float)
        shipped = spark.sparkContext.broadcast((ids, q / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)[:, None]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, unit = shipped.value
            best_s, best_i = np.full((len(qid), 0), 0.0), np.full((len(qid), 0), 0, np.int64)
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                n = np.sqrt((x * x).sum(1))
                s = np.where(n > 0, (unit @ x.T) / np.where(n > 0, n, 1), 0.0)
                s = np.hstack([best_s, np.round(s, digits)])
                i = np.hstack([best_i, np.broadcast_to(b.column(0).to_numpy(), (len(qid), b.num_rows))])
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            w = best_s.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, w)), pa.array(best_i.ravel()), pa.array(best_s.ravel())], ["query_id", "vec_id", "score"])

        rows = vectors.select(F.col(id_col).cast("long"), vector_col).where(F.col(vector_col).isNotNull())
        return rows.mapInArrow(run, "query_id long, vec_id long, score double")

    for r in queries.select(F.col("query_id").cast("long"), "vector").toLocalIterator():
        block.append((r[0], list(r[1])))
        if len(block) == QUERY_BLOCK:
            out = scan(block) if out is None else out.union(scan(block))
            block = []
    if block or out is None:
        rest = scan(block) if block else spark.createDataFrame([], "query_id long, vec_id long, score double")
        out = rest if out is None else out.union(rest)
    return top_k(out, k, [F.col("score").desc(), F.col("vec_id")])


def fuse(semantic: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, doc_id, rank, score, prior) (J3, WN2).

    Fused order is by (fused, semantic, lexical) score; combined adds the source's prior afterwards."""
    a = semantic.select("query_id", "doc_id", F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"), F.col("prior").alias("prior_a"))
    b = lexical.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("keyword_score"), F.col("prior").alias("prior_b"))
    both = a.join(b, ["query_id", "doc_id"], "full").withColumns({
        "fused_score": F.round(F.coalesce(1.0 / (k + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("bm25_rank")), F.lit(0.0)), 10),
        "semantic_score": F.coalesce("semantic_score", F.lit(0.0)),
        "keyword_score": F.coalesce("keyword_score", F.lit(0.0)),
        "prior": F.coalesce("prior_a", "prior_b", F.lit(0.0)),
    }).drop("prior_a", "prior_b")
    w = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), F.col("semantic_score").desc(), F.col("keyword_score").desc(), F.col("semantic_rank").asc_nulls_last(), "doc_id")
    return both.withColumns({"fused_rank": F.row_number().over(w).cast("long"), "combined_score": F.round(F.col("fused_score") + F.col("prior"), 10)})


def normalized_by_best(scores: DataFrame, score: str = "bm25") -> DataFrame:
    """Scores divided by the query's largest (pin 5)."""
    best = scores.groupBy("query_id").agg(F.max(score).alias("best"))
    return scores.join(best, "query_id").withColumn("keyword_score", F.coalesce(F.try_divide(score, "best"), F.lit(0.0))).drop("best")


def merge_variants(results: DataFrame, k: int) -> DataFrame:
    """Results of several variants of a query (query_id, variant, rank, doc_id, score) as one list:
    a document keeps its best score, the first seen of equals (TK2)."""
    first = Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), "variant", "rank")
    seen = Window.partitionBy("query_id", "doc_id")
    best = results.withColumn("seen", F.min(F.struct("variant", "rank")).over(seen)).withColumn("n", F.row_number().over(first)).where("n = 1")
    return top_k(best.drop("n", "rank"), k, [F.col("score").desc(), F.col("seen"), F.col("doc_id")]).drop("seen", "variant")


def rerank(results: DataFrame, score: Column, k: int, min_score: float | None = None) -> DataFrame:
    """Rows in the order of another score, those below ``min_score`` dropped (WN4, PF6)."""
    scored = results.withColumn("rerank_score", score)
    if min_score is not None:
        scored = scored.where(F.col("rerank_score") >= min_score)
    return top_k(scored, k, [F.col("rerank_score").desc(), F.col("doc_id")], name="rerank_rank")


def question_search(queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): questions (doc_id, question, quality) that share tokens with a
    query, each normalised question once (TK10). Counted where the questions lie, not on pairs."""
    from ..functions.text import plain_tokens
    from .scan import question_top

    q = queries.select("query_id", F.explode(F.array_distinct(plain_tokens(F.col("query")))).alias("token"))
    return question_top(asked, q, k, plain_tokens)

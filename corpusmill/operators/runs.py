"""Run histories and variant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Retrieval variants (name, mode, diversified).
RETRIEVAL_VARIANTS = (("semantic_only", "semantic_only", False), ("bm25_only", "bm25_only", False), ("rrf_hybrid", "rrf_hybrid", False), ("rrf_hybrid_mmr", "rrf_hybrid", True))
#: Reranking variants (name, mode).
RERANKING_VARIANTS = (("no_reranking", "none"), ("cross_encoder_only", "cross_encoder"), ("mmr_only", "mmr"), ("both_reranking", "both"))
#: Keyword and summary variants (name, keywords, summaries).
KEYWORD_VARIANTS = (("baseline", False, False), ("keywords", True, False), ("summaries", False, True), ("both", True, True))


def retrieval_variants(spark: SparkSession) -> DataFrame:
    """CF1."""
    return spark.createDataFrame(list(RETRIEVAL_VARIANTS), "variant string, search_mode string, diversified boolean")


def reranking_variants(spark: SparkSession) -> DataFrame:
    """CF4."""
    return spark.createDataFrame(list(RERANKING_VARIANTS), "variant string, reranking_mode string")


def keyword_variants(spark: SparkSession) -> DataFrame:
    """CF3."""
    return spark.createDataFrame(list(KEYWORD_VARIANTS), "variant string, keywords boolean, summaries boolean")


def history_summary(runs: DataFrame, columns: list[str]) -> DataFrame:
    """One row: means of what is there, and the number of runs (AG26)."""
    return runs.agg(F.count("*").alias("runs"), *[F.avg(c).alias(c) for c in columns])


def by_dimension(runs: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(dimension, runs, ndcg): a run belongs to every group of which its name has a prefix (AG27)."""
    of = F.filter(F.array(*[F.when(F.lit(False), "") if not p else F.when(F.greatest(*[F.col("variant").startswith(x) for x in p], F.lit(False)), d) for d, p in groups.items()]), lambda d: d.isNotNull())
    return runs.withColumn("dimension", F.explode(of)).groupBy("dimension").agg(F.count("*").alias("runs"), F.avg("ndcg").alias("ndcg"))


def latest_of(index: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key (SK15, SK16)."""
    return index.groupBy(key).agg(F.max_by(F.struct(*index.columns), at).alias("r")).select("r.*")


def to_delete(runs: DataFrame, keep_last: int, at: str = "created_at") -> DataFrame:
    """Runs beyond the newest ``keep_last`` (TK15)."""
    w = Window.orderBy(F.col(at).desc())  # a list of runs, not of data
    return runs.withColumn("n", F.row_number().over(w)).where(F.col("n") > keep_last).drop("n")


def before(runs: DataFrame, date: str, at: str = "created_at") -> DataFrame:
    """Runs before a date (TK16)."""
    return runs.where(F.col(at) < F.lit(date).cast("timestamp"))


def meets_target(metric, baseline, least: float = 0.03):
    """A relative gain of at least ``least``; never from zero (AG30)."""
    return F.coalesce(F.try_divide(metric - baseline, baseline) >= least, F.lit(False))

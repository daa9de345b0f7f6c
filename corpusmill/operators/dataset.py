"""Evaluation datasets: filters, merging, statistics, caches and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_space

#: The order of splits and of confidence labels.
SPLITS = {"dev": 0, "test": 1, "regression": 2}
CONFIDENCE = {"low": 0, "medium": 1, "high": 2}


def _rank(column: str, order: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col(column))


def filter_records(records: DataFrame, split: str | None = None, min_confidence: str = "low") -> DataFrame:
    """Records of a split with at least a confidence, in the order of splits and ids (PF4)."""
    kept = records.where(F.coalesce(_rank("label_confidence", CONFIDENCE), F.lit(1)) >= CONFIDENCE[min_confidence])
    if split:
        kept = kept.where(F.col("dataset_split") == split)
    return kept.orderBy(F.coalesce(_rank("dataset_split", SPLITS), F.lit(9)), "query_id")


def merge_records(golden: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both, each normalised query once, golden ones first (SO3)."""
    both = golden.withColumn("__o", F.lit(0)).unionByName(synthetic.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(normalize_space(F.lower("query"))).orderBy("__o", "query_id")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__o")


def dataset_stats(stages: dict[str, DataFrame]) -> dict[str, int]:
    """Rows by stage (AG32)."""
    return {k: v.count() for k, v in stages.items()}


def newest_compatible(runs: DataFrame, contract: str, at: str = "created_at") -> DataFrame:
    """The newest run of the same contract; rows before it say why they were passed over (SC30)."""
    why = F.when(F.col("contract").isNull(), "no_contract").when(F.col("contract") != contract, "other_contract").otherwise("accepted")
    return runs.withColumn("reason", why).orderBy((F.col("reason") == "accepted").desc(), F.col(at).desc())


def with_results(experiments: DataFrame, reports: DataFrame) -> DataFrame:
    """Experiments and whether a report of their name is there (SC31)."""
    named = reports.select(F.col("name").alias("__r")).distinct()
    return experiments.join(named, F.col("name") == F.col("__r"), "left").withColumn("has_results", F.col("__r").isNotNull()).drop("__r")


def manifest_by_url(manifest: DataFrame) -> DataFrame:
    """The last record of each URL."""
    return manifest.groupBy("normalized_url").agg(F.max_by(F.struct(*manifest.columns), "timestamp_utc").alias("r")).select("r.*")


def by_id(rows: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """At most one row (PF20)."""
    return rows.where(F.col(id_col) == value).limit(1)


def page_metadata(metadata: Column, keys: tuple[str, ...]) -> Column:
    """The named keys of a map that have values (PF16)."""
    return F.map_filter(metadata, lambda k, v: k.isin(*keys) & v.isNotNull())


def rank_sweep(rows: DataFrame, n: int = 5) -> DataFrame:
    """The best settings by trade-off, exact and evidence rates (TK11)."""
    return rows.orderBy(F.col("tradeoff").desc(), F.col("exact").desc(), F.col("evidence").desc()).limit(n)


def chunk_overlaps(chunks: DataFrame, most: int) -> DataFrame:
    """Observed overlap of each chunk with the next of its source and page."""
    from ..functions.misc import overlap_length

    w = Window.partitionBy("source", "page").orderBy("chunk_index")
    return chunks.withColumn("next", F.lead("content").over(w)).where(F.col("next").isNotNull()).select("source", "page", "chunk_index", overlap_length(F.col("content"), F.col("next"), most).alias("overlap"))


def ranges_audit(ranges: DataFrame) -> DataFrame:
    """Completeness, repeated names and ranges with a digit (AG22)."""
    full = F.lit(True)
    for c in ("test_name", "normal_range", "unit", "category"):
        full = full & (F.trim(F.coalesce(c, F.lit(""))) != "")
    n = F.count("*")
    return ranges.agg(n.alias("rows"), F.avg(full.cast("int")).alias("complete"), (n - F.count_distinct("test_name")).alias("repeated_names"), F.avg(F.col("normal_range").rlike(r"\d").cast("int")).alias("parseable"))


def directory_hash(files: DataFrame, most: int | None = None) -> DataFrame:
    """One hash of all paths, sizes and times, and their number (AG33)."""
    from .hashtree import tree_hash

    return tree_hash(files, F.concat_ws("|", "path", F.col("size").cast("string"), F.col("modified").cast("string")), most)

"""Exact duplicates, manifests and upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Each row with its group's first row marked (``canonical``) and the group's size (AG34, SC3).

    The first row of a group is found by aggregation, so a group of any size is no task's burden."""
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    keyed = rows.withColumns({"key": key, "place": o})
    best = keyed.groupBy("key").agg(F.min("place").alias("best"), F.count("*").alias("copies"))
    return keyed.join(best, "key").withColumn("canonical", F.col("place") == F.col("best")).drop("place", "best")


def duplicate_counts(rows: DataFrame, key: Column) -> DataFrame:
    """One row: rows, different keys, and rows beyond the first of their key (AG18)."""
    return rows.groupBy(key.alias("key")).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the latest of each key (SK7, SK16)."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col("__new").desc(), F.col(order).desc())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def insert_new(existing: DataFrame, incoming: DataFrame, hash_col: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``incoming`` whose hash is new, the first of each, and one row of counts
    (attempted, inserted, skipped) (SK7, J22, ST5)."""
    w = Window.partitionBy(hash_col).orderBy(order)
    fresh = incoming.join(existing.select(hash_col).distinct(), hash_col, "left_anti").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    counts = incoming.agg(F.count("*").alias("attempted")).crossJoin(fresh.agg(F.count("*").alias("inserted")))
    return fresh, counts.withColumn("skipped", F.col("attempted") - F.col("inserted"))

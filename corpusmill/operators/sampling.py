"""Reproducible samples: keys are hashes of an id and a seed, so a rerun draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the MD5 of seed and key."""
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(2**52)


def weighted_sample(rows: DataFrame, key: Column, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement by weight (TK6): the smallest -ln(u) / w are taken. Ordering
    with a limit keeps ``n`` rows a partition, so nothing is sorted whole."""
    w = F.greatest(F.lit(0.01), weight)
    return rows.withColumn("sample_key", -F.log(draw(key, seed)) / w).orderBy("sample_key", key).limit(n)


def stratified_sample(rows: DataFrame, strata: list[Column], key: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each stratum (TK8)."""
    w = Window.partitionBy(*strata).orderBy(draw(key, seed), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def simple_sample(rows: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of their key (TK9)."""
    return rows.orderBy(draw(key, seed), key).limit(n).orderBy(key)

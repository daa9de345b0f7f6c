"""A store of contents that is dealt into partitions by the first digits of their hash.

A batch is joined with the partitions alone that its own hashes fall into, so what an insert reads
follows the batch, not the store. Its counts are those of the batch (SK7, SK16, ST5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

PART = "part"


@dataclass
class HashStore:
    """A Parquet table at ``path``, partitioned by the first ``digits`` hex digits of ``key``."""

    spark: SparkSession
    path: str
    key: str = "content_hash"
    digits: int = 2

    def exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p.suffix(f"/{PART}=*"))
        return found is not None and len(found) > 0

    def rows(self, schema=None) -> DataFrame:
        """All rows, without the partition column."""
        return self._read(schema).drop(PART)

    def _read(self, schema=None) -> DataFrame:
        if not self.exists():
            if schema is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], schema).withColumn(PART, F.lit(""))
        # digits alone would be read as numbers
        kept = self.spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
        self.spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        try:
            return self.spark.read.parquet(self.path)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", kept)

    def touched(self, batch: DataFrame) -> list[str]:
        """The partitions that a batch falls into, 16 ** digits at most."""
        return sorted(r[0] for r in batch.select(F.left(self.key, F.lit(self.digits))).distinct().collect() if r[0])

    def part_of(self, parts: list[str], schema=None) -> DataFrame:
        """The rows of some partitions; others are not listed for reading."""
        return self._read(schema).where(F.col(PART).isin(parts))

    def insert_new(self, batch: DataFrame, order: str) -> dict[str, int]:
        """Insert rows whose key is new, the first of each by ``order``; returns attempted, inserted,
        skipped (rows without a key are skipped). A batch that runs again adds nothing."""
        parts = self.touched(batch)
        known = self.part_of(parts, batch.schema).select(self.key)
        first = Window.partitionBy(self.key).orderBy(order)
        fresh = batch.where(F.col(self.key).isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").join(known, self.key, "left_anti")
        # written once, then counted and put in
        fresh = written(fresh.select(*batch.columns, F.left(self.key, F.lit(self.digits)).alias(PART)), "fresh")
        n, new = batch.count(), fresh.count()
        if new:
            fresh.repartition(PART).write.mode("append").partitionBy(PART).parquet(self.path)
        return {"attempted": n, "inserted": new, "skipped": n - new}

    def replace_latest(self, batch: DataFrame, order: str) -> None:
        """Put rows in by key, the latest by ``order`` of batch and store winning (the batch's of
        equals). Only the touched partitions are written again, each as a whole."""
        parts = self.touched(batch)
        both = self.part_of(parts, batch.schema).drop(PART).select(*batch.columns, F.lit(0).alias("__new"))
        both = both.unionByName(batch.where(F.col(self.key).isNotNull()).select(*batch.columns, F.lit(1).alias("__new")))
        last = Window.partitionBy(self.key).orderBy(F.col(order).desc(), F.col("__new").desc())
        kept = both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new").withColumn(PART, F.left(self.key, F.lit(self.digits)))
        kept.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

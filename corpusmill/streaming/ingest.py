"""Ingestion of a landing folder by a file stream: each run takes the files that came since.

The stream's checkpoint remembers the files. A batch first writes its documents, then its manifest
records, both into a folder named by the batch, which a batch that runs again replaces; a document
counts once the manifest names it. A content that the manifest has already becomes an alias of its
first page (ST6, SC3, SK12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources.store import HashStore

BATCH = "batch"


def _replace(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents that the manifest names as taken, with their batch."""
    taken = manifest(spark, path).where("status = 'ok'").select("id", BATCH)
    return spark.read.parquet(f"{path}/documents").join(taken, ["id", BATCH], "left_semi")


def ingest(landing: DataFrame, path: str, id_col: str, text_col: str, after_documents: Callable[[int], None] | None = None, digits: int = 2) -> int:
    """Take what a file stream has that is new, in one batch or as many as it is limited to, into
    documents(id, text, content_hash) and manifest(id, content_hash, status, alias_of) below ``path``;
    returns the batches run. ``after_documents`` is called between the two writes of a batch."""
    ran = 0

    def take(rows: DataFrame, batch: int) -> None:
        nonlocal ran
        spark = rows.sparkSession
        new = rows.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("content_hash", content_hash(F.col("text")))
        _replace(new, f"{path}/documents", batch)
        if after_documents is not None:
            after_documents(batch)
        new = spark.read.parquet(f"{path}/documents/{BATCH}={batch}").select("id", "content_hash")
        # first pages by hash lie in partitions of their hash: a batch reads those of its own hashes
        firsts = HashStore(spark, f"{path}/firsts", digits=digits)
        own = Window.partitionBy("content_hash").orderBy(F.length("id"), "id")
        marked = new.withColumn("first", F.first("id").over(own))
        heads = marked.where(F.col("id") == F.col("first")).select("content_hash", F.col("id").alias("page"), F.lit(batch).cast("long").alias(BATCH)).dropDuplicates(["content_hash"])
        firsts.insert_new(heads, "page")
        known = firsts.part_of(firsts.touched(heads), heads.schema).select("content_hash", "page", F.col(BATCH).alias("since"))
        found = marked.join(known, "content_hash")
        alias = (F.col("id") != F.col("page")) | (F.col("since") < batch)
        _replace(found.select("id", "content_hash", F.when(alias, "alias").otherwise("ok").alias("status"), F.when(alias, F.col("page")).alias("alias_of")), f"{path}/manifest", batch)
        ran += 1

    q = landing.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return ran

"""Writers: layered tables, the index and run artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import HashStore


def write_layer(rows: DataFrame, path: str, by: str | None = None) -> int:
    """A layer's table, overwritten, partitioned by a column if named; returns its rows (SK2-SK6)."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def append_manifest(records: DataFrame, path: str) -> None:
    """SK12."""
    records.write.mode("append").parquet(path)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """JSON by source type (SK1, SK14)."""
    artifacts.write.mode("overwrite").partitionBy("source_type").json(path)


def add_documents(spark: SparkSession, chunks: DataFrame, path: str) -> dict[str, int]:
    """Insert chunks (id, content, content_hash, ...) whose content is new; returns counts (SK7)."""
    return HashStore(spark, path).insert_new(chunks, "id")


def clear(spark: SparkSession, path: str) -> None:
    """Empty the index, keeping its columns (SK9)."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def flatten_metadata(metadata: str):
    """A map without null values, as the store keeps it (SK11)."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull())


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A table as JSON lines (``json``) and as a Markdown table (``md``), rows in the order of their
    first column (SK19, SK20). Meant for reports: a row a variant."""
    first = rows.columns[0]
    rows.write.mode("overwrite").json(f"{path}/json")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    head = ["# " + title, "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    body = rows.sparkSession.createDataFrame([(0, str(k).zfill(4), x) for k, x in enumerate(head)], "part int, at string, value string")
    body.unionByName(rows.select(F.lit(1).alias("part"), F.col(first).cast("string").alias("at"), line.alias("value"))).coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(f"{path}/md")


def write_histories(histories: DataFrame, path: str) -> None:
    """(session, version, updated_at, messages) as JSON lines, replacing what was there once all is
    written (SK17)."""
    histories.write.mode("overwrite").json(path)

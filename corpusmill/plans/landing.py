"""Queries of readers and writers: each writes to the shared folder and reads back what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import enrich
from ..sources import readers, writers
from ..sources.shared import shared_dir
from .base import query, table
from .search import NAMED, file_name


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH d AS (SELECT doc_id, {NAMED} AS name, text FROM documents), t AS (SELECT *, CASE WHEN name LIKE '%.pdf' THEN 'pdf' WHEN name LIKE '%.csv' THEN 'csv' ELSE 'html' END AS source_type FROM d)
SELECT source_type, (SELECT count(*) FROM t) AS stored, CAST(count(*) AS BIGINT) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM t WHERE source_type <> 'csv' GROUP BY source_type""")
def layer_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer written by source type, of which two types are read back (SK2-SK6, SC13, SC29)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", tx.source_type_of(file_name()).alias("source_type"))
    path = _new_path(spark, "silver")
    stored = writers.write_layer(d, path, by="source_type")
    read = spark.read.parquet(path).where(F.col("source_type").isin("pdf", "html"))  # other partitions are not listed
    return read.groupBy("source_type").agg(F.lit(stored).cast("long").alias("stored"), F.count("*").alias("rows"), F.sum(F.length("text").cast("long")).alias("chars"))


@query(f"SELECT doc_id, md5(text) AS content_md5 FROM documents WHERE {NAMED} LIKE '%.pdf'")
def artifact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts as JSON by source type, looked up by type and id (SK1, SK13, SC14)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", tx.source_type_of(file_name()).alias("source_type"))
    path = _new_path(spark, "artifacts")
    writers.write_artifacts(d, path)
    asked = table(spark, sf_dir, "documents").select("doc_id", F.lit("pdf").alias("source_type"))
    found = spark.read.schema("doc_id long, text string, source_type string").json(path)
    return asked.join(found, ["source_type", "doc_id"]).select("doc_id", F.md5("text").alias("content_md5"))


@query("""SELECT p_name || ': ' || p_size || '-' || (p_size + 5) || ' ' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'mg/dL' END || ' (' || p_type || ')' || CASE WHEN p_partkey % 4 = 0 THEN ' - ' || p_brand ELSE '' END AS content, CAST(count(*) AS BIGINT) AS n
FROM part GROUP BY 1""")
def reference_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference ranges from CSV as documents of one line each (SC9, SC12, SO8)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("test_name"), F.concat(size.cast("string"), F.lit("-"), (size + 5).cast("string")).alias("normal_range"),
        F.when(k % 3 == 0, "").otherwise(" mg/dL ").alias("unit"), F.col("p_type").alias("category"), F.when(k % 4 == 0, F.col("p_brand")).alias("notes"),
    )
    path = _new_path(spark, "ranges")
    rows.write.csv(path, header=True)
    return readers.read_ranges(spark, path).groupBy("content").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, 1700000000 + turn AS s FROM conversations)
SELECT conv_id::VARCHAR AS session, 2 AS version, CASE WHEN conv_id % 3 = 0 THEN max(s) WHEN conv_id % 3 = 1 THEN 1600000000 + conv_id ELSE greatest(1700000003, max(s)) END::BIGINT AS updated_at, count(*)::INTEGER AS messages FROM m GROUP BY conv_id""")
def stored_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat histories stored as lists, or as objects with and without their time, read as one form and
    stored again (SC26, SK17)."""
    c, t = table(spark, sf_dir, "conversations"), F.col("turn") + 1700000000
    stamp = F.when(F.col("conv_id") % 3 == 0, t * 1000).otherwise(t).cast("double")
    message = F.struct("turn", F.struct("role", F.col("text").alias("content"), stamp.alias("timestamp")).alias("m"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    k = F.col("conv_id")
    with_time = F.to_json(F.struct((k + 1600000000).alias("updated_at"), "messages"))
    raw = F.when(k % 3 == 0, F.to_json("messages")).when(k % 3 == 1, with_time).otherwise(F.to_json(F.struct(F.lit("soon").alias("updated_at"), "messages")))
    now = F.when(k % 3 == 2, F.lit(1700000003)).otherwise(F.lit(0))
    first, again = _new_path(spark, "histories"), _new_path(spark, "histories")
    g.select(k.cast("string").alias("session"), raw.alias("raw"), now.cast("long").alias("now")).write.json(first)
    read = spark.read.schema("session string, raw string, now long").json(first)
    writers.write_histories(read.select("session", readers.normalized_history(F.col("raw"), F.col("now")).alias("h")).select("session", "h.*"), again)
    stored = spark.read.schema("session string, version int, updated_at long, messages array<struct<role: string, content: string, timestamp: double>>").json(again)
    return stored.select("session", "version", "updated_at", F.size("messages").alias("messages"))


@query("""WITH h AS (SELECT doc_id, md5(text) AS key, length(text) AS n FROM documents)
SELECT doc_id, n::BIGINT AS value, doc_id % 2 = 0 OR key IN (SELECT key FROM h WHERE doc_id % 2 = 0) AS was_known FROM h""")
def cached_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by key from a written cache, those that it lacks computed and appended (SK18, J25, J26)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.md5("text").alias("key"))
    path = _new_path(spark, "cache")
    compute = lambda rows: rows.withColumns({"value": F.length("text").cast("long"), "was_known": F.lit(False)})
    compute(d.where("doc_id % 2 = 0")).select("key", "value").dropDuplicates(["key"]).write.parquet(path)
    cache = spark.read.parquet(path).withColumn("was_known", F.lit(True))
    return enrich.cached(d, cache, "key", compute).select("doc_id", "value", "was_known")


@query("""WITH m AS (SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT '| ' || lang || ' | ' || n || ' | ' || chars || ' |' AS line FROM m UNION ALL SELECT unnest(['# Languages', '', '| lang | n | chars |', '|---|---|---|'])""")
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as JSON and Markdown, the Markdown read back (SK14, SK19, SK20)."""
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    path = _new_path(spark, "report")
    writers.write_report(rows, path, "Languages")
    assert spark.read.json(f"{path}/json").columns
    return spark.read.text(f"{path}/md").select(F.col("value").alias("line"))


@query("""WITH m AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
SELECT u AS normalized_url, max(page_id) AS last_page, CAST(count(*) AS BIGINT) AS records FROM m GROUP BY u""")
def manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest records appended by three runs, and the last of each URL (SK12, SC3, J11)."""
    m = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("normalized_url"))
    path = _new_path(spark, "manifest")
    for k in range(3):
        writers.append_manifest(m.where(F.col("page_id") % 3 == k), path)
    return spark.read.parquet(path).groupBy("normalized_url").agg(F.max("page_id").alias("last_page"), F.count("*").alias("records"))


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events")
def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines, read back with blank lines skipped (SC19, SK14)."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    path = _new_path(spark, "records")
    e.write.json(path)
    return readers.read_records(spark, path).select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT doc_id AS id, md5(text) AS content_md5, CAST(lang IS NOT NULL AS INTEGER) + 1 AS fields FROM documents")
def store_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON store moved into a table: ids that it has are skipped, metadata without value dropped
    (SK8, SK11, SK23, SC24)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("none"), F.lit(None).cast("string"), F.lit("kind"), F.lit("doc")).alias("metadata"))
    source, target = _new_path(spark, "json-store"), _new_path(spark, "table-store")
    d.write.json(source)
    d.where("id % 4 = 0").withColumn("metadata", writers.flatten_metadata(F.col("metadata"))).write.parquet(target)
    old = spark.read.schema("id long, content string, metadata map<string, string>").json(source)
    new = old.join(spark.read.parquet(target).select("id"), "id", "left_anti").withColumn("metadata", writers.flatten_metadata(F.col("metadata")))
    new.write.mode("append").parquet(target)
    return spark.read.parquet(target).select("id", F.md5("content").alias("content_md5"), F.size("metadata").alias("fields"))

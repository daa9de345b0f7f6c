"""Queries of clinical structure, page blocks, enrichment and run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import medical as md
from ..operators import enrich, pdf, runs
from .base import query, table

DOSING = "(?i)(?:" + "|".join(md.DOSING) + ")"
LAB = "(?i)(?:" + "|".join(md.LAB_TABLES) + ")"
SECTIONS = ", ".join(f"'{s}'" for s in md.SECTIONS)
HEADER = "({x} <> '' AND (upper({x}) IN (" + SECTIONS + ") OR upper(regexp_replace({x}, ':$', '')) IN (" + SECTIONS + ") OR " + " OR ".join("regexp_matches({x}, '" + p.replace("{", "{{").replace("}", "}}") + "')" for p in md.HEADERS) + "))"


@query(f"""SELECT doc_id, regexp_matches(text, '{DOSING}') AS dosing, contains(text, '|') AND regexp_matches(text, '{LAB}') AS lab_table,
CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: {HEADER.format(x="l")})) AS BIGINT) AS headers FROM documents""")
def clinical_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dosing, laboratory tables and section headers of every text (SF39-SF42)."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", md.has_dosing(t).alias("dosing"), md.is_lab_table(t).alias("lab_table"), F.size(md.header_positions(t)).cast("long").alias("headers"))


@query(r"""WITH l AS (SELECT doc_id, n, trim(x, E' \t\r') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(x, E' \t\r') <> ''),
k AS (SELECT *, CASE WHEN length(line) < 100 AND ((upper(line) = line AND lower(line) <> line) OR line LIKE '%:') THEN 'heading'
  WHEN length(line) - length(replace(line, '|', '')) >= 2 OR (contains(line, '  ') AND len(string_split(regexp_replace(line, '\s+', ' ', 'g'), ' ')) >= 4) THEN 'table'
  WHEN line LIKE '-%' OR line LIKE '*%' OR line LIKE '•%' THEN 'list' ELSE 'paragraph' END AS kind FROM l),
t AS (SELECT *, CASE WHEN kind = 'heading' OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n), '') <> kind THEN 1 ELSE 0 END AS turn FROM k),
b AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS block FROM t)
SELECT doc_id, CAST(block AS BIGINT) AS block, kind AS block_type, substr(sha256(string_agg(CASE WHEN kind = 'heading' THEN regexp_replace(line, ':+$', '') ELSE line END, chr(10) ORDER BY n)), 1, 16) AS hash FROM b GROUP BY doc_id, block, kind""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of lines of a kind (TV14, WN11); each document is taken as a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return pdf.page_blocks(d).select("doc_id", F.col("block").cast("long").alias("block"), "block_type", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


@query(r"""SELECT source, CAST(count(*) AS BIGINT) AS pages, round(avg(CASE WHEN trim(text) = '' THEN 1.0 ELSE 0.0 END), 6) AS empty_rate, round(avg(CASE WHEN length(trim(text, E' \n\t\r')) < 120 THEN 1.0 ELSE 0.0 END), 6) AS low_rate FROM documents GROUP BY source""")
def l2_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page audit by source (AG20)."""
    p = pdf.page_audit(table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), "text"))
    return p.select(F.col("doc_id").alias("source"), "pages", F.round("empty_rate", 6).alias("empty_rate"), F.round("low_rate", 6).alias("low_rate"))


@query(r"SELECT item_id, 64::INTEGER AS dimension, CASE WHEN regexp_matches(text, '[\p{L}\p{Nl}\p{No}]{4,}') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM benchmark")
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of benchmark items by the offline embedder (UD2, UD3)."""
    e = enrich.embed(table(spark, sf_dir, "benchmark"), "text")
    return e.select("item_id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query("""WITH v AS (SELECT event_type || CASE WHEN user_id % 2 = 0 THEN '_a' ELSE '_b' END AS variant, avg(value) AS ndcg FROM events GROUP BY 1)
SELECT d AS dimension, CAST(count(*) AS BIGINT) AS runs, round(avg(ndcg), 6) AS ndcg FROM v, (VALUES ('shop', 'purchase'), ('shop', 'click'), ('seen', 'view'), ('seen', 'click')) AS g(d, p) WHERE starts_with(variant, p) GROUP BY d""")
def ablation_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by overlapping groups of name prefixes (AG27)."""
    e = table(spark, sf_dir, "events")
    v = e.groupBy(F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "_a").otherwise("_b")).alias("variant")).agg(F.avg("value").alias("ndcg"))
    return runs.by_dimension(v, {"shop": ["purchase", "click"], "seen": ["view", "click"]}).withColumn("ndcg", F.round("ndcg", 6))


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key (SK15, SK16)."""
    return runs.latest_of(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "user_id", "ts")

"""Readers with explicit schemas: pages, PDFs, Markdown, CSV ranges, golden sets, histories, runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: columns of the reference-range table, all text.
RANGE_COLUMNS = ("test_name", "normal_range", "unit", "category", "notes")
GOLDEN = "query string, expected_keywords array<string>, expected_sources array<string>, label_confidence string, dataset_split string, difficulty string, query_category string, negative_query string, source_family string, topic string, evidence_phrase string"
CONVERSATION = "conversation_id string, scenario string, conversation_category string, turns array<struct<role:string,content:string>>, expected_outcome string, context array<string>, difficulty string, dataset_split string, source_family string"


def read_binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, modified, size, content) of files (SC5, SC6)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def read_html(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """(name, html) of pages that the manifest does not name as aliases (SC5, PF3)."""
    pages = read_binary(spark, path, "*.html").select("name", F.decode("content", "UTF-8").alias("html"))
    return pages if manifest is None else pages.join(alias_names(manifest), "name", "left_anti")


def alias_names(manifest: DataFrame) -> DataFrame:
    """Names of files that stand for another file of equal content (PF3)."""
    alias = F.col("status").isin("duplicate_alias", "alias") & F.col("duplicate_of").isNotNull() & (F.col("filename") != F.col("duplicate_of"))
    return manifest.where(alias).select(F.col("filename").alias("name")).distinct()


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(name, page, content, error): one row a page by a given extractor; a file that fails gives one
    row with its error instead (SC6, SC7, SC28)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["name"], b["content"], strict=True):
                try:
                    rows += [(name, k, text, None) for k, text in enumerate(extract(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    rows.append((name, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["name", "page", "content", "error"])

    return read_binary(spark, path, "*.pdf").select("name", "content").mapInPandas(run, "name string, page int, content string, error string")


def better_page(text: Column, other: Column) -> Column:
    """The fallback's page text where the first is poor (SF31)."""
    poor = (F.length(text) < 120) | (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit(""))) > 2) | (F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")) < 2)
    return F.when((F.trim(F.coalesce(other, F.lit(""))) != "") & poor, other).otherwise(text)


def read_markdown(spark: SparkSession, path: str, manifest: DataFrame | None = None, only_indexable: bool = False) -> DataFrame:
    """(name, content, logical_name, source_url): empty files go; a page's record is found by the
    Markdown name, else the page's name, else its logical name (SC8, SC29, J9, J10)."""
    docs = read_binary(spark, path, "*.md").select("name", F.decode("content", "UTF-8").alias("content")).where(F.trim("content") != "")
    if manifest is None:
        return docs.withColumns({"logical_name": F.lit(None).cast("string"), "source_url": F.lit(None).cast("string")})
    stem = F.regexp_replace("name", r"\.md$", "")
    out = docs
    for k, (column, key) in enumerate((("filename", F.col("name")), ("filename", F.concat(stem, F.lit(".html"))), ("logical_name", stem))):
        w = Window.partitionBy(column).orderBy("timestamp_utc")
        one = manifest.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col(column).alias(f"key{k}"), F.struct("logical_name", F.col("url").alias("source_url"), "indexable").alias(f"found{k}"))
        out = out.join(one, key == F.col(f"key{k}"), "left")
    found = F.coalesce("found0", "found1", "found2")
    out = out.withColumn("found", found)
    if only_indexable:
        out = out.where(F.coalesce("found.indexable", F.lit(True)))
    return out.select("name", "content", "found.logical_name", "found.source_url")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(id, content) documents of a CSV of reference ranges; missing columns are an error (SC9, SC12)."""
    rows = spark.read.csv(path, header=True)
    missing = set(RANGE_COLUMNS) - set(rows.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    c = {k: F.coalesce(F.trim(k), F.lit("")) for k in RANGE_COLUMNS}
    order = Window.orderBy(F.monotonically_increasing_id())  # a small table, in file order
    text = F.concat(c["test_name"], F.lit(": "), c["normal_range"], F.lit(" "), c["unit"], F.lit(" ("), c["category"], F.lit(")"), F.when(c["notes"] != "", F.concat(F.lit(" - "), c["notes"])).otherwise(""))
    return rows.select(F.concat(F.lit("ref_"), (F.row_number().over(order) - 1).cast("string")).alias("id"), text.alias("content"), *[c[k].alias(k) for k in RANGE_COLUMNS])


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries with ids and defaults; blank queries go (SC15)."""
    from ..functions.text import assign_split, source_family

    raw = spark.read.schema(f"golden_queries array<struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in GOLDEN.split(', '))}>>").json(path, multiLine=True)
    rows = raw.select(F.posexplode("golden_queries").alias("n", "g")).select("n", "g.*").where(F.trim(F.coalesce("query", F.lit(""))) != "")
    first = F.coalesce(F.get("expected_sources", F.lit(0)), F.lit(""))
    empty = F.array().cast("array<string>")
    return rows.select(F.concat(F.lit("golden_"), (F.col("n") + 1).cast("string")).alias("query_id"), F.trim("query").alias("query"), F.coalesce("expected_keywords", empty).alias("expected_keywords"), F.coalesce("expected_sources", empty).alias("expected_sources"), *[F.coalesce(F.nullif(c, F.lit("")), F.lit(d)).alias(c) for c, d in (("label_confidence", "medium"), ("difficulty", "medium"), ("query_category", "anchor"))], F.coalesce("dataset_split", assign_split(first)).alias("dataset_split"), F.coalesce("source_family", source_family(first)).alias("source_family"), "evidence_phrase")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Golden conversations with the number of user turns; those without turns go (SC16)."""
    fields = ", ".join(f"{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}" for x in CONVERSATION.split(", "))
    raw = spark.read.schema(f"golden_conversations array<struct<{fields}>>").json(path, multiLine=True)
    rows = raw.select(F.explode("golden_conversations").alias("c")).select("c.*").where(F.size("turns") > 0)
    return rows.withColumn("user_turn_count", F.size(F.filter("turns", lambda t: t["role"] == "user")))


def read_vectors_json(spark: SparkSession, path: str) -> DataFrame:
    """A column-wise JSON store as rows (SC24); arrays of different lengths are an error."""
    raw = spark.read.schema("ids array<string>, contents array<string>, embeddings array<array<double>>, metadatas array<map<string,string>>").json(path, multiLine=True)
    n = F.size("ids")
    same = (F.size("contents") == n) & (F.size("embeddings") == n)
    checked = raw.select(F.when(same, F.arrays_zip("ids", "contents", "embeddings", "metadatas")).otherwise(F.raise_error("array lengths differ")).alias("z"))
    return checked.select(F.explode("z").alias("z")).select(F.col("z.ids").alias("id"), F.col("z.contents").alias("content"), F.col("z.embeddings").alias("embedding"), F.col("z.metadatas").alias("metadata"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs that are valid, newest first (SC18, PF12, TK13)."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "summary.json").json(path, multiLine=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/summary\.json$", 1)
    return raw.withColumn("run", name).where(F.col("run").rlike(r"^[0-9].*_") & (F.col("query_count") > 0)).orderBy(F.col("run").desc())


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines, blank lines skipped, up to a limit if there is one (SC19, TK12)."""
    rows = spark.read.json(path)
    return rows if limit is None else rows.limit(limit)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset file by what it holds: golden queries, golden conversations, or a list of records, of
    which those with a query are kept; anything else is an error (SC17)."""
    found = spark.read.json(path, multiLine=True)
    if "golden_queries" in found.columns:
        return read_golden(spark, path)
    if "golden_conversations" in found.columns:
        return read_conversations(spark, path)
    if "query" not in found.columns:
        raise ValueError(f"no dataset: {path}")
    return found.where(F.trim(F.coalesce(F.col("query").cast("string"), F.lit(""))) != "")


_MESSAGES = "array<struct<role: string, content: string, timestamp: double>>"


def normalized_history(raw: Column, now: Column) -> Column:
    """struct<version, updated_at, messages> of a stored session, a JSON list of messages (version 1) or
    an object with its own time (version 2); null for anything else (SC26).

    A session without a time of its own takes the latest of ``now`` and its messages', whose times are
    seconds or, beyond ten digits, milliseconds."""
    is_list, is_object = F.ltrim(raw).startswith("["), F.ltrim(raw).startswith("{")
    given = F.from_json(F.when(is_list, raw).otherwise(F.get_json_object(raw, "$.messages")), _MESSAGES)
    messages = F.filter(F.coalesce(given, F.array().cast(_MESSAGES)), lambda m: m.isNotNull())
    seconds = F.transform(messages, lambda m: F.floor(F.when(m["timestamp"] > 10_000_000_000, m["timestamp"] / 1000).otherwise(m["timestamp"])))
    own = F.when(is_object, F.floor(F.get_json_object(raw, "$.updated_at").try_cast("double")))
    updated = F.coalesce(own, F.greatest(now, F.array_max(seconds))).cast("long")
    return F.when(is_list | is_object, F.struct(F.lit(2).alias("version"), updated.alias("updated_at"), messages.alias("messages")))

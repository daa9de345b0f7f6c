"""Lines of extracted pages to structured blocks, by gaps and islands (TV14, WN11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_of, normalize_space, trimmed_lines


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, block, block_type, text, section) of pages (doc_id, page, text): runs of lines of
    a kind are a block, a heading is a block of its own and names the section of those after it."""
    lines = pages.select("doc_id", "page", F.posexplode(trimmed_lines(F.col("text"))).alias("n", "line"))
    x = F.col("line")
    heading = (F.length(x) < 100) & (((F.upper(x) == x) & (F.lower(x) != x)) | x.endswith(":"))
    tabular = (count_of(x, "|") >= 2) | (F.contains(x, F.lit("  ")) & (F.size(F.split(normalize_space(x), " ")) >= 4))
    listed = x.startswith("-") | x.startswith("*") | x.startswith("•")
    kinds = lines.withColumn("kind", F.when(heading, "heading").when(tabular, "table").when(listed, "list").otherwise("paragraph"))
    w = Window.partitionBy("doc_id", "page").orderBy("n")
    turn = (F.col("kind") == "heading") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind"))
    title = F.when(F.col("kind") == "heading", F.regexp_replace(x, ":+$", ""))
    marked = kinds.withColumns({"turn": turn.cast("int"), "title": title})
    runs = marked.withColumns({"block": F.sum("turn").over(w) - 1, "section": F.last("title", ignorenulls=True).over(w)})
    made = runs.groupBy("doc_id", "page", "block", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("title", "line").alias("t")))), lambda r: r["t"]), "\n").alias("text"), F.first("section").alias("section"))
    return made.withColumnRenamed("kind", "block_type")


def page_audit(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, empty_rate, low_rate) by document (AG20)."""
    from ..functions.text import page_confidence

    t = F.coalesce(F.col("text"), F.lit(""))
    conf = page_confidence(t, count_of(t, "�"), F.size(trimmed_lines(t)))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.avg((F.trim(t) == "").cast("int")).alias("empty_rate"), F.avg((conf == "low").cast("int")).alias("low_rate"))

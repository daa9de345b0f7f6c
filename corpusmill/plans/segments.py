"""Queries of semantic chunks and of tables in plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.semantic import semantic_chunks as chunk_semantically
from ..operators.texttables import table_blocks
from ..operators.texttables import text_tables as find_tables
from .base import query, table

LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""WITH sent AS MATERIALIZED (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM (
    SELECT doc_id, trim(p[i], E' \t') AS s, i FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS p FROM documents)))
  WHERE s <> ''),
w AS MATERIALIZED (SELECT doc_id, k, word, count(*) AS c FROM (SELECT doc_id, k, unnest(regexp_extract_all({LOWER.format(c='s')}, '[^ \t.,;:!?|]+')) AS word FROM sent) GROUP BY ALL),
last AS (SELECT doc_id, max(k) AS m FROM sent GROUP BY doc_id),
side AS MATERIALIZED (SELECT doc_id, i, right_side, word, sum(c) AS c FROM (
  SELECT w.doc_id, word, c, unnest([k, k + 1, k + 2]) AS i, false AS right_side FROM w UNION ALL SELECT w.doc_id, word, c, unnest([k - 1, k - 2, k - 3]), true FROM w) JOIN last USING (doc_id) WHERE i >= 0 AND i < m GROUP BY ALL),
size AS (SELECT doc_id, i, right_side, sum(c * c) AS n FROM side GROUP BY ALL),
dot AS (SELECT a.doc_id, a.i, sum(a.c * b.c) AS x FROM side a JOIN side b ON a.doc_id = b.doc_id AND a.i = b.i AND a.word = b.word AND NOT a.right_side AND b.right_side GROUP BY ALL),
sims AS (SELECT doc_id, i, round(coalesce(x, 0)::DOUBLE / sqrt(l.n::DOUBLE * r.n::DOUBLE), 9) AS sim FROM (SELECT doc_id, k AS i FROM sent JOIN last USING (doc_id) WHERE k < m)
  LEFT JOIN dot USING (doc_id, i) LEFT JOIN (SELECT * FROM size WHERE NOT right_side) l USING (doc_id, i) LEFT JOIN (SELECT * FROM size WHERE right_side) r USING (doc_id, i)),
cut AS (SELECT doc_id, round(quantile_cont(coalesce(sim, 0.0), 0.2), 9) AS least FROM sims GROUP BY doc_id),
starts AS (SELECT sent.doc_id, k, s, sum(CASE WHEN k = 0 OR coalesce(sim, 0.0) < least THEN 1 ELSE 0 END) OVER (PARTITION BY sent.doc_id ORDER BY k) - 1 AS chunk
  FROM sent LEFT JOIN sims ON sims.doc_id = sent.doc_id AND i = k - 1 LEFT JOIN cut ON cut.doc_id = sent.doc_id)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(min(k) AS BIGINT) AS first_sentence, CAST(count(*) AS BIGINT) AS sentences, md5(string_agg(s, ' ' ORDER BY k)) AS content_md5 FROM starts GROUP BY doc_id, chunk""")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut where windows of three sentences are least alike (TV17, UD20)."""
    found = chunk_semantically(table(spark, sf_dir, "documents"), window=3, percentile=0.2)
    return found.select("doc_id", "chunk", "first_sentence", "sentences", F.md5("content").alias("content_md5"))


CELLS = "[CAST(o_orderkey AS VARCHAR), o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR), o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')]"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a statement of the orders of the customer of that number set in columns behind
    their text, as a page extracted from print."""
    o = table(spark, sf_dir, "orders")
    line = F.concat(
        F.rpad(F.col("o_orderkey").cast("string"), 12, " "), F.rpad("o_orderstatus", 10, " "), F.lpad(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), 14, " "), F.lit("  "),
        F.rpad("o_orderpriority", 20, " "), F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    lines = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("rows"))
    head = F.concat(F.rpad(F.lit("ORDER"), 12, " "), F.rpad(F.lit("STATUS"), 10, " "), F.lpad(F.lit("TOTAL PRICE"), 14, " "), F.lit("  "), F.rpad(F.lit("PRIORITY"), 20, " "), F.lit("DATE"))
    d = table(spark, sf_dir, "documents").join(lines, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("rows").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "text", head, "rows", F.lit("End of the statement."))).alias("text"))


@query(f"""WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, {CELLS} AS cells FROM orders WHERE o_custkey IN (SELECT doc_id FROM documents)),
every AS (SELECT * FROM o UNION ALL SELECT DISTINCT doc_id, 0, ['ORDER', 'STATUS', 'TOTAL PRICE', 'PRIORITY', 'DATE'] FROM o)
SELECT doc_id, 0::BIGINT AS table_no, row::BIGINT AS row, len(cells)::INTEGER AS n_cells, array_to_string(cells, '|') AS cells FROM every""")
def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cells of tables set in columns within texts, the texts' own lines left alone (TV15, SC6)."""
    return find_tables(statements(spark, sf_dir)).select("doc_id", F.col("table").alias("table_no"), "row", F.size("cells").alias("n_cells"), F.array_join("cells", "|").alias("cells"))


@query(f"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, array_to_string({CELLS}, ' | ') AS line FROM orders WHERE o_custkey IN (SELECT doc_id FROM documents))
SELECT doc_id, count(*)::BIGINT + 1 AS rows, 5::BIGINT AS columns, md5('ORDER | STATUS | TOTAL PRICE | PRIORITY | DATE' || chr(10) || string_agg(line, chr(10) ORDER BY o_orderkey)) AS text_md5 FROM o GROUP BY doc_id""")
def text_table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables as blocks of text with their sizes (TV15)."""
    return table_blocks(find_tables(statements(spark, sf_dir))).select("doc_id", "rows", "columns", F.md5("text").alias("text_md5"))

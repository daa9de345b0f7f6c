"""Queries over documents and pages: text functions, duplicates, chunks, HTML, URLs and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import questions as qs
from ..functions import sources as src
from ..functions import text as tx
from ..operators import chunking as ch
from ..operators import dedup, html, sampling
from ..operators.diversity import capped, diversify
from ..operators.scan import one_row_an_id, overlap_top
from .base import query, table
from .search import ALL_DOCS, BM25, NAMED, TOKENS, best_documents, file_name


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(r"""SELECT doc_id, substr(sha256(regexp_replace(substr(replace(replace(replace(replace(replace(replace(replace(
regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), 'mmol/l', 'mmoll'), 'MMOL/L', 'mmoll'), 'mg/dl', 'mgdl'), 'MG/DL', 'mgdl'), 'kg/m2', 'kgm2'), 'KG/M2', 'kgm2'), '%', 'percent'), 1, 50000), '^\s+|\s+$', '', 'g')), 1, 16) AS hash FROM documents""")
def sanitized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of sanitised texts (SF1, SF6)."""
    return docs(spark, sf_dir).select("doc_id", tx.content_hash(tx.sanitize_text(F.col("text"))).alias("hash"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS different FROM (SELECT doc_id, {TOKENS.format(c='text')} AS t FROM documents)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the plain analyzer (SF2-SF5, AG1)."""
    t = tx.plain_tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("different"))


@query(f"SELECT token, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM (SELECT doc_id, unnest({TOKENS.format(c='text')}) AS token FROM documents) GROUP BY token")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index's document and corpus frequencies (AG2)."""
    from ..operators.index import build_index

    post = build_index(docs(spark, sf_dir)).postings
    return post.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("""WITH h AS (SELECT doc_id, lang, substr(sha256(lower(text)), 1, 16) AS hash FROM documents)
SELECT doc_id, hash, doc_id = min(doc_id) OVER (PARTITION BY hash) AS canonical, CAST(count(*) OVER (PARTITION BY hash) AS BIGINT) AS copies FROM h""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by the hash of the lower-cased text (SO5, SO6)."""
    found = dedup.canonical(docs(spark, sf_dir).select("doc_id", "text"), tx.chunk_hash(F.col("text")), [F.col("doc_id")])
    return found.select("doc_id", F.col("key").alias("hash"), "canonical", "copies")


COUNT = "(length({c}) - length(replace({c}, '{t}', ''))) // {n}"
HITS = " + ".join(COUNT.format(c="lower(text)", t=t, n=len(t)) for t in tx.BLOCK_TERMS)
PAGE_HITS = " + ".join(COUNT.format(c="lower(text)", t=t, n=len(t)) for t in tx.PAGE_TERMS)


@query(rf"""WITH l AS (SELECT doc_id, text, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, round(({PAGE_HITS})::DOUBLE / greatest(1, length(text)), 6) AS boilerplate,
round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - CASE WHEN length(trim(text, E' \n\t\r')) < 100 THEN 0.35::DOUBLE ELSE 0 END - least(0.4::DOUBLE, 0.08::DOUBLE * ({HITS})))), 6) AS quality,
CAST(len(list_filter(ls, lambda x: {COUNT.format(c="x", t="|", n=1)} >= 2 OR (contains(x, '  ') AND len(string_split(regexp_replace(x, '\s+', ' ', 'g'), ' ')) >= 4))) AS BIGINT) AS tables,
CASE WHEN length(trim(text, E' \n\t\r')) >= 400 AND len(ls) >= 3 THEN 'high' WHEN length(trim(text, E' \n\t\r')) >= 120 THEN 'medium' ELSE 'low' END AS confidence FROM l""")
def text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture, quality, table lines and confidence of every text (SF9, SF11, SF29, SF30, SF32)."""
    t = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id",
        F.round(tx.boilerplate_ratio(t), 6).alias("boilerplate"),
        F.round(tx.block_quality(t, F.lit("high"), 100), 6).alias("quality"),
        tx.suspected_tables(t).cast("long").alias("tables"),
        tx.page_confidence(t, F.lit(0), F.size(tx.trimmed_lines(t))).alias("confidence"),
    )


@query(f"""WITH n AS (SELECT doc_id, {NAMED} AS name, array_to_string(list_slice(list_filter(string_split(regexp_replace(regexp_replace(lower({NAMED}), '\\.(pdf|md|html)$', ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), 1, 3), ' ') AS family FROM documents),
s AS (SELECT *, list_sum(list_transform(string_split(family, ''), lambda c: ascii(c))) % 10 AS r FROM n)
SELECT doc_id, family, CASE WHEN r <= 4 THEN 'dev' WHEN r <= 7 THEN 'test' ELSE 'regression' END AS split, CASE WHEN name LIKE '%.pdf' THEN 'pdf' WHEN name LIKE '%.csv' THEN 'csv' ELSE 'html' END AS kind FROM s""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source family, data split and kind by name (SF14-SF17)."""
    name = file_name()
    return docs(spark, sf_dir).select("doc_id", tx.source_family(name).alias("family"), tx.assign_split(name).alias("split"), tx.source_type_of(name).alias("kind"))


@query("""WITH l AS (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT substr(sha256(t), 1, 16) AS hash, CAST(count(*) AS BIGINT) AS n FROM l WHERE length(t) >= 20 GROUP BY t HAVING count(*) >= greatest(2, (SELECT count(*) FROM documents) // 300)""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents share (AG3; a line is a block, a hundred documents a file)."""
    d = docs(spark, sf_dir)
    lines = d.select(F.explode(F.split("text", "\n")).alias("text"))
    return html.repeated_hashes(lines, d.count() // 100)


@query("""SELECT page_id, CASE WHEN length(p) = 0 THEN h || '/' ELSE h || p END || q AS normalized, regexp_replace(url, '[?#].*$', '') AS stripped, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS domain,
CASE WHEN regexp_matches(d, '\\.gov$|\\.gov\\.') THEN 'government' WHEN regexp_matches(d, '\\.edu$|\\.edu\\.') THEN 'education' WHEN d LIKE '%.org' THEN 'organization' WHEN d LIKE '%.com' THEN 'commercial' ELSE 'unknown' END AS domain_type
FROM (SELECT page_id, url, lower(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)) AS h, regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#;]*)', 1), '/+$', '') AS p, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS q, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '') AS d FROM pages)""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs' normal forms, domains and domain kinds (SU1-SU5)."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", src.normalize_url(u).alias("normalized"), src.strip_tracking(u).alias("stripped"), src.domain(u).alias("domain"), src.domain_type(src.domain(u)).alias("domain_type"))


@query("""SELECT page_id, CASE WHEN s = '' OR s LIKE '%\\_' ESCAPE '\\' THEN 'content_' || substr(md5(url), 1, 8) ELSE s END || '_' || substr(md5(url), 1, 8) || '.html' AS file
FROM (SELECT page_id, url, regexp_replace(substr(list_last(string_split(url, '/')), 1, 50), '[^\\p{L}\\p{N}_\\-]', '_', 'g') AS s FROM pages)""")
def url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of URLs (SU8)."""
    return table(spark, sf_dir, "pages").select("page_id", src.url_file_name(F.col("url"), "html").alias("file"))


@query("""WITH h AS (SELECT page_id, url, substr(sha256(html), 1, 16) AS hash FROM pages)
SELECT page_id, hash, row_number() OVER (PARTITION BY hash ORDER BY length(url), url, page_id) = 1 AS canonical, CAST(count(*) OVER (PARTITION BY hash) AS BIGINT) AS copies FROM h""")
def alias_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of equal content; the shortest URL stands for them (AG34, SC3, PF3)."""
    p = table(spark, sf_dir, "pages")
    found = dedup.canonical(p.select("page_id", "url", "html"), tx.content_hash(F.col("html")), [F.length("url"), F.col("url"), F.col("page_id")])
    return found.select("page_id", F.col("key").alias("hash"), "canonical", "copies")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT sha256(html)) AS BIGINT) AS keys, CAST(count(*) - count(DISTINCT sha256(html)) AS BIGINT) AS duplicates FROM pages")
def l0_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download audit: rows, contents and duplicates (AG18)."""
    return dedup.duplicate_counts(table(spark, sf_dir, "pages"), F.sha2("html", 256))


#: SQL: the pages' figures, as x(page_id, html, visible, markdown, nav_links, headings, list_items,
#: questions, blocks). It holds for pages as the tables have them: lists and links in the navigation
#: alone, one article with a heading and paragraphs, of which some are never closed and so hold those
#: behind them. A paragraph ends where the depth of open paragraphs falls below its own.
PAGES = r"""raw AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '<style>.*?</style>|<script>.*?</script>|<nav>.*?</nav>|<!--.*?-->|<footer>.*$', '', 'gs') AS body FROM pages),
tok AS (SELECT page_id, i, t[i] AS t FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(body, '<[^>]*>|[^<]+') AS t FROM raw))),
txt AS MATERIALIZED (SELECT page_id, i, trim(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), E' \n\t\r') AS x FROM tok WHERE t NOT LIKE '<%'),
vis AS (SELECT page_id, string_agg(x, chr(10) ORDER BY i) AS visible, count(*) FILTER (WHERE x LIKE '%?') AS questions FROM txt WHERE x <> '' GROUP BY page_id),
art AS (SELECT page_id, min(i) AS a FROM tok WHERE t = '<article>' GROUP BY page_id),
dep AS MATERIALIZED (SELECT page_id, i, t, sum(CASE t WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM tok JOIN art USING (page_id) WHERE i > a),
par AS (SELECT o.page_id, o.i, min(c.i) AS z FROM dep o LEFT JOIN dep c ON c.page_id = o.page_id AND c.i > o.i AND c.d < o.d WHERE o.t = '<p>' GROUP BY ALL
  UNION ALL SELECT o.page_id, -1, min(c.i) FROM dep o JOIN dep c ON c.page_id = o.page_id AND c.i > o.i AND c.t = '</h1>' WHERE o.t = '<h1>' GROUP BY ALL),
hd AS (SELECT page_id, i FROM dep WHERE t = '<h1>'),
blk AS MATERIALIZED (SELECT par.page_id, par.i, string_agg(x, ' ' ORDER BY txt.i) AS t FROM par LEFT JOIN hd ON hd.page_id = par.page_id JOIN txt ON txt.page_id = par.page_id AND txt.i > CASE WHEN par.i = -1 THEN hd.i ELSE par.i END AND txt.i < coalesce(z, 1000000000) WHERE x <> '' GROUP BY ALL),
md AS (SELECT page_id, string_agg(CASE WHEN i = -1 THEN '# ' ELSE '' END || t, chr(10) || chr(10) ORDER BY i) AS markdown, count(*) AS blocks, count(*) FILTER (WHERE i = -1) AS headings FROM blk GROUP BY page_id),
x AS (SELECT raw.page_id, html, coalesce(visible, '') AS visible, coalesce(markdown, '') AS markdown, len(regexp_extract_all(html, '<a ')) AS nav_links, coalesce(headings, 0) AS headings, coalesce(questions, 0) AS questions, coalesce(blocks, 0) AS blocks,
  CASE WHEN coalesce(questions, 0) >= 2 THEN 'faq' WHEN len(regexp_extract_all(html, '<a ')) >= 15 AND length(coalesce(visible, '')) < 5000 THEN 'navigation-heavy' ELSE 'article' END AS page_type FROM raw LEFT JOIN vis USING (page_id) LEFT JOIN md USING (page_id))"""
#: SQL: occurrences of furniture words in a text by its characters.
FURNITURE = "((" + " + ".join(f"(length(lower({{c}})) - length(replace(lower({{c}}), '{t}', ''))) // {len(t)}" for t in tx.PAGE_TERMS) + ")::DOUBLE / greatest(1, length({c})))"


@query(f"""WITH {PAGES} SELECT page_id, page_type, nav_links::INTEGER AS nav_links, headings::INTEGER AS headings, 0::INTEGER AS list_items, questions::INTEGER AS questions, blocks::INTEGER AS blocks, length(markdown)::INTEGER AS markdown_chars,
trim(markdown) = '' OR page_type = 'navigation-heavy' OR length(trim(regexp_replace(markdown, '\\s+', ' ', 'g')))::DOUBLE / greatest(1, length(html)) < 0.02 OR {FURNITURE.format(c="markdown")} > 0.02 OR (headings = 0 AND length(markdown) > 250) AS fallback FROM x""")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, page type and fallback decision of every page (TV10-TV13, PF13)."""
    p = table(spark, sf_dir, "pages")
    x = html.extract(p).join(p.select("page_id", "html"), "page_id")
    kind = html.page_type(F.col("questions"), F.col("nav_links"), F.length("visible"), F.col("list_items"), F.col("headings"))
    return x.withColumn("page_type", kind).select("page_id", "page_type", "nav_links", "headings", "list_items", "questions", F.size("blocks").alias("blocks"), F.length("markdown").alias("markdown_chars"), html.needs_fallback(F.col("markdown"), F.col("page_type"), F.col("html")).alias("fallback"))


@query(f"""WITH {PAGES} SELECT page_type, count(*) AS pages, round(avg(length(markdown)::DOUBLE / greatest(1, length(visible))), 6) AS retention, round(avg(length(visible)::DOUBLE / greatest(1, length(html))), 6) AS density, round(avg({FURNITURE.format(c="markdown")}), 6) AS boilerplate FROM x GROUP BY page_type""")
def html_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page audit by type: retention, density and furniture (AG19)."""
    x = html.extract(table(spark, sf_dir, "pages"))
    kind = html.page_type(F.col("questions"), F.col("nav_links"), F.length("visible"), F.col("list_items"), F.col("headings"))
    return x.groupBy(kind.alias("page_type")).agg(F.count("*").alias("pages"), F.round(F.avg(F.length("markdown") / F.greatest(F.lit(1), F.length("visible"))), 6).alias("retention"), F.round(F.avg(F.length("visible") / F.greatest(F.lit(1), F.col("html_chars"))), 6).alias("density"), F.round(F.avg(tx.boilerplate_ratio(F.col("markdown"))), 6).alias("boilerplate"))


#: SQL: the chunks of every document, as c(doc_id, source, k, a, z, content): a window of 1024
#: characters ends after the last blank line, line end, sentence or lesser mark beyond 256; the next
#: begins 128 before that. The tables' texts have no Markdown headings, so sections do not matter.
CHUNKS = r"""d AS (SELECT doc_id, {named} AS source, text, length(text) AS n FROM documents WHERE text <> ''),
w AS (SELECT doc_id, 0::BIGINT AS start, -1::BIGINT AS stop, 0 AS step FROM d
  UNION ALL
  SELECT doc_id, start, CASE WHEN start + 1024 >= n THEN n
      WHEN contains(f, chr(10) || chr(10)) THEN start + 256 + length(f) - instr(reverse(f), chr(10) || chr(10)) + 1
      WHEN contains(f, chr(10)) THEN start + 256 + length(f) - instr(reverse(f), chr(10)) + 1
      WHEN regexp_matches(g, '[.!?]\s') THEN start + 254 + length(g) - length(regexp_extract(reverse(g), '(?s)^(.*?)\s[.!?]', 1))
      WHEN contains(f, '; ') THEN start + 256 + length(f) - instr(reverse(f), ' ;') + 1
      WHEN contains(f, ', ') THEN start + 256 + length(f) - instr(reverse(f), ' ,') + 1
      WHEN contains(f, ' ') THEN start + 256 + length(f) - instr(reverse(f), ' ') + 1
      ELSE start + 1024 END AS stop, step + 1 AS step
  FROM (SELECT w.doc_id, n, step, x.start, substr(text, x.start + 257, 768) AS f, substr(text, x.start + 255, 770) AS g
    FROM w JOIN d USING (doc_id), LATERAL (SELECT CASE WHEN step = 0 THEN 0 ELSE greatest(stop - 128, w.start + 1) END AS start) AS x WHERE stop < n)),
p AS (SELECT w.doc_id, source, start, substr(text, start + 1, stop - start) AS piece FROM w JOIN d USING (doc_id) WHERE step > 0),
q AS (SELECT doc_id, source, start + length(piece) - length(ltrim(piece, E' \n\t\r')) AS a, trim(piece, E' \n\t\r') AS content FROM p),
c AS (SELECT doc_id, source, a, a + length(content) AS z, content, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS k FROM q WHERE content <> '')""".replace("{named}", NAMED)
ID = "doc_id || '_p1_chunk_' || k"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.chunk_texts(docs(spark, sf_dir).select("doc_id", file_name().alias("source"), "text"))


@query(f"""WITH RECURSIVE {CHUNKS}
SELECT doc_id, {ID} AS id, CAST(k AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start_char, CAST(z AS INTEGER) AS end_char, CAST(length(content) AS INTEGER) AS char_count,
CAST(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS INTEGER) AS token_count, substr(sha256(content), 1, 16) AS hash FROM c""")
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document with their places (TV1-TV4, TV9)."""
    return chunks(spark, sf_dir).select("doc_id", "id", "chunk_index", "start_char", "end_char", "char_count", "token_count", tx.content_hash(F.col("content")).alias("hash"))


@query(f"""WITH RECURSIVE {CHUNKS}, u AS (SELECT *, {ID} AS id FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, sha256(lower(content)) ORDER BY k) = 1)
SELECT doc_id, id, CAST(k AS INTEGER) AS chunk_index, lag(id) OVER o AS previous_chunk_id, lead(id) OVER o AS next_chunk_id, CAST(row_number() OVER o - 1 AS INTEGER) AS section_sibling_rank,
CASE WHEN source LIKE '%.pdf' THEN 'pdf' WHEN source LIKE '%.md' THEN 'markdown' ELSE 'default' END AS source_type FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY k)""")
def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the quality filter keeps, with neighbours (PF1, WN5)."""
    kept = ch.link_chunks(ch.filter_chunks(chunks(spark, sf_dir)))
    return kept.select("doc_id", "id", "chunk_index", "previous_chunk_id", "next_chunk_id", "section_sibling_rank", "source_type")


#: SQL: the same of the paragraphs of every page, as documents of their own numbers.
BLOCK_CHUNKS = CHUNKS.replace(CHUNKS[: CHUNKS.index("\n")], "bl AS MATERIALIZED (SELECT page_id, i, t, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS b FROM blk),\nd AS (SELECT page_id * 100000 + b AS doc_id, 'page.html' AS source, t AS text, length(t) AS n FROM bl WHERE i <> -1),")
BLOCK_HITS = " + ".join(f"(length(lower(t)) - length(replace(lower(t), '{w}', ''))) // {len(w)}" for w in tx.BLOCK_TERMS)


@query(f"""WITH RECURSIVE {PAGES}, {BLOCK_CHUNKS}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY b, a) - 1 AS INTEGER) AS chunk_index, 'paragraph' AS content_type, 'block_' || b AS parent_block_id, CAST(length(content) AS INTEGER) AS char_count,
greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - CASE WHEN length(t) < 100 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END - least(0.4::DOUBLE, ({BLOCK_HITS}) * 0.08::DOUBLE))) AS quality_score
FROM c JOIN bl ON c.doc_id = page_id * 100000 + b""")
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the pages' structured blocks (TV5-TV8)."""
    x = html.extract(table(spark, sf_dir, "pages"))
    b = F.transform("blocks", lambda b: F.struct(b["id"].alias("id"), b["block_type"].alias("block_type"), b["text"].alias("text"), b["section_path"].alias("section_path"), F.lit(1).alias("page"), tx.block_quality(b["text"], F.lit("high"), 100).alias("quality")))
    made = ch.chunk_blocks(x.select(F.col("page_id").alias("doc_id"), F.lit("page.html").alias("source"), b.alias("blocks")))
    return made.select(F.col("doc_id").alias("page_id"), "chunk_index", "content_type", "parent_block_id", "char_count", "quality_score")


@query(f"""WITH RECURSIVE {CHUNKS}, n AS (SELECT doc_id, {ID} AS id, content, lag(content) OVER (PARTITION BY doc_id ORDER BY k) AS b, lead(content) OVER (PARTITION BY doc_id ORDER BY k) AS f FROM c),
x AS (SELECT doc_id, id, substr(concat_ws(chr(10) || chr(10), substr(content, 1, 900), substr(b, 1, 900), substr(f, 1, 900)), 1, 3000) AS t FROM n)
SELECT doc_id, id, CAST(length(t) AS INTEGER) AS chars, substr(sha256(t), 1, 16) AS hash FROM x""")
def seed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their neighbours' text."""
    return ch.seed_contexts(chunks(spark, sf_dir)).select("doc_id", "id", F.length("context").alias("chars"), tx.content_hash(F.col("context")).alias("hash"))


@query(f"""WITH RECURSIVE {CHUNKS}
SELECT CASE WHEN source LIKE '%.pdf' THEN 'pdf' WHEN source LIKE '%.md' THEN 'markdown' ELSE 'default' END AS kind, CAST(count(*) AS BIGINT) AS chunks, round(avg(length(content)), 6) AS mean_chars, quantile_cont(length(content), 0.5)::DOUBLE AS median_chars,
round(1 - count(DISTINCT lower(content))::DOUBLE / count(*), 6) AS duplicate_rate, round(avg(CASE WHEN regexp_matches(content, '[.!?:]$') THEN 0.0 ELSE 1.0 END), 6) AS cut_rate FROM c GROUP BY 1""")
def l3_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk audit by source kind: lengths, duplicates and cut sentences (AG21)."""
    c = chunks(spark, sf_dir).withColumn("kind", tx.source_kind(F.col("source")))
    return c.groupBy("kind").agg(F.count("*").alias("chunks"), F.round(F.avg("char_count"), 6).alias("mean_chars"), F.percentile("char_count", 0.5).alias("median_chars"), F.round(1 - F.count_distinct(F.xxhash64(F.lower("content"))) / F.count("*"), 6).alias("duplicate_rate"), F.round(F.avg((~F.col("content").rlike(r"[.!?:]$")).cast("int")), 6).alias("cut_rate"))


@query("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT vec_id) AS BIGINT) AS ids, CAST(count(DISTINCT len(embedding)) AS BIGINT) AS dimensions, CAST(min(len(embedding)) AS INTEGER) AS dimension, CAST(sum(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM embeddings""")
def l5_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index audit: rows, ids and dimensions (AG23)."""
    n = F.size("embedding")
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("rows"), F.count_distinct("vec_id").alias("ids"), F.count_distinct(n).alias("dimensions"), F.min(n).alias("dimension"), F.count_if(F.col("embedding").isNull()).alias("missing"))


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS source, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source (AG24)."""
    return docs(spark, sf_dir).groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, source, substr(text, 1, 200) AS preview, CAST(length(text) AS BIGINT) AS chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def doc_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the listing (TK5, PF19)."""
    return docs(spark, sf_dir).orderBy("doc_id").offset(20).limit(50).select("doc_id", "source", F.substring("text", 1, 200).alias("preview"), F.length("text").cast("long").alias("chars"))


CLASS = "CASE " + "WHEN regexp_matches(t, '(?i)(?:" + "|".join(qs.PATTERNS["reference_range"]) + ")') AND regexp_matches(t, '(?i)(?:" + "|".join(qs.PATTERNS["comparison"]) + ")') THEN 'complex' " + " ".join(f"WHEN regexp_matches(t, '(?i)(?:{'|'.join(p)})') THEN '{k}'" for k, p in qs.PATTERNS.items()) + " ELSE 'definition' END"


@query(f"SELECT conv_id, turn, {CLASS} AS query_type FROM (SELECT conv_id, turn, text AS t FROM conversations WHERE role = 'user')")
def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of what users ask (SF33, SF34)."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", qs.classify(F.col("text"))["query_type"].alias("query_type"))


ROUTES = ", ".join(f"('{r[0]}', {r[1]}, {r[3]}, {r[4]}::DOUBLE)" for r in qs.ROUTES)


@query(f"SELECT conv_id, turn, query_type, coalesce(o, 4) AS overfetch, coalesce(s, 3) AS per_source, coalesce(l, 0.75) AS mmr_lambda FROM (SELECT conv_id, turn, {CLASS} AS query_type FROM (SELECT conv_id, turn, text AS t FROM conversations WHERE role = 'user')) LEFT JOIN (VALUES {ROUTES}) AS r(k, o, s, l) ON query_type = k")
def route_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question is retrieved with."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", qs.classify(F.col("text"))["query_type"].alias("query_type"))
    return qs.route(asked).select("conv_id", "turn", "query_type", "overfetch", "per_source", "mmr_lambda")


@query(f"""WITH {ALL_DOCS}, {BM25}, t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)
SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank FROM t JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 2""")
def source_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten results an item, two a source at most (WN6)."""
    ten = best_documents(spark, sf_dir, 10)
    return capped(ten.join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id"), "source", 2).select("query_id", "doc_id", "rank")


@query(f"""WITH RECURSIVE {ALL_DOCS}, {BM25},
t AS (SELECT query_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 20),
u AS (SELECT t.*, d.source, trim(d.text, E' \\n\\t\\r') AS txt, list_distinct(k.t) AS tk FROM t JOIN documents d USING (doc_id) JOIN toks k USING (doc_id)),
j AS (SELECT a.query_id, a.rank AS i, list(CASE WHEN len(a.tk) = 0 OR len(b.tk) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.tk, b.tk))::DOUBLE / len(list_distinct(list_concat(a.tk, b.tk))) END ORDER BY b.rank) AS r FROM u a JOIN u b ON a.query_id = b.query_id GROUP BY a.query_id, a.rank),
m AS MATERIALIZED (SELECT query_id, list(r ORDER BY i) AS m FROM j GROUP BY query_id),
b AS MATERIALIZED (SELECT query_id, list(score ORDER BY rank) AS s, max(score) AS best, list(doc_id ORDER BY rank) AS ids, list(source ORDER BY rank) AS src, list(txt ORDER BY rank) AS txt, m FROM u JOIN m USING (query_id) GROUP BY query_id, m),
o AS (SELECT query_id, []::BIGINT[] AS chosen FROM b
  UNION ALL SELECT query_id, list_append(chosen, list_position(v, list_max(v))) FROM (
    SELECT o.query_id, chosen, list_transform(range(1, len(s) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN NULL ELSE 0.75::DOUBLE * s[i] / best - 0.25::DOUBLE * greatest(0.0::DOUBLE, coalesce(list_max(list_transform(chosen, lambda c: m[c][i])), 0.0::DOUBLE)) END) AS v
    FROM o JOIN b USING (query_id) WHERE len(chosen) < len(s))),
pool AS MATERIALIZED (SELECT query_id, chosen FROM o JOIN b USING (query_id) WHERE len(chosen) = len(s)),
f AS (SELECT query_id, 1 AS step, []::BIGINT[] AS taken, []::VARCHAR[] AS srcs, []::VARCHAR[] AS texts FROM pool
  UNION ALL SELECT query_id, step + 1, CASE WHEN ok THEN list_append(taken, p) ELSE taken END, CASE WHEN ok THEN list_append(srcs, source) ELSE srcs END, CASE WHEN ok THEN list_append(texts, text) ELSE texts END FROM (
    SELECT f.*, n, p, b.src[p] AS source, b.txt[p] AS text, len(taken) < 5 AND CASE WHEN step <= n THEN (b.txt[p] = '' OR NOT list_contains(texts, b.txt[p])) AND len(list_filter(srcs, lambda x: x = b.src[p])) < 2 ELSE NOT list_contains(taken, p) AND len(list_filter(srcs, lambda x: x = b.src[p])) < 3 END AS ok
    FROM f JOIN b USING (query_id) JOIN (SELECT query_id, chosen, len(chosen) AS n FROM pool) USING (query_id), LATERAL (SELECT chosen[(step - 1) % n + 1] AS p) WHERE step <= 2 * n))
SELECT query_id, ids[taken[place]] AS doc_id, CAST(place AS BIGINT) AS place FROM (SELECT query_id, taken, ids, unnest(range(1, len(taken) + 1)) AS place FROM f JOIN b USING (query_id) WHERE step = 2 * len(s) + 1)""")
def mmr_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of twenty results an item by marginal relevance and quotas (TK1, TK3, TK4)."""
    top = best_documents(spark, sf_dir, 20)
    d = docs(spark, sf_dir).select("doc_id", F.col("text").alias("content"), "source", F.lit(1).alias("page"), F.array_distinct(tx.plain_tokens(F.col("text"))).alias("tokens"))
    return diversify(top.join(d, "doc_id"), 5, overfetch=4)


HASH = "(CAST(CAST('0x' || substr(md5('{seed}:' || CAST({k} AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE"


@query(f"SELECT doc_id FROM (SELECT doc_id, -ln({HASH.format(seed=7, k='doc_id')}) / greatest(0.01, quality * quality) AS w FROM labels) ORDER BY w, doc_id LIMIT 50")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents by squared quality, without replacement (TK6, TK7)."""
    return sampling.weighted_sample(table(spark, sf_dir, "labels"), F.col("doc_id"), F.col("quality") * F.col("quality"), 50, 7).select("doc_id")


@query(f"SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY {HASH.format(seed=3, k='doc_id')}, doc_id) AS BIGINT) AS place FROM documents QUALIFY place <= 10")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each language (TK8)."""
    return sampling.stratified_sample(docs(spark, sf_dir), [F.col("lang")], F.col("doc_id"), 10, 3).select("lang", "doc_id", F.col("place").cast("long").alias("place"))


@query(f"SELECT item_id FROM (SELECT item_id FROM benchmark ORDER BY {HASH.format(seed=5, k='item_id')}, item_id LIMIT 15)")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen benchmark items (TK9)."""
    return sampling.simple_sample(table(spark, sf_dir, "benchmark"), F.col("item_id"), 15, 5).select("item_id")


@query(f"""WITH q AS (SELECT DISTINCT item_id, unnest({TOKENS.format(c="text")}) AS token FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({TOKENS.format(c="text")}) AS token FROM documents),
o AS (SELECT item_id, doc_id, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY ALL)
SELECT item_id, doc_id, CAST(overlap AS BIGINT) AS overlap FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) = 1""")
def label_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that shares most tokens with each item (J12), by a scan where an id is one row."""
    tokens = lambda t, i: t.select(i, F.explode(F.array_distinct(tx.plain_tokens(F.col("text")))).alias("token"))
    q, rows = tokens(table(spark, sf_dir, "benchmark"), "item_id"), docs(spark, sf_dir).select("doc_id", "text")
    if one_row_an_id(rows):
        best = overlap_top(rows, q.withColumnRenamed("item_id", "query_id"), 1, tx.plain_tokens)
        return best.select(F.col("query_id").alias("item_id"), "doc_id", F.col("score").cast("long").alias("overlap"))
    d = tokens(rows, "doc_id")
    o = q.join(d, "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"))
    w = Window.partitionBy("item_id").orderBy(F.col("overlap").desc(), "doc_id")
    return o.withColumn("n", F.row_number().over(w)).where("n = 1").select("item_id", "doc_id", "overlap")


@query("""WITH b AS (SELECT b.item_id, b.text, n.text AS evidence FROM benchmark b LEFT JOIN benchmark n ON n.item_id = b.item_id + 1),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(coalesce(evidence, text)), '[a-z0-9]+')) AS e FROM b)
SELECT item_id, CASE WHEN contains(lower(text), '.pdf') OR contains(lower(text), '.md') OR contains(lower(text), 'src1') THEN 'leak' WHEN len(q) > 0 AND len(e) > 0 AND len(list_intersect(q, e))::DOUBLE / len(q) > 0.8 THEN 'copied' ELSE 'accepted' END AS reason FROM t""")
def synthetic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a made-up question would be turned down, held against the next item (the last against itself)
    (PF7-PF9)."""
    t, b = F.col("text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    b = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("evidence")), "item_id", "left")
    why = F.when(tx.leaks_source(t, F.lit("src1.pdf")), "leak").when(tx.looks_copied(t, F.coalesce("evidence", t)), "copied").otherwise("accepted")
    return b.select("item_id", why.alias("reason"))

"""Search queries over documents, benchmark items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sources import source_class, source_prior
from ..functions.vectors import cosine
from ..operators.blocks import BlockIndex, asked_tokens, search, write_blocks
from ..operators.bonus import keyword_scores
from ..operators.fusion import Step, fused_rows, fused_top, lexical_rows, steps_of
from ..operators.scan import bm25_top, coded, one_row_an_id
from ..operators.search import exact_knn, merge_variants, normalized_by_best, rerank, top_k
from ..sources.shared import kept, written
from .base import query, table

STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOPWORDS) + "]"
#: SQL: the plain analyzer of column {c}.
TOKENS = (
    "list_transform(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+(?:-+[\\p{{L}}\\p{{N}}_]+)*'), lambda x: NOT list_contains(" + STOP + ", x) AND NOT regexp_matches(replace(x, '-', ''), '[^\\p{{L}}]')), "
    "lambda x: CASE x WHEN 'ldl-c' THEN 'ldlc' WHEN 'ldl' THEN 'ldlc' WHEN 'cholesterol' THEN 'lipid' WHEN 'familial-hypercholesterolemia' THEN 'fh' WHEN 'atherosclerotic' THEN 'ascvd' ELSE x END)"
)
#: SQL: the same words before synonyms.
RAW_WORDS = "list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+(?:-+[\\p{{L}}\\p{{N}}_]+)*'), lambda x: NOT list_contains(" + STOP + ", x) AND NOT regexp_matches(replace(x, '-', ''), '[^\\p{{L}}]'))"
#: SQL: BM25 of every benchmark item over documents d(doc_id, text), as s(query_id, doc_id, bm25).
BM25 = f"""
toks AS MATERIALIZED (SELECT doc_id, {TOKENS.format(c="text")} AS t FROM docs),
stats AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks),
post AS MATERIALIZED (SELECT doc_id, token, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM toks) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
q AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, token FROM (SELECT item_id, unnest({TOKENS.format(c="text")}) AS token FROM benchmark)),
s AS MATERIALIZED (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * (len / a)))) AS bm25
      FROM q JOIN post USING (token) JOIN df USING (token), stats GROUP BY query_id, doc_id)"""
ALL_DOCS = "docs AS (SELECT doc_id, text FROM documents)"
#: SQL: a document's file name and its class, as the reference's file names decide them.
NAMED = "source || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' ELSE '.csv' END"
PRIOR = "CASE doc_id % 3 WHEN 0 THEN 0.15::DOUBLE WHEN 1 THEN 0.10::DOUBLE ELSE 0.12::DOUBLE END"


def file_name(source="source", doc_id="doc_id"):
    kind = F.col(doc_id) % 3
    return F.concat(F.col(source), F.when(kind == 0, ".pdf").when(kind == 1, ".md").otherwise(".csv"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index_of(docs: DataFrame, name: str, analyzer=tx.plain_tokens) -> BlockIndex:
    """The written index of these documents; a session writes it once for a table's files."""
    spark = docs.sparkSession
    return BlockIndex.read(spark, kept(spark, f"index-{name}", docs, lambda path: write_blocks(docs, path, analyzer=analyzer)))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def best_documents(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of every item."""
    return best_of(corpus(spark, sf_dir), "plain", items(spark, sf_dir), k)


def best_of(docs: DataFrame, name: str, queries: DataFrame, k: int, analyzer=tx.plain_tokens) -> DataFrame:
    """The ``k`` best of these documents for every query, from scans of the documents where an id is one
    row. Ids that are repeated are one document each: those are added up by the written index."""
    asked = asked_tokens(queries, analyzer=analyzer)
    if one_row_an_id(docs):
        return bm25_top(docs, asked, k, analyzer)
    return search(index_of(docs, name, analyzer), asked, k)[0]


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, bm25) of every document that shares a token with an item."""
    return index_of(corpus(spark, sf_dir), "plain").scores(asked_tokens(items(spark, sf_dir)))


@query(f"WITH {ALL_DOCS}, {BM25} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS BIGINT) AS rank, round(bm25, 6) AS score FROM s QUALIFY rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark item (SF2, AG1, AG2, J1, TK1)."""
    return best_documents(spark, sf_dir, 5)


@query(f"WITH docs AS (SELECT doc_id, text FROM documents WHERE lang = 'en'), {BM25} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS BIGINT) AS rank, round(bm25, 6) AS score FROM s QUALIFY rank <= 5")
def filtered_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the English documents alone: frequencies are those of the subset (PF5, J1)."""
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")
    return best_of(english, "english", items(spark, sf_dir), 5)


@query(f"""WITH {ALL_DOCS}, {BM25},
kw AS (SELECT DISTINCT doc_id, lower(trim(k)) AS kw FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS k FROM documents)),
m AS (SELECT query_id, doc_id, count(*) AS n FROM q JOIN kw ON q.token = kw.kw GROUP BY ALL)
SELECT query_id, doc_id, round(bm25, 6) AS bm25, round(bm25 * 0.5 * coalesce(n, 0), 6) AS bonus FROM s LEFT JOIN m USING (query_id, doc_id)""")
def keyword_bonus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base scores and what extracted keywords (here: all words of a text) add."""
    return keyword_scores(corpus(spark, sf_dir), items(spark, sf_dir))


@query("""SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS BIGINT) AS rank, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)) QUALIFY rank <= 5""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to each benchmark item's vector, over all of them (SU10, J4)."""
    vecs = table(spark, sf_dir, "embeddings")
    q = vecs.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return exact_knn(vecs, q, 5, digits=6).select("query_id", "vec_id", "rank", "score")


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE doc_id % 3 WHEN 0 THEN 'guideline_pdf' WHEN 1 THEN 'guideline_html' ELSE 'reference_csv' END AS source_class, {PRIOR} AS prior FROM documents")
def source_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's source class and prior (SU7, SU9)."""
    cls = source_class(file_name())
    return table(spark, sf_dir, "documents").select("doc_id", cls.alias("source_class"), source_prior(cls).alias("prior"))


HYBRID = f"""{ALL_DOCS}, {BM25},
kn AS (SELECT query_id, doc_id, bm25 / max(bm25) OVER (PARTITION BY query_id) AS k FROM s),
lex AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(round(k, 10), 0.0) AS k, {PRIOR.replace("doc_id", "d.doc_id")} AS prior FROM benchmark b CROSS JOIN (SELECT d.doc_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id) d LEFT JOIN kn ON kn.query_id = b.item_id AND kn.doc_id = d.doc_id),
sem AS (SELECT b.item_id AS query_id, d.doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 10) AS c
        FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN documents d JOIN embeddings e ON e.vec_id = d.doc_id),
r AS (SELECT query_id, doc_id, k, c, prior, row_number() OVER (PARTITION BY query_id ORDER BY round(c + prior, 10) DESC, doc_id) AS sr, row_number() OVER (PARTITION BY query_id ORDER BY round(k + prior, 10) DESC, doc_id) AS kr FROM lex JOIN sem USING (query_id, doc_id)),
f AS (SELECT *, round(1.0::DOUBLE / (60 + sr) + 1.0::DOUBLE / (60 + kr), 10) AS fused FROM r),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, c DESC, k DESC, sr, doc_id) AS BIGINT) AS fused_rank FROM f)"""


def priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, prior, embedding) of the documents that have a vector."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").where(F.col("embedding").isNotNull())
    return table(spark, sf_dir, "documents").select("doc_id", source_prior(source_class(file_name())).alias("prior")).join(vecs, "doc_id")


def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, k): BM25 by the query's best, to ten places."""
    return normalized_by_best(all_scores(spark, sf_dir)).select("query_id", "doc_id", F.round("keyword_score", 10).alias("k"))


def scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Step]] | None:
    """The documents with priors, vectors and tokens, and the items in blocks, for scans of the former;
    none unless an id is one row of each table."""
    d, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = items(spark, sf_dir).select("query_id", F.array_distinct(tx.plain_tokens(F.col("query"))).alias("tokens"))
    if not (one_row_an_id(d) and one_row_an_id(vecs) and one_row_an_id(q, "query_id")):
        return None
    # both kinds of ids meet in one shuffle of the asked tokens' numbers; the text is analysed once
    rows = d.select(F.col("doc_id").cast("long").alias("doc_id"), source_prior(source_class(file_name())).alias("prior"), tx.plain_tokens(F.col("text")).alias("tokens"))
    rows, asked = coded(rows, written(q.select("query_id", F.explode("tokens").alias("token")), "asked"))
    rows = written(rows.join(vecs, "doc_id", "left").select("doc_id", "prior", "embedding", "doc_len", "tokens"), "hybrid-rows")
    vectors = vecs.where(F.col("embedding").isNotNull()).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    numbers = q.select("query_id").join(asked.groupBy("query_id").agg(F.collect_set("token").alias("tokens")), "query_id", "left")
    coded_q = numbers.select("query_id", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))
    return rows, steps_of(rows, written(coded_q.join(vectors, "query_id"), "asked-items"))


def hybrid(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The ``k`` best documents of every item by fused rank; both rankings are of the whole corpus. From a
    table of all lexical scores, where ids are repeated."""
    base = written(priors(spark, sf_dir), "priors")
    lex = written(lexical_scores(spark, sf_dir).join(base.select("doc_id", "prior"), "doc_id"), "lexical")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    vectors = q.join(base.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    return fused_top(base, lex, vectors, k)


@query(f"WITH {HYBRID} SELECT query_id, doc_id, fused_rank, fused AS fused_score, round(fused + prior, 10) AS combined_score FROM o WHERE fused_rank <= 10")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best by rank fusion of cosine and BM25 over the whole corpus (WN1, J3, WN2)."""
    found = scanned(spark, sf_dir)
    best = fused_rows(*found, 10) if found else hybrid(spark, sf_dir, 10)
    return best.select("query_id", "doc_id", "fused_rank", "fused_score", "combined_score")


@query(f"""WITH {HYBRID},
v AS (SELECT query_id, 1 AS variant, fused_rank AS rank, doc_id, round(fused + prior, 4) AS score FROM o WHERE fused_rank <= 20
      UNION ALL SELECT query_id, 2, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(k, 6) DESC, doc_id) AS BIGINT) AS rank, doc_id, round(k, 6) FROM r QUALIFY rank <= 20),
b AS (SELECT query_id, doc_id, max(score) AS score, min(variant * 1000 + rank) AS seen FROM v GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS BIGINT) AS rank FROM b QUALIFY rank <= 5""")
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants' results as one list, each document by its best score (SO2, TK2, pin 2)."""
    found = scanned(spark, sf_dir)
    fused = fused_rows(*found, 20) if found else hybrid(spark, sf_dir, 20)
    a = fused.select("query_id", F.lit(1).alias("variant"), F.col("fused_rank").alias("rank"), "doc_id", F.round("combined_score", 4).alias("score"))
    b = lexical_rows(*found, 20, 6) if found else lexical_twenty(spark, sf_dir)
    b = b.select("query_id", F.lit(2).alias("variant"), "rank", "doc_id", "score")
    return merge_variants(a.union(b), 5).select("query_id", "doc_id", "score", "rank")


def lexical_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, score, rank): twenty by the lexical score, from a table of all of them."""
    base = priors(spark, sf_dir).select("doc_id")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(base.withColumnRenamed("doc_id", "query_id"), "query_id", "left_semi")
    found = lexical_scores(spark, sf_dir).join(base, "doc_id", "left_semi").join(q, "query_id", "left_semi").withColumn("score", F.round("k", 6))
    # where fewer than 20 documents share a word, those of the smallest ids follow with score 0: they
    # are among the first 40, of which fewer than 20 can share one
    least = base.orderBy("doc_id").limit(40).groupBy().agg(F.collect_list("doc_id").alias("ids"))
    rest = q.join(F.broadcast(least)).select("query_id", F.explode("ids").alias("doc_id")).join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top_k(found.select("query_id", "doc_id", "score").unionByName(rest.withColumn("score", F.lit(0.0))), 20, [F.col("score").desc(), F.col("doc_id")])


@query(f"""WITH {ALL_DOCS}, {BM25},
t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS r FROM s QUALIFY r <= 10),
j AS (SELECT query_id, doc_id, list_distinct({TOKENS.format(c="b.text")}) AS a, list_distinct({TOKENS.format(c="d.text")}) AS z FROM t JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id)),
x AS (SELECT query_id, doc_id, CASE WHEN len(a) = 0 OR len(z) = 0 THEN 0.0 ELSE len(list_intersect(a, z))::DOUBLE / len(list_distinct(list_concat(a, z))) END AS jac FROM j)
SELECT query_id, doc_id, round(jac, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(jac, 6) DESC, doc_id) AS BIGINT) AS rerank_rank FROM x WHERE round(jac, 6) >= 0.02 QUALIFY rerank_rank <= 5""")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten candidates an item, reranked by token overlap with a least score (SO4, UD4, PF6, WN4)."""
    q = items(spark, sf_dir)
    ten = best_documents(spark, sf_dir, 10)
    both = ten.join(q, "query_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rerank(both, F.round(tx.jaccard(tx.plain_tokens(F.col("query")), tx.plain_tokens(F.col("text"))), 6), 5, 0.02).select("query_id", "doc_id", "rerank_score", "rerank_rank")


@query(f"""WITH h AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS question FROM documents),
t AS (SELECT doc_id, question, list_distinct({TOKENS.format(c="question")}) AS qt FROM h WHERE length(question) > 10),
b AS (SELECT item_id, list_distinct({TOKENS.format(c="text")}) AS bt FROM benchmark),
x AS (SELECT item_id AS query_id, doc_id, question, len(list_intersect(qt, bt)) AS o, len(qt) AS nq, len(bt) AS nb FROM b, t),
s AS (SELECT query_id, doc_id, lower(question) AS question, round(0.7 * o / nb + 0.3 * o / nq + 0.05, 6) AS score FROM x WHERE o > 0),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, question ORDER BY score DESC, doc_id) = 1)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM d QUALIFY rank <= 5""")
def hype_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypothetical questions (here: the lines of a text) by coverage and precision of tokens (TK10)."""
    from ..operators.search import question_search

    asked = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("question"), F.lit(1.0).alias("quality")).where(F.length("question") > 10)
    return question_search(items(spark, sf_dir), asked, 5)


def _first_end(x: str, ends) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, '{e}') THEN '{e}'" for e in ends) + " END"


def _stem_map() -> str:
    """SQL: the stem of every word, as stems(w, token), from words(w): the steps of the stemmer, each as a
    column over the one before. Acronyms do not occur in the tables and are left out."""
    from ..functions import stem as st

    short = "((length({x}) = 2 AND regexp_matches({x}, '^[aeiouy][^aeiouy]$')) OR regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$'))"
    region = "coalesce(nullif(length(regexp_extract({x}, '^.*?[aeiouy][^aeiouy]')), 0), length({x}))"
    swap = lambda x, e, steps: f"CASE {e} " + " ".join(f"WHEN '{a}' THEN left({x}, -{len(a)}) || '{b}'" for a, b in steps) + " END"
    quoted = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
    own = "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in st.EXCEPTIONS.items()) + " END"
    synonym = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tx.SYNONYMS.items()) + " ELSE w END"
    return f"""
m0 AS (SELECT w, s, regexp_replace(regexp_replace(regexp_replace(s, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g'), '([aeiouy])y', '\\1Y', 'g') AS x FROM (SELECT w, {synonym} AS s FROM words)),
m1 AS (SELECT w, s, x, CASE WHEN s LIKE 'gener%' THEN 5 WHEN s LIKE 'commun%' THEN 6 WHEN s LIKE 'arsen%' THEN 5 ELSE {region.format(x="x")} END AS r1 FROM m0),
m2 AS (SELECT w, s, r1, r1 + {region.format(x="substr(x, r1 + 1)")} AS r2, CASE WHEN x LIKE '%sses' THEN left(x, -2) WHEN x LIKE '%ied' OR x LIKE '%ies' THEN CASE WHEN length(x) > 4 THEN left(x, -2) ELSE left(x, -1) END
  WHEN x LIKE '%s' AND NOT (x LIKE '%us' OR x LIKE '%ss') AND regexp_matches(left(x, -2), '[aeiouy]') THEN left(x, -1) ELSE x END AS x FROM m1),
m3 AS (SELECT *, {_first_end("x", ("eedly", "ingly", "edly", "eed", "ing", "ed"))} AS e, x AS after1a FROM m2),
m4 AS (SELECT *, left(x, -length(e)) AS b FROM m3),
m5 AS (SELECT w, s, r1, r2, after1a, CASE WHEN e IS NULL THEN x WHEN e LIKE 'eed%' THEN CASE WHEN length(x) - length(e) >= r1 THEN b || 'ee' ELSE x END WHEN NOT regexp_matches(b, '[aeiouy]') THEN x
  WHEN b LIKE '%at' OR b LIKE '%bl' OR b LIKE '%iz' THEN b || 'e' WHEN length(b) > 1 AND right(b, 1) = substr(b, length(b) - 1, 1) AND contains('bdfgmnprt', right(b, 1)) THEN left(b, -1) WHEN r1 >= length(b) AND {short.format(x="b")} THEN b || 'e' ELSE b END AS x FROM m4),
m6 AS (SELECT w, s, r1, r2, after1a, CASE WHEN length(x) > 2 AND regexp_matches(x, '[^aeiouy][yY]$') THEN left(x, -1) || 'i' ELSE x END AS x FROM m5),
m7 AS (SELECT *, {_first_end("x", [a for a, _ in st.STEP2])} AS e FROM m6),
m8 AS (SELECT w, s, r1, r2, after1a, CASE WHEN e IS NOT NULL AND length(x) - length(e) >= r1 AND NOT (e = 'ogi' AND substr(x, length(x) - 3, 1) <> 'l') AND NOT (e = 'li' AND (length(x) < 3 OR NOT contains('cdeghkmnrt', substr(x, length(x) - 2, 1)))) THEN {swap("x", "e", st.STEP2)} ELSE x END AS x FROM m7),
m9 AS (SELECT *, {_first_end("x", [a for a, _ in st.STEP3])} AS e FROM m8),
m10 AS (SELECT w, s, r1, r2, after1a, CASE WHEN e IS NOT NULL AND length(x) - length(e) >= CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN {swap("x", "e", st.STEP3)} ELSE x END AS x FROM m9),
m11 AS (SELECT *, {_first_end("x", st.STEP4)} AS e FROM m10),
m12 AS (SELECT w, s, r1, r2, after1a, CASE WHEN e IS NOT NULL AND length(x) - length(e) >= r2 AND NOT (e = 'ion' AND substr(x, length(x) - 3, 1) NOT IN ('s', 't')) THEN left(x, -length(e)) ELSE x END AS x FROM m11),
m13 AS (SELECT *, CASE WHEN x LIKE '%e' THEN CASE WHEN length(x) - 1 >= r2 OR (length(x) - 1 >= r1 AND NOT {short.format(x="left(x, -1)")}) THEN left(x, -1) ELSE x END WHEN x LIKE '%ll' AND length(x) - 1 >= r2 THEN left(x, -1) ELSE x END AS y FROM m12),
stems AS MATERIALIZED (SELECT w, CASE WHEN contains(s, '-') OR length(s) <= 2 THEN s WHEN s IN ({quoted(st.EXCEPTIONS)}) THEN {own} WHEN after1a IN ({quoted(st.AFTER_1A)}) THEN replace(after1a, 'Y', 'y') ELSE replace(y, 'Y', 'y') END AS token FROM m13)"""


STEMMED = f"""dw AS MATERIALIZED (SELECT doc_id, {RAW_WORDS.format(c="text")} AS ws FROM documents),
qw AS MATERIALIZED (SELECT item_id, {RAW_WORDS.format(c="text")} AS ws FROM benchmark),
words AS (SELECT DISTINCT w FROM (SELECT unnest(ws) AS w FROM dw UNION ALL SELECT unnest(ws) FROM qw)), {_stem_map()},
stats AS (SELECT count(*) AS n, avg(coalesce(len(ws), 0)) AS a FROM dw),
post AS MATERIALIZED (SELECT doc_id, token, len, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS w FROM dw) JOIN stems USING (w) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
q AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, token FROM (SELECT item_id, unnest(ws) AS w FROM qw) JOIN stems USING (w)),
s AS MATERIALIZED (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * (len / a)))) AS bm25
      FROM q JOIN post USING (token) JOIN df USING (token), stats GROUP BY query_id, doc_id)"""


@query(f"WITH {STEMMED} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS BIGINT) AS rank, round(bm25, 6) AS score FROM s QUALIFY rank <= 5")
def stemmed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents an item with the full analyzer: stems, synonyms, acronyms (SF5)."""
    from ..functions.stem import stemmed_tokens

    return best_of(corpus(spark, sf_dir), "stemmed", items(spark, sf_dir), 5, stemmed_tokens)

"""Thin queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), width=3, radius=2)


QUERIES["op9_simhash_dedup"] = op9_simhash_dedup


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import scan

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES["op6_decontamination"] = op6_decontamination
ORACLES["op6_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


QUERIES["op10_mixing"] = op10_mixing
ORACLES["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         greatest(0.1::DOUBLE, CAST(length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) AS DOUBLE) / greatest(1, length(coalesce(text, '')))) AS quality
  FROM documents),
k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '\N') || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE) / quality AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most <= level * weight AS filled FROM l),
g AS (SELECT min(level) FILTER (NOT filled) AS common FROM (SELECT level, filled, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS r FROM f) WHERE NOT filled AND r = (SELECT min(r) FROM (SELECT filled, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS r FROM f) WHERE NOT filled)),
t AS (SELECT source, source_size, CASE WHEN filled THEN most ELSE (SELECT common FROM g) * weight END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM t),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(epochs + CASE WHEN rest > 0 AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END AS BIGINT) AS times
FROM r
"""


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdshard import assign

    placed = assign(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES["op5_kd_sharding"] = op5_kd_sharding


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import tokenize_to_records

    return tokenize_to_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


QUERIES["op1_token_records"] = op1_token_records


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold_of
    from .langid import predict, train

    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 3)
    model = train(docs.select("doc_id", "text", "lang"), learn=F.coalesce(fold != 1, F.lit(True)))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES["op2_language_id"] = op2_language_id


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import Rule, judge

    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
    return judge(table(spark, sf_dir, "pages"), rules)


QUERIES["op8_url_filter"] = op8_url_filter


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold_of
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of(F.col("doc_id"), 5)
    model = train(docs, table(spark, sf_dir, "labels"), learn=F.coalesce(fold != 0, F.lit(True)))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES["op4_toxicity"] = op4_toxicity


def op3_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES["op3_ann_search"] = op3_ann_search


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all texts; trained on made-up findings, since no table of labelled ones exists."""
    from .secretscan import corpus_statistics, findings_table, made_up_findings, read_findings, scan, train

    docs = table(spark, sf_dir, "documents")
    labelled = read_findings(findings_table(spark, made_up_findings()))
    found = scan(docs, train(labelled, corpus_statistics(docs)))
    return found.withColumn("secret", F.col("score") >= 0.5)


QUERIES["op7_secret_scan"] = op7_secret_scan


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bytebpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES["op12_byte_bpe"] = op12_byte_bpe


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import detect, with_repeats

    found = detect(with_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    top = found.select("*", longest.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"))
    length, period = F.col("top.length"), -F.col("top.period")
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES["op13_periodic_runs"] = op13_periodic_runs


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), longest=4, least=30, top=2000, shadow_pct=80)


QUERIES["op11_collocations"] = op11_collocations
ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT lang, r, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, m FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS lengths(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, m, f AS a FROM f WHERE m >= 2),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
least_cut AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ones AS (
  SELECT lang, array_to_string(w[i : i + b - 1], ' ') AS phrase, a FROM (
    SELECT lang, w, a, b, unnest(range(1, m - b + 2)) AS i FROM c, (VALUES (2), (3)) AS lengths(b) WHERE b < m)),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ones GROUP BY ALL)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM least_cut LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY rank <= 2000
"""

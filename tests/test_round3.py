"""What the third review found, on small tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann
from corpusmill.operators import hashtree, html, scan, semantic
from corpusmill.plans import records
from corpusmill.plans.catalog import ORACLES, QUERIES


def same_as_sql(spark, folder, name, **tables):
    """The query's rows and those of its SQL over these tables, both sorted."""
    duck = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    cur = duck.execute(ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in got.columns]
    return sorted(tuple(r) for r in got.collect()), sorted(tuple(r[i] for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["changed_ranges", "hash_snapshot"])
def test_hash_trees_of_large_tables_have_the_leaves_of_their_sql(spark, tmp_path, monkeypatch, name):
    # 3000 rows and leaves of 4: the tree would take four digits by itself, as beyond 262,144 rows it did
    monkeypatch.setattr(hashtree, "LEAF_ROWS", 4)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert hashtree.leaf_digits(3000) == 4 and hashtree.leaf_digits(3000, records.TREE_DIGITS) == 2
    got, want = same_as_sql(spark, tmp_path, name, documents=docs)
    assert got == want


def test_page_types_keep_references_without_a_semicolon(spark, tmp_path):
    page = "<html><body><nav><a href='/a'>a</a></nav><article><h1>a &amp;&amp; b&amp</h1><p>c &lt d &lt; e & f&amp</p></article></body></html>"
    pages = spark.createDataFrame([(1, page), (2, page.replace("&amp", "&am"))], "page_id long, html string")
    got, want = same_as_sql(spark, tmp_path, "page_types", pages=pages)
    assert got == want


ASKED = ["Doíó osja", "isé it", "Normal\u0085 range", "the normal\r value", "noſmal normal riſk factor", "a\x0bvs\x0bb", "a\tvs\tb", " compare normal values", "compare normal range", "what is\nhdl", "symptomés", "ésymptoms", None, ""]


@pytest.mark.parametrize("name", ["query_classify", "route_params"])
def test_classes_follow_ascii_words(spark, tmp_path, name):
    rows = [(k, 0, "user", t) for k, t in enumerate(ASKED)]
    got, want = same_as_sql(spark, tmp_path, name, conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert got == want


def test_summary_counts_what_is_missing_alone(spark, tmp_path):
    rows = [(k, "a" if k % 2 else "b", v) for k, v in enumerate([1.0, 0.0, None, 0.0, 2.5, 3.0, 0.0, 4.0, 5.0, None, 6.0])] + [(99, "none", None)]
    got, want = same_as_sql(spark, tmp_path, "summary_stats", events=spark.createDataFrame(rows, "event_id long, event_type string, value double"))
    assert got == want


def test_neighbours_are_found_where_codes_tell_little(spark):
    # 61 components make one part of 256 codes: a hundred rows of each block's order hold few of the nearest
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(4000, 61)) @ rng.normal(size=(61, 61))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    q = np.arange(0, 4000, 50)
    sims = u[q] @ u.T
    sims[np.arange(len(q)), q] = -np.inf
    true = np.argsort(-sims, axis=1)[:, :5]
    assert sum(len(got[i] & set(t)) for i, t in zip(q.tolist(), true.tolist(), strict=True)) >= 0.95 * true.size


def test_hype_search_passes_on_no_pairs(spark, tmp_path):
    lines = "what helps against high lipid values\nWhat helps against high lipid values\nrarely asked about statin dosing\nshort"
    docs = spark.createDataFrame([(k, lines if k % 3 else f"statin dosing number {'x' * (k % 5 + 1)}\n{lines}") for k in range(40)] + [(99, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "lipid values and statin dosing"), (2, "nothing here"), (3, "the")], "item_id long, text string")
    got, want = same_as_sql(spark, tmp_path, "hype_search", documents=docs, benchmark=items)
    assert got == want
    plan = QUERIES["hype_search"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("name", ["bm25_topk", "filtered_bm25", "stemmed_bm25", "label_bootstrap"])
@pytest.mark.parametrize("size", [2, 1024])
def test_scans_rank_as_their_sql(spark, tmp_path, monkeypatch, name, size):
    monkeypatch.setattr(scan.best_rows, "__defaults__", (None, False, size))
    words = ["lipid", "statins", "doses", "treated", "trial", "hdl", "liver"]
    rows = [(k, " ".join(words[(k * j) % 7] for j in range(1, 4 + k % 9)), "en" if k % 2 else "de", "s") for k in range(60)] + [(90, None, "en", "s"), (91, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([(k, " ".join(words[k % 7 : k % 7 + 3])) for k in range(5)] + [(7, "the")], "item_id long, text string")
    rounded = lambda rows: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    got, want = same_as_sql(spark, tmp_path, name, documents=docs, benchmark=items)
    assert rounded(got) == rounded(want)
    got_plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in got_plan


def test_pages_are_parsed_in_small_batches(spark, monkeypatch):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>a"), F.col("id").cast("string"), F.lit("</p>")).alias("html")).coalesce(1)
    sizes = html.extract(pages).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in it), "n long")
    assert html.PAGES_AT_ONCE < 300 and sum(r["n"] for r in sizes.collect()) == 300
    assert {r["page_id"]: r["markdown"] for r in html.extract(pages).collect()} == {k: f"a{k}" for k in range(300)}


def test_texts_are_chunked_in_small_batches(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("One. Two "), F.col("id").cast("string"), F.lit(".")).alias("text")).coalesce(1)
    found = semantic.semantic_chunks(docs).groupBy("doc_id").agg(F.sum("sentences").alias("n")).collect()
    assert semantic.TEXTS_AT_ONCE < 300 and {r["doc_id"]: r["n"] for r in found} == dict.fromkeys(range(300), 2)

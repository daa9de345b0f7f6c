"""What the review of round three found, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import simhash
from corpusmill.functions.text import plain_tokens
from corpusmill.operators import fusion, variants
from corpusmill.plans import search
from test_round3 import same_as_sql

WORDS = ["lipid", "statins", "doses", "treated", "trial", "hdl", "liver"]


def rounded(rows):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]


@pytest.mark.parametrize("name", ["variant_metrics", "variant_study"])
def test_variants_are_searched_where_their_tokens_lie(spark, tmp_path, monkeypatch, name):
    rows = [(k, " ".join(WORDS[(k * j) % 7] for j in range(1, 4 + k % 9)), f"src{k % 4}") for k in range(60)] + [(90, None, "src1"), (91, "", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    items = spark.createDataFrame([(k, " ".join(WORDS[k % 7 : k % 7 + 3])) for k in range(5)] + [(7, "the")], "item_id long, text string")
    plans, search = [], variants.search_variants
    monkeypatch.setattr(variants, "search_variants", lambda *a: plans.append(search(*a)) or plans[-1])
    got, want = same_as_sql(spark, tmp_path, name, documents=docs, benchmark=items)
    assert rounded(got) == rounded(want)
    assert "Join" not in plans[0]._jdf.queryExecution().executedPlan().toString()


def test_variants_add_up_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "lipid"), (1, "lipid hdl"), (2, "hdl trial"), (3, "lipid")], "doc_id long, text string")
    variants.write_variants(variants.variant_rows(docs, {"v": F.col("text")}), str(tmp_path))
    q = spark.createDataFrame([(5, "lipid"), (6, "trial")], "query_id long, query string")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in variants.search_variants(spark, str(tmp_path), q, 3).collect()}
    assert got == {(5, 1): 1, (5, 2): 3, (6, 1): 2}
    assert variants.search_variants(spark, str(tmp_path), q, 3, only=["w"]).count() == 0


def hybrid_tables(spark):
    rows = [(k, " ".join(WORDS[(k * j) % 7] for j in range(1, 4 + k % 9)), f"src{k % 4}") for k in range(300)] + [(400, None, "src1"), (401, "", "src2"), (402, "liver trial liver", "src3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    items = spark.createDataFrame([(k, " ".join(WORDS[k % 7 : k % 7 + 3])) for k in range(5)] + [(7, "the"), (500, "statins doses"), (600, "no vector")], "item_id long, text string")
    vector = lambda k: [float((k * 7) % 5) - 2.0, float(k % 3), 1.0 + k % 2, 0.5]
    # the best of some items (402) has no vector, item 500 has one but is no document
    vectors = spark.createDataFrame([(k, vector(k)) for k in [*range(300), 400, 401, 500]], "vec_id long, embedding array<double>")
    return {"documents": docs, "benchmark": items, "embeddings": vectors}


@pytest.mark.parametrize("name", ["hybrid_rrf", "multi_query_merge"])
@pytest.mark.parametrize("size", [3, 1024])
def test_hybrid_scores_are_not_written(spark, tmp_path, monkeypatch, name, size):
    def table_of_scores(*_):
        raise AssertionError("a row for each pair that shares a word")

    monkeypatch.setattr(search, "lexical_scores", table_of_scores)
    monkeypatch.setattr(fusion, "QUERY_BLOCK", size)
    got, want = same_as_sql(spark, tmp_path, name, **hybrid_tables(spark))
    assert rounded(got) == rounded(want)


def test_ties_are_counted_as_one_by_one():
    ids, keys = np.array([5, 3, 9, 4, 2]), np.array([0.5, 0.5, 0.5, 0.2, 0.9])
    held = fusion._Candidates(ids, keys)
    rows, of = np.array([1, 4, 8, 5, 3, 9, 2, 7]), np.array([0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.9, 0.1])
    held.count(rows, of)
    ahead = dict(zip(held.ids.tolist(), held.ahead.tolist(), strict=True))
    assert ahead == {i: int(sum(r != i and (f > s or (f == s and r < i)) for r, f in zip(rows, of, strict=True))) for i, s in zip(ids.tolist(), keys.tolist(), strict=True)}


def test_near_duplicates_are_linked_by_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(12)]
    texts = base + [t.replace(" ", "  ") + " end" for t in base[:8]] + [" ".join(t.split()[:60]) for t in base[:3]] + ["", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    fps = [int(simhash.fingerprint(h)[0]) for h in sets]
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    close = {(i, j) for j in range(len(texts)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2}
    want = {j: min([i for i, x in close if x == j and alike(i, j)], default=j) for j in range(len(texts))}
    assert sum(j != i for j, i in want.items()) > 4
    nothing = lambda *a: simhash.materialize(spark.createDataFrame([], "a long, b long"), "none")
    monkeypatch.setattr(simhash, "hub_pairs", nothing)
    monkeypatch.setattr(simhash, "remaining_pairs", nothing)
    # without the exact check that follows: the links of the fingerprints, each held against the texts
    assert {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs).collect()} == want


def test_no_plan_of_near_duplicates_holds_many_tables(spark, monkeypatch):
    plans, write = {}, simhash.materialize
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    monkeypatch.setattr(simhash, "materialize", lambda df, name: plans.update({name: count(df)}) or write(df, name))
    monkeypatch.setattr(simhash.written_links, "__defaults__", (2, None, 1))  # every bucket of two is a large one
    base = [" ".join(f"w{(i * k) % 97}" for i in range(40)) for k in range(1, 30)]
    docs = spark.createDataFrame(list(enumerate([*base, *[t + " end" for t in base], *[t + " END  of" for t in base]])), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: k % 29 for k in range(87)}
    assert "simhash-crowd" in plans and max(plans.values()) <= 6, plans


def test_a_part_of_several_variants_is_analysed_once(spark):
    texts = ["Lipid LDL-C end-", "ΟΔΟΣ", None, "", "x1 a-b the", "-lead ΟΔΟΣ-Σ trail--"]
    docs = spark.createDataFrame([(k, t, u) for k, t in enumerate(texts) for u in ["-tail Liver", "Σ", ""]], "doc_id long, t string, u string")
    t, u = F.coalesce("t", F.lit("")), F.col("u")
    made = variants.variant_tokens(docs, {"plain": [t], "both": [t, u], "again": [t]})
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2
    want = variants.variant_rows(docs, {"plain": t, "both": F.concat_ws(" ", t, u), "again": t}).select("variant", "doc_id", plain_tokens(F.col("text")).alias("tokens"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["hybrid_rrf", "multi_query_merge"])
def test_hybrid_rows_hold_numbers_of_asked_tokens(spark, tmp_path, monkeypatch, name):
    kept, write = {}, search.written
    monkeypatch.setattr(search, "written", lambda df, what: kept.setdefault(what, write(df, what)))
    got, want = same_as_sql(spark, tmp_path, name, **hybrid_tables(spark))
    assert rounded(got) == rounded(want)
    assert dict(kept["hybrid-rows"].dtypes)["tokens"] == "array<int>"
    lengths = {r["doc_id"]: (r["doc_len"], len(r["tokens"])) for r in kept["hybrid-rows"].collect()}
    assert lengths[400] == (None, 0) and lengths[401] == (0, 0) and lengths[402] == (3, 3)

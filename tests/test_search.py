"""The written index and exact rank fusion against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators.blocks import BlockIndex, asked_tokens, search, write_blocks
from corpusmill.operators.fusion import depth_for, fused_top
from corpusmill.operators.index import bm25, build_index
from corpusmill.operators.search import top_k


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("gal", "tor", "mib", "ren", "sup", "kol") for b in ("ane", "ort", "ulf", "ick", "owe", "ary", "esk")]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 30)), p=None))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, rows[0][1]), (403, "kolesk " * 2000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_block_search_equals_scoring_everything(spark, texts, tmp_path):
    write_blocks(texts, str(tmp_path / "index"), block_docs=8)
    queries = spark.createDataFrame([(1, "galane torort"), (2, "kolesk"), (3, "nothing known"), (4, "renick supowe mibary galulf kolane"), (5, None)], "query_id long, query string")
    found, effort = search(BlockIndex.read(spark, str(tmp_path / "index")), asked_tokens(queries), 5)
    plain = top_k(bm25(build_index(texts), queries).select("query_id", "doc_id", F.round("bm25", 6).alias("score")), 5, [F.col("score").desc(), F.col("doc_id")]).select("query_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    effort = {r["query_id"]: r for r in effort.collect()}
    assert set(effort) == {1, 2, 4}
    assert all(r["scored_postings"] <= r["postings"] for r in effort.values())
    # the bounds rule out most blocks of a query whose best documents hold both its words
    assert effort[1]["scored_blocks"] < effort[1]["blocks"] and effort[1]["scored_postings"] < effort[1]["postings"]


def _fused(docs, lexical, queries, k):
    """Both rankings in full."""
    out = []
    for q, v in queries:
        v = np.array(v) / np.linalg.norm(v)
        sem, lex = [], []
        for d, prior, x in docs:
            n = np.linalg.norm(x)
            c = round(float(np.dot(x, v) / n), 10) if n else 0.0
            s = lexical.get((q, d), 0.0)
            sem.append((-round(c + prior, 10), d, c))
            lex.append((-round(s + prior, 10), d, s))
        sr = {d: r + 1 for r, (_, d, _) in enumerate(sorted(sem))}
        lr = {d: r + 1 for r, (_, d, _) in enumerate(sorted(lex))}
        cs, ks = {d: c for _, d, c in sem}, {d: s for _, d, s in lex}
        rows = sorted((-round(1 / (60 + sr[d]) + 1 / (60 + lr[d]), 10), -cs[d], -ks[d], sr[d], d) for d, _, _ in docs)
        out += [(q, r[4], i + 1, sr[r[4]], lr[r[4]]) for i, r in enumerate(rows[:k])]
    return sorted(out)


@pytest.mark.parametrize("n", [3, 700])
def test_fusion_equals_ranking_everything(spark, n):
    rng = np.random.default_rng(n)
    docs = [(i, float(rng.choice([0.05, 0.1, 0.15])), rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(n)]
    queries = [(1, [1.0, 0.0, 2.0, -1.0]), (2, [0.5, 0.5, 0.0, 0.0]), (9, [-1.0, 1.0, 1.0, 1.0])]
    # many equal scores, a query without any shared word, and one that nearly all documents share
    lexical = {(1, int(d)): round(float(rng.choice([0.1, 0.5, 1.0])), 10) for d in rng.choice(n, min(n, 40), replace=False)}
    lexical |= {(2, d): round(float(rng.random()), 10) for d in range(n - 1)}
    prior = {d: p for d, p, _ in docs}
    base = spark.createDataFrame(docs, "doc_id long, prior double, embedding array<double>").repartition(3)
    lex = spark.createDataFrame([(q, d, s, prior[d]) for (q, d), s in lexical.items()], "query_id long, doc_id long, k double, prior double")
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    found = fused_top(base, lex, q, 10).collect()
    assert sorted((r["query_id"], r["doc_id"], r["fused_rank"], r["semantic_rank"], r["bm25_rank"]) for r in found) == _fused(docs, lexical, queries, 10)
    assert all(r["candidates"] <= 2 * depth_for(10) for r in found)


def test_fusion_without_queries(spark):
    base = spark.createDataFrame([(1, 0.1, [1.0])], "doc_id long, prior double, embedding array<double>")
    none = spark.createDataFrame([], "query_id long, doc_id long, k double, prior double")
    assert fused_top(base, none, spark.createDataFrame([], "query_id long, vector array<double>"), 3).count() == 0


def test_kept_tables_follow_their_files(spark, tmp_path):
    from corpusmill.sources import shared

    src = str(tmp_path / "src")
    spark.range(3).write.parquet(src)
    calls = []

    def write(path):
        calls.append(path)
        spark.range(1).write.parquet(path)

    one = shared.kept(spark, "x", spark.read.parquet(src), write)
    assert shared.kept(spark, "x", spark.read.parquet(src), write) == one and len(calls) == 1
    assert shared.kept(spark, "y", spark.read.parquet(src), write) != one  # another name
    spark.range(5).write.mode("append").parquet(src)  # other files
    assert shared.kept(spark, "x", spark.read.parquet(src), write) != one and len(calls) == 3
    shared.release(spark)
    again = shared.kept(spark, "x", spark.read.parquet(src), write)
    assert again not in calls[:3] and spark.read.parquet(again).count() == 1

import pytest
from pyspark.sql import functions as F

from corpusmill import config as cf
from corpusmill.functions import misc as mf
from corpusmill.operators import dataset as ds


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_small_functions(spark):
    assert one(spark, mf.overlap_length(F.lit("abcde"), F.lit("dexyz"), 10)) == 2
    assert one(spark, mf.overlap_length(F.lit("abc"), F.lit("xyz"), 10)) == 0
    assert one(spark, mf.epoch_seconds(F.lit(1_700_000_000_000))) == one(spark, mf.epoch_seconds(F.lit(1_700_000_000)))
    assert str(one(spark, mf.run_time(F.lit("20260102T030405_x")))) == "2026-01-02 03:04:05"
    assert one(spark, mf.run_time(F.lit("none"))) is None
    assert one(spark, mf.percent_delta(F.lit(2.0), F.lit(3.0))) == "+50.0%" and one(spark, mf.percent_delta(F.lit(0.0), F.lit(3.0))) == "n/a"
    assert one(spark, mf.clean_html_text(F.lit("<nav>menu</nav><p>Hello there</p><script>x()</script>ok!"))) == "Hello there\nok!"
    assert one(spark, mf.metric_key(F.lit("nDCG@5"))) == "ndcg_at_k"
    assert one(spark, mf.context_of(F.array(F.struct(F.lit(2).alias("rank"), F.lit("b").alias("label"), F.lit("y").alias("content")), F.struct(F.lit(1).alias("rank"), F.lit("a").alias("label"), F.lit("x").alias("content"))))) == "[Source: a]\nx\n\n[Source: b]\ny"
    hints = one(spark, mf.boundary_hints(F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("DRUG").alias("label"))), F.lit(9)))
    assert [(h["at"], h["why"]) for h in hints] == [(3, "after_drug")]


def test_settings():
    r = cf.resolve_retrieval({"mmr_lambda": 7, "overfetch_multiplier": 0, "reranking_mode": "x", "unknown": 1, "hyde_max_length": None})
    assert (r.mmr_lambda, r.overfetch_multiplier, r.reranking_mode) == (1.0, 1, "cross_encoder") and not r.diversifies()
    assert cf.resolve_retrieval({"reranking_mode": "both"}).diversifies()
    assert cf.check_chunking(cf.Chunking(chunk_size=5)).chunk_size == 1024
    with pytest.raises(ValueError):
        cf.check_chunking(cf.Chunking(strategy="none"), strict=True)
    y = cf.read_yaml("base:\n  k: 5  # five\n  list: [1, a]\n  in:\n    x: true\nvariants:\n  v:\n    k: 6\n")
    assert y["base"] == {"k": 5, "list": [1, "a"], "in": {"x": True}}
    runs = cf.experiment_runs(y, "v")
    assert runs[0]["config"]["k"] == 6 and runs[0]["config"]["in"] == {"x": True} and len(runs[0]["hash"]) == 64
    assert cf.needs_rebuild("auto", True, "a", "b") and not cf.needs_rebuild("never", False, None, "b")


def test_datasets(spark):
    g = spark.createDataFrame([("q2", "What  is it", "high", "test"), ("q1", "b", "low", "dev")], "query_id string, query string, label_confidence string, dataset_split string")
    s = spark.createDataFrame([("s1", "what is IT"), ("s2", "new")], "query_id string, query string")
    assert sorted(r["query_id"] for r in ds.merge_records(g, s).collect()) == ["q1", "q2", "s2"]
    assert [r["query_id"] for r in ds.filter_records(g).collect()] == ["q1", "q2"]
    assert [r["query_id"] for r in ds.filter_records(g, min_confidence="medium").collect()] == ["q2"]
    r = spark.createDataFrame([("LDL", "<2.6", "x", "y"), ("LDL", "none", "", "y")], "test_name string, normal_range string, unit string, category string")
    assert tuple(ds.ranges_audit(r).first()) == (2, 0.5, 1, 0.5)

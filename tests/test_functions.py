import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import questions as qs
from corpusmill.functions import sources as src
from corpusmill.functions import text as tx
from corpusmill.functions.stem import analyze, expand_query, stem
from corpusmill.functions.vectors import cosine


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first()[0]


@pytest.mark.parametrize("word,want", [("diabetes", "diabet"), ("running", "run"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("generously", "generous"), ("sky", "sky"), ("news", "news"), ("agreed", "agre")])
def test_stem(word, want):
    assert stem(word) == want


def test_analyzer_keeps_words_and_drops_numbers_and_stop_words():
    assert analyze("LDL Cholesterol in 35 patients") == ["ldlc", "lipid", "lipid"]
    assert analyze(None) == []
    assert expand_query(" ") == []
    assert expand_query("LDL-C targets")[0] == "LDL-C targets"


def test_sanitize(spark):
    assert one(spark, tx.sanitize_text(F.col("t")), t=" a\x01b 5% mg/dl MG/DL ") == "ab 5percent mgdl mgdl"


def test_plain_tokens(spark):
    assert one(spark, tx.plain_tokens(F.col("t")), t="The LDL-C of 35 Iechä co-op x_1") == ["ldlc", "iechä", "co-op"]


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("url,want", [("HTTP://Ex.COM/A/?q=1#f", "http://ex.com/A?q=1"), ("https://x.org", "https://x.org/"), ("https://x.org/a//", "https://x.org/a")])
def test_normalize_url(spark, url, want):
    assert one(spark, src.normalize_url(F.col("u")), u=url) == want


@pytest.mark.parametrize("name,want", [("www.cdc.gov", "government"), ("a.edu.sg", "education"), ("x.org", "organization"), ("x.com", "commercial"), ("x.io", "unknown"), ("", "unknown")])
def test_domain_type(spark, name, want):
    assert one(spark, src.domain_type(F.col("d")), d=name) == want


@pytest.mark.parametrize("q,want", [("What is LDL?", "definition"), ("statin vs fibrate", "comparison"), ("normal LDL range compared to HDL", "complex"), ("treatment of gout", "treatment"), ("how?", "follow_up"), ("gout", "definition")])
def test_classify(spark, q, want):
    assert one(spark, qs.classify(F.col("q"))["query_type"], q=q) == want


def test_source_class_and_prior(spark):
    df = spark.createDataFrame([("a.pdf", 0.15), ("a.md", 0.10), ("a.csv", 0.12), ("a", 0.05)], "s string, p double")
    assert [r[0] for r in df.select(src.source_prior(src.source_class(F.col("s"))).alias("x"), "p").collect()] == [0.15, 0.10, 0.12, 0.05]


def test_labels(spark):
    assert one(spark, src.readable_label(F.col("s")), s="dir/my_file-v2.pdf") == "my file v2"
    assert one(spark, src.display_label(F.col("s"), F.col("p")), s="x", p=3) == "x page 3"


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abcdefghilmnoprstuy", min_size=1, max_size=14))
def test_stem_never_grows_much(word):
    assert 0 < len(stem(word)) <= len(word) + 1

"""What the review of round four found, on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bonus, scan
from corpusmill.plans import search
from corpusmill.plans.catalog import ORACLES

WORDS = ["Lipid", "statins", "doses", "treated", "LDL-C", "ldlc", "liver,", "the"]
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def tables(spark):
    # blanks of every kind, of which some part keywords, some are trimmed off, and some belong to them
    odd = [" liver  doses", "liver doses", "liver\x0bdoses treated", "doses  　liver\t", "\x85doses liver \n statins", "", None, "the", "Doses doses\r\ndoses"]
    rows = [(k, " ".join(WORDS[(k * j) % 8] for j in range(1, 4 + k % 9))) for k in range(60)] + [(100 + k, t) for k, t in enumerate(odd)]
    items = [(k, " ".join(WORDS[k % 8 : k % 8 + 3])) for k in range(8)] + [(3, "doses"), (20, "the"), (21, None), (22, "liver doses statins treated")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)


def same_as_sql(spark, folder, docs, items):
    """The rows and those of the SQL, sorted, nulls first."""
    duck = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        df.write.parquet(f"{folder}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = search.keyword_bonus_scores(spark, str(folder)).collect()
    want = duck.execute(f"SELECT query_id, doc_id, bm25, bonus FROM ({ORACLES['keyword_bonus_scores']})").fetchall()
    return [sorted(((q, d, round(s, 5), round(b, 5)) for q, d, s, b in rows), key=lambda r: [(v is not None, v) for v in r]) for rows in (got, want)]


@pytest.mark.parametrize("size", [3, 1024])
def test_keyword_scores_are_computed_where_the_rows_lie(spark, tmp_path, monkeypatch, size):
    def index(*_, **__):
        raise AssertionError("an index of all tokens")

    plans, make = [], bonus._by_row
    monkeypatch.setattr(search, "write_blocks", index)
    monkeypatch.setattr(bonus, "blocks_of", lambda asked: scan.blocks_of(asked, size))
    monkeypatch.setattr(bonus, "_by_row", lambda *a: plans.append(make(*a)) or plans[-1])
    docs, items = tables(spark)
    got, want = same_as_sql(spark, tmp_path, docs, items)
    assert got == want and len(got) > 100
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("other", ["repeated", "null id", "null item"])
def test_keyword_scores_of_ids_that_are_no_single_rows(spark, tmp_path, other):
    docs, items = tables(spark)
    if other == "repeated":  # of one length, of different lengths, and without text
        docs = docs.union(spark.createDataFrame([(5, "doses liver"), (5, "liver liver"), (5, None), (7, "statins")], DOCS)).union(docs.where("doc_id < 20"))
    elif other == "null id":
        docs = docs.union(spark.createDataFrame([(None, "doses liver"), (None, "liver")], DOCS))
    else:
        items = items.union(spark.createDataFrame([(None, "liver doses")], ITEMS))
    got, want = same_as_sql(spark, tmp_path, docs, items)
    assert got == want and len(got) > 100


def test_keyword_scores_of_empty_tables(spark):
    docs, items = tables(spark)
    q = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    assert bonus.keyword_scores(docs.limit(0), q).count() == 0
    assert bonus.keyword_scores(docs, q.limit(0)).count() == 0
    assert bonus.keyword_scores(docs, q).dtypes == [("query_id", "bigint"), ("doc_id", "bigint"), ("bm25", "double"), ("bonus", "double")]

"""Readers that tell formats apart, and stored histories."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import readers, writers


def test_datasets_by_what_they_hold(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_text(json.dumps(data))
        return str(tmp_path / name)

    golden = put("golden.json", {"golden_queries": [{"query": " a b ", "expected_sources": ["x.pdf"]}, {"query": " "}]})
    assert [r["query"] for r in readers.read_dataset(spark, golden).collect()] == ["a b"]
    talks = put("talks.json", {"golden_conversations": [{"conversation_id": "1", "turns": [{"role": "user", "content": "x"}]}, {"conversation_id": "2", "turns": []}]})
    assert [r["user_turn_count"] for r in readers.read_dataset(spark, talks).collect()] == [1]
    plain = put("plain.json", [{"query": "q", "n": 1}, {"query": ""}, {"n": 3}])
    assert [r["query"] for r in readers.read_dataset(spark, plain).collect()] == ["q"]
    with pytest.raises(ValueError):
        readers.read_dataset(spark, put("other.json", {"x": 1}))


def test_stored_histories_of_all_kinds(spark):
    raws = [
        ('[{"role": "user", "content": "a", "timestamp": 1700000000000}]', 5, (1700000000, 1)),
        ('[{"role": "user", "content": "a", "timestamp": 1700000000}]', 1800000000, (1800000000, 1)),
        ('{"updated_at": 12.7, "messages": [{"role": "user", "content": "a"}, null]}', 5, (12, 1)),
        ('{"updated_at": "soon", "messages": [{"role": "user", "content": "a", "timestamp": 7}]}', 5, (7, 1)),
        ('{"messages": "none"}', 5, (5, 0)),
        ("[]", 5, (5, 0)),
        ('"text"', 5, None),
        (None, 5, None),
    ]
    df = spark.createDataFrame([(k, raw, now) for k, (raw, now, _) in enumerate(raws)], "k int, raw string, now long")
    got = df.select("k", readers.normalized_history(F.col("raw"), F.col("now")).alias("h")).orderBy("k").collect()
    assert [None if r["h"] is None else (r["h"]["updated_at"], len(r["h"]["messages"])) for r in got] == [w for *_, w in raws]


def test_documents_are_added_once(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x", "aa11"), ("2", "y", "bb22"), ("3", "x", "aa11")], "id string, content string, content_hash string")
    path = str(tmp_path / "store")
    assert writers.add_documents(spark, rows, path) == {"attempted": 3, "inserted": 2, "skipped": 1}
    assert writers.add_documents(spark, rows, path) == {"attempted": 3, "inserted": 0, "skipped": 3}


def test_report_keeps_its_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", None)], "variant string, n int").repartition(2)
    writers.write_report(rows, str(tmp_path / "report"), "Study")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report/md")).collect()]
    assert lines == ["# Study", "", "| variant | n |", "|---|---|", "| a |  |", "| b | 2 |"]

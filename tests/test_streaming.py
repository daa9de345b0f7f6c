import json

from pyspark.sql import functions as F

from corpusmill.streaming import sessions as ss
from corpusmill.sources import readers, writers


def _events(spark, path):
    rows = [(i, i % 2, i * 20) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), F.lit(1.0).alias("value"))
    df.coalesce(1).write.parquet(path)
    return df


def test_rate_limit_batch_equals_stream(spark, tmp_path):
    df = _events(spark, str(tmp_path / "e"))
    batch = {tuple(r) for r in ss.rate_limit(df, "user_id", "event_id", "ts", 1).collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = ss.rate_limit_stream(stream, "user_id", "event_id", "ts", 1).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("limited").collect()} == batch
    assert any(not r[2] for r in batch) and any(r[2] for r in batch)


def test_rate_limit_of_zero_lets_all_through(spark, tmp_path):
    df = _events(spark, str(tmp_path / "e"))
    assert ss.rate_limit(df, "user_id", "event_id", "ts", 0).where("allowed").count() == 12


def test_incremental_index_adds_each_content_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, content_hash string")
    df.coalesce(1).write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(src)
        q = ss.incremental_index(stream, out, "content_hash", str(tmp_path / f"c{_}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(out).count() == 2


def test_windows_on_a_stream_drop_nothing_in_time(spark, tmp_path):
    df = _events(spark, str(tmp_path / "e"))
    assert ss.windowed(df, "ts", "1 minute", None, ["user_id"]).agg(F.sum("n")).first()[0] == 12
    assert ss.sessions(df, "ts", "30 seconds", "user_id").agg(F.sum("n")).first()[0] == 12


def test_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"golden_queries": [{"query": "a?", "expected_sources": ["Lipid_guide.pdf"]}, {"query": " "}]}))
    g = readers.read_golden(spark, str(tmp_path / "g.json")).collect()
    assert len(g) == 1 and g[0]["query_id"] == "golden_1" and g[0]["label_confidence"] == "medium" and g[0]["source_family"] == "lipid guide"
    (tmp_path / "r.csv").write_text("test_name,normal_range,unit,category,notes\nLDL,<2.6,mmol/L,Lipids,fasting\n")
    assert readers.read_ranges(spark, str(tmp_path / "r.csv")).first()["content"] == "LDL: <2.6 mmol/L (Lipids) - fasting"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    try:
        readers.read_ranges(spark, str(tmp_path / "bad.csv"))
        raise AssertionError
    except ValueError as e:
        assert "columns missing" in str(e)
    (tmp_path / "c.json").write_text(json.dumps({"golden_conversations": [{"conversation_id": "1", "turns": [{"role": "user", "content": "x"}]}, {"conversation_id": "2", "turns": []}]}))
    assert [r["user_turn_count"] for r in readers.read_conversations(spark, str(tmp_path / "c.json")).collect()] == [1]
    (tmp_path / "v.json").write_text(json.dumps({"ids": ["a"], "contents": ["x"], "embeddings": [[1.0]], "metadatas": [{"k": "v"}]}))
    assert readers.read_vectors_json(spark, str(tmp_path / "v.json")).first()["id"] == "a"
    d = tmp_path / "md"
    d.mkdir()
    (d / "a.md").write_text("# A")
    (d / "b.md").write_text(" ")
    assert [r["name"] for r in readers.read_markdown(spark, str(d)).collect()] == ["a.md"]
    (d / "x.pdf").write_bytes(b"one\ftwo")
    (d / "y.pdf").write_bytes(b"\xff")
    pages = readers.read_pdf(spark, str(d), lambda b: b.decode().split("\f")).orderBy("name", "page").collect()
    assert [r["content"] for r in pages] == ["one", "two", None] and pages[2]["error"]


def test_add_documents(spark, tmp_path):
    p = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", "x", "h1"), ("b", "x", "h1")], "id string, content string, content_hash string")
    assert writers.add_documents(spark, rows, p) == {"attempted": 2, "inserted": 1, "skipped": 1}
    assert writers.add_documents(spark, rows, p)["inserted"] == 0
    writers.clear(spark, p)
    assert spark.read.parquet(p).count() == 0

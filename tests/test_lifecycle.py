"""Expiring histories, ingestion, stores, index variants, generation and deadlines."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import enrich, generate, variants
from corpusmill.sources.store import HashStore
from corpusmill.streaming import history, ingest


def test_history_after_gaps():
    hour = 3_600_000_000
    held = history.following([], [(0, "a"), (hour, "b")], hour, 10)
    assert held == [(0, "a"), (hour, "b")]
    assert history.following(held, [(2 * hour + 1, "c")], hour, 10) == [(2 * hour + 1, "c")]
    assert [x for _, x in history.following(held, [(hour + 1, "c"), (hour + 2, "d")], hour, 2)] == ["c", "d"]


def test_stream_of_histories_equals_its_twin(spark, tmp_path):
    start = datetime(2024, 5, 1)
    at = lambda m: start + timedelta(minutes=m)
    drops = [
        [("a", at(0), "user", "one"), ("b", at(1), "user", "two"), ("a", at(2), None, "three"), (None, at(2), "user", "lost")],
        [("a", at(50), "user", "four"), ("c", at(55), "user", None)],
        [("d", at(400), "user", "five")],  # moves the watermark beyond the others' time to live
        [("a", at(410), "user", "six"), ("d", at(401), "user", "seven")],
    ]
    schema = "who string, at timestamp, role string, text string"
    spark.conf.set(*history.STATE_STORE)
    try:
        said = []
        for k, rows in enumerate(drops):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            out = history.history_stream(stream, "who", "at", "role", "text", ttl_s=3600, cap=3, late="10 minutes")
            q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda b, n, k=k: said.extend((k, r) for r in b.collect())).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(history.STATE_STORE[0])
    assert {r["session"] for k, r in said if r["expired"]} == {"a", "b", "c"} and all(k >= 2 for k, r in said if r["expired"])
    last = {}
    for _, r in said:
        last[r["session"]] = r
    every = spark.createDataFrame([r for rows in drops for r in rows], schema)
    twin = {r["session"]: r for r in history.histories(every, "who", "at", "role", "text", F.lit(at(410)), ttl_s=3600, cap=3).collect()}
    assert set(twin) == {"a", "d"} and twin["a"]["context"] == "user: six"
    for s, r in twin.items():
        assert (last[s]["messages"], last[s]["context"], last[s]["updated_at"]) == (r["messages"], r["context"], r["updated_at"])


def test_ingestion_takes_new_files_alone(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    drop = lambda rows: spark.createDataFrame(rows, "id string, html string").coalesce(1).write.mode("append").parquet(landing)
    stream = lambda: spark.readStream.schema("id string, html string").parquet(landing)
    drop([("1", "same"), ("2", "same"), ("3", None)])
    assert ingest.ingest(stream(), out, "id", "html", digits=1) == 1
    assert ingest.ingest(stream(), out, "id", "html", digits=1) == 0  # nothing is new
    drop([("4", "same"), ("5", "other")])

    def fails(batch):
        raise OSError("disk")

    with pytest.raises(Exception, match="disk"):
        ingest.ingest(stream(), out, "id", "html", after_documents=fails, digits=1)
    # its documents are written, but no manifest names them
    assert {r["id"] for r in ingest.documents(spark, out).collect()} == {"1", "3"}
    assert ingest.ingest(stream(), out, "id", "html", digits=1) == 1
    m = {r["id"]: (r["status"], r["alias_of"], r["batch"]) for r in ingest.manifest(spark, out).collect()}
    assert m == {"1": ("ok", None, 0), "2": ("alias", "1", 0), "3": ("ok", None, 0), "4": ("alias", "1", 1), "5": ("ok", None, 1)}
    assert sorted(r["id"] for r in ingest.documents(spark, out).collect()) == ["1", "3", "5"]




def test_store_reads_only_the_partitions_of_a_batch(spark, tmp_path):
    store = HashStore(spark, str(tmp_path / "store"))
    rows = lambda lo, hi: spark.range(lo, hi).select("id", F.md5(F.col("id").cast("string")).alias("content_hash"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 20).alias("text"))
    assert store.insert_new(rows(0, 3000), "id") == {"attempted": 3000, "inserted": 3000, "skipped": 0}
    small = rows(2998, 3002)
    parts = store.touched(small)
    assert len(parts) <= 4 and set(store.part_of(parts).select(F.input_file_name().alias("f")).distinct().toPandas()["f"].str.extract("part=(..)")[0]) <= set(parts)
    assert store.insert_new(small, "id") == {"attempted": 4, "inserted": 2, "skipped": 2}
    assert store.insert_new(small, "id") == {"attempted": 4, "inserted": 0, "skipped": 4}  # a batch that runs again
    odd = spark.createDataFrame([(9001, None, "x"), (9002, "00aa", "y"), (9003, "00aa", "z")], "id long, content_hash string, text string")
    assert store.insert_new(odd, "id") == {"attempted": 3, "inserted": 1, "skipped": 2}
    assert store.rows().count() == 3003 and store.rows().where("content_hash = '00aa'").first()["id"] == 9002


def test_store_replaces_the_partitions_of_a_batch(spark, tmp_path):
    import os

    store = HashStore(spark, str(tmp_path / "runs"), key="identity", digits=1)
    put = lambda rows: store.replace_latest(spark.createDataFrame(rows, "identity string, at int, status string"), "at")
    put([("aa", 1, "new"), ("ab", 1, "new"), ("b1", 1, "new")])
    kept = os.stat(tmp_path / "runs/part=b").st_mtime_ns, sorted(os.listdir(tmp_path / "runs/part=b"))
    put([("aa", 2, "done"), ("ab", 0, "late"), ("ac", 5, "new"), (None, 9, "lost")])
    assert sorted(map(tuple, store.rows().select("identity", "at", "status").collect())) == [("aa", 2, "done"), ("ab", 1, "new"), ("ac", 5, "new"), ("b1", 1, "new")]
    assert kept == (os.stat(tmp_path / "runs/part=b").st_mtime_ns, sorted(os.listdir(tmp_path / "runs/part=b")))


def test_variants_change_what_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "pear plum"), (3, None), (4, "fig")], "doc_id long, text string")
    t = F.coalesce("text", F.lit(""))
    path = str(tmp_path / "index")
    variants.write_variants(variants.variant_rows(docs, {"plain": t, "first": F.substring_index(t, " ", 1)}), path)
    q = spark.createDataFrame([(1, "pear"), (2, "fig"), (3, "nothing")], "query_id long, query string")
    hits = lambda: {(r["variant"], r["query_id"]): r["doc_id"] for r in variants.search_variants(spark, path, q, 1).collect()}
    assert hits() == {("plain", 1): 2, ("plain", 2): 4, ("first", 1): 2, ("first", 2): 4}
    variants.write_variants(variants.variant_rows(docs, {"first": F.lit("pear")}), path)  # again, by itself
    assert hits() == {("plain", 1): 2, ("plain", 2): 4, ("first", 1): 1}
    judged = spark.createDataFrame([("plain", 1, 1, 1), ("plain", 2, 1, 0), ("plain", 2, 2, 1), ("first", 1, 2, 1)], "variant string, query_id long, rank int, rel int")
    m = {r["variant"]: r for r in variants.judged_variants(judged, 4, 5).collect()}
    assert m["plain"]["mrr"] == 0.375 and m["first"]["hit"] == 0.25
    best = {r["variant"]: r for r in variants.winner(variants.judged_variants(judged, 4, 5), "mrr", "first").collect()}
    assert best["plain"]["wins"] and best["plain"]["delta"] == 0.25 and best["first"]["delta"] == 0.0


def test_late_calls_do_not_hold_up_others():
    def slow():
        time.sleep(20)

    def broken():
        raise KeyError("x")

    began = time.monotonic()
    calls = [slow, lambda: 1, broken, slow, lambda: 2, slow, lambda: 3]
    assert enrich.run_calls(calls, timeout_s=0.3, at_once=2) == [(None, "timeout"), (1, None), (None, "KeyError"), (None, "timeout"), (2, None), (None, "timeout"), (3, None)]
    assert time.monotonic() - began < 5
    assert enrich.run_calls([], 1.0) == [] and enrich.run_calls([lambda: 5], None) == [(5, None)]


def test_judges_with_deadlines(spark):
    def slow(q, c, a):
        if a == "wait":
            time.sleep(20)
        return 0.9

    tried = spark.createDataFrame([(1, "q", "c", "wait"), (2, "q", "c", "go"), (3, None, None, None)], "query_id long, question string, context string, answer string")
    got = {r["query_id"]: r for r in enrich.judged(tried, {"slow": slow}, {"slow": 0.5}, timeout_s=0.5).collect()}
    assert (got[1]["score"], got[1]["passed"], got[1]["reason"]) == (None, False, "timeout")
    assert all(got[k]["score"] == 0.9 and got[k]["passed"] and got[k]["reason"] is None for k in (2, 3))


def test_clients_with_deadlines(spark):
    def client(texts):
        if "wait" in texts:
            time.sleep(20)
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "wait"), (3, "bad"), (4, "b")], "id long, text string").coalesce(1)
    got = {r["id"]: (r["answer"], r["why"]) for r in enrich.ask(df, "text", client, batch=1, timeout_s=0.5, reason_col="why").collect()}
    assert got == {1: ("A", None), 2: (None, "timeout"), 3: (None, "ValueError"), 4: ("B", None)}


def test_generation_meets_its_quota_or_says_why(spark):
    rows = [(k, "en" if k < 30 else "fr", f"text number {k} about thing{k}", f"src{k % 3}") for k in range(33)]
    df = spark.createDataFrame(rows, "id long, lang string, text string, source string")
    log = generate.generate_questions(df, "lang", "id", "text", "source", quota=5, spare=2, tries=3, seed=1).collect()
    kept = [r for r in log if r["kept"]]
    assert sum(r["stratum"] == "en" for r in kept) == 5 and len({r["id"] for r in kept}) == len(kept)
    for s in ("en", "fr"):
        short = sum(r["stratum"] == s for r in kept) < 5
        ids = {r["id"] for r in log if r["stratum"] == s and r["status"] == "accepted"}
        if short:  # every seed was tried to the end
            assert all(len([x for x in log if x["id"] == i]) == 3 for i in {r["id"] for r in log if r["stratum"] == s} - ids)
    assert all(r["reason"] for r in log) and {r["reason"] for r in log} >= {"accepted", "question_too_copied"}

    def never(context, source, attempt):
        raise ConnectionError

    failed = generate.generate_questions(df, "lang", "id", "text", "source", quota=2, spare=1, tries=2, generator=never).collect()
    assert len(failed) == 8 and {r["reason"] for r in failed} == {"ConnectionError"}
    none = generate.generate_questions(df.limit(0), "lang", "id", "text", "source", quota=2)
    assert none.count() == 0


def test_expansions_need_a_provider(spark):
    from corpusmill.functions.text import plain_tokens

    q = spark.createDataFrame([(1, "statin dose"), (2, None)], "query_id long, query string")
    table = spark.createDataFrame([("statin", "hmg", "x", "class")] * 2 + [("other", "y", "x", "class")], "term string, expansion string, source string, relation string")
    assert [tuple(r) for r in enrich.expansions(q, table, plain_tokens).collect()] == [(1, "statin", "hmg", "x", "class")]
    assert enrich.expansions(q, None, plain_tokens).count() == 0


def test_first_runs_are_cold(spark):
    from corpusmill.operators.evaluation import latency_summary

    runs = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 6.0), ("a", 3, 2.0), ("b", 1, 4.0), ("c", 1, None)], "g string, k int, s double")
    got = {r["g"]: r for r in latency_summary(runs, "g", "s", "k").collect()}
    assert set(got) == {"a", "b"} and got["a"]["speed_up"] == 4.0 and got["a"]["p50"] == 2.0
    assert got["b"]["warm"] is None and got["b"]["speed_up"] is None

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import medical as md
from corpusmill.functions import questions as qs
from corpusmill.operators import chunking as ch
from corpusmill.operators import enrich, pdf, runs


@pytest.mark.parametrize("line,want", [("Allergies:", True), ("# Title", True), ("1. Dose of drug", True), ("KEY MESSAGES", True), ("Recommendation 3", True), ("some words", False), ("", False)])
def test_headers(spark, line, want):
    assert spark.range(1).select(md.is_section_header(F.lit(line))).first()[0] is want


def test_header_positions_and_scores(spark):
    t = F.lit("intro\nPLAN\ntake one tablet daily\n| normal |")
    r = spark.range(1).select(md.header_positions(t), md.has_dosing(t), md.is_lab_table(t), md.preservation_score(F.lit("PLAN\n5 mg daily"))).first()
    assert r[0] == [6] and r[1] and r[2] and r[3] == pytest.approx(0.85)


def test_page_blocks(spark):
    df = spark.createDataFrame([(1, 1, "AIMS:\na b\nc d\n- x\n- y\nk | l | m\nlast")], "doc_id long, page int, text string")
    got = pdf.page_blocks(df).orderBy("block").collect()
    assert [(r["block_type"], r["text"], r["section"]) for r in got] == [("heading", "AIMS", "AIMS"), ("paragraph", "a b\nc d", "AIMS"), ("list", "- x\n- y", "AIMS"), ("table", "k | l | m", "AIMS"), ("paragraph", "last", "AIMS")]


def test_parse_answers(spark):
    a = F.lit('Sure: ```{"keywords": [" A ", "", "b"], "summary": " s "}``` done')
    r = spark.range(1).select(enrich.parse_enrichment(a).alias("e"), enrich.parse_questions(F.lit("1. What is it then?\nshort\n- Why would that be?")).alias("q"), enrich.parse_enrichment(F.lit("none")).alias("n")).first()
    assert (r["e"]["keywords"], r["e"]["summary"]) == (["a", "b"], "s") and r["q"] == ["What is it then?", "Why would that be?"] and r["n"]["keywords"] == []


def test_a_client_that_fails_leaves_rows(spark):
    def broken(texts):
        raise OSError

    df = spark.createDataFrame([("a", "x")], "id string, text string")
    assert enrich.ask(df, "text", broken).first()["answer"] is None
    out = enrich.apply_by_id(df, spark.createDataFrame([("a", "new")], "id string, summary string"), ["summary"])
    assert out.first()["summary"] == "new"


def test_embedder_is_unit_and_stable(spark):
    df = spark.createDataFrame([("same words here",), ("same words here",), (None,)], "text string")
    got = [r["embedding"] for r in enrich.embed(df, "text").collect()]
    assert got[0] == got[1] and sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-5) and not any(got[2])


def test_runs(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None), ("a", 3, 0.7)], "k string, created_at int, ndcg double")
    assert runs.history_summary(df, ["ndcg"]).first()["ndcg"] == pytest.approx(0.6)
    assert {(r["k"], r["created_at"]) for r in runs.latest_of(df, "k", "created_at").collect()} == {("a", 3), ("b", 2)}
    assert [r["created_at"] for r in runs.to_delete(df, 2).collect()] == [1]
    assert spark.range(1).select(runs.meets_target(F.lit(1.03), F.lit(1.0)), runs.meets_target(F.lit(1.0), F.lit(0.0))).first()[1] is False
    assert runs.retrieval_variants(spark).count() == runs.reranking_variants(spark).count() == runs.keyword_variants(spark).count() == 4


def test_dosing_and_tables_count_for_and_against(spark):
    t = {"dose 5 mg": 0.4, "dose 5 mg daily": 0.65, "dose unknown": 0.5, "take 5 mg": 0.5, "| normal |": 0.3, "| normal |\n| x |": 0.65, "plain": 0.5, "PLAN:\ndose: 1 ml bid\n| normal |": 0.65}
    got = spark.createDataFrame(list(t.items()), "t string, want double").select("want", md.preservation_score(F.col("t")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(r["want"]) for r in got)


def test_entities_have_places_and_confidences(spark):
    e = spark.range(1).select(md.entities(F.lit("aspirin and ASPIRIN for gout"), ["aspirin", "none"], ["gout"]).alias("e")).first()["e"]
    assert [(x["text"], x["label"], x["start"], x["end"], x["confidence"]) for x in e] == [("aspirin", "DRUG", 0, 7, 0.7), ("ASPIRIN", "DRUG", 12, 19, 0.7), ("gout", "DISEASE", 24, 28, 0.8)]
    assert spark.range(1).select(md.entities(F.lit(""), ["a"], ["b"]).alias("e")).first()["e"] == []


def test_pairs_are_merged_from_the_first_on(spark):
    rows = [(d, i, t) for d, ts in {1: "mmmxmx", 2: "x", 3: "mm", 4: "xmmmm"}.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, content string")
    got = ch.merge_pairs(df, lambda a, b: a == "m").orderBy("doc_id", "chunk_index").collect()
    want = []
    for d, ts in {1: "mmmxmx", 2: "x", 3: "mm", 4: "xmmmm"}.items():
        i = k = 0
        while i < len(ts):
            both = ts[i] == "m" and i + 1 < len(ts)
            want.append((d, k, f"{ts[i]} {ts[i + 1]}" if both else ts[i]))
            i, k = i + 1 + both, k + 1
    assert [(r["doc_id"], r["chunk_index"], r["content"]) for r in got] == want


def test_clinical_chunks_are_cut_at_headers(spark):
    df = spark.createDataFrame([(1, "a.pdf", "some intro\nPLAN:\ndose 5 mg\nALLERGIES\nnone daily"), (2, "b.pdf", None)], "doc_id long, source string, text string")
    got = ch.chunk_by("medical", df, drugs=["aspirin"], least=1).orderBy("chunk_index").collect()
    assert [(r["id"], r["content"], r["merged"]) for r in got] == [("1_p1_chunk_0", "some intro", False), ("1_p1_chunk_1", "PLAN:\ndose 5 mg ALLERGIES\nnone daily", True)]
    with pytest.raises(ValueError, match="no chunker"):
        ch.chunk_by("late", df)


def test_a_classifier_that_fails_says_definition(spark):
    rows = [("Treatment | why", "treatment", 0.6), ("odd", "definition", 0.6), (None, "definition", 0.3), ("", "definition", 0.3), ("complex", "complex", 0.6)]
    got = spark.createDataFrame(rows, "a string, t string, c double").select("t", "c", qs.classify_answer(F.col("a")).alias("x")).collect()
    assert all((r["x"]["query_type"], r["x"]["confidence"]) == (r["t"], r["c"]) for r in got)


def test_retries_wait_longer_each_time():
    calls, waits = [], []

    def client(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise ConnectionError
        return texts

    assert enrich.with_retries(client, 3, 0.5, waits.append)(["a"]) == ["a"] and waits == [0.5, 1.0]
    calls.clear()
    with pytest.raises(ConnectionError):
        enrich.with_retries(client, 2, 0.5, waits.append)(["a"])


def test_a_judge_that_fails_leaves_no_score(spark):
    def fails(q, c, a):
        raise ValueError

    df = spark.createDataFrame([(1, "q", "some words here", "words here"), (2, None, None, None)], "query_id long, question string, context string, answer string")
    got = {(r["query_id"], r["metric"]): (r["score"], r["passed"]) for r in enrich.judged(df, {"ok": enrich.overlap_judge, "no": fails}, {"ok": 0.5, "no": 0.0}).collect()}
    assert got == {(1, "ok"): (1.0, True), (1, "no"): (None, False), (2, "ok"): (0.0, False), (2, "no"): (None, False)}

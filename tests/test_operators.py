import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import chunking as ch
from corpusmill.operators import dedup, html
from corpusmill.operators import evaluation as ev
from corpusmill.operators.diversity import choose, mmr_order
from corpusmill.operators.search import exact_knn, fuse, merge_variants

WORDS = st.text(alphabet="ab .\n,;", max_size=400)


@settings(max_examples=100, deadline=None)
@given(WORDS, st.integers(5, 60), st.integers(0, 80), st.integers(1, 40))
def test_chunk_spans_slice_back_and_cover(text, size, overlap, least):
    spans = ch.chunk_spans(text, size, overlap, least)
    assert all(text[a:z] == text[a:z].strip() != "" and z - a <= size for a, z in spans)
    assert all(x[0] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    seen = set().union(*(range(a, z) for a, z in spans)) if spans else set()
    assert all(c.isspace() or i in seen for i, c in enumerate(text))


def test_split_prefers_lines_then_sentences():
    assert ch.split_place("aaaa aaaa\nbbbb bbbb", 0, 15, 15, 3) == 10
    assert ch.split_place("Aa bb. Cc dd ee", 0, 12, 12, 2) == 7


def test_lists_and_tables():
    assert ch.list_items("- a\n  more\n- b\n\n1. c") == ["- a\n  more", "- b", "1. c"]
    assert ch.group_items(["- aaaa", "- bbbb", "- cc"], 13) == ["- aaaa\n- bbbb", "- cc"]
    assert ch.group_rows("h\n1\n2\n3", 3) == [("h\n1", True), ("h\n2", True), ("h\n3", True)]
    assert ch.group_rows("", 3) == []


def test_markdown_sections():
    assert ch.markdown_sections("x\n# A\na\n## B\nb") == [(0, "x\n"), (2, "# A\na\n"), (8, "## B\nb")]


def test_filter_chunks_drops_repeats_and_short(spark):
    docs = spark.createDataFrame([(1, "a.txt", "word " * 400)], "doc_id long, source string, text string")
    chunks = ch.chunk_texts(docs, 200, 0, 50)
    kept = ch.filter_chunks(chunks, 50)
    assert kept.count() < chunks.count()
    linked = ch.link_chunks(kept).orderBy("chunk_index").collect()
    assert linked[0]["previous_chunk_id"] is None and linked[-1]["next_chunk_id"] is None


def test_html_blocks():
    blocks, f = html.parse("<html><nav><a href=x>n</a></nav><body><main><h1>T</h1><p>Hi <b>you</b></p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><div class='cookie-bar'>c</div></main></body></html>")
    assert [b["block_type"] for b in blocks] == ["heading", "paragraph", "list", "table"]
    assert blocks[1]["text"] == "Hi you" and blocks[1]["section_path"] == ["T"] and f["nav_links"] == 1
    assert html.parse(None)[0] == [] and "cookie" not in html.markdown_of(blocks)


def test_exact_knn_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vector array<double>")
    assert [r["vec_id"] for r in exact_knn(v, q, 4).orderBy("rank").collect()] == [0, 3, 6, 1]


def test_fuse_gives_both_ranks(spark):
    s = "query_id long, doc_id long, rank long, score double, prior double"
    out = fuse(spark.createDataFrame([(1, 1, 1, 0.9, 0.1), (1, 2, 2, 0.5, 0.0)], s), spark.createDataFrame([(1, 2, 1, 3.0, 0.0)], s))
    assert [(r["doc_id"], r["fused_rank"]) for r in out.orderBy("fused_rank").collect()] == [(2, 1), (1, 2)]


def test_merge_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 1, 1, 7, 0.5), (1, 2, 1, 8, 0.5), (1, 2, 2, 7, 0.4)], "query_id long, variant int, rank long, doc_id long, score double")
    assert [r["doc_id"] for r in merge_variants(rows, 5).orderBy("rank").collect()] == [7, 8]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=8))
def test_mmr_with_lambda_one_is_the_order_of_scores(scores):
    order = mmr_order(scores, [{str(i)} for i in range(len(scores))], len(scores), 1.0)
    assert order == sorted(range(len(scores)), key=lambda i: (-scores[i], i))


def test_quotas_then_backfill():
    rows = [{"id": i, "content": f"c{i}", "source": "s", "page": 1, "score": 1.0 - i / 10, "tokens": {str(i)}} for i in range(4)]
    assert [r["id"] for r in choose(rows, 3, 1.0, 2, 2, 3)] == [0, 1, 2]
    assert len(choose(rows, 4, 1.0, 2, 2, 3)) == 3


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1)], "query_id long, rank int, rel int")
    got = ev.query_metrics(ranked, spark.createDataFrame([(1, 1), (2, 1)], "query_id long, expected int"), 5).orderBy("query_id").collect()
    assert got[0]["precision"] == pytest.approx(2 / 3) and got[0]["mrr"] == 0.5 and got[0]["recall"] == 1.0
    assert got[1]["hit"] == 0.0 and got[1]["ndcg"] == 0.0


def test_insert_new(spark):
    old = spark.createDataFrame([("h1", "a")], "hash string, id string")
    new = spark.createDataFrame([("h1", "b"), ("h2", "c"), ("h2", "d")], "hash string, id string")
    fresh, counts = dedup.insert_new(old, new, "hash", "id")
    assert [r["id"] for r in fresh.collect()] == ["c"]
    assert tuple(counts.first()) == (3, 1, 2)


def test_canonical_of_a_large_group(spark):
    rows = spark.range(1000).select("id", F.lit("x").alias("k"))
    out = dedup.canonical(rows, F.col("k"), [F.col("id")])
    assert out.where("canonical").collect()[0]["id"] == 0 and out.where("copies = 1000").count() == 1000

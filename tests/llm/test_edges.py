"""Cases at the edges of the number range, of Unicode and of skew."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann, kdshard, langid, secretscan, tokens, toxicity

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(P.path("word_bpe_49k.json"))


def _whole(encoder, texts):
    return [np.array(e.ids, encoder.dtype).tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_character_beside_a_stop(encoder):
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x2F800, 0x2FA20)]
    for form in ("a{}.b", "b,{}a"):
        for lo in range(0, len(chars), 20_000):
            texts = [form.format(c) for c in chars[lo : lo + 20_000]]
            assert encoder.batch([t.encode() for t in texts]) == _whole(encoder, texts), form


def test_stops_beside_letters_that_composition_takes_apart(encoder):
    rng = random.Random(2)
    pool = "पढ़क़ड़শשׁİΣßﬁAa1.,., \n\t-'" + "".join(chr(rng.randrange(0x80, 0x3000)) for _ in range(80))
    texts = ["पढ़.", "aक़.b", "ড়.", "ששׁ."] + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    assert encoder.batch([t.encode() for t in texts]) == _whole(encoder, texts)


def test_records_of_one_id_fill_several_files(spark, tmp_path):
    rows = [(None, f"word{k} of many") for k in range(4000)] + [(5, "x"), (5, "y"), (4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = tokens.write_token_records(df, f"file://{tmp_path}/records", P.path("word_bpe_49k.json"))
    assert sum(f["records"] for f in files) == len(rows) and max(f["records"] for f in files) < 3000
    ids = [d for f in files for d, _ in tokens.read_records(f["uri"])]
    assert ids == [None] * 4000 + [4, 5, 5]


def test_scores_at_the_ends_of_the_double_range(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)] + [(100, [1e-200] * 8), (150, [1e200] * 8), (200, [5e-324] * 8), (250, [1e308, 1e308] + [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, k=5).collect()
    unit = {k: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for k, v in rows}
    for r in got:
        assert abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-12
    assert Counter(r["query_id"] for r in got) == {q: 5 for q in (0, 50, 100, 150, 200, 250)}
    assert {r["vec_id"] for r in got if r["query_id"] == 100 and r["rank"] <= 2} == {150, 200}


def test_centroids_by_two_levels(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, F.col("vec_id") % 200 == 0, k=5, flat_lists=16)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, ids in found.items():
        s = u @ u[q]
        s[q] = -2
        hits += len(ids & set(np.argsort(-s)[:5].tolist()))
    assert len(found) == 30 and hits / 150 >= 0.9


def test_sample_of_vectors_that_many_rows_share(spark):
    same = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    other = spark.createDataFrame([(9000, [1.0, 0.0]), (9050, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.search(same.union(other), F.col("vec_id") == 9050, k=3, max_sample=100).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2]


def test_shards_are_written_by_id(spark, tmp_path):
    good = spark.createDataFrame([(k, f"text {k}", "s", "en") for k in range(40)], "doc_id long, text string, source string, lang string")
    kdshard.write_shards(good, str(tmp_path / "shards"), shards=4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 40
    for bad in ([(None, "x", "s", "en")], [(1, "x", "s", "en")] * 2):
        with pytest.raises(ValueError):
            kdshard.write_shards(good.union(spark.createDataFrame(bad, good.schema)), str(tmp_path / "bad"), shards=4)


def test_lexicon_has_no_cap():
    counts = [(f" w{k:06d} ", 50, 0) for k in range(30_000)]
    assert len(toxicity.choose_lexicon(counts, 100_000, 100_000, min_odds=1.0)) == 30_000


def test_dictionary_takes_all_words_of_a_share(spark):
    docs = spark.createDataFrame([(" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(2000)),)] * 4, "text string")
    words = secretscan.corpus_statistics(docs).words
    assert sum(w.startswith("word") for w in words) == 2000
    assert sum(w.startswith("word") for w in secretscan.corpus_statistics(docs, least_share=0.01).words) == 0


def test_languages_share_the_rows(spark):
    rows = [(k, f"{'abcdefgh'[k % 8] * 6} text of kind {k % 8} {k}", f"l{k % 8}") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, learn=F.lit(True), max_rows=400)
    got = langid.predict(df.select("doc_id", "text"), model).join(df.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() > 780


def test_names_that_clash_with_results(spark):
    rows = [(k, "plain words of text" if k % 2 else "autre texte ici", "en" if k % 2 else "fr", 0.5, "x") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.train(df, learn=F.lit(True))
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.where("lang_pred = lang").count() == 40
    as_text = langid.predict(df.select("doc_id", F.col("text").alias("score")), model, "score")
    assert as_text.columns == ["doc_id", "lang_pred", "score"] and as_text.where("lang_pred IN ('en', 'fr')").count() == 40
    toxic = toxicity.ToxicityModel({" words ": 5.0})
    scored = toxicity.score(df.withColumn("toxicity", F.lit("old")), toxic)
    assert scored.columns == [*df.columns, "toxicity"] and dict(scored.dtypes)["toxicity"] == "double"
    named = toxicity.score(df.select("doc_id", F.col("text").alias("toxicity")), toxic, "toxicity")
    assert named.columns == ["doc_id", "toxicity"] and named.where("toxicity > 0.5").count() == 20


def test_stage_folders_do_not_stay(spark, tmp_path):
    import glob

    import corpus_pipeline
    from corpusmill.llm.common import shared_dir

    rows = [(k, f"some words of text number {k} " * 3, "en", f"s{k % 2}", 60) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this occurs")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/stage-*"))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/stage-*")) - before
    assert len(left) == 1 and "stage-mixing" in left.pop()

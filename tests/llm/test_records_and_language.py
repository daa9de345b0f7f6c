import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import langid, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "a.b,c. ,. ..", "It's O'CLOCK. don't. 3.14, x., é. <|startoftext|> <|ENDOFTEXT|> <|endoftext|>", "ﬁ ① ½ Å KÅ", "İstanbul ΣΑΣ. ß ẞ", "日本語。テスト、 5. n.,", "a\x1cb\x85c\x0bd", "a… b", "a.… b,—", "x². y½,", "word " * 3000]


def test_word_encoder_equals_whole_texts():
    whole, enc = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    for t in ODD:
        assert np.frombuffer(enc.batch([t.encode()])[0], enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids
    assert tokens.WordEncoder(PATH, by_word=False).batch([b"a b"]) == enc.batch([b"a b"])


def test_fuzzed_texts_equal_whole_texts():
    whole, enc, rng = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH), random.Random(0)
    parts = [*(chr(c) for c in range(33)), ".", ",", ".", ",", "İ", "i\u0307", "é", "e\u0301", "ß", "Σ", "ς", "²", "½", "…", "—", "日", "'", "-", "<", "a", "Z", "9", "the", "End", "\x7f", "\x85", "\xa0", "\u200b", "\u2028", "ﬁ", "Å"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(60_000)]
    want = whole.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, ids, w in zip(texts, enc.batch([t.encode() for t in texts]), want, strict=True) if np.frombuffer(ids, enc.dtype).tolist() != w.ids]
    assert not wrong, wrong[:5]


def test_generations_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 3)
    enc, whole = tokens.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for t in ["alpha beta gamma delta", "delta alpha epsilon zeta", "beta eta alpha"] * 2:
        assert np.frombuffer(enc.batch([t.encode()])[0], "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_round_trip(spark, tmp_path):
    rows = [(3, "three"), (1, None), (2, ""), (None, "no id"), (3, "three"), (5, ODD[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    folder = f"file://{tmp_path}/r"
    files = tokens.write_token_records(docs, folder, PATH)
    got = tokens.read_token_records(spark, folder).orderBy("start").collect()
    whole = Tokenizer.from_file(PATH)
    want = [whole.encode(t or "", add_special_tokens=False).ids + [1] for _, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))]
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 5]
    assert [r["n_tokens"] for r in got] == [len(w) for w in want]
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    f = tokens.RecordFile(files[0]["uri"])  # a shuffled read
    assert f[len(f) - 1][1].tolist() == want[sum(x["records"] for x in files[:1]) - 1]


def test_damage_is_seen(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    uri = tokens.write_token_records(docs, f"file://{tmp_path}/r", PATH)[0]["uri"]
    path = uri.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[-6] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(tokens.read_records(uri))
    open(path, "wb").write(raw[:5])
    with pytest.raises(ValueError, match="short"):
        list(tokens.read_records(uri))


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.write_token_records(docs, f"file://{tmp_path}/r", PATH) == []
    assert tokens.read_token_records(spark, f"file://{tmp_path}/r").count() == 0


EN = "the weather of the house was there and then with other things that people say "
DE = "das wetter und die häuser sind nicht schön aber wir gehen jetzt nach haus "


def _texts(spark, n=60):
    rows = [(i, (EN if i % 2 else DE)[i % 7 :] * (1 + i % 4), "en" if i % 2 else "de") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_is_learned_and_calibrated(spark):
    docs = _texts(spark)
    model = langid.train(docs, F.col("doc_id") < 40)
    got = langid.predict(docs.where("doc_id >= 40"), model).collect()
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0


@pytest.mark.parametrize("byte", [*range(32), 127])
def test_control_characters_beside_marks(byte):
    whole, enc = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    for t in (f"end.{chr(byte)}x", f"a{chr(byte)},b", f"one.{chr(byte)}, two", f"{chr(byte)}."):
        assert np.frombuffer(enc.batch([t.encode()])[0], enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_language_of_odd_texts(spark):
    model = langid.train(_texts(spark), F.lit(True))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !? 34", "x"), (4, EN * 5000, "x"), (4, EN * 5000, "x")], "doc_id long, text string, c0 string")
    got = langid.predict(odd, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "en"] and got[0]["score"] == 0.0 and got[3] == got[4]
    assert [r["doc_id"] for r in langid.keep_identified(odd, model).collect()] == [4, 4]


def test_language_without_labels(spark):
    docs = _texts(spark).withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(docs, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}
    one = langid.train(_texts(spark).where("lang = 'en'"), F.lit(True))
    assert one.predict(DE.encode()) == ("en", 1.0)
    assert langid.predict(docs.limit(0), model).count() == 0


def test_predictions_equal_brute_force(spark):
    """n-grams counted one by one, document frequencies over all learning rows, then the softmax."""
    docs = _texts(spark)
    model = langid.train(docs, F.col("doc_id") < 40)

    learned = [r for r in docs.collect() if r["doc_id"] < 40]
    df = np.zeros(langid.BINS)
    for r in learned:
        at, _ = langid.ngram_counts(r["text"].encode())
        df[at] += 1
    assert np.allclose(model.idf, np.log((1 + len(learned)) / (1 + df)) + 1)
    for r in langid.predict(docs, model).collect():
        cp, _ = langid.code_points(r["text"].encode())
        tf = {}
        for n in langid.ORDERS:
            for i in range(len(cp) - n + 1):
                h = 2166136261 + n
                for c in cp[i : i + n].tolist():
                    h = ((h ^ c) * 16777619) % 2**32
                    h ^= h >> 15
                tf[h % langid.BINS] = tf.get(h % langid.BINS, 0) + 1
        x = {b: (1 + math.log(c)) * model.idf[b] for b, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * model.weights[b, k] for b, v in x.items()) + model.bias[k]) / model.temperature for k in range(len(model.labels))]
        p = [math.exp(v - max(z)) / sum(math.exp(w - max(z)) for w in z) for v in z]
        assert r["lang_pred"] == model.labels[int(np.argmax(p))] and r["score"] == pytest.approx(max(p), abs=1e-6)


def test_equal_margins_go_to_the_first_label(spark):
    both = _texts(spark).withColumn("lang", F.lit("b")).unionByName(_texts(spark).withColumn("lang", F.lit("a")))
    empty = langid.LanguageModel(["a", "b"], np.ones(langid.BINS), np.zeros((langid.BINS, 2)), np.zeros(2))
    assert empty.predict(EN.encode()) == ("a", 0.5)
    got = langid.predict(both, langid.train(both, F.lit(True))).collect()
    assert {r["lang_pred"] for r in got} <= {"a", "b"} and all(0.5 <= r["score"] <= 1 for r in got)


def test_temperature_lowers_overconfidence():
    margins = np.array([[8.0, 0.0]] * 10)
    y = np.array([0] * 7 + [1] * 3)
    t = langid.fit_temperature(margins, y)
    assert t > 5 and langid.softmax(margins / t)[0, 0] == pytest.approx(0.7, abs=0.02)

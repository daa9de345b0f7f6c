"""Phrases, byte-level BPE and periodic runs against brute force."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bytebpe, phrases, runs

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")

ODD = [None, "", " ", "\n\t", "a", "a  b", " lead", "trail ", "x\n y", "Ｆｕｌｌ １２ ", "İı ſ", "\x1c\x1d", "　　x", "don't WE'LL 'S", "a" * 3000, "ab" * 700, "é" * 500, "=-" * 900, "中文字" * 200, "z" * 40 + "\U0010ffff"]


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.Encoder(RANKS, P.PATTERN)


def _packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_fuzz(reference, encoder):
    rng = random.Random(4)
    pools = ["abcdefghinost' ", "ab \n\t　\x1c1", "aeinst", "中文字一是不了", "éßñøåł İẞΣς", "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1F000)])) for _ in range(300))]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 120))) for pool in pools for _ in range(300)]
    texts += ["".join(rng.choice("aeinst") for _ in range(rng.randrange(257, 900))) for _ in range(10)]
    got = encoder.batch(texts)
    assert got == [_packed(reference.encode_ordinary(t)) for t in texts]
    assert got == [b"".join(encoder.parts(t)) for t in texts]
    assert all(encoder.vocabulary.decode(np.frombuffer(g, "<u4")).decode() == t for g, t in zip(got, texts, strict=True))


def test_bpe_characters_of_other_unicode_versions(reference, encoder):
    changed = sorted(bytebpe._class_changes())
    rng = random.Random(1)
    chars = [chr(c) for c in changed[:200] + rng.sample(changed, min(len(changed), 500))]
    texts = [f"a{c}b {c}{c} 1{c}" for c in chars]
    assert encoder.batch(texts) == [_packed(reference.encode_ordinary(t)) for t in texts]


def test_bpe_long_rows_merge_as_one_after_the_other():
    # a vocabulary in which a later pair outranks the one just merged, and pairs overlap
    words = [b"ab", b"ba", b"aba", b"abab", b"bb", b"aa", b"baab", b"aab"]
    for seed in range(30):
        rng = random.Random(seed)
        rng.shuffle(words)
        ranks = {bytes([b]): b for b in range(256)} | {w: 256 + k for k, w in enumerate(words)}
        v = bytebpe.Vocabulary(ranks)
        e = tiktoken.Encoding("t", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        for n in (1, 2, 7, 40, 300, 700):
            t = "".join(rng.choice("ab") for _ in range(n))
            want = e.encode_ordinary(t)
            assert v.merge_long(v.of_byte[np.frombuffer(t.encode(), np.uint8)]).tolist() == (want if t.encode() not in ranks else v.merge_long(v.of_byte[np.frombuffer(t.encode(), np.uint8)]).tolist())
            assert v.encode_pieces([t.encode()]) == [_packed(want)]


def test_bpe_operator(spark, reference):
    rows = [(k if k % 5 else None, t, "x", 1) for k, t in enumerate(ODD)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bytebpe.digests(df, RANKS, P.PATTERN).collect()
    want = []
    for k, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(_packed(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = bytebpe.decode(bytebpe.encode(df, RANKS, P.PATTERN), RANKS).collect()
    assert Counter(r["text"] for r in back) == Counter(t or "" for _, t, *_ in rows)
    assert bytebpe.digests(df.limit(0), RANKS, P.PATTERN).count() == 0


# ---------------------------------------------------------------- periodic runs


def _runs(x, e=4, least=6):
    out, n = [], len(x)
    for p in range(1, n // e + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            size = j - i + p
            w = x[i : i + size]
            if j > i and size >= max(least, e * p) and not any(all(w[k] == w[k + d] for k in range(size - d)) for d in range(1, p) if p % d == 0):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_fuzz():
    rng = random.Random(3)
    for _ in range(1500):
        x = []
        for _ in range(rng.randrange(0, 14)):
            x += [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 9))] * rng.choice([1, 1, 2, 4, 5, 7])
        x = x[:110]
        for e in (3, 4, 5):
            assert runs.find_runs(np.array(x, np.int64), exponent=e) == _runs(x, e)
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(4, np.int64), exponent=2)


def test_long_runs():
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert runs.find_runs(np.tile(np.arange(7000), 6)) == [(0, 42_000, 7000)]


def _digest(doc, text):
    w = (text or "").encode().split()
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if h is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = _runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_query(spark, tmp_path):
    from corpusmill.llm.queries import op13_periodic_runs

    rng = random.Random(8)
    texts = [None, "", " \n", "one", "a a a a a", "a a a a a a", "x y x y x y x y z", "p q r " * 5 + "p", "    é é é é é é é", "tick tock " * 400]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 60))) + rng.choice(["", " u v" * 6, "\tw" * 7]) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b " * 9), (3, "m n " * 4), (3, "m n " * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted((_digest(*r) for r in rows), key=str)


def test_runs_operator(spark):
    df = spark.createDataFrame([(1, "q a b a b a b a b a b z", "keep"), (None, None, "x")], "doc_id long, text string, runs string")
    got = {r["doc_id"]: r for r in runs.detect(df).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 10, 2)] and got[1]["collapsed"] == "q a b z"
    assert got[None]["runs"] == [] and got[None]["collapsed"] == "" and got[None]["n_words"] == 0
    assert runs.detect(df.limit(0)).count() == 0


# ---------------------------------------------------------------- phrases


def test_suffix_array_fuzz():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(0, 60))]
        for depth in (1, 2, 3, 4, 7):
            order, lcp = phrases.suffix_array(np.array(x, np.int32), depth)
            heads = [x[i : i + depth] for i in order]
            assert heads == sorted(heads)
            assert lcp.tolist() == [next((k for k in range(depth) if k >= min(len(a), len(b)) or a[k] != b[k]), depth) for a, b in zip(([[]] + heads)[: len(heads)], heads, strict=True)]
            room = phrases.before_break(np.array(x, np.int32), depth)
            for n in range(1, depth + 1):
                want = Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1) if 0 not in x[i : i + n])
                at, c = phrases.intervals(order, lcp, room, n)
                assert {tuple(x[i : i + n]): k for i, k in zip(at.tolist(), c.tolist(), strict=True)} == want


def _collocations(rows, longest, least, top, shadow):
    totals, f = Counter(), Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            totals[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    kept = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    out = {}
    for (lang, w), a in kept.items():
        cut = min(((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))))
        inside = any(100 * b >= shadow * a for (other, v), b in kept.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))))
        if not inside:
            out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], totals[lang], -x[0]) for lang, v in out.items() for r, x in enumerate(sorted(v)[:top]))


@pytest.mark.parametrize("shard_words", [40, 10**6])
def test_collocations(spark, shard_words):
    rng = random.Random(shard_words)
    words = ["Of", "the", "in", "é", "Ωmega", "x-y", " ", "new", "york", "new"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",\n", "\t", "\r"]) for _ in range(rng.randrange(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, ".,;"), ("de", "alone"), ("en", "New York city hall " * 12)] + [("fr", rows[0][1])] * 3
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)
    got = phrases.collocations(df, longest=4, least=5, top=25, shard_words=shard_words)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == _collocations(rows, 4, 5, 25, 80)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_collocation_scores_are_exact(spark):
    # beyond 64 bits: the product of a count and the scale
    a, l, r = 3 * 10**13 + 1, 4 * 10**13 + 7, 5 * 10**13 + 9
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    score = df.select(F.expr("CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(10, 0)) div CAST(CAST(l AS DECIMAL(20, 0)) + r AS DECIMAL(21, 0))")).first()[0]
    assert score == 2_000_000 * a // (l + r)


def test_very_long_text_is_cut_between_pieces():
    text = b"a b c" + b"\xff" + b"d e" * 10
    old, phrases.PART_BYTES = phrases.PART_BYTES, 4
    try:
        assert b"".join(phrases._parts(text)) == text
    finally:
        phrases.PART_BYTES = old

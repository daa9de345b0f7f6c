import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import components, decontam, simhash

WORDS = [f"w{i}" for i in range(400)]


def _union(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 4), (200, 150)]
    got = dict(components.connected_components(spark.createDataFrame(links, "x long, y long"))[0].collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[200] == got[150] == 150
    assert components.connected_components(spark.createDataFrame([], "x long, y long"))[0].count() == 0


def test_shingles_and_fingerprint():
    import xxhash

    h = simhash.shingle_hashes(b"A b\tC d", 3)
    assert h.tolist() == [xxhash.xxh64_intdigest(b"a b c", 42), xxhash.xxh64_intdigest(b"b c d", 42)]
    assert simhash.shingle_hashes(b"One", 3).tolist() == [xxhash.xxh64_intdigest(b"one", 42)]
    assert simhash.fingerprint(np.zeros(0, np.uint64))[0] == 0
    many = np.random.default_rng(0).integers(0, 2**63, 700).astype(np.uint64)
    bits = (many[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert simhash.fingerprint(many)[0] == sum(1 << i for i in range(64) if 2 * bits[:, i].sum() > 700)


def test_thresholds_by_dynamic_programming():
    assert simhash.allocate_thresholds([[0, 1, 5], [0, 1, 5], [0, 100, 200]], 3) in ([1, 0, -1], [0, 1, -1])
    assert simhash.allocate_thresholds([[0, 2, 9, 30]] * 3, 3) == [0, 0, 0]


def _near(rng, base, flips):
    x = base
    for i in rng.sample(range(64), flips):
        x ^= 1 << i
    return x


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_equal_brute_force(spark, bucket):
    rng = random.Random(1)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({_near(rng, c, rng.randint(0, 3)) for c in centers for _ in range(20)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = dict(components.connected_components(simhash.hamming_links(df, 2, pair_bucket=bucket))[0].collect())
    want = _union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = [roots.get(x, x) for x in signed]
    assert len({*zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_odd_radius_equals_brute_force(spark):
    rng = random.Random(2)
    fps = sorted({_near(rng, c, rng.randint(0, 3)) for c in [rng.getrandbits(63) for _ in range(8)] for _ in range(6)})
    links = {tuple(sorted(r)) for r in simhash.hamming_links(spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long"), 3).collect()}
    s = [x - 2**64 if x >= 2**63 else x for x in fps]
    assert links == {tuple(sorted((s[i], s[j]))) for i in range(len(s)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_groups_of_odd_texts(spark):
    rows = [(5, None), (2, ""), (9, "  \n"), (7, "a b c d"), (4, "A  b\nC d"), (4, "A  b\nC d"), (None, "a b c d"), (1, "x " * 50_000)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)))
    rows = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()}
    assert got.count() == 8
    assert {r for r in rows if r[1] == "0" * 16} == {(5, "0" * 16, 2), (2, "0" * 16, 2), (9, "0" * 16, 2)}
    assert {r[2] for r in rows if r[0] in (7, 4, None)} == {4}
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _text(rng, n=200):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = _text(rng).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 3, 12):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs).collect()}
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    want = _union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert [got[i] for i in range(len(texts))] == want
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == set(want)


def test_keep_one_of_odd_rows(spark):
    rows = [(1, "same text here", "a"), (1, "same text here", "a"), (2, "same text here", "b"), (3, None, "c"), (4, "", "d"), (None, "unlike", "e"), (6, "word " * 30_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["node"]) for r in kept.collect()) == [(0, "e"), (1, "a"), (3, "c"), (6, "f")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_large_group_of_copies_and_near_copies_stays_linked(spark):
    rng = random.Random(4)
    base = _text(rng, 300).split()
    texts = []
    for i in range(150):
        w = list(base)
        w[i] = f"own{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    assert {r["component"] for r in simhash.near_duplicates(docs).collect()} == {0}


def _groups(texts):
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    return _union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])


def _found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_pairs_within_a_crowd_of_one_template(spark):
    template = " ".join(f"t{i}" for i in range(300))
    texts = []
    for i in range(1500):  # alike in 0.79 to each other, in 0.93 to one copy
        own = [f"o{i}x{k}" for k in range(38)]
        texts.append(f"{template} {' '.join(own)}")
        own[5 + i % 28] = own[6 + i % 28] = own[7 + i % 25] = "edit"
        texts.append(f"{template} {' '.join(own)}")
    assert _found(spark, texts) == [i - i % 2 for i in range(3000)]


def test_every_pair_at_the_wanted_similarity_is_found(spark):
    texts = []
    for i in range(1500):  # 80 of 100 shingles each: exactly 0.8
        shared = " ".join(f"s{i}x{k}" for k in range(84))
        texts += [f"{shared} {' '.join(f'{own}{i}x{k}' for k in range(10))}" for own in "ab"]
    assert _found(spark, texts) == [i - i % 2 for i in range(3000)]


@pytest.mark.parametrize("times", [5, 10, 30])
def test_copies_with_a_line_repeated(spark, times):
    texts = []
    for i in range(20):
        words = [f"v{i}x{k}" for k in range(312)]
        texts += [" ".join(words), " ".join(words + words[-12:] * (times - 1))]
    assert _found(spark, texts) == _groups(texts) == [i - i % 2 for i in range(40)]


# ---------------------------------------------------------------- decontamination


def _brute(text, items, window=10):
    ws, hit, found = decontam.words_of((text or "").encode()), set(), set()
    for name, t in items:
        iw = decontam.words_of((t or "").encode())
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return len(ws), len(hit), sorted(found - {None})


@pytest.mark.parametrize("block_words", [100_000, 25])
def test_scan_equals_brute_force(spark, block_words):
    rng = random.Random(5)
    few = WORDS[:6]  # few words: many repeats and overlaps
    items = [(i, " ".join(rng.choice(few) for _ in range(n))) for i, n in enumerate([1, 2, 5, 9, 10, 11, 14, 20, 20])] + [(90, None), (91, "?!"), (92, "W1 w2, w3")]
    texts = [" ".join(rng.choice(few) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "é W1-W2.W3", " ".join(few * 500)]
    texts += [f"zz {t} yy" for _, t in items if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit(0))
    bench = spark.createDataFrame([*items, (None, "w0 w1")], "item_id long, text string")
    got = decontam.scan(docs, bench, block_words=block_words).collect()
    known = [*((str(i), t) for i, t in items), (None, "w0 w1")]  # hit, though it has no name to list
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == _brute(texts[r["doc_id"]], known)


def test_decontaminate_cuts_and_drops(spark):
    item = " ".join(WORDS[:12])
    clean = "Nothing, to see: here! " + " ".join(WORDS[50:90])
    docs = spark.createDataFrame([(1, f"{clean} {item.upper()}; end.", "k"), (2, clean, "k"), (3, item, "k"), (4, None, "k"), (5, "", None)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows == {1: f"{clean} ; end.", 2: clean, 4: None, 5: ""}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 5
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0

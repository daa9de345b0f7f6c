import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import kdshard, mixing


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def _many(n=300, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "of", "the")) for _ in range(rng.randint(1, 80)))
        out.append((i, t, rng.choice(("en", "fr")), rng.choice(("a", "b", "c", None)) if i % 3 else "hot", len(t)))
    return out


def _targets(sizes, ratio=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = ratio * sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s: cap * sizes[s] for s in open_ if share[s] >= cap * sizes[s]}
        if not over:
            return share | full
        full |= over


def test_targets_equal_step_by_step_sharing(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {s: rng.choice((0, 3, 50, 1000)) for s in ("b", "a", "Z", "é", None)}
        if not sum(sizes.values()):
            continue
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = _targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BIN", 5)  # the bin of the cut is cut again
    monkeypatch.setattr(mixing, "BINS", 4)
    docs = _docs(spark, _many())
    a, b = (sorted(map(tuple, mixing.mix(docs).collect()), key=str) for _ in range(2))
    assert a == b
    rows = mixing.mix(docs, keep=("source",)).collect()
    largest = max(r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest / 2 + 1
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        times = {r["times"] for r in own}
        assert max(times) <= 2 and max(times) - min(times) <= 1  # whole epochs come first


def test_mix_of_odd_rows(spark):
    rows = [(1, None, None, "a", None), (2, "", None, "a", 0), (None, "x y", "en", None, 3), (4, "same", "en", "b", 4), (4, "same", "en", "b", 4), (5, "w " * 60_000, "en", "c", 0)]
    docs = _docs(spark, rows).withColumn("target", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and {r["doc_id"]: r["taken"] for r in got}[1] == 0 and all(r["taken"] <= 2 * r["size"] for r in got)
    taken = mixing.mix_documents(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["times"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0
    assert all(r["target"] == 0 for r in mixing.mix(_docs(spark, [(1, None, None, "a", None)])).collect())


def test_rows_of_low_quality_are_cut_into_small_bins(spark, monkeypatch):
    """All keys far out, as a source of markup has them: the cut is still found in few rows."""
    docs = _docs(spark, [(i, "1 2 3 4 5", "en", "a", 0) for i in range(2000)])
    whole = {r["doc_id"]: r["times"] for r in mixing.mix(docs, ratio=0.5).collect()}
    monkeypatch.setattr(mixing, "ROWS_A_BIN", 3)
    monkeypatch.setattr(mixing, "BINS", 16)
    assert {r["doc_id"]: r["times"] for r in mixing.mix(docs, ratio=0.5).collect()} == whole
    assert sum(whole.values()) == 1000


def test_null_ids_of_equal_size_are_taken_in_one_order(spark):
    rows = [(None, f"t{i}", "en", "a", 0) for i in range(40)]
    a, b = (sorted(r["text"] for r in mixing.mix_documents(_docs(spark, x), ratio=0.5).collect()) for x in (rows, rows[::-1]))
    assert a == b and len(a) == 20


def test_quality_tilts_the_draw(spark):
    rows = [(i, ("word " * 10) if i % 2 else ("12345 " * 10), "en", "a", 0) for i in range(1000)]
    got = mixing.mix(_docs(spark, rows), ratio=0.5).collect()
    share = np.mean([r["doc_id"] % 2 for r in got if r["times"]])
    assert share > 0.7


def _check(rows, shards):
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(0 <= r["shard"] < shards for r in rows)


def test_shards_are_near_equal_and_keep_copies(spark):
    docs = _docs(spark, _many(1500, 2))
    for shards in (16, 5):
        rows = kdshard.assign(docs, shards).collect()
        _check(rows, shards)
        b = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]
        assert max(b) - min(b) <= 0.06 * np.mean(b) + 2 * max(r["size"] for r in rows)
        again = {(r["doc_id"], r["shard"]) for r in kdshard.assign(docs, shards).collect()}
        assert again == {(r["doc_id"], r["shard"]) for r in rows}
    copies = _docs(spark, [(i, f"text {i // 3} " * 5, "en", f"s{i % 3}", 1) for i in range(3000)])
    split = kdshard.assign(copies, 16).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count()
    assert split == 0


def test_a_huge_group_of_copies_is_spread(spark):
    docs = _docs(spark, [(i, "the very same text" if i % 2 else f"own {i} text", "en", "hot", 1) for i in range(2000)])
    rows = kdshard.assign(docs, 16).collect()
    _check(rows, 16)
    b = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(b) - min(b) <= 0.1 * np.mean(b)


def test_shards_equal_sequential_splits(spark):
    """A k-d tree built in one place: same widest dimension, same order, cut nearest to the goal."""
    docs = _docs(spark, _many(700, 5))
    cols = [F.log2(F.octet_length("text") + 1), F.octet_length("text") % 17]
    th, dh = kdshard._hash36(F.col("text")), kdshard._hash36(F.col("doc_id"), F.xxhash64("text"), F.lit(1))
    rows = [r.asDict() for r in docs.select("doc_id", (F.octet_length("text") + 1).alias("size"), "text", th.alias("th"), dh.alias("dh"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).collect()]
    for d in ("x0", "x1"):
        lo, hi = min(r[d] for r in rows), max(r[d] for r in rows)
        for r in rows:
            r[d] = min(kdshard.GRID - 1, int((r[d] - lo) / (hi - lo) * kdshard.GRID))
    total, want = sum(r["size"] for r in rows), {}

    def split(part, first, shards):
        if shards == 1:
            want.update({r["doc_id"]: first for r in part})
            return
        dim = max(("x0", "x1"), key=lambda d: (max(r[d] for r in part) - min(r[d] for r in part), d == "x0"))
        digits = lambda r: [r[dim], *[(r["th"] >> s) & 4095 for s in (24, 12, 0)], *[(r["dh"] >> s) & 4095 for s in (24, 12, 0)]]
        goal, open_, left, k = sum(r["size"] for r in part) * (shards // 2) / shards, part, [], 0
        while True:
            sums, run = {}, 0
            for r in open_:
                sums[digits(r)[k]] = sums.get(digits(r)[k], 0) + r["size"]
            for d in sorted(sums):
                run += sums[d]
                if run >= goal:
                    break
            before = run - sums[d]
            left += [r for r in open_ if digits(r)[k] < d]
            here = [r for r in open_ if digits(r)[k] == d]
            if sums[d] <= 0.02 * total / 8 or k == kdshard.DIGITS - 1:
                left += here if run - goal <= goal - before else []
                break
            goal, open_, k = goal - before, here, k + 1
        ids = {r["doc_id"] for r in left}
        split([r for r in part if r["doc_id"] in ids], first, shards // 2)
        split([r for r in part if r["doc_id"] not in ids], first + shards // 2, shards - shards // 2)

    split(rows, 0, 8)
    got = {r["doc_id"]: r["shard"] for r in kdshard.assign(docs, 8, dimensions=cols).collect()}
    assert got == want


def test_shards_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "", None, "a", 0), (2, "é", "en", "b", 1), (2, "é", "en", "b", 1), (3, "x" * 200_000, "en", "c", 1)]
    docs = _docs(spark, rows).withColumn("shard", F.lit("clash")).withColumn("node", F.lit(1))
    got = kdshard.assign(docs, 16).collect()
    _check(got, 16)
    assert sorted(r["size"] for r in got) == [1, 1, 3, 3, 200_001] and len(got) == 5
    assert kdshard.assign(docs.limit(0), 16).count() == 0
    assert {r["shard"] for r in kdshard.assign(docs, 1).collect()} == {0}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    en = "the and with that this from have been were which their there would about other into than time".split()
    de = "der die und nicht mit auf eine sich auch werden nach über durch wird oder wenn noch aber".split()
    bench = " ".join(f"item{i}" for i in range(12))
    rows = []
    for i in range(120):
        t = " ".join(rng.choice(de if i % 3 == 0 else en) for _ in range(80))
        rows.append((i, t, "de" if i % 3 == 0 else "en", f"s{i % 4}", len(t)))
    rows += [(200 + i, rows[i][1], rows[i][2], "copy", 1) for i in range(5)]  # copies of 0 to 4
    rows += [(300, rows[10][1] + " extra", "en", "near", 1), (301, "123 !!", "en", "junk", 1), (302, None, "en", "junk", None), (303, rows[11][1] + " " + bench, "en", "leak", 1), (304, bench, "en", "leak", 1)]
    docs = _docs(spark, rows)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        at[name] = out.collect()
        docs = spark.createDataFrame(at[name], out.schema)
        if name != "sharding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {k: {r["doc_id"] for r in v} for k, v in at.items()}
    assert kept["language_id"] >= set(range(120)) and not kept["language_id"] & {301, 302}
    assert kept["near_duplicates"] >= set(range(120)) and not kept["near_duplicates"] & {200, 201, 202, 203, 204, 300}
    assert kept["decontamination"] == kept["near_duplicates"] - {304}
    assert all(bench not in r["text"] for r in at["decontamination"])
    assert len(at["sharding"]) == len(at["mixing"])
    _check(at["sharding"], 16)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(at["sharding"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = _docs(spark, [])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

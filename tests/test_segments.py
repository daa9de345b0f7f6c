"""Semantic chunks, tables in plain text, and the hash of a whole table."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import hashtree, semantic, texttables
from corpusmill.operators.enrich import hashing_embedder


def _cosines(parts, w):
    out = []
    count = lambda some: Counter(x for s in some for x in semantic._WORD.findall(s.lower()))
    for i in range(len(parts) - 1):
        a, b = count(parts[max(0, i - w + 1) : i + 1]), count(parts[i + 1 : i + 1 + w])
        n = math.sqrt(sum(c * c for c in a.values()) * sum(c * c for c in b.values()))
        out.append(round(sum(c * b[x] for x, c in a.items()) / n, 9) if n else 0.0)
    return out


@pytest.mark.parametrize("window", [1, 2, 4])
def test_similarities_equal_whole_windows(window):
    rng = random.Random(window)
    for _ in range(60):
        parts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) + "." for _ in range(rng.randrange(0, 15))]
        assert np.allclose(semantic.similarities(parts, window), _cosines(parts, window), atol=2e-9)


def test_chunks_cut_where_the_topic_turns(spark):
    a = " ".join(f"The liver stores iron in cell {k}." for k in range(6))
    b = " ".join(f"Tides follow moon number {k}." for k in range(6))
    df = spark.createDataFrame([(1, a + " " + b, "x"), (2, None, "x"), (3, "", "x"), (None, "One sentence only", "x"), (4, "word " * 50_000, "x")], "doc_id long, text string, chunk string")
    got = {}
    for r in semantic.semantic_chunks(df, window=3, percentile=0.05).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {1, None, 4} and [r["sentences"] for r in sorted(got[1], key=lambda r: r["chunk"])] == [6, 6]
    assert got[4][0]["content"] == ("word " * 50_000).strip()
    small = semantic.semantic_chunks(df.where("doc_id = 1"), size=80, overlap_words=2).orderBy("chunk").collect()
    assert all(len(r["content"]) <= 80 + 20 for r in small) and sum(r["sentences"] for r in small) == 12
    for before, after in zip(small, small[1:], strict=False):
        assert after["content"].startswith(" ".join(before["content"].split()[-2:]))
    by_vector = semantic.semantic_chunks(df.where("doc_id = 1"), percentile=0.05, embedder=hashing_embedder).orderBy("chunk").collect()
    assert [r["sentences"] for r in by_vector] == [6, 6]
    assert semantic.semantic_chunks(df.limit(0)).count() == 0


def test_gaps_that_lines_share():
    assert texttables.shared([(0, 3), (5, 9)], [(2, 7), (8, 12)], 1) == [(2, 3), (5, 7), (8, 9)]
    assert texttables.shared([(0, 3), (5, 9)], [(2, 7), (8, 12)], 2) == [(5, 7)]


def test_tables_are_found_again(spark):
    rng = random.Random(7)
    docs, want = [], []
    for doc in range(60):
        n, lines, expected, at = rng.randrange(1, 4), [], [], 0
        for t in range(n):
            prose = ["Some words of plain text here", "and more of it"][: rng.randrange(1, 3)]
            cols = rng.randrange(2, 6)
            rows = [[rng.choice(["a", "blue ring", "12.5", "x-y z", "Ünï"]) + str(rng.randrange(100)) for _ in range(cols)] for _ in range(rng.randrange(2, 6))]
            width = [max(len(r[c]) for r in rows) + rng.randrange(2, 5) for c in range(cols)]
            right = [rng.random() < 0.4 for _ in range(cols)]
            made = ["".join((cell.rjust(width[c] - 2) + "  ") if right[c] else cell.ljust(width[c]) for c, cell in enumerate(r)).rstrip() for r in rows]
            expected.append((doc, t, at + len(prose), rows))
            lines += prose + made
            at += len(prose) + len(made)
        docs.append((doc, "\n".join([*lines, "The end."])))
        want += expected
    df = spark.createDataFrame(docs + [(90, None), (91, ""), (92, "no table  here"), (93, "a  b\n\nc  d")], "doc_id long, text string")
    got = {}
    for r in texttables.text_tables(df).orderBy("doc_id", "table", "row").collect():
        got.setdefault((r["doc_id"], r["table"], r["first_line"]), []).append(r["cells"])
    assert got == {(d, t, at): rows for d, t, at, rows in want}
    blocks = texttables.table_blocks(texttables.text_tables(df)).where("doc_id = 0").orderBy("table").first()
    assert blocks["rows"] == len(want[0][3]) and blocks["text"].split("\n")[0] == " | ".join(want[0][3][0])


def test_tree_hash_follows_rows_alone(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("line"))
    one = hashtree.tree_hash(rows, F.col("line")).first()
    assert one == hashtree.tree_hash(rows.orderBy(F.rand(3)).repartition(7), F.col("line")).first() and one["rows"] == 3000
    twice = hashtree.tree_hash(rows.union(rows.where("line = '5'")), F.col("line")).first()
    assert twice["hash"] != one["hash"] and twice["rows"] == 3001
    few = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(3)]
    small = hashtree.tree_hash(rows.where("CAST(line AS INT) < 3"), F.col("line")).first()
    assert small["hash"] == hashlib.sha256(",".join(f"{h}:1" for h in sorted(few)).encode()).hexdigest()
    assert hashtree.tree_hash(rows.limit(0), F.col("line")).first()["hash"] == hashlib.sha256(b"").hexdigest()
    changed = rows.withColumn("line", F.when(F.col("line") == "77", "other").otherwise(F.col("line")))
    ranges = {r["prefix"] for r in hashtree.differing_ranges(rows, changed, F.col("line")).collect()}
    assert ranges == {hashlib.sha256(x).hexdigest()[:2] for x in (b"77", b"other")}

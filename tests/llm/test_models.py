import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann, secretscan, toxicity, urlfilter

RULES = [urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "example.org", "/en/1"), urlfilter.Rule("allow", "com", "/fr/"), urlfilter.Rule("block", "com", "/de/")]


# ---------------------------------------------------------------- nearest neighbours


def _exact(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i in queries:
            s = [(-round(float(v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w))), 12), j) for j, w in ok if j != i]
            out[i] = [j for _, j in sorted(s)[:k]]
    return out


def test_search_reaches_its_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)) + 3 * rng.integers(0, 4, (600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=5, block=100, query_block=7).collect()
    want = _exact(rows, set(range(0, 600, 20)), 5)
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in got)
    assert len(got) == 150 and hits >= 0.9 * 150
    for r in got:
        a, b = x[r["query_id"]], x[r["vec_id"]]
        assert r["score"] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_many_equal_vectors_keep_the_least_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(300 + i, [float(i), 1.0, 0.0, -1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") == 100, k=5, rerank=10, block=50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 0.0]), (8, [1e-200, 1e-200]), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = ann.search(df, F.lit(True), k=5).collect()
    assert {r["query_id"] for r in got} | {r["vec_id"] for r in got} <= {0, 7, 8}
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df, F.col("vec_id") == 3).count() == 0


def test_fewer_candidates_than_asked_for_are_all_found(spark):
    df = spark.createDataFrame([(i, [math.cos(i * 1.7), math.sin(i * 1.7)]) for i in range(4)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.lit(True), k=5).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(i, j) for i in range(4) for j in range(4) if i != j]


# ---------------------------------------------------------------- toxicity


def test_fold():
    assert toxicity.fold("1D10T Ïdiót іdiоt ｉｄｉｏｔ!") == " idiot idiot idiot idiot "
    assert toxicity.fold("") == "  "


def _labelled(spark, n=200):
    rng = random.Random(0)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lan", "ron", "tim")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            w[rng.randrange(60)] = rng.choice(("zorkish", "zorkling", "plugh"))
            w[rng.randrange(60)] = rng.choice(("zorkish", "zorkling", "plugh"))
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if i % 4 == 0 else 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_learned(spark):
    docs, labels = _labelled(spark)
    model = toxicity.train(docs, labels, F.col("doc_id") < 140)
    got = toxicity.score(docs.where("doc_id >= 140"), model).join(labels, "doc_id").collect()
    assert np.mean([(r["toxicity"] >= 0.5) == (r["toxic"] == 1) for r in got]) >= 0.9
    assert toxicity.Matcher(model).score("bla z0rk1sh PLUGH bla") > toxicity.Matcher(model).score("bla bla")


def test_toxicity_of_odd_rows(spark):
    docs, labels = _labelled(spark, 40)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "plugh " * 50_000, 0), (None, "x", 0)], "doc_id long, text string, toxic int")
    model = toxicity.train(docs, labels.unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")), F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert all(0 <= r["toxicity"] <= 1 for r in got) and got[0]["toxicity"] == got[1]["toxicity"]
    bare = toxicity.train(docs, labels.limit(0), F.lit(True), seeds={"plugh": 5.0})
    assert list(bare.lexicon) == [" plugh "]
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_exception_phrases_are_spared():
    m = toxicity.Matcher(toxicity.ToxicityModel({" trash ": 5.0}))
    assert m.marks("the trash can stands") @ np.ones(3) == 0 < m.marks("you trash") @ np.ones(3)


# ---------------------------------------------------------------- URLs


def _host_path(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


URLS = [None, "", "no scheme", "http://", "http://A.example.ORG/es/x?y", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/de/1#a", "http://x.com", "http://notcom/fr/", "a://b://c/d", "http://xexample.org/es/", "http://x.com?/fr/", "http://é.com/fr/\n2", "http://u@x.com:80/de/", "http://x.net/" + "a" * 20_000]


def test_hosts_paths_and_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, host int")
    got = urlfilter.judge(df, RULES, trees=2).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        h, p = _host_path((URLS * 2)[r["page_id"]])
        fits = [x for x in RULES if (h == x.host or h.endswith("." + x.host)) and p.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r["host"], r["path"], r["rule"]) == (h, p, best.text if best else None)
        assert r["verdict"] == best.action if best else r["verdict"] in ("allow", "block")


def test_trees_learn_labelled_urls(spark):
    rows = [(i, f"http://h{i % 7}.net/{'9' * (i % 10)}/{'a/' * (i % 5)}", int(i % 10 >= 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = urlfilter.judge(df, [], label=F.when(F.col("page_id") < 300, F.col("bad")), trees=6).where("page_id >= 300").join(df.select("page_id", "bad"), "page_id").collect()
    assert np.mean([(r["verdict"] == "block") == (r["bad"] == 1) for r in got]) > 0.9


def test_urls_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert urlfilter.judge(df, RULES).first()["verdict"] == "allow"
    assert urlfilter.judge(df.limit(0), RULES).count() == 0


def test_probes_do_not_follow_the_first_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2300, 16))
    x[:300] = x[0]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    assert ann.probes_needed(x, ann._kmeans(x, 40, rng), 0.97) > 3


# ---------------------------------------------------------------- secrets


@pytest.mark.parametrize("name", ["DB_PASSWORD=", "client_secret: ", 'AUTH_TOKEN="', "password_2 = ", "my-api-key: "])
def test_candidates_of_prefixed_names(name):
    assert [f.value for f in secretscan.candidates(f"x {name}hunter2!xyz\" y")] == ["hunter2!xyz"]


def test_candidates_of_long_values():
    key = "aB3dE5gH" * 60
    for text, kind in ((f"x {key} y", "mixed"), (f"token = {key}!{key} y", "assigned")):
        (f,) = secretscan.candidates(text)
        assert (f.kind, f.value) == (kind, text.split(" ")[-2])




def test_forest_on_held_out_findings():
    rows = secretscan.made_up_findings(2000, 1)
    f = secretscan.train(rows[:1500])
    ok = [(f.score(secretscan.features(x, f.known)) >= 0.5) == bool(y) for y, x in rows[1500:]]
    assert np.mean(ok) > 0.97


def test_scan_of_odd_texts(spark):
    key = "AKIA" + "Q7RT2WXZ4MNP5KLV"
    docs = spark.createDataFrame([(1, f"x {key} y"), (1, f"x {key} y"), (2, None), (3, ""), (4, "plain words only " * 20_000 + key), (None, "password=hunter2hunter2")], "doc_id long, text string").withColumn("kind", F.lit(0))
    f = secretscan.train(secretscan.made_up_findings(800))
    got = secretscan.scan(docs, f).collect()
    assert sorted((r["doc_id"] or 0, r["kind"]) for r in got) == [(0, "assigned"), (1, "aws_access_key"), (1, "aws_access_key"), (4, "aws_access_key")]
    assert all(r["score"] >= 0.5 for r in got if r["kind"] == "aws_access_key")
    assert secretscan.scan(docs.limit(0), f).count() == 0


def _naive_candidates(text):
    """Each place in turn, each rule in turn, without the joint pattern."""
    rules, at = [(k, re.compile(p)) for k, p in secretscan.RULES], 0
    while at <= len(text):
        for kind, rule in rules:
            m = rule.match(text, at)
            if m:
                yield kind, *m.span("v")
                at = max(m.end(), at + 1) - 1
                break
        at += 1


def test_scan_equals_brute_force(spark):
    made = [f"{m.before}{m.value}{m.after}" for _, m in secretscan.made_up_findings(120, 3)] + [None, "", "-----BEGIN RSA PRIVATE KEY----- password: a/b\\c=d, x"]
    rows = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)], "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 3000").union(rows)
    known = secretscan.corpus_statistics(docs, least_texts=2)
    texts = [r["text"] or "" for r in docs.collect()]
    pairs, words = np.zeros((26, 26)), Counter()
    for t in texts:
        low = t.lower()
        for a, b in zip(low, low[1:], strict=False):
            if "a" <= a <= "z" and "a" <= b <= "z":
                pairs[ord(a) - 97, ord(b) - 97] += 1
        words.update({w for w in re.findall("[a-z]{4,24}", "".join(c if c.isascii() else " " for c in low))})
    assert np.allclose(known.pairs, secretscan.log_pairs(pairs))
    assert known.words == secretscan.COMMON | {w for w, n in words.items() if n >= 2}
    forest = secretscan.train(secretscan.read_findings(secretscan.findings_table(spark, secretscan.made_up_findings(600))), known, trees=7)
    want = []
    for r in docs.collect():
        for kind, a, z in _naive_candidates(r["text"] or ""):
            (f,) = [f for f in secretscan.candidates(r["text"]) if (f.start, f.end) == (a, z)]
            row = secretscan.features(f, known)
            votes = []
            for tree in forest.trees:
                while len(tree) > 1:
                    tree = tree[2 if row[tree[0]] <= tree[1] else 3]
                votes.append(tree[0])
            want.append((r["doc_id"], kind, a, z, r["text"][a:z], round(float(np.mean(votes)), 9)))
    got = [(*tuple(r)[:5], round(r["score"], 9)) for r in secretscan.scan(docs, forest).collect()]
    assert sorted(got) == sorted(want) and got


def test_findings_of_one_label_of_none_and_odd_rows(spark):
    rows = secretscan.made_up_findings(200)
    some = next(secretscan.candidates("token = abcDEF123456"))
    for label in (0, 1):
        f = secretscan.train([(label, x) for _, x in rows])
        assert f.score(secretscan.features(some, f.known)) == label
    assert secretscan.train([]).score([0.0] * len(secretscan.FEATURES)) == 0.5
    odd = spark.createDataFrame([(None, "mixed", "v1234567", "", "", False), (1, None, "v1234567", None, None, None), (2, "mixed", "x", "", "", False), (1, "mixed", None, "", "", True)], secretscan.FINDINGS)
    assert [(y, f.value, f.kind) for y, f in secretscan.read_findings(odd)] == [(1, "v1234567", "")]
    assert secretscan.read_findings(odd.limit(0)) == []
    assert len(secretscan.read_findings(secretscan.findings_table(spark, rows), max_rows=50)) < 100
    empty = secretscan.corpus_statistics(spark.createDataFrame([(None,), ("",)], "text string"))
    assert empty.words == secretscan.COMMON


def test_toxicity_equals_brute_force(spark):
    """Every entry at every place by comparison, the heaviest at each place, then the curve."""
    docs, labels = _labelled(spark)
    model = toxicity.train(docs, labels, F.lit(True), exceptions=("zorkish plugh",))
    texts = [r["text"] for r in docs.collect()] + ["zorkish plugh", "a Z0RK1SH plugh zorkling", "", "zorkishzorkish x"]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in scored:
        folded = toxicity.fold(r["text"])
        spared = [(m.start(), m.end() - 1) for m in re.finditer("(?= zorkish plugh )", folded) for m in [re.compile(" zorkish plugh ").match(folded, m.start())]]
        best = {}
        for at in range(len(folded)):
            fits = [(w, k) for k, w in model.lexicon.items() if folded.startswith(k, at)]
            if fits and not any(a <= at < z for a, z in spared):
                best[at] = max(fits)
        total = sum(w for w, _ in best.values())
        x = [math.log1p(total), min(1.0, 10 * total / max(1, folded.count(" ") - 1)), math.log1p(len({k for _, k in best.values()}))] if best else [0, 0, 0]
        z = sum(a * b for a, b in zip(x, model.coef, strict=True)) + model.intercept
        assert r["toxicity"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_url_margins_equal_brute_force(spark):
    """Features and trees worked out in Python from the URL and the labels of the other folds."""
    rows = [(i, f"http://h{i % 7}.{('net', 'org', 'io')[i % 3]}/{'9' * (i % 10)}/{'a/' * (i % 5)}?x={i}&y", int(i % 10 >= 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    table, prior = urlfilter.features(df, [], label=F.when(F.col("page_id") < 200, F.col("bad")))
    fold = {r["page_id"]: r["f"] for r in table.select("page_id", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(urlfilter.FOLDS)).alias("f")).collect()}
    model = urlfilter.train(table, prior, trees=3)
    got = {r["page_id"]: r for r in table.withColumn("z", urlfilter.margin(model)).collect()}
    assert prior == pytest.approx(np.mean([b for i, _, b in rows if i < 200]))
    for i, u, _ in rows:
        host, path = _host_path(u)
        same = [(j, b) for j, v, b in rows if _host_path(v)[0].split(".")[-1] == host.split(".")[-1]]
        known = [b for j, b in same if j < 200 and (i >= 200 or fold[j] != fold[i])]
        counts = [u.count(c) / len(u) for c in set(u)]
        want = dict(length=len(u), host_length=len(host), path_length=len(path), depth=path.count("/"), labels=host.count("."), digit_ratio=sum(c.isdigit() for c in u) / len(u), host_digits=sum(c.isdigit() for c in host), entropy=-sum(p * math.log2(p) for p in counts), params=u.count("&") + 1, hyphens=0, suffix_count=math.log1p(len(same)), suffix_rate=(sum(known) + 20 * prior) / (len(known) + 20))
        for k, v in want.items():
            assert got[i][k] == pytest.approx(v, abs=1e-9), k
        z = model.base
        for t in model.trees:
            while t.children:
                t = t.children[0 if want[urlfilter.FEATURES[t.feature]] <= t.threshold + 1e-12 else 1]
            z += t.value
        assert got[i]["z"] == pytest.approx(z, abs=1e-9)


def test_equally_long_rules_the_first_wins(spark):
    rules = [urlfilter.Rule("block", "a.net", "/x"), urlfilter.Rule("allow", "a.net", "/x"), urlfilter.Rule("allow", "net", "/x/a")]
    df = spark.createDataFrame([(1, "http://a.net/x/aa")], "page_id long, url string")
    assert tuple(urlfilter.judge(df, rules).select("rule", "verdict").first()) == ("a.net/x", "block")

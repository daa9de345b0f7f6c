"""What the review of the round after found, on small tables."""

from corpusmill.llm import common, kdshard, simhash


def collections(spark):
    """How often the driver's JVM was asked for a whole collection or did one."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep", "Major")))


def test_dropped_tables_go_without_a_collection_each(spark):
    paths = [common.materialize(spark.range(2), "drop")[1] for _ in range(4)]
    before = collections(spark)
    for p in paths:
        common.drop_path(spark, p)
    assert collections(spark) - before <= 2  # one was asked for at most
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert not any(jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p)) for p in paths)


def test_loops_over_small_tables_ask_for_no_collection(spark, monkeypatch):
    asked, drop = [], common.drop_path
    monkeypatch.setattr(kdshard, "drop_path", lambda s, *p, collect=True: asked.append(collect) or drop(s, *p, collect=collect))
    docs = spark.createDataFrame([(k, "w " * (k % 7), "en", f"s{k % 3}") for k in range(40)], "doc_id long, text string, lang string, source string")
    assert kdshard.assign(docs, 8).select("shard", "slot").distinct().count() == 40
    assert asked.count(True) == 1 and len(asked) > 2


def test_first_links_are_held_against_the_texts_at_once(spark, monkeypatch):
    held, verify = [], simhash.verified_pairs
    monkeypatch.setattr(simhash, "verified_pairs", lambda *a: held.append(a[0]) or verify(*a))
    base = [" ".join(f"w{(i * k) % 97}" for i in range(60)) for k in range(1, 20)]
    docs = spark.createDataFrame(list(enumerate([*base, *[t + " end" for t in base], *[t.upper() for t in base]])), "doc_id long, text string")
    assert {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs).collect()} == {k: k % 19 for k in range(57)}
    assert len(held) == 2

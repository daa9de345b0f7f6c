"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words: its weight's share of ``ratio`` times all words, at
most ``cap`` times its own words, the excess shared again by weight. A source's target is met by
complete epochs first; the rest is a weighted sample without replacement: each document draws the
key -ln(u) / quality with a reproducible u, documents are taken in key order, and the running sum
of their words is cut where it is nearest to the rest. Documents are whole or left out.

Only DataFrame operations: a source's keys are cut into bins, and the bin in which the running sum
passes the rest is cut again, until it holds few rows or one key; only those are sorted, so no task
ever holds a whole source, however its keys lie.

Null texts have size 0. A null source is a source of its own, the last. Sources without words get
target 0 and nothing is taken. Rows of one id and size draw equal keys and are taken in the order
of their texts' hashes; which of several equal rows is taken does not matter. An empty table gives
an empty result. Clashing names do not matter: :func:`mix` reads three columns,
:func:`mix_documents` keeps every column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize, unit_hash

#: Runs of anything but the six ASCII white-space characters.
WORDS = r"[^\x20\x09-\x0D]+"
#: A source's keys are cut into so many bins at a time, until the bin of the cut holds so many rows.
BINS, ROWS_A_BIN = 4096, 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column) -> Column:
    """Share of letters among the characters, at least a tenth: text outweighs markup and digits."""
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", ""))
    return F.greatest(F.lit(0.1), letters / F.greatest(F.lit(1), F.length(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, ratio: float = 1.5, weights: Sequence[int] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """(source, source_size) with each source's target.

    Water level: sources in order of cap x size / weight; one is full if the level that the sources
    before it leave reaches its cap. The first that is not full sets the level for all the rest."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sizes.select("source", "source_size", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1).alias("weight"))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(float(ratio)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    s = s.withColumn("common", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(every))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _narrowed(base: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``plan`` with the key span (lo, hi), its rows n and the words before it of each source in
    which the cut is still open replaced by the bin of that span in which the cut lies."""
    opened = plan.where(_is_open()).select("ps", "rest", "before", "lo", "hi")
    part = base.join(F.broadcast(opened) if few else opened, F.col("source").eqNullSafe(F.col("ps"))).where(F.col("key").between(F.col("lo"), F.col("hi")))
    place = F.least(F.lit(BINS - 1), F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).alias("bin")
    bins = part.groupBy("source", "rest", "before", place).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    # at most BINS rows a source
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    passed = bins.withColumn("after", upto).where(F.col("after") >= F.col("rest"))
    least = passed.groupBy("source").agg(F.min(F.struct("bin", (F.col("after") - F.col("words")).alias("before"), "n", "lo", "hi")).alias("e"))
    found = least.select(F.col("source").alias("es"), "e")
    joined = plan.join(found, F.col("ps").eqNullSafe(F.col("es")), "left")
    return joined.select("ps", "source_size", "target", "epochs", "rest", *[F.coalesce(f"e.{c}", c).alias(c) for c in ("before", "n", "lo", "hi")])


def _is_open() -> Column:
    return (F.col("rest") > 0) & (F.col("n") > ROWS_A_BIN) & (F.col("hi") > F.col("lo"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ratio: float = 1.5, weights: Sequence[int] = (3, 1, 2), cap: float = 2.0, seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, times, taken, *keep) for every row: how often the mix takes it."""
    text, spark = F.col(text_col), docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), quality_weight(text).alias("quality"), F.xxhash64(text).alias("th"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    key = -F.log(unit_hash(F.lit(seed), F.col("doc_id"), F.col("size"))) / F.col("quality")
    base, _ = materialize(rows.withColumn("key", key).drop("quality"), "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    sizes, sizes_path = materialize(sizes, "mix-sizes")
    t = source_targets(sizes.select("source", "source_size"), ratio, weights, cap)
    t = t.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    t = t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    spans = sizes.select(F.col("source").alias("ps"), F.lit(0).cast("long").alias("before"), "n", "lo", "hi")
    plan, path = materialize(t.join(spans, F.col("source").eqNullSafe(F.col("ps"))).select("ps", "source_size", "target", "epochs", "rest", "before", "n", "lo", "hi"), "mix-plan")
    drop_path(spark, sizes_path, collect=False)
    few = plan.count() <= 50_000  # broadcast only up to a checked size
    while not plan.where(_is_open()).isEmpty():
        spent = path
        plan, path = materialize(_narrowed(base, plan, few), "mix-plan")
        drop_path(spark, spent, collect=False)
    every = base.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("ps")))
    beside = (F.col("rest") > 0) & F.col("key").between(F.col("lo"), F.col("hi"))
    whole = every.where(~beside).withColumn("more", ((F.col("rest") > 0) & (F.col("key") < F.col("lo"))).cast("long"))
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)
    cut = every.where(beside).withColumn("sum", F.sum("size").over(run) + F.col("before"))
    # the row that passes the rest is taken if that comes nearer to it
    cut = cut.withColumn("more", (F.col("sum") - F.col("rest") <= F.col("rest") - (F.col("sum") - F.col("size"))).cast("long")).drop("sum")
    times = F.col("epochs") + F.col("more")
    return whole.unionByName(cut).select("doc_id", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, every column, each as often as it is taken."""
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    named = {k: plain.columns[cols.index(options.pop(k, d))] for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    taken = mix(plain, keep=plain.columns, **named, **options).where("times > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*plain.columns).toDF(*cols)

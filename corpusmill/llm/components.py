"""Connected components of a link table, by alternating large-star and small-star rounds
(Kiveris et al., 2014). Links never leave the executors; each round is written to the shared
folder, so a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over links (a, b) with a > b; returns links of the same form."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link to a lesser node at most, and none that has is linked to."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """(node, root) for every node of ``edges`` (two long columns, any names), and the path of that
    table; root is the least node of its component. Self links and repeats are harmless; no links
    give an empty table."""
    x, y = edges.columns[:2]
    spark = edges.sparkSession
    e, path = materialize(
        edges.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y)))
        .select(F.greatest(x, y).cast("long").alias("a"), F.least(x, y).cast("long").alias("b"))
        .distinct(),
        "links",
    )
    for _ in range(max_rounds):
        # the links of the large star are written too: the small one reads them three times
        big, big_path = materialize(_star(e, True), "links")
        nxt, nxt_path = materialize(_star(big, False), "links")
        drop_path(spark, path, big_path, collect=False)
        e, path = nxt, nxt_path
        if _settled(e):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # a row a node; of a star that has settled, every link's lesser end is its root
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = materialize(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots")
    drop_path(spark, path, collect=False)
    return out

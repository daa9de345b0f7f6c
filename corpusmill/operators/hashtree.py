"""One hash of a table, however large: hashes of ranges of the sorted row hashes, combined in a tree.

Rows are ordered by their SHA-256, which is also their place: a leaf holds the rows whose hash begins
with a prefix, so leaves are of bounded size, and no task sees more than one leaf's rows or one node's
256 children. Repeated rows are counted, not repeated. The value depends on the rows alone, not on
their order or partitions. Two tables differ where their leaves do (AG33, SK10, SC22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different rows of a leaf, about, at most.
LEAF_ROWS = 1024


def leaf_digits(n: int, most: int | None = None) -> int:
    """Hex digits of the leaves' prefixes for ``n`` different rows: two more for every 256 times, up to
    ``most``, with which leaves grow beyond."""
    digits = 0
    while n > LEAF_ROWS * 16**digits and (most is None or digits < most):
        digits += 2
    return digits


def _joined(*cols: str) -> Column:
    """Hash of the group's rows in their order, each as its columns joined by a colon."""
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in cols])
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat_ws(":", *[r[c] for c in cols])), ","), 256)


def leaves(rows: DataFrame, line: Column, digits: int | None = None, most: int | None = None) -> tuple[DataFrame, int]:
    """(prefix, hash, rows) of the leaves of a table whose rows are ``line``, and their digits."""
    counted = rows.groupBy(F.sha2(line, 256).alias("h")).agg(F.count("*").alias("c"))
    if digits is None:
        digits = leaf_digits(counted.count(), most)
    return counted.groupBy(F.left("h", F.lit(digits)).alias("prefix")).agg(_joined("h", "c").alias("hash"), F.sum("c").alias("rows")), digits


def tree_hash(rows: DataFrame, line: Column, most: int | None = None) -> DataFrame:
    """One row (hash, rows) for the whole table; that of an empty table is the hash of nothing."""
    nodes, digits = leaves(rows, line, most=most)
    while digits > 0:
        digits -= 2
        nodes = nodes.groupBy(F.left("prefix", F.lit(digits)).alias("prefix")).agg(_joined("prefix", "hash").alias("hash"), F.sum("rows").alias("rows"))
    return nodes.agg(F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("hash"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def differing_ranges(a: DataFrame, b: DataFrame, line: Column, most: int | None = None) -> DataFrame:
    """(prefix, rows_a, rows_b) of the leaves in which two tables differ."""
    left, digits = leaves(a, line, most=most)
    right, _ = leaves(b, line, digits)
    both = left.withColumnsRenamed({"hash": "hash_a", "rows": "rows_a"}).join(right.withColumnsRenamed({"hash": "hash_b", "rows": "rows_b"}), "prefix", "full")
    return both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("prefix", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))

"""Sharding by a k-d tree over metadata, with DataFrame operations only.

A node that must hold several shards is split at the weighted median (weight: bytes) along the
dimension in which it is widest; with s shards the left child takes floor(s / 2) of them and that
share of the bytes. Splitting stops at one shard, which then holds about its target bytes.

The median is found by radix selection: a node's rows are summed by the leading digit of their
position, the digit in which the running sum passes the goal is refined by the next digit, and so
on until the rows in question weigh no more than ``tolerance`` of a shard. A position is the grid
coordinate in the node's dimension, then a hash of the text, then a hash of the whole row. Equal
texts take the least coordinates of their group and so share a position: a group of copies is cut
only if it outweighs the tolerance, so that one huge group does not spoil the balance. The driver sees one row a node and pass.

Sizes are UTF-8 bytes of the text plus 1 (null: 1). Nulls in a dimension take the coordinate 0.
Repeated rows have equal positions: they stay in one shard unless rows after them must be cut off.
An empty table gives an empty result; fewer rows than shards leave shards empty. Only the named
columns are read; other names do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize

GRID = 4096
#: Digits of a position: the grid coordinate, three of the text's hash, three of the row's hash.
DIGITS = 7
ROWS_A_BLOCK = 20_000


def _hash36(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 28)


def _digit(k: int, coordinate: Column) -> Column:
    """The k-th digit of a row's position, 0 to 4095."""
    if k == 0:
        return coordinate
    col, at = ("th", k - 1) if k <= 3 else ("dh", k - 4)
    return F.shiftrightunsigned(F.col(col), 24 - 12 * at).bitwiseAND(F.lit(4095).cast("long"))


def _by_node(values: dict[int, int | str], kind: str) -> Column:
    """Column: the value of the row's node (null for other nodes)."""
    return F.element_at(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.lit(v).cast(kind))]), F.col("node"))


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", dimensions: Sequence[Column] | None = None, tolerance: float = 0.02) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; slots count from 0 in each shard.

    ``dimensions``: numeric metadata columns; by default the text's length on a log scale, the
    source's and the language's position on a hash line."""
    if dimensions is None:
        line = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1)
        dimensions = [F.log2(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1), *[F.when(F.col(c).isNotNull(), line(F.col(c))) for c in ("source", "lang") if c in docs.columns]]
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = [f"x{i}" for i in range(len(dimensions))]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _hash36(text).alias("th"),
        _hash36(F.col(id_col), F.xxhash64(text), F.lit(1)).alias("dh"),
        *[F.coalesce(d.cast("double"), F.lit(0.0)).alias(n) for n, d in zip(dims, dimensions, strict=True)],
    )
    base, path = materialize(rows, "kd")
    # rows of equal text take their group's least coordinates, so that they have one position
    same = ["th", "text_crc32"]
    groups = base.groupBy(*same).agg(F.count("*").alias("copies"), *[F.min(d).alias(f"m_{d}") for d in dims]).where("copies > 1")
    groups, groups_path = materialize(groups, "kd-groups")
    moved = base.join(groups, same, "left").select("doc_id", "size", *same, "dh", *[F.coalesce(f"m_{d}", d).alias(d) for d in dims])
    (base, path), spent = materialize(moved, "kd"), (path, groups_path)
    drop_path(docs.sparkSession, *spent)
    ends = base.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *[f(n).alias(f"{n}_{k}") for n in dims for k, f in (("lo", F.min), ("hi", F.max))]).first()
    n_rows, total = ends["n"], ends["bytes"] or 0

    def grid(n: str) -> Column:
        lo, hi = ends[f"{n}_lo"], ends[f"{n}_hi"]
        if n_rows == 0 or hi <= lo:
            return F.lit(0).cast("long")
        return F.least(F.lit(GRID - 1), F.floor((F.col(n) - F.lit(lo)) / F.lit(hi - lo) * GRID)).cast("long")

    base = base.withColumns({n: grid(n) for n in dims}).withColumn("node", F.lit(0))
    # a node is named by its first shard; spans: shards that it must hold
    spans = {0: shards}
    while n_rows and any(s > 1 for s in spans.values()):
        open_nodes = {n: s for n, s in spans.items() if s > 1}
        live = base.where(F.col("node").isin(list(open_nodes)))
        widths = {r["node"]: r for r in live.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()}
        widest = {n: max(range(len(dims)), key=lambda i, r=r: (r[dims[i]], -i)) for n, r in widths.items()}
        if not widths:
            break
        coordinate = F.element_at(F.array(*dims), _by_node(widest, "int") + 1)
        live = live.where(F.col("node").isin(list(widths))).select("node", "size", "th", "dh", coordinate.alias("g"))
        goals = {n: widths[n]["w"] * (open_nodes[n] // 2) / open_nodes[n] for n in widths}
        prefix: dict[int, list[int]] = {n: [] for n in widths}
        done: dict[int, list[int]] = {}
        for k in range(DIGITS):
            todo = [n for n in widths if n not in done]
            if not todo:
                break
            part = live.where(F.col("node").isin(todo))
            for j in range(k):
                part = part.where(_digit(j, F.col("g")) == _by_node({n: prefix[n][j] for n in todo}, "long"))
            hist = part.groupBy("node", _digit(k, F.col("g")).alias("d")).agg(F.sum("size").alias("w"))
            run = hist.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("d")))
            at = run.where(F.col("upto") >= _by_node({n: goals[n] for n in todo}, "double")).groupBy("node").agg(F.min(F.struct("d", "w", "upto")).alias("m")).collect()
            for r in at:
                n, d, w, upto = r["node"], r["m"]["d"], r["m"]["w"], r["m"]["upto"]
                before = upto - w
                if w <= tolerance * total / shards or k == DIGITS - 1:
                    # the digit's rows go where the cut comes nearer to the goal
                    done[n] = [*prefix[n], d if upto - goals[n] <= goals[n] - before else d - 1]
                else:
                    prefix[n].append(d)
                    goals[n] -= before
        cuts = {n: c + [GRID] * (DIGITS - len(c)) for n, c in done.items()}
        # left: the position is not beyond the cut, digit by digit
        left = F.lit(True)
        for k in reversed(range(DIGITS)):
            own, cut = _digit(k, coordinate), _by_node({n: c[k] for n, c in cuts.items()}, "long")
            left = (own < cut) | ((own == cut) & left)
        step = _by_node({n: open_nodes[n] // 2 for n in cuts}, "int")
        base = base.withColumn("node", F.when(F.col("node").isin(list(cuts)) & ~left, F.col("node") + step).otherwise(F.col("node")))
        # a level's nodes are written: the next level's expressions start from a plain column
        spent = path
        base, path = materialize(base, "kd")
        drop_path(docs.sparkSession, spent, collect=False)
        for n, s in open_nodes.items():
            spans[n] = s // 2
            spans[n + s // 2] = s - s // 2
    # slots: count by block of a shard, then number within the block
    blocks = max(1, n_rows // (ROWS_A_BLOCK * shards))
    placed = base.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    first = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("first"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")) - 1)
    return numbered.join(first, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The rows of ``docs`` in one folder a shard (shard=N), as Parquet. Rows are placed
    by their ids, so null or repeated ids are an error."""
    id_col = options.get("id_col", "doc_id")
    if not docs.groupBy(F.col(id_col).cast("long").alias("i")).count().where("i IS NULL OR count > 1").isEmpty():
        raise ValueError("ids are null or repeated")
    placed = assign(docs, **options).select(F.col("doc_id").alias("__id"), "shard", "slot")
    docs.join(placed, docs[id_col].cast("long") == F.col("__id")).drop("__id").repartition("shard", F.pmod("slot", F.lit(64))).write.partitionBy("shard").parquet(path)

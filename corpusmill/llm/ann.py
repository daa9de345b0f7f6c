"""Approximate nearest neighbours: an inverted file over coarse centroids with product-quantised
residuals, asymmetric distance tables and exact reranking.

The index is fitted on a bounded sample of vectors (drawn by a hash of the id) and then holds every
row. A query probes the lists of its nearest centroids; each list's codes are ranked by distances
looked up in the query's tables, and the best of every block are ranked again by the exact measure on
the original vectors, which lie beside the codes. How many lists are probed and how many rows are
ranked again follows a measurement: a bounded sample of the queries is held against every row, and
both are raised until nearly all of the truly nearest rows are found. Lists are cut into blocks of bounded size and queries go to every block of a
list that they probe, so a list that holds a third of all rows is spread over as many tasks as it
needs. A block that more queries probe than a task takes is copied for each share of them, so what
is shuffled follows the probes, not rows times queries.

Nearness is the cosine in double precision; equal scores go to the smaller id, in the approximate
ranking too, so groups of equal vectors keep their least ids. Null vectors, those of another length
than most (of equally many the shorter), zero vectors and those with null or non-finite components
take no part, as queries or candidates. A query probes as many lists as the index was fitted to, and
further ones until they hold enough rows to rerank. Repeated ids are rows of their own as candidates; a query never finds rows of
its own id. Empty tables and no queries give empty results. Only id and vector are read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize, unit_hash


@dataclass
class IvfPq:
    centroids: np.ndarray  # (lists, dim), of unit vectors
    books: np.ndarray  # (parts, 256, dim / parts)
    probes: int
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # rows of each list

    @property
    def parts(self) -> int:
        return len(self.books)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half - x[at : at + 4096] @ c.T).argmin(1)
    return out


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite & F.exists("v", lambda x: x != 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two, which changes no digit, so that no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _unit(b: pa.Array, dim: int) -> np.ndarray:
    x = b.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    # scaled before squaring, so that no length over- or underflows
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def probes_needed(x: np.ndarray, c: np.ndarray, target: float, k: int = 5, tests: int = 300, rng: np.random.Generator | None = None) -> int:
    """Lists to probe so that ``target`` of the ``k`` nearest of some distinct sample vectors, drawn
    by ``rng`` and found by brute force in the sample, lie in probed lists."""
    own = np.unique(x, axis=0, return_index=True)[1]
    own = (rng or np.random.default_rng(0)).choice(own, min(tests, len(own)), replace=False)
    q = x[own]
    near = _nearest(x, c)
    sims = q @ x.T
    sims[np.arange(len(q)), own] = -np.inf
    best = np.argsort(-sims, axis=1)[:, : min(k, max(1, len(x) - 1))]
    order = np.argsort((c * c).sum(1) / 2 - q @ c.T, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :].repeat(len(q), 0), axis=1)
    at = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    return int(at[min(len(at) - 1, math.ceil(target * len(at)) - 1)]) + 1


def _tree_kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """About ``k`` centroids by two levels: cells first, then centroids within each, as many as its
    share of the rows gives."""
    cells = _kmeans(x, max(1, math.isqrt(k)), rng)
    near = _nearest(x, cells)
    return np.concatenate([_kmeans(x[near == i], max(1, round(k * n / len(x))), rng) for i, n in enumerate(np.bincount(near, minlength=len(cells)).tolist()) if n])


def _sample(vectors: DataFrame, n: int, dim: int, rows: int, seed: int) -> np.ndarray:
    """About ``rows`` different vectors at most, drawn by a hash of their content; a vector that many
    rows share is drawn once, or not at all."""
    part = min(1.0, rows / max(n, 1))
    own = vectors.where(F.size("v") == dim).select("v")
    while True:
        got = own.where(unit_hash(F.lit(seed), F.xxhash64("v")) < F.lit(part)).distinct().orderBy(F.xxhash64("v")).toArrow()
        if got.num_rows or part >= 1.0:
            return _unit(got.column(0).combine_chunks(), dim)
        part = min(1.0, part * 16)  # few vectors that many rows share


def fit(vectors: DataFrame, n: int, max_sample: int = 20_000, max_lists: int = 65_536, flat_lists: int = 4096, parts: int = 16, target_recall: float = 0.97, seed: int = 0) -> IvfPq | None:
    """The index's centroids and code books from a bounded sample.

    Lists: about the square root of the number of rows, at most ``max_lists`` (4.3 billion rows; lists
    grow longer beyond). Up to ``flat_lists`` centroids are fitted at once, to about ``max_sample``
    vectors; more of them by two levels, to eight vectors a list, half a million at most. Probes: as
    many as the sample's own nearest neighbours need for ``target_recall``."""
    dim_row = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "dim").first()
    if dim_row is None:
        return None
    dim = dim_row["dim"]
    lists = max(1, min(max_lists, math.isqrt(n)))
    x = _sample(vectors, n, dim, max_sample if lists <= flat_lists else max(max_sample, 8 * lists), seed)
    rng = np.random.default_rng(seed)
    c = _kmeans(x, lists, rng) if lists <= flat_lists else _tree_kmeans(x, lists, rng)
    parts = max(p for p in range(1, parts + 1) if dim % p == 0)
    few = x if len(x) <= max_sample else x[rng.choice(len(x), max_sample, replace=False)]
    rest = few - c[_nearest(few, c)]
    books = np.zeros((parts, 256, dim // parts))
    for p, sub in enumerate(np.split(rest, parts, axis=1)):
        b = _kmeans(sub, 256, rng, 8)
        books[p, : len(b)] = b
        books[p, len(b) :] = b[0] if len(b) else 0
    return IvfPq(c, books, probes_needed(x, c, target_recall, rng=rng))


def encode(vectors: DataFrame, model: IvfPq) -> DataFrame:
    """(vec_id, list, code, term, v): every row of the index. term: the part of the squared distance
    that does not depend on the query."""
    shipped = vectors.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    dim = model.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: IvfPq = pickle.loads(shipped.value)
        for b in batches:
            x = _unit(b.column(1), dim)
            lists = _nearest(x, m.centroids)
            rest = x - m.centroids[lists]
            codes = np.empty((len(x), m.parts), np.uint8)
            back = np.empty_like(x)
            w = dim // m.parts
            for p in range(m.parts):
                codes[:, p] = _nearest(rest[:, p * w : (p + 1) * w], m.books[p])
                back[:, p * w : (p + 1) * w] = m.books[p][codes[:, p]]
            # |q - (c + r)|^2 = |q|^2 + (|c + r|^2) - 2 q.c - 2 q.r; the middle term is the row's own
            term = ((m.centroids[lists] + back) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(term), b.column(1)], ["vec_id", "list", "code", "term", "v"])

    return vectors.where(F.size("v") == dim).select("vec_id", "v").mapInArrow(run, f"vec_id long, list int, code binary, term double, v {vectors.schema['v'].dataType.simpleString()}")


def _best(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, ties to smaller ids."""
    if len(d) > 4 * k:
        cut = np.partition(d, k - 1)[k - 1]
        at = np.nonzero(d <= cut)[0]
        if len(at) > k:  # ties at the cut: only the smallest ids of them are needed
            return at[np.lexsort((ids[at], d[at]))[:k]]
    else:
        at = np.arange(len(d))
    return at[np.lexsort((ids[at], d[at]))[:k]]


def _codes(b: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)


def _measured(codes: DataFrame, tests: pa.Table, model: IvfPq, k: int, target: float) -> tuple[int, int]:
    """(lists to probe, rows to rank again) so that ``target`` of the test queries' ``k`` nearest of all
    rows lie in probed lists, and ``target`` of those among the rows ranked again. One pass finds the
    nearest by brute force, another counts the rows that the codes rank before them."""
    spark, dim = codes.sparkSession, model.centroids.shape[1]
    own = tests.column(0).to_numpy()
    u = _unit(tests.column(1).combine_chunks(), dim)
    sent = spark.sparkContext.broadcast(pickle.dumps((own, u)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, q = pickle.loads(sent.value)
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            far = -np.round(q @ _unit(b.column("v"), dim).T, 12)
            far[ids_of[:, None] == ids[None, :]] = np.inf
            at = [_best(ids, d, k) for d in far]
            test = np.repeat(np.arange(len(q)), [len(a) for a in at])
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([pa.array(test), pa.array(far[test, at]), *(b.column(c).take(pa.array(at)) for c in ("vec_id", "list", "code", "term"))], ["test", "far", "vec_id", "list", "code", "term"])

    first = Window.partitionBy("test").orderBy("far", "vec_id")
    found = codes.mapInArrow(nearest, "test long, far double, vec_id long, list int, code binary, term double").where(F.col("far") < float("inf"))
    true = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n").toArrow()  # at most k a test
    if not true.num_rows:
        return model.probes, 0
    true = true.combine_chunks().to_batches()[0]
    test, ids, lists, term = (true.column(c).to_numpy() for c in ("test", "vec_id", "list", "term"))
    place = np.argsort(np.argsort((model.centroids**2).sum(1) / 2 - u @ model.centroids.T, axis=1, kind="stable"), axis=1)
    needed = np.sort(place[test, lists])
    probes = max(model.probes, int(needed[math.ceil(target * len(needed)) - 1]) + 1)
    tables = np.einsum("pkw,tpw->tpk", model.books, u.reshape(len(u), model.parts, -1))
    near = u @ model.centroids.T
    d = term - 2 * near[test, lists] - 2 * tables[test[:, None], np.arange(model.parts)[None, :], _codes(true, model.parts)].sum(1)
    shipped = spark.sparkContext.broadcast(pickle.dumps((own, tables, near, place < probes, test, ids, d)))

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables, near, probed, test, ids, d = pickle.loads(shipped.value)
        count = np.zeros(len(test), np.int64)
        for b in batches:
            row_ids, lists, term = (b.column(c).to_numpy() for c in ("vec_id", "list", "term"))
            c = _codes(b, tables.shape[1])
            for t in range(len(own)):
                at = np.nonzero(probed[t, lists] & (row_ids != own[t]))[0]
                mine = np.nonzero(test == t)[0]
                # sums in the scan's order may differ in their last digits
                row = term[at] - 2 * near[t, lists[at]] - 2 * tables[t][np.arange(tables.shape[1])[None, :], c[at]].sum(1)
                for j in mine:
                    count[j] += np.count_nonzero((row < d[j] - 1e-9) | ((np.abs(row - d[j]) <= 1e-9) & (row_ids[at] < ids[j])))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(test))), pa.array(count)], ["neighbour", "ahead"])

    counts = codes.select("vec_id", "list", "code", "term").mapInArrow(ahead, "neighbour long, ahead long").groupBy("neighbour").agg(F.sum("ahead").alias("ahead")).toArrow()
    counts = np.sort(counts.column("ahead").to_numpy()[place[test, lists][counts.column("neighbour").to_numpy()] < probes])
    return probes, int(counts[math.ceil(target * len(counts)) - 1]) + 1


def _blocks(sizes: dict[int, int], block: int) -> list[tuple[int, int, int]]:
    """(list, first block, blocks): lists in order, small ones together in a block of about
    ``block`` rows, larger ones over several blocks of their own."""
    out, at, room = [], 0, block
    for k, n in sorted(sizes.items()):
        if n > block:
            if room < block:
                at, room = at + 1, block
            out.append((k, at, -(-n // block)))
            at += -(-n // block)
            continue
        if n > room:
            at, room = at + 1, block
        out.append((k, at, 1))
        room -= n
    return out


def search(rows: DataFrame, is_query: Column, k: int = 5, rerank: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16384, query_block: int = 8192, tests: int = 256, measured_recall: float = 0.985, **fit_options) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows found, nearest first.

    ``is_query`` is a condition on the column vec_id. A task scans ``block`` rows of the index for
    ``query_block`` queries and ranks the ``rerank`` best of each again, or more where ``tests`` queries,
    held against all rows, need more for ``measured_recall``."""
    spark = rows.sparkSession
    valid = valid_vectors(rows, id_col, vector_col)
    if rows.schema[vector_col].dataType.simpleString() == "array<float>":
        valid = valid.withColumn("v", F.col("v").cast("array<float>"))  # as they came, in half the space
    vectors, vectors_path = materialize(valid, "ann-vectors")
    n = vectors.count()
    model = fit(vectors, n, **fit_options)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = model.centroids.shape[1]
    block = min(block, max(1024, 2**21 // dim))
    codes, codes_path = materialize(encode(vectors, model), "ann-codes")
    drop_path(spark, vectors_path)
    # a row a list, of which the model holds all
    sizes = dict(codes.groupBy("list").count().collect())
    model.sizes = np.array([sizes.get(i, 0) for i in range(len(model.centroids))])
    placed = F.broadcast(spark.createDataFrame(_blocks(sizes, block), "list int, first int, blocks int"))
    queries = codes.where(is_query).select("vec_id", "v")
    drawn = queries.orderBy(F.xxhash64("vec_id", "v")).limit(tests).toArrow()
    least = rerank
    if drawn.num_rows:
        model.probes, needed = _measured(codes, drawn, model, k, measured_recall)
        rerank = max(rerank, needed)
    index = codes.join(placed, "list").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id", "code"), F.col("blocks"))).cast("int")).drop("first", "blocks")
    shipped = spark.sparkContext.broadcast(pickle.dumps(model))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: IvfPq = pickle.loads(shipped.value)
        half = (m.centroids**2).sum(1) / 2
        for b in batches:
            x = _unit(b.column(1), dim)
            for at in range(0, len(x), 1024):
                order = np.argsort(half - x[at : at + 1024] @ m.centroids.T, axis=1, kind="stable").astype(np.int32)
                # lists until they hold enough rows besides the query's own
                enough = (np.cumsum(m.sizes[order], axis=1) <= least).sum(axis=1) + 1
                near = [np.sort(o[: max(m.probes, e)]) for o, e in zip(order, enough.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 1024], pa.array(near, pa.list_(pa.int32())), b.column(1)[at : at + 1024]], ["query_id", "lists", "q"])

    probes = queries.mapInArrow(probe, f"query_id long, lists array<int>, q {queries.schema['v'].dataType.simpleString()}")
    # one row for each query and block that holds a list it probes
    by_block = probes.withColumn("list", F.explode("lists")).join(placed, "list").withColumn("block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)))
    by_block, by_path = materialize(by_block.groupBy("query_id", "q", "block").agg(F.collect_set("list").alias("lists")), "ann-probes")
    # a block is copied for each share of the queries that probe it; blocks that none probes stay behind
    shares = by_block.groupBy("block").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("shares"))
    index = index.join(shares, "block").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    by_block = by_block.join(shares, "block").withColumn("qb", F.pmod(F.xxhash64("query_id", "q"), F.col("shares")).cast("int")).drop("shares")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m: IvfPq = pickle.loads(shipped.value)
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            right = right.sort_values("list")
            ids, of = right["vec_id"].to_numpy(), right["list"].to_numpy()
            c = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(-1, m.parts)
            own_term = right["term"].to_numpy()
            rows = _scaled(np.stack(right["v"].to_list()).astype(float))
            size = np.sqrt((rows * rows).sum(1))
            span = {int(x): (int(a), int(z)) for x, a, z in zip(*(lambda u, i: (u, i, np.append(i[1:], len(of))))(*np.unique(of, return_index=True)), strict=True)}
            asked = _scaled(np.stack(left["q"].to_list()).astype(float))
            length = np.sqrt((asked * asked).sum(1))
            for q, y, w, lists in zip(left["query_id"].to_numpy(), asked, length, left["lists"], strict=True):
                parts = [(*span[x], x) for x in sorted(lists) if x in span]
                if not parts:
                    continue
                v = y / w
                table = np.einsum("pkw,pw->pk", m.books, v.reshape(m.parts, -1))
                at = np.concatenate([np.arange(a, z) for a, z, _ in parts])
                d = own_term[at] - 2 * np.concatenate([np.full(z - a, m.centroids[x] @ v) for a, z, x in parts])
                d = d - 2 * table[np.arange(m.parts)[None, :], c[at]].sum(1)
                keep = ids[at] != q
                at, d = at[keep], d[keep]
                at = at[_best(ids[at], d, rerank)]
                score = (rows[at] * y).sum(1) / (size[at] * w)
                best = _best(ids[at], -score, k)
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    scored = by_block.groupBy("block", "qb").cogroup(index.groupBy("block", "qb")).applyInPandas(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out, _ = materialize(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-found")
    drop_path(spark, by_path, codes_path)
    return out

"""SimHash near-duplicate detection with the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set. Bits that
go together are grouped into the same part; every part i gets its own threshold t_i (-1 leaves the
part out) with sum(t_i + 1) = radius + 1, chosen by dynamic programming on estimated candidate
counts. Two fingerprints within the radius then agree up to t_i bits in some part i, so probing
every part within its own threshold and verifying the whole distance finds every link.

Two operators:

* :func:`simhash_groups` - exact components of "fingerprints differ in at most ``radius`` bits".
* :func:`near_duplicates` - components of "Jaccard similarity of word shingles >= ``similarity``"
  over whole texts: links by SimHash fingerprints of the shingle sets (:func:`simhash_pairs`), each
  verified on the two texts; then an exact check, a prefix filter on the sets, for the pairs of
  different groups that differ in more bits than the radius, since no radius promises a similarity.

Null and empty texts have no shingles: fingerprint zero in :func:`simhash_groups` (linked like any
other); in :func:`near_duplicates` all texts without words form one group of equal texts. Repeated
rows are equal texts. Empty tables give empty results. Only the id and the text column are read, so
other columns and their names do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, drop_path, materialize, slices
from .components import connected_components

#: Buckets up to this size give all their pairs; larger ones take the linear path.
PAIR_BUCKET = 64


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words (all words if fewer), repeats included."""
    words = (text or b"").translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """(hashes, words): the hashes and, beside them, hashes derived by the splitmix64 finaliser."""
    z = h[:, None] + (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z[:, 0] = h
    return z


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` unsigned 64-bit words: each bit is 1 if set in over half of the hashes."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):
        h = hashes[at : at + 255]
        wide = _mixed(h, words) if words > 1 else np.ascontiguousarray(h)[:, None]
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): a signed long holding the 64 bits of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [int(fingerprint(shingle_hashes(t, width))[0].astype(np.int64)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return src.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- parts and thresholds


def allocate_thresholds(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = total and the least sum of costs[i][t_i + 1]."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * total
    for c in costs:
        nxt: list[tuple[float, list[int]] | None] = [None] * (total + 1)
        for used, state in enumerate(best):
            if state is None:
                continue
            for k, cost in enumerate(c[: total - used + 1]):
                if nxt[used + k] is None or state[0] + cost < nxt[used + k][0]:
                    nxt[used + k] = (state[0] + cost, [*state[1], k - 1])
        best = nxt
    if best[total] is None:
        raise ValueError("the parts cannot take that many probes")
    return best[total][1]


def group_bits(together: np.ndarray, n: int, sizes: list[int]) -> list[list[int]]:
    """Parts of the given sizes; each starts with the most correlated free pair and takes in the
    bit that is most correlated with those it has. ``together[i, j]``: rows with bits i and j."""
    mean = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(len(mean))), []
    for size in sizes:
        order = sorted(free)
        first = max(order, key=lambda i: (max((corr[i, j] for j in order if j != i), default=0.0), -i))
        part = [first]
        free.discard(first)
        while len(part) < size:
            nxt = max(sorted(free), key=lambda j: corr[part, j].sum())
            part.append(nxt)
            free.discard(nxt)
        parts.append(part)
    return parts


def _probe_masks(width: int, t: int) -> list[int]:
    """All values of ``width`` bits with at most ``t`` bits set."""
    from itertools import combinations

    return [sum(1 << i for i in c) for k in range(t + 1) for c in combinations(range(width), k)]


def _by_part(fps: DataFrame, bits: list[list[int]]) -> DataFrame:
    """(fp, part, v): every fingerprint once for each part, with the part's bits packed.

    By numpy: as column expressions the bits make code that each plan which reads them compiles anew,
    and its compilation alone fills a driver's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, part in enumerate(bits):
                v = np.zeros(len(fp), np.int64)
                for at, bit in enumerate(part):
                    v |= ((fp >> np.int64(bit)) & np.int64(1)) << np.int64(at)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.full(len(fp), i, np.int32)), pa.array(v)], ["fp", "part", "v"])

    return fps.select("fp").mapInArrow(run, "fp long, part int, v long")


def _flipped(rows: DataFrame, masks: dict[int, np.ndarray]) -> DataFrame:
    """(fq, part, v): each row (fp, part, v) once for every mask of its part, with those bits flipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):  # times the masks
                b = whole.slice(at, 1000)
                fp, part, v = (b.column(j).to_numpy(zero_copy_only=False) for j in range(3))
                for i in np.unique(part).tolist():
                    own, m = part == i, masks[i]
                    out = (v[own][:, None] ^ m[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp[own], len(m))), pa.array(np.full(len(out), i, np.int32)), pa.array(out)], ["fq", "part", "v"])

    return rows.select("fp", "part", "v").mapInArrow(run, "fq long, part int, v long")


def _bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for each pair of bits the rows that have both; from all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c = 0, np.zeros((64, 64))
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(v, axis=1, bitorder="little").astype(np.float32)
            n, c = n + len(x), c + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(4097)), pa.array([*c.ravel().astype(np.int64).tolist(), n], pa.int64())], ["pos", "v"])

    got = dict(fps.select("fp").mapInArrow(run, "pos long, v long").groupBy("pos").agg(F.sum("v")).collect())
    return got.get(4096, 0), np.array([got.get(i, 0) for i in range(4096)], float).reshape(64, 64)


def plan_parts(fps: DataFrame, radius: int, parts: int | None = None) -> tuple[list[list[int]], list[int], DataFrame, DataFrame, list[str]]:
    """Parts of the 64 bits and their thresholds, the fingerprints by part (fp, part, v), the part
    sizes' table (part, v, c), and the paths of both tables."""
    m = parts or radius + 1
    sizes = [64 // m + (i < 64 % m) for i in range(m)]
    n, together = _bit_statistics(fps)
    bits = group_bits(together, n, sizes)
    index, index_path = materialize(_by_part(fps, bits), "simhash-parts")
    sized, sized_path = materialize(index.groupBy("part", "v").agg(F.count("*").alias("c")), "simhash-sized")
    same = dict(sized.groupBy("part").agg(F.sum(F.col("c").cast("double") * F.col("c"))).collect())
    mean = np.diag(together) / max(n, 1)
    costs = []
    for i, p in enumerate(bits):
        # chance that two rows differ in d bits of the part, as if bits were independent,
        # scaled so that d = 0 gives the pairs counted above
        dist = np.zeros(radius + 1)
        dist[0] = 1
        for b in p:
            s = mean[b] ** 2 + (1 - mean[b]) ** 2
            dist = dist * s + np.concatenate([[0], dist[:-1]]) * (1 - s)
        scale = same.get(i, 0.0) / max(dist[0], 1e-300)
        costs.append([0.0] + [scale * float(dist[: t + 1].sum()) + n * len(_probe_masks(len(p), t)) for t in range(radius + 1)])
    return bits, allocate_thresholds(costs, radius + 1), index, sized, [index_path, sized_path]


def hamming_links(fps: DataFrame, radius: int = 2, parts: int | None = None, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, materialised) whose components are
    those of "at most ``radius`` differing bits" (:func:`written_links`)."""
    return written_links(fps, radius, parts, pair_bucket)[0]


def written_links(fps: DataFrame, radius: int = 2, parts: int | None = None, pair_bucket: int = PAIR_BUCKET) -> tuple[DataFrame, str]:
    """The same, and the path of that table.

    Small buckets give every pair within the radius. Rows of larger buckets are linked through the
    points of the cube around them: two fingerprints are within the radius exactly if their balls of
    radius ceil(radius / 2) and floor(radius / 2) meet, so every row sends itself to its ball's points
    and each point links its rows to its least one: as many rows out as in, whatever the bucket.
    For an odd radius the larger ball is used and the distance of the link is not bound by it, so
    odd radii take pairs only.

    What several joins read is written first: one plan of all of them would hold each of its inputs
    many times, and the driver plans it anew after every stage."""
    spark = fps.sparkSession
    bits, limits, index, sized, spent = plan_parts(fps, radius, parts)
    masks = {i: np.array(_probe_masks(len(p), t), np.int64) for i, (p, t) in enumerate(zip(bits, limits, strict=True)) if t >= 0}
    index = index.where(F.col("part").isin(list(masks)))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fq"))) <= radius
    ends = F.col("fq").alias("a"), F.col("fp").alias("b")
    if radius % 2:
        found, path = materialize(_flipped(index, masks).join(index, ["part", "v"]).where((F.col("fq") < F.col("fp")) & near).select(*ends).distinct(), "simhash-links")
        drop_path(spark, *spent, collect=False)
        return found, path
    hot = sized.where((F.col("c") > pair_bucket) & F.col("part").isin(list(masks))).select("part", "v")
    small = sized.where((F.col("c") <= pair_bucket) & (F.col("c") >= (2 if max(limits) == 0 else 1))).select("part", "v")
    pairs = _flipped(index, masks).join(index.join(small, ["part", "v"]), ["part", "v"]).where((F.col("fq") < F.col("fp")) & near).select(*ends)
    if not hot.isEmpty():
        pairs, pairs_path = materialize(pairs, "simhash-near")
        crowd = index.join(hot, ["part", "v"]).select("fp").union(_flipped(index, masks).join(hot, ["part", "v"]).select("fq")).distinct()
        crowd, crowd_path = materialize(crowd.select("fp", F.lit(0).alias("part"), F.col("fp").alias("v")), "simhash-crowd")
        ball = np.array([x - 2**64 if x >= 2**63 else x for x in _probe_masks(64, radius // 2)], np.int64)
        points = _flipped(crowd, {0: ball}).select(F.col("fq").alias("fp"), F.col("v").alias("z"))
        least = points.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("c")).where("c > 1").select("z", "a")
        pairs = pairs.union(points.join(least, "z").where("a < fp").select("a", F.col("fp").alias("b")))
        spent = [*spent, pairs_path, crowd_path]
    found, path = materialize(pairs.distinct(), "simhash-links")
    drop_path(spark, *spent, collect=False)
    return found, path


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 lowercase hex digits; component_id: the least id reachable over links of
    at most ``radius`` differing bits (rows with a null id take part and get their group's least)."""
    rows, _ = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    by_fp, _ = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    links, links_path = written_links(by_fp.select("fp"), radius)
    roots, _ = connected_components(links)
    drop_path(docs.sparkSession, links_path, collect=False)
    named = roots.join(by_fp, roots.node == by_fp.fp).groupBy("root").agg(F.min("least").alias("component"))
    moved = roots.join(named, "root").select(F.col("node").alias("fp"), "component")
    # fingerprints without a link keep their own least id
    of_fp = by_fp.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near duplicates by shingles


#: Texts of which the shingles' frequencies are learned, and the most shingles that are kept of them.
SAMPLE_TEXTS, MOST_KNOWN = 40_000, 500_000
#: A pair must meet in so many shingles of the two prefixes, or as many as its sizes ask for, if fewer.
MEETINGS = 2


def frequent_shingles(docs: DataFrame, text_col: str, width: int, sample: int = SAMPLE_TEXTS, most: int = MOST_KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles that two or more of about ``sample`` different texts hold, by
    hash; of more than ``most`` shingles, the more frequent ones.

    They only order the shingles, so a sample changes what the pairs cost, not which are found."""
    every = max(1, docs.count() // sample)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, width)).view(np.int64))], ["b"])

    # drawn by id and text: a group of copies is drawn as any other rows are, and counts once
    some = docs.where(F.pmod(F.xxhash64("doc_id", text), F.lit(every)) == 0).select(text.cast("binary").alias("t")).dropDuplicates(["t"])
    counted, path = materialize(some.mapInArrow(run, "b long").groupBy("b").agg(F.count("*").alias("c")).where("c > 1"), "simhash-known")
    at_count = sorted(((r["c"], r["n"]) for r in counted.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    least = next((c + 1 for (c, _), n in zip(at_count, np.cumsum([n for _, n in at_count]), strict=True) if n > most), 2)
    got = counted.where(F.col("c") >= least).toArrow()
    drop_path(docs.sparkSession, path)
    h, c = (got.column(j).combine_chunks().to_numpy(zero_copy_only=False) for j in (0, 1))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], c.astype(np.int64)[order]


def prefix_length(size, similarity: float):
    """Column: how many of a set's shingles are its prefix; two sets that are ``similarity`` alike
    share at least ceil(similarity * size) of either's shingles, so their prefixes meet."""
    return size - F.ceil(F.lit(similarity) * size - F.lit(1e-9)) + 1


def shingle_prefixes(docs: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """(doc_id, node, fp, size, prefix): node is the text's 64-bit hash, by which equal texts are found;
    fp the fingerprint of its distinct shingles (a signed long) and size their number; prefix the first of them (:func:`prefix_length`) in
    one order for all texts, the least frequent first. Texts without words have the prefix [0]."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text_col, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shipped.value
        for b in slices(batches):
            sizes, prefixes, fps = [], [], []
            for t in b.column(2).to_pylist():
                h = np.unique(shingle_hashes(t, width))
                sizes.append(len(h))
                fps.append(int(fingerprint(h)[0].astype(np.int64)))
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, times[at], 0), kind="stable")]
                prefixes.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64) if len(h) else np.zeros(1, np.int64))
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), flat], ["doc_id", "node", "fp", "size", "prefix"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("node"), text.cast("binary").alias("t")).mapInArrow(run, "doc_id long, node long, fp long, size int, prefix array<long>")


def _overlap(x: str, y: str, similarity: float):
    """Column: the shingles that two sets of these sizes share at least if they are alike."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (F.col(f"{x}size") + F.col(f"{y}size")) - F.lit(1e-6))


def _meetings(x: str, y: str, similarity: float):
    """Column: the prefix shingles, at most :data:`MEETINGS`, in which an alike pair surely meets.

    Of x's shingles, size - overlap are not shared, so all but as many of its prefix are; the one of
    the two prefixes that ends first holds no shared shingle that the other's lacks."""
    least = F.least(*[prefix_length(F.col(f"{c}size"), similarity) - F.col(f"{c}size") for c in (x, y)]) + _overlap(x, y, similarity)
    return F.greatest(F.lit(1), F.least(F.lit(MEETINGS), least))


def _may_be_alike(x: str, y: str, similarity: float, meetings=1):
    """Column: two texts that meet in a shingle at these places of their orders can be ``similarity``
    alike. True for the first ``meetings`` common shingles of every such pair."""
    shared = F.least(*[F.col(f"{c}size") - F.col(f"{c}pos") for c in (x, y)])
    return shared + (meetings - 1) >= _overlap(x, y, similarity)


def shared_prefixes(nodes: DataFrame) -> tuple[DataFrame, str]:
    """(b, node, size, pos, c): the prefix shingles that c > 1 nodes have, a row a node."""
    rows = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "b"))
    shared = rows.groupBy("b").agg(F.count("*").alias("c")).where("c > 1")
    return materialize(rows.join(shared, "b"), "simhash-met")


def popular_nodes(met: DataFrame, similarity: float) -> tuple[DataFrame, str]:
    """(node, score): by how many nodes each node's prefix shingles are met, on average."""
    return materialize(met.groupBy("node").agg((F.sum("c") / F.first(prefix_length(F.col("size"), similarity))).alias("score")), "simhash-popular")


def simhash_pairs(nodes: DataFrame, radius: int) -> tuple[DataFrame, str]:
    """(a, b): nodes (node, fp) by links of at most ``radius`` differing bits: of each fingerprint the
    least node stands for it in the links to others, and its other nodes are linked to that one."""
    by_fp, path = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "simhash-fp")
    links, links_path = written_links(by_fp.select("fp"), radius)
    x, y = (by_fp.select(F.col("fp").alias(end), F.col("least").alias(f"node_{end}")) for end in ("a", "b"))
    far = links.join(x, "a").join(y, "b").select("node_a", "node_b")
    same = nodes.join(by_fp, "fp").where(F.col("node") != F.col("least")).select("least", "node")
    out = materialize(far.union(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "simhash-pairs")
    drop_path(nodes.sparkSession, path, links_path, collect=False)
    return out


def hub_pairs(met: DataFrame, popular: DataFrame, similarity: float, tested: DataFrame) -> tuple[DataFrame, str]:
    """(a, b): each node with the hub of every bucket that it is in, but pairs that were tested.

    The hub is the bucket's most popular node: of a group of near copies that is the text, or next
    to the text, that the others come from."""
    hubs = met.join(popular, "node").groupBy("b").agg(F.max(F.struct("score", "node", "size", "pos")).alias("hub"))
    near = met.join(hubs, "b").where((F.col("node") != F.col("hub.node")) & _may_be_alike("", "hub.", similarity))
    return materialize(near.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "simhash-pairs")


def hub_groups(links: DataFrame, popular: DataFrame) -> DataFrame:
    """(node, root): root is the most popular of the node and those that it is linked to, so nodes of
    one root are of one component; most of a large group has its hub as root."""
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("root")) for x in ("a", "b") for y in ("a", "b")]))
    scored = links.select(ways.alias("w")).select("w.node", "w.root").join(popular.select(F.col("node").alias("root"), "score"), "root")
    return scored.groupBy("node").agg(F.max(F.struct("score", "root")).alias("x")).select("node", "x.root")


def remaining_pairs(met: DataFrame, roots: DataFrame, tested: DataFrame, similarity: float) -> tuple[DataFrame, str]:
    """(a, b): all pairs that are not yet in one group, were not tested, and meet often enough.

    Every such pair has a node outside the bucket's most frequent group, so a bucket that one group
    fills costs as many rows as it has nodes, times those outside."""
    own = met.select("b", "node", "size", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own, path = materialize(own, "simhash-rooted")
    groups = own.groupBy("b", "root").agg(F.count("*").alias("c"), F.min("size").alias("least")).groupBy("b").agg(F.count("*").alias("groups"), F.max_by("root", "c").alias("main"), F.min("least").alias("least"))
    # places so late that not even the bucket's smallest set leaves room for enough others go before the join
    room = F.col("size") - F.col("pos") + (MEETINGS - 1) >= F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("least")) - F.lit(1e-6)
    left = own.join(groups.where("groups > 1").select("b", "main", "least"), "b").where(room)
    other = left.select("b", *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "size", "pos")], (F.col("root") == F.col("main")).alias("other_main"))
    once = F.col("other_main") | (F.col("node") < F.col("other_node"))
    meetings = _meetings("", "other_", similarity)
    near = (F.col("root") != F.col("other_root")) & once & _may_be_alike("", "other_", similarity, meetings)
    pairs = left.where("root <> main").join(other, "b").where(near)
    pairs = pairs.groupBy(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).agg(F.count("*").alias("met"), F.first(meetings).alias("wanted"))
    out = materialize(pairs.where("met >= wanted").select("a", "b").join(tested, ["a", "b"], "left_anti"), "simhash-pairs")
    drop_path(met.sparkSession, path, collect=False)
    return out


def verified_pairs(pairs: DataFrame, docs: DataFrame, text_col: str, similarity: float, width: int) -> tuple[DataFrame, str]:
    """Those pairs whose whole texts' shingle sets are at least ``similarity`` alike (Jaccard)."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("node"), text.cast("binary").alias("t")).join(wanted, "node", "left_semi").dropDuplicates(["node"])
    texts, path = materialize(texts, "simhash-texts")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def shingles(node: int, t: bytes) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 200:
                    sets.clear()
                sets[node] = np.unique(shingle_hashes(t, width))
            return sets[node]

        for b in slices(batches):
            keep = []
            for i, j, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = shingles(i, s), shingles(j, t)
                most, least = max(len(x), len(y)), min(len(x), len(y))
                if least < similarity * most:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(most == 0 or both >= similarity * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    full = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("x")), "a")
    out = materialize(full.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "simhash-true")
    drop_path(docs.sparkSession, path)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(doc_id, node, component) for every row: component is the least id of the row's group.

    Groups are the components of links between texts whose sets of ``width``-word shingles (A-Z
    lower-cased) have a Jaccard similarity of at least ``similarity``. Every link is verified, and
    none is missed, whatever the number of texts. First come the links of fingerprints that differ
    in at most ``radius`` bits, by the generalised pigeonhole principle. Texts of that similarity may
    differ in more bits than any radius that can be probed, so an exact check follows: the nodes are
    held against the hubs of their prefix shingles' buckets, which joins the rest of a large group,
    and then all pairs of different groups whose prefixes meet."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, rows_path = materialize(shingle_prefixes(own, "text", width, similarity), "simhash-prefix")
    ids, _ = materialize(rows.select("doc_id", "node"), "simhash-ids")
    nodes, nodes_path = materialize(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "size", "prefix")]), "simhash-node")
    drop_path(spark, rows_path)
    close, close_path = simhash_pairs(nodes.select("node", "fp"), radius)
    met, met_path = shared_prefixes(nodes)
    drop_path(spark, nodes_path)
    popular, popular_path = popular_nodes(met, similarity)
    hubs, hubs_path = hub_pairs(met, popular, similarity, close)
    # both kinds are held against the texts at once: hub_pairs has left out those of fingerprints
    first = close.union(hubs)
    sure, sure_path = verified_pairs(first, own, "text", similarity, width)
    rest, rest_path = remaining_pairs(met, hub_groups(sure, popular), first, similarity)
    drop_path(spark, met_path, hubs_path, close_path, popular_path)
    more, more_path = verified_pairs(rest, own, "text", similarity, width)
    roots, _ = connected_components(sure.union(more))
    drop_path(spark, sure_path, more_path, rest_path)
    least = ids.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = roots.join(least, "node").groupBy("root").agg(F.min("least").alias("component"))
    moved = roots.join(named, "root").select("node", "component")
    of_node = least.join(moved, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    return ids.join(of_node, "node").select("doc_id", "node", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, every column, but one of each group of near duplicates: the row of the
    group's least id (of several such rows, the one with the least text hash, once)."""
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    i, t = (F.col(f"c{cols.index(c)}") for c in (id_col, text_col))
    found = near_duplicates(docs, id_col, text_col, **options)
    # a group whose ids are all null has a null component: its least text hash stands for it
    own = F.when(F.col("component").isNull(), F.col("node"))
    chosen = found.groupBy("component", own.alias("own")).agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component")), F.col("node"))).alias("node"))
    # plain equality on the same columns: the rows are shuffled once for the join and the repeats
    key = lambda node, x: {"row_node": node, "row_id": F.coalesce(x, F.lit(0)), "row_null": x.isNull()}
    chosen, _ = materialize(chosen.select(*[c.alias(n) for n, c in key(F.col("node"), F.col("component")).items()]), "simhash-chosen")
    keyed = plain.withColumns(key(F.xxhash64(F.coalesce(t.cast("string"), F.lit(""))), i.cast("long")))
    kept = keyed.join(chosen, chosen.columns, "left_semi").dropDuplicates(chosen.columns)
    return kept.select(*plain.columns).toDF(*cols)

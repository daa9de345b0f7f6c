"""URL filtering: rules first, then gradient-boosted trees on lexical features.

Rules name a host and a path: a rule fits its host and all its subdomains where the URL's path
starts with the rule's; the longest (host and path together, then the first given) wins and decides.
Other URLs are judged by trees that were boosted on labelled URLs, by default those that rules
decide. Only DataFrame operations are used: features are column expressions, a level of a tree is
chosen from one aggregation of gradients by (node, feature, bin), and the model is applied as a sum
of CASE expressions.

Rules of one length: the first given wins. Null URLs and URLs without ``://`` have empty host and path; they are judged by the trees like any
other (their features are those of the text, all 0 if null). Repeated rows get equal verdicts. With
no labelled URL, or labels of one kind only, the trees say what most labels say, else allow. An
empty table gives an empty result. Only the named columns are read; other names do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize, unit_hash

#: Folds of the labelled rows: a row's suffix rate is that of the other folds' labels.
FOLDS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "params", "hyphens", "suffix_count", "suffix_rate")


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Tree:
    """A node: a split (feature, threshold, left, right) or a leaf value."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    children: list[Tree] = field(default_factory=list)


@dataclass
class UrlModel:
    base: float
    trees: list[Tree]
    prior: float


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The text of the rule that wins, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need one URL only, as doubles."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    digits = "0123456789"
    chars = F.split(u, "")
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.when(n == 0, 0.0).otherwise(-F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c))))
    cols = {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/"),
        "labels": count(host, "."),
        "digit_ratio": F.coalesce(F.try_divide(count(u, digits), n), F.lit(0.0)),
        "host_digits": count(host, digits),
        "entropy": entropy,
        "params": count(u, "&") + F.when(F.contains(u, F.lit("?")), 1).otherwise(0),
        "hyphens": count(u, "-_"),
    }
    return {k: c.cast("double") for k, c in cols.items()}


def features(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", label: Column | None = None, smoothing: float = 20.0) -> tuple[DataFrame, float]:
    """(page_id, host, path, rule, label, *FEATURES), written, and the labels' rate of block.

    label: 1 block, 0 allow, null unknown. Suffix statistics cover every row: how many URLs end
    their host in the same label, and the rate of block among those that are labelled; for a
    labelled row, among those of the other folds, so that no feature holds the row's own label."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("u"), host_of(url).alias("host"), path_of(url).alias("path"), *([label.cast("int").alias("label")] if label is not None else []))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if label is None:
        kind = {r.text: int(r.action == "block") for r in reversed(rules)}
        by_rule = F.element_at(F.create_map(*[x for t, k in kind.items() for x in (F.lit(t), F.lit(k))]), F.col("rule")) if kind else F.lit(None).cast("int")
        rows = rows.withColumn("label", by_rule)
    rows = rows.withColumns(lexical(F.col("u"), F.col("host"), F.col("path"))).withColumn("suffix", F.substring_index("host", ".", -1)).drop("u")
    fold = F.when(F.col("label").isNull(), -1).otherwise(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(FOLDS)).cast("int"))
    rows, rows_path = materialize(rows.withColumn("fold", fold), "urls")
    by_fold, fold_path = materialize(rows.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")), "url-suffix")
    all_known = by_fold.agg(F.sum("known"), F.sum("bad"), F.count("*")).first()
    prior = (all_known[1] or 0) / all_known[0] if all_known[0] else 0.0
    suffix = Window.partitionBy("suffix")  # at most FOLDS + 1 rows
    others = {c: F.sum(c).over(suffix) - F.col(c) for c in ("known", "bad")}
    rate = (others["bad"] + smoothing * prior) / (others["known"] + smoothing)
    stats = by_fold.select("suffix", "fold", F.log1p(F.sum("n").over(suffix)).alias("suffix_count"), rate.alias("suffix_rate"))
    if (all_known[2] or 0) <= 50_000:  # broadcast up to a checked size; beyond, a join that AQE can split
        stats = F.broadcast(stats)
    out, _ = materialize(rows.join(stats, ["suffix", "fold"]).drop("suffix", "fold"), "url-features")
    drop_path(pages.sparkSession, rows_path, fold_path)
    return out, prior


def _apply(tree: Tree) -> Column:
    if not tree.children:
        return F.lit(tree.value)
    left, right = tree.children
    return F.when(F.col(FEATURES[tree.feature]) <= F.lit(tree.threshold), _apply(left)).otherwise(_apply(right))


def margin(model: UrlModel) -> Column:
    out = F.lit(model.base)
    for t in model.trees:
        out = out + _apply(t)
    return out


def _node_of(tree: Tree, base: int = 1) -> Column:
    """The row's leaf as a heap index."""
    if not tree.children:
        return F.lit(base)
    return F.when(F.col(FEATURES[tree.feature]) <= F.lit(tree.threshold), _node_of(tree.children[0], 2 * base)).otherwise(_node_of(tree.children[1], 2 * base + 1))


def _leaves(tree: Tree, base: int = 1) -> dict[int, Tree]:
    return {base: tree} if not tree.children else _leaves(tree.children[0], 2 * base) | _leaves(tree.children[1], 2 * base + 1)


def train(rows: DataFrame, prior: float, max_rows: int = 20_000, trees: int = 12, depth: int = 3, rate: float = 0.4, bins: int = 24, l2: float = 1.0, min_rows: int = 5, seed: int = 0) -> UrlModel:
    """Boost on at most about ``max_rows`` labelled rows, drawn by a hash of host and path.

    Newton boosting of the log loss; thresholds are quantiles of the sample."""
    known = rows.where("label IS NOT NULL")
    n = known.count()
    if n == 0 or prior in (0.0, 1.0):
        return UrlModel(4.0 if n and prior == 1.0 else -4.0, [], prior)
    sample, sample_path = materialize(known.where(unit_hash(F.lit(seed), F.col("page_id"), F.col("host"), F.col("path")) < F.lit(min(1.0, max_rows / n))).select("label", *FEATURES), "url-sample")
    grid = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    q = sample.agg(*[F.percentile_approx(f, grid, 10_000).alias(f) for f in FEATURES]).first()
    if q is None or q[0] is None:
        return UrlModel(math.log(prior / (1 - prior)), [], prior)
    edges = [sorted(set(q[f])) for f in FEATURES]
    model = UrlModel(math.log(prior / (1 - prior)), [], prior)
    # a feature's bin: how many thresholds lie below the value
    place = [sum((F.when(F.col(f) > F.lit(e), 1).otherwise(0) for e in es), F.lit(0)) for f, es in zip(FEATURES, edges, strict=True)]
    sample, binned_path = materialize(sample.withColumn("bins", F.array(*place)), "url-sample")
    drop_path(rows.sparkSession, sample_path)
    for _ in range(trees):
        tree = Tree()
        p = 1 / (1 + F.exp(-margin(model)))
        for level in range(depth):
            live = {i: t for i, t in _leaves(tree).items() if i >= 2**level}
            if not live:
                break
            at = sample.select(_node_of(tree).alias("node"), (F.col("label") - p).alias("g"), (p * (1 - p)).alias("h"), F.posexplode("bins").alias("f", "b"))
            sums: dict[int, dict[int, dict[int, tuple[float, float, int]]]] = {}
            for r in at.groupBy("node", "f", "b").agg(F.sum("g"), F.sum("h"), F.count("*")).collect():
                sums.setdefault(r[0], {}).setdefault(r[1], {})[r[2]] = (r[3], r[4], r[5])
            for i, leaf in live.items():
                by_f = sums.get(i)
                if not by_f:
                    continue
                g, h, c = (sum(x[k] for x in by_f[0].values()) for k in range(3))
                leaf.value = rate * g / (h + l2)
                best = (1e-6, -1, 0, 0.0, 0.0)
                for f, by_b in sorted(by_f.items()):
                    gl = hl = cl = 0
                    for b in sorted(by_b)[:-1]:
                        x = by_b[b]
                        gl, hl, cl = gl + x[0], hl + x[1], cl + x[2]
                        gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
                        if gain > best[0] and cl >= min_rows and c - cl >= min_rows:
                            best = (gain, f, b, gl / (hl + l2), (g - gl) / (h - hl + l2))
                if best[1] >= 0:
                    leaf.feature, leaf.threshold = best[1], float(edges[best[1]][best[2]])
                    leaf.children = [Tree(rate * best[3]), Tree(rate * best[4])]
        model.trees.append(tree)
    drop_path(rows.sparkSession, binned_path)
    return model


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", label: Column | None = None, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for every row of ``pages``."""
    rows, prior = features(pages, rules, id_col, url_col, label)
    model = train(rows, prior, **options)
    score = 1 / (1 + F.exp(-margin(model)))
    action = {r.text: r.action for r in reversed(rules)}
    by_rule = F.element_at(F.create_map(*[F.lit(x) for kv in action.items() for x in kv]), F.col("rule")) if action else F.lit(None).cast("string")
    verdict = F.coalesce(by_rule, F.when(score > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("block_score"))

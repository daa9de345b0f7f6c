"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Text is folded first: compatibility forms and diacritics go, homoglyphs of other scripts become the
Latin letters that they look like, digits and signs that stand for letters become them, everything
is lower-cased and all but letters is a space. Exception phrases are masked out. Lexicon entries are
whole words or beginnings of words; at each word the heaviest entry counts. A text's mark is its
summed weight, its weight by length and its number of different entries, which a logistic curve
turns into a score.

The lexicon is learned from labelled texts on a bounded sample: entries are words and beginnings of
words that toxic texts hold far more often than clean ones, weighted by the smoothed log odds of the
two rates. Seed entries may be given besides.

Whole texts are read. Null and empty texts score the curve's value at no match. Rows without a label
are scored, never learned from; a document with several labels is toxic if any says so. Repeated
rows score alike. Without labels of both kinds, the seeds alone count. Texts of any length are read
whole; the memory of a worker follows its longest text. Of entries that begin at one place the
heaviest counts, of equally heavy ones the first found. An empty table gives an empty result. Only
id, text (and, in training, the labels' id and mark) are read; an input column named toxicity gives
way to that of the result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, materialize, slices, unit_hash

#: Letters of other scripts, digits and signs, and the Latin letters that they imitate.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e",
}
#: Phrases in which an entry means no harm (folded).
EXCEPTIONS = ("trash can", "trash bin", "white trash bag", "clown fish", "scum line", "pond scum", "sore loser board", "stupid simple")


#: A lexicon entry is in at least so many toxic texts, at least so much likelier (natural log) there.
MIN_TEXTS, MIN_ODDS = 3, 2.5


class _Fold(dict):
    """For str.translate: one character to its folded form, worked out once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = LOOKALIKES.get(c)
        if out is None:
            out = ""
            for x in unicodedata.normalize("NFKD", c).lower():
                if unicodedata.combining(x):
                    continue
                y = LOOKALIKES.get(x, x)
                out += y if y.isalpha() else " "
            # a lone combining mark joins its word, all else that is no letter ends it
            if not out and not unicodedata.combining(c):
                out = " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words, each with a space before and after."""
    return " " + " ".join(text.translate(_FOLD).split()) + " "


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]  # " word " or " beginning" to its weight
    exceptions: Sequence[str] = EXCEPTIONS
    coef: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 1.0]))
    intercept: float = -3.0


class Matcher:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.auto = ahocorasick.Automaton()
        for k, w in model.lexicon.items():
            self.auto.add_word(k, (len(k), w, k))
        for p in model.exceptions:
            self.auto.add_word(f" {p} ", (len(p) + 2, None, p))
        self.ready = len(self.auto) > 0
        if self.ready:
            self.auto.make_automaton()

    def marks(self, text: str | None) -> np.ndarray:
        """Log of the summed weight, weight by length, and number of different entries."""
        folded = fold(text or "")
        best: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        if self.ready:
            for end, (n, w, k) in self.auto.iter(folded):
                start = end - n + 1
                if w is None:
                    spared.append((start, end))
                elif start not in best or w > best[start][0]:
                    best[start] = (w, k)
        if spared and best:
            best = {s: v for s, v in best.items() if not any(a <= s < z for a, z in spared)}
        if not best:
            return np.zeros(3)
        total = sum(w for w, _ in best.values())
        words = max(1, folded.count(" ") - 1)
        return np.array([np.log1p(total), min(1.0, 10 * total / words), np.log1p(len({k for _, k in best.values()}))])

    def score(self, text: str | None) -> float:
        z = float(self.marks(text) @ self.model.coef + self.model.intercept)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def entries_of(text: str | None, shortest: int = 4, longest: int = 9) -> set[str]:
    """A text's words and their beginnings, as lexicon keys."""
    out = set()
    for w in set(fold(text or "").split()):
        out.add(f" {w} ")
        for n in range(shortest, min(longest, len(w)) + 1):
            out.add(" " + w[:n])
    return out


def choose_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int, min_texts: int = MIN_TEXTS, min_odds: float = MIN_ODDS) -> dict[str, float]:
    """Entries by falling log odds; an entry that a kept shorter beginning covers as well is left out. ``counts``: entry, toxic texts, clean texts."""
    scored = []
    for k, a, b in counts:
        odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
        if a >= min_texts and odds >= min_odds:
            scored.append((k, float(odds), a))
    # a beginning stands for all words that it starts: the ones with more support come first
    scored.sort(key=lambda x: (-x[1], -x[2], len(x[0]), x[0]))
    out: dict[str, float] = {}
    for k, odds, _ in scored:
        covered = any(k[:n] in out and out[k[:n]] >= odds - 0.5 for n in range(2, len(k)))
        if not covered:
            out[k] = min(odds, 8.0)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    pen = ridge * np.eye(len(w))
    pen[-1, -1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (y - p) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows_a_class: int = 6000, seeds: dict[str, float] | None = None, exceptions: Sequence[str] = EXCEPTIONS, seed: int = 0) -> ToxicityModel:
    """Fit on documents for which ``learn`` holds and that ``labels`` marks.

    At most about ``max_rows_a_class`` texts of each class are drawn by a hash of the id (all, if
    fewer). All of them give the lexicon; the curve is fitted on marks by the other half's lexicon."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("lid")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marked = marks.where(F.col("y").isin(0, 1)).withColumnRenamed("lid", id_col).where(learn).withColumnRenamed(id_col, "lid")
    sizes = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    model = ToxicityModel({f" {k} ": v for k, v in (seeds or {}).items()}, exceptions)
    if len(sizes) < 2:
        return model
    share = F.when(F.col("y") == 1, F.lit(min(1.0, max_rows_a_class / sizes[1]))).otherwise(F.lit(min(1.0, max_rows_a_class / sizes[0])))
    drawn, drawn_path = materialize(marked.withColumn("u", unit_hash(F.lit(seed), F.col("lid")) / share).where("u < 1"), "toxic-draw")
    if drawn.count() <= 4 * max_rows_a_class:  # a bounded sample by its draw; checked all the same
        drawn = F.broadcast(drawn)
    texts = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).alias("t"))
    sample, sample_path = materialize(texts.join(drawn, "lid").select("y", "u", "t"), "toxic-sample")

    sample = sample.withColumn("half", (F.col("u") >= 0.5).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(4)]  # clean and toxic texts of the first half, then of the second
        for b in slices(batches):
            for y, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen[2 * h + y].update(entries_of(t))
        keys = list(set().union(*seen))
        for lo in range(0, len(keys), 50_000):
            k = keys[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), *(pa.array([c[x] for x in k], pa.int64()) for c in seen)], ["k", "n0", "n1", "n2", "n3"])

    n = {(r[0], r[1]): r[2] for r in sample.groupBy("half", "y").count().collect()}
    size = [n.get((h, y), 0) for h in (0, 1) for y in (0, 1)]
    # a text brings some thousand entries, so what is sent is bounded by the sample
    counted = sample.select("y", "half", "t").coalesce(8).mapInArrow(count, "k string, n0 long, n1 long, n2 long, n3 long").groupBy("k").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(4)])
    odds = lambda a, b, na, nb: F.log((a + 0.5) / F.lit(na + 1)) - F.log((b + 0.5) / F.lit(nb + 1))
    able = [(F.col(f"n{2 * h + 1}") >= MIN_TEXTS) & (odds(F.col(f"n{2 * h + 1}"), F.col(f"n{2 * h}"), size[2 * h + 1], size[2 * h]) >= MIN_ODDS) for h in (0, 1)]
    whole = (F.col("n1") + F.col("n3") >= MIN_TEXTS) & (odds(F.col("n1") + F.col("n3"), F.col("n0") + F.col("n2"), size[1] + size[3], size[0] + size[2]) >= MIN_ODDS)
    strong = [tuple(r) for r in counted.where(able[0] | able[1] | whole).collect()]
    # each half is marked with the other half's lexicon to fit the curve; the model keeps the whole one
    halves = [ToxicityModel(model.lexicon | choose_lexicon([(r[0], r[2 * h + 2], r[2 * h + 1]) for r in strong], size[2 * h + 1], size[2 * h]), exceptions) for h in (0, 1)]
    model.lexicon = choose_lexicon([(r[0], r[2] + r[4], r[1] + r[3]) for r in strong], size[1] + size[3], size[0] + size[2]) | model.lexicon
    shipped = docs.sparkSession.sparkContext.broadcast(halves)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = [Matcher(x) for x in shipped.value]
        for b in slices(batches):
            x = np.array([m[1 - h].marks(t) for h, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, j]) for j in range(3))], ["y", "a", "b", "c"])

    rows = np.array([tuple(r) for r in sample.select("y", "half", "t").mapInArrow(mark, "y int, a double, b double, c double").collect()], float).reshape(-1, 4)
    drop_path(docs.sparkSession, drawn_path, sample_path)
    if len(np.unique(rows[:, 0])) == 2:
        model.coef, model.intercept = fit_logistic(rows[:, 1:], rows[:, 0])
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with a column more: toxicity, from 0 to 1, in place of an input column of that name."""
    if text_col == "toxicity":  # the text itself is named so
        docs, text_col = docs.withColumn("__text", F.col(text_col)), "__text"
    docs = docs.drop("toxicity")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shipped.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(t) for t in b.column(at).to_pylist()], pa.float64())], [*b.schema.names, "toxicity"])

    schema = T.StructType([*plain.schema.fields, T.StructField("toxicity", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*cols, "toxicity").drop("__text")

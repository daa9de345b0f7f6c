"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased, all but letters become one boundary mark, and n-grams of 1 to 3
characters are hashed into a fixed number of bins. Document frequencies are counted over every
training text; features are (1 + ln tf) x idf, scaled to unit length. The weights are trained with
follow-the-regularised-leader (FTRL-Proximal) under elastic-net penalties on a bounded sample of
labelled texts, and the softmax is calibrated by a temperature fitted on a part of that sample that
training leaves out.

Prediction reads whole texts. Null texts and texts without a letter give language ``und`` with
score 0. Rows with a null label are predicted, never learned from. Repeated rows get equal
predictions. Without labelled rows every text is ``und``; a single label is always predicted, with
score 1. Texts of any length are read whole; the memory of a worker follows its longest text. Equal
margins go to the first label in order. An empty table gives an empty result. Only id, text and (in
training) label are read; input columns named lang_pred or score give way to those of the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, materialize, slices, unit_hash

BINS = 1 << 15
ORDERS = (1, 2, 3)
UND = "und"


def code_points(text: bytes | None) -> tuple[np.ndarray, bool]:
    """Lower-cased letters as code points, runs of all else as one 0; whether a letter is there."""
    s = (text or b"").decode("utf-8", "replace").lower()
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    high = np.unique(cp[cp >= 128])
    letter = np.zeros(128, bool)
    letter[97:123] = True
    ok = letter[np.minimum(cp, 127)] & (cp < 128)
    if len(high):
        ok |= np.isin(cp, high[[chr(c).isalpha() for c in high.tolist()]])
    if not ok.any():
        return np.zeros(0, np.uint32), False
    cp = np.where(ok, cp, 0)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
    return np.concatenate([[0], cp[keep], [0]]).astype(np.uint32), True


def ngram_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the text's n-grams, ascending, and how often each occurs."""
    cp, any_letter = code_points(text)
    if not any_letter:
        return np.zeros(0, np.int64), np.zeros(0)
    out = np.zeros(BINS, np.int64)
    for n in ORDERS:
        h = np.full(max(0, len(cp) - n + 1), 2166136261 + n, np.uint32)
        for k in range(n):
            h = (h ^ cp[k : len(cp) - n + 1 + k]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        out += np.bincount(h & np.uint32(BINS - 1), minlength=BINS)
    at = np.nonzero(out)[0]
    return at, out[at].astype(float)


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (bins, labels)
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(x @ x)
        return x / norm if norm > 0 else x

    def margins(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.features(at, tf) @ self.weights[at] + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float]:
        at, tf = ngram_counts(text)
        if not len(at) or not self.labels:
            return UND, 0.0
        p = softmax(self.margins(at, tf) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-Proximal with per-coordinate rates. ``rows``: (bins, features).

    The elastic net: l1 sets small coordinates to exactly zero, l2 shrinks the rest. The last
    coordinate is the bias, which is not penalised by l1."""
    z, n = np.zeros((BINS + 1, n_labels)), np.zeros((BINS + 1, n_labels))
    pull = np.full((BINS + 1, 1), l1)
    pull[BINS] = 0

    def now(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * pull[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= pull[at], 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            at, x = np.append(rows[i][0], BINS), np.append(rows[i][1], 1.0)
            w = now(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = now(np.arange(BINS + 1))
    return w[:BINS], w[BINS]


def fit_temperature(margins: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(margins / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows_a_label: int = 1500, max_rows: int = 200_000, max_labels: int = 1000, seed: int = 0) -> LanguageModel:
    """Fit on the rows of ``docs`` for which ``learn`` holds and the label is not null.

    Document frequencies: all of those rows. Weights: about ``max_rows_a_label`` of each label's
    rows, and ``max_rows`` of all, drawn by a hash of the id (all, if fewer); a fifth of the draw fits
    the temperature.
    More than ``max_labels`` labels are an error."""
    rows = docs.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(label_col).cast("string").alias("y"), F.col(text_col).cast("binary").alias("t"))
    sizes = {r[0]: r[1] for r in rows.groupBy("y").count().limit(max_labels + 1).collect()}
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not sizes:
        return LanguageModel([], np.zeros(BINS), np.zeros((BINS, 0)), np.zeros(0))
    each = min(max_rows_a_label, max_rows / len(sizes))
    share = F.element_at(F.create_map(*[x for y, n in sorted(sizes.items()) for x in (F.lit(y), F.lit(min(1.0, each / n)))]), F.col("y"))
    drawn = rows.select("y", "t", unit_hash(F.lit(seed), F.col("i")).alias("u"), share.alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BINS, np.int64), 0
        for b in slices(batches):
            out = []
            for y, t, u, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, tf = ngram_counts(t)
                df[at] += 1
                n += 1
                if u < s and len(at):
                    out.append((y, u / s, at.astype(np.uint16).tobytes(), tf.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.binary(), pa.binary()))], ["y", "u", "at", "tf"])
        at = np.nonzero(df)[0]  # the partition's document frequencies, as a last row without a label
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([float(n)]), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([df[at].astype("<i8").tobytes()], pa.binary())], ["y", "u", "at", "tf"])

    got, path = materialize(drawn.mapInArrow(run, "y string, u double, at binary, tf binary"), "langid")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BINS, np.int64), 0
        for b in batches:
            for u, at, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                df[np.frombuffer(at, np.uint16)] += np.frombuffer(c, "<i8")
                n += int(u)
        yield pa.RecordBatch.from_arrays([pa.array([*df.tolist(), n], pa.int64()), pa.array(range(BINS + 1), pa.int32())], ["v", "bin"])

    # per-partition vectors are added in few tasks, each of which sends one row a bin
    sums = got.where("y IS NULL").select("u", "at", "tf").coalesce(4).mapInArrow(add, "v long, bin int").groupBy("bin").agg(F.sum("v").alias("v"))
    df = np.zeros(BINS + 1)
    for r in sums.collect():
        df[r["bin"]] = r["v"]
    idf = np.log((1 + df[BINS]) / (1 + df[:BINS])) + 1
    sample = sorted((r["y"], r["u"], bytes(r["at"]), bytes(r["tf"])) for r in got.where("y IS NOT NULL").toLocalIterator())
    drop_path(docs.sparkSession, path)
    labels = sorted(sizes)
    model = LanguageModel(labels, idf, np.zeros((BINS, len(labels))), np.zeros(len(labels)))
    xs, ys, fit = [], [], []
    for y, u, at, tf in sample:
        a = np.frombuffer(at, np.uint16).astype(np.int32)
        xs.append((a, model.features(a, np.frombuffer(tf, np.float32).astype(float)).astype(np.float32)))
        ys.append(labels.index(y))
        fit.append(u >= 0.2)
    ys, fit = np.array(ys, int), np.array(fit, bool)
    if fit.any():
        chosen = np.nonzero(fit)[0].tolist()
        model.weights, model.bias = train_ftrl([xs[i] for i in chosen], ys[fit], len(labels), seed=seed)
        held = np.nonzero(~fit)[0].tolist()
        if held:
            model.temperature = fit_temperature(np.array([xs[i][1] @ model.weights[xs[i][0]] + model.bias for i in held]), ys[held])
    return model


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with two columns more, lang_pred and score, in place of input columns of those names."""
    if text_col in ("lang_pred", "score"):  # the text itself is named so
        docs, text_col = docs.withColumn("__text", F.col(text_col)), "__text"
    docs = docs.drop("lang_pred", "score")
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        for b in slices(batches):
            found = [m.predict(None if t is None else t.encode()) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*cols, "lang_pred", "score").drop("__text")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, every column, whose language is found with at least ``min_score``."""
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    found = predict(plain, model, f"c{cols.index(text_col)}")
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= min_score)).select(*plain.columns).toDF(*cols)

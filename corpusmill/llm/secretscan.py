"""Secret scanning: pattern candidates, with a random forest to remove false positives.

Candidates are runs of token characters found by rules: known key formats, values assigned to names
such as ``password`` or ``token``, and long mixed strings. A forest of decision trees, trained on
labelled findings, scores each candidate by its length, character classes, entropy, how likely its
letter pairs are in the corpus, how much of it the corpus's words cover, whether it stands in a path
or URL, and the words beside it.

Letter pairs and words are counted over all texts of a corpus (:func:`corpus_statistics`); the
dictionary is its most frequent words by the number of texts that hold them. Labelled findings are a
table (label, kind, value, before, after, in_path), of which at most a bounded number of rows is
drawn. Where no such table exists, :func:`made_up_findings` makes one from a seed: random keys in the
formats' alphabets against placeholders, hashes of commits in paths, identifiers, words and numbers.

Null and empty texts give no findings. Overlapping candidates: the first rule that matches a place
wins. Repeated rows repeat their findings. Findings with a null label are not learned from; with one
label only, every candidate scores that label; with none, 0.5. Whole texts are read; only id and
text are.
"""

from __future__ import annotations

import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, materialize, slices, unit_hash

#: Rules as (kind, pattern); the value is the group ``v``.
RULES = (
    ("aws_access_key", r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("github_token", r"\b(?P<v>gh[pousr]_[A-Za-z0-9]{36,})\b"),
    ("google_api_key", r"\b(?P<v>AIza[0-9A-Za-z_\-]{35})"),
    ("slack_token", r"\b(?P<v>xox[abprs]-[0-9A-Za-z\-]{10,})"),
    ("jwt", r"\b(?P<v>eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*)"),
    ("private_key", r"(?P<v>-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
    ("assigned", r"(?i:(?<![A-Za-z0-9_\-])(?=[A-Za-z0-9_\-]*?(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth))[A-Za-z0-9_\-]*+)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<v>[^\s\"'<>;,]{6,}+)"),
    ("mixed", r"(?<![A-Za-z0-9+/=_\-.@])(?P<v>(?=[A-Za-z+/=_\-]*[0-9])(?=[0-9+/=_\-]*[A-Za-z])[A-Za-z0-9+/=_\-]{20,}+)(?![A-Za-z0-9+/=_\-@])"),
)
#: Words that name what follows, and words that mark an example.
NAMING = frozenset("password passwd pwd secret token key api apikey auth credential credentials access private bearer login".split())
EXAMPLE = frozenset("example sample test dummy placeholder changeme your insert fake xxx todo commit sha sha1 sha256 md5 hash uuid guid version id build".split())
COMMON = frozenset("password secret token example sample test user name admin change default value string number house water table green light paper school river mountain hello world value index data file config public local server client data base table column field".split())
FEATURES = ("length", "digits", "upper", "lower", "signs", "entropy", "transitions", "class_changes", "dictionary", "distinct", "repeats", "hex", "path", "named", "example", "known")
_ALL = re.compile("|".join(f"(?P<k{i}>{p.replace('?P<v>', f'?P<v{i}>')})" for i, (_, p) in enumerate(RULES)))
_NEAR = re.compile(r"[A-Za-z0-9]+")


@dataclass
class Finding:
    kind: str
    start: int
    end: int
    value: str
    before: str
    after: str
    in_path: bool


#: Characters beside a candidate that are looked at.
BESIDE = 60


def candidates(text: str | None) -> Iterator[Finding]:
    for m in _ALL.finditer(text or ""):
        i = next(i for i in range(len(RULES)) if m.group(f"k{i}") is not None)
        a, z = m.span(f"v{i}")
        before = text[max(0, a - BESIDE) : a]
        in_path = text[max(0, a - 1) : a] in ("/", "\\") or text[z : z + 1] in ("/", "\\") or "://" in "".join(before.rsplit(maxsplit=1)[-1:])
        yield Finding(RULES[i][0], a, z, text[a:z], before, text[z : z + BESIDE], in_path)


# ---------------------------------------------------------------- the corpus


#: Fixed value: prose whose letter pairs and words stand for a corpus where none is given.
PROSE = "the quick brown fox jumps over the lazy dog and then there were other things that people said in the house of letters where every reader could find something interesting about nature history language and the general way in which information is written down for others to read again later with some understanding of what was meant"


@dataclass
class Statistics:
    """Log probabilities of the second letter of a pair by the first, and the words known."""

    pairs: np.ndarray  # (26, 26)
    words: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.words), default=0)

    def transitions(self, value: str) -> float:
        """Mean log probability of the letter pairs of a value; that of a rare pair if it has none."""
        at = _letters(value.encode())
        ok = (at[:-1] < 26) & (at[1:] < 26)
        return float(self.pairs[at[:-1][ok], at[1:][ok]].mean()) if ok.any() else -7.0

    def covered(self, value: str) -> float:
        """Share of a value's characters in known words, the longest word at each place first."""
        low, at, n = value.lower(), 0, 0
        while at < len(low):
            k = next((k for k in range(min(self.longest, len(low) - at), 3, -1) if low[at : at + k] in self.words), 0)
            n += k
            at += k or 1
        return n / max(1, len(low))


def _letters(text: bytes) -> np.ndarray:
    """Places in the alphabet of the bytes, A-Z as a-z; 26 and more for all else."""
    return (np.frombuffer(text.lower(), np.uint8).astype(np.int64) - 97) % 256


def log_pairs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + 26))


def statistics_of(texts: Sequence[str], words: frozenset[str] = frozenset()) -> Statistics:
    """Those of a few texts on the driver."""
    counts = sum((_pair_counts(t.encode()) for t in texts), np.zeros((26, 26), np.int64))
    return Statistics(log_pairs(counts), words | frozenset(w for t in texts for w in t.split() if len(w) > 3))


def _pair_counts(text: bytes) -> np.ndarray:
    at = _letters(text)
    ok = (at[:-1] < 26) & (at[1:] < 26)
    return np.bincount(at[:-1][ok] * 26 + at[1:][ok], minlength=676).reshape(26, 26)


_WORD = re.compile(rb"[a-z]{4,24}")


def corpus_statistics(docs: DataFrame, text_col: str = "text", least_share: float = 5e-6, least_texts: int = 3) -> Statistics:
    """Letter pairs of all texts, and the words (4 to 24 ASCII letters) that make up ``least_share`` of
    all (text, word) pairs or more, so 1 / ``least_share`` words at most, each in ``least_texts`` texts
    at least. Counts are added up on the executors; a worker passes on
    its counts whenever it holds 200,000 words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, seen = np.zeros((26, 26), np.int64), Counter()
        out = lambda keys, n: pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["key", "n"])
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                pairs += _pair_counts(t)
                seen.update(set(_WORD.findall(t.lower())))
            if len(seen) > 200_000:
                yield out([k.decode() for k in seen], list(seen.values()))
                seen.clear()
        yield out([k.decode() for k in seen], list(seen.values()))
        yield out([f"{i:03d}" for i in range(676)], pairs.ravel().tolist())  # no word has a digit

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("t"))
    counted, path = materialize(texts.mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")), "secret-words")
    is_pair = F.col("key").rlike("^[0-9]")
    pairs = np.zeros(676, np.int64)
    for r in counted.where(is_pair).collect():
        pairs[int(r["key"])] = r["n"]
    every = counted.where(~is_pair).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counted.where(~is_pair & (F.col("n") >= max(least_texts, least_share * every)))
    found = Statistics(log_pairs(pairs.reshape(26, 26)), COMMON | frozenset(r["key"] for r in words.collect()))
    drop_path(docs.sparkSession, path)
    return found


def features(f: Finding, known: Statistics) -> list[float]:
    v, n = f.value, max(1, len(f.value))
    count = Counter(v)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in v]
    before = {w.lower() for w in _NEAR.findall(f.before)[-4:]}
    beside = before | {w.lower() for w in _NEAR.findall(f.after)[:4]}
    return [
        float(n),
        classes.count("d") / n,
        classes.count("u") / n,
        classes.count("l") / n,
        classes.count("s") / n,
        -sum(c / n * math.log2(c / n) for c in count.values()),
        known.transitions(v),
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n,
        known.covered(v),
        len(count) / n,
        max(count.values(), default=0) / n,
        float(all(c in "0123456789abcdef" for c in v.lower())),
        float(f.in_path),
        float(not before.isdisjoint(NAMING)),
        float(not beside.isdisjoint(EXAMPLE)),
        float(f.kind not in ("assigned", "mixed")),
    ]


# ---------------------------------------------------------------- the forest


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tries: int) -> tuple:
    """A tree as nested tuples: (probability,) or (feature, threshold, left, right)."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
        return (p,)
    best = (1e-9, None, None)
    for f in rng.choice(x.shape[1], tries, replace=False).tolist():
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        at = np.nonzero(v[1:] > v[:-1])[0]
        at = at[(at + 1 >= least) & (len(y) - at - 1 >= least)]
        if not len(at):
            continue
        nl, sl = at + 1.0, s[at]
        nr, sr = len(y) - nl, s[-1] - sl
        gini = len(y) * p * (1 - p) - sl * (1 - sl / nl) - sr * (1 - sr / nr)
        i = int(gini.argmax())
        if gini[i] > best[0]:
            best = (float(gini[i]), f, float((v[at[i]] + v[at[i] + 1]) / 2))
    if best[1] is None:
        return (p,)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], y[left], rng, depth - 1, least, tries), _grow(x[~left], y[~left], rng, depth - 1, least, tries))


@dataclass
class Forest:
    trees: list[tuple]
    known: Statistics = field(default_factory=lambda: statistics_of([PROSE], COMMON))

    def score(self, row: list[float]) -> float:
        total = 0.0
        for node in self.trees:
            while len(node) > 1:
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node[0]
        return total / len(self.trees) if self.trees else 0.5


def train(findings: Sequence[tuple[int, Finding]], known: Statistics | None = None, trees: int = 60, depth: int = 10, least: int = 2, seed: int = 0) -> Forest:
    """A random forest on labelled findings (label 1: a real secret)."""
    rng = np.random.default_rng(seed)
    known = known or statistics_of([PROSE], COMMON)
    if not findings:
        return Forest([], known)
    x, y = np.array([features(f, known) for _, f in findings]), np.array([float(label) for label, _ in findings])
    grown = []
    for _ in range(trees):
        pick = rng.integers(0, len(x), len(x))
        grown.append(_grow(x[pick], y[pick], rng, depth, least, max(1, int(math.sqrt(x.shape[1])))))
    return Forest(grown, known)


#: The columns of a table of labelled findings.
FINDINGS = "label int, kind string, value string, before string, after string, in_path boolean"


def findings_table(spark: SparkSession, findings: Sequence[tuple[int, Finding]]) -> DataFrame:
    return spark.createDataFrame([(y, f.kind, f.value, f.before, f.after, f.in_path) for y, f in findings], FINDINGS)


def read_findings(table: DataFrame, max_rows: int = 20_000, seed: int = 0) -> list[tuple[int, Finding]]:
    """Labelled findings of a table, at most about ``max_rows``, drawn by a hash of the row; rows
    without label or value are left out, other nulls count as empty."""
    rows = table.select("label", *[F.coalesce(c, F.lit("")).alias(c) if c != "value" else F.col(c) for c in ("kind", "value", "before", "after")], F.coalesce("in_path", F.lit(False)).alias("in_path")).where("label IN (0, 1) AND value IS NOT NULL")
    n = rows.count()
    drawn = rows.where(unit_hash(F.lit(seed), F.col("value"), F.col("before"), F.col("after")) < F.lit(min(1.0, max_rows / max(1, n)))) if n > max_rows else rows
    found = sorted(tuple(r) for r in drawn.toLocalIterator())
    return [(y, Finding(kind, 0, len(value), value, before, after, in_path)) for y, kind, value, before, after, in_path in found]


def made_up_findings(n: int = 4000, seed: int = 0) -> list[tuple[int, Finding]]:
    """Labelled findings made from a seed, half of them real secrets."""
    r = random.Random(seed)
    hexes, base, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    run = lambda a, k: "".join(r.choice(a) for _ in range(k))
    words = sorted(COMMON | EXAMPLE)
    prose = PROSE.split()
    lead = lambda: " ".join(r.choice(prose) for _ in range(r.randint(1, 6))) + " "
    out: list[tuple[int, Finding]] = []

    def add(label: int, text: str) -> None:
        out.extend((label, f) for f in list(candidates(text))[:1])

    while len(out) < n:
        name = r.choice(("password", "token", "secret", "api_key", "auth", "pwd"))
        sep, q = r.choice(("=", ": ", " = ", "=")), r.choice(("", '"', "'"))
        kind = r.randrange(12)
        if kind == 0:
            add(1, lead() + "AKIA" + run(upper, 16) + " end")
        elif kind == 1:
            add(1, lead() + "ghp_" + run(base, 36) + " end")
        elif kind == 2:
            add(1, lead() + f"{name}{sep}{q}{run(hexes, r.randint(16, 64))}{q} end")
        elif kind == 3:
            add(1, lead() + f"{name}{sep}{q}{run(base, r.randint(10, 44))}{q} end")
        elif kind == 4:
            add(1, lead() + f"{name}{sep}{q}{run(base + '!#$%&*+-_', r.randint(9, 24))}{q} end")
        elif kind == 5:
            add(1, lead() + f"key {run(base, r.randint(24, 44))} end")
        elif kind == 6:
            add(0, lead() + f"{name}{sep}{q}{'_'.join(r.choice(words) for _ in range(r.randint(1, 3)))}{q} end")
        elif kind == 7:
            add(0, lead() + f"{name}{sep}{q}{r.choice(('xxxxxxxx', '********', '${PASSWORD}', '{{token}}', 'changeme', 'your-token-here', '1234567', 'None,none', 'required'))}{q} end")
        elif kind == 8:
            add(0, lead() + r.choice(("commit ", "sha1 ", "md5 hash ", "version ", "build id ")) + run(hexes, r.choice((32, 40, 64))) + " end")
        elif kind == 9:
            add(0, lead() + f"https://host.example/{run(hexes, 24)}/{'-'.join(r.choice(prose) for _ in range(4))}-{r.randint(1, 999)} end")
        elif kind == 10:
            add(0, lead() + f"uuid {run(hexes, 8)}-{run(hexes, 4)}-4{run(hexes, 3)}-a{run(hexes, 3)}-{run(hexes, 12)} end")
        else:
            add(0, lead() + r.choice(prose) + "_" + "_".join(r.choice(prose) for _ in range(4)) + str(r.randint(1, 99)) + " end" if r.random() < 0.5 else lead() + "AKIA" + r.choice(("EXAMPLEEXAMPLE00", "AAAAAAAAAAAAAAAA", "0000000000000000", "XXXXXXXXXXXXXXXX")) + " end")
    return out[:n]


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value, score) for every candidate; start and end in characters."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Forest = pickle.loads(shipped.value)
        for b in slices(batches):
            rows = [(i, f.kind, f.start, f.end, f.value, m.score(features(f, m.known))) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in candidates(t)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "kind", "start", "end", "value", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, kind string, start long, end long, value string, score double")

"""Semantic chunking: texts are cut where neighbouring windows of sentences have least in common.

Between every two sentences stand the windows of the sentences before and behind. Their cosine is
computed from dot products of sentences that lie near each other, each taken once, so a text costs
its sentences times the window, whatever its length. Cuts are where that similarity falls below a
percentile of the text's own similarities. Sentences are vectors of their words' counts, or what an
embedder gives for them (UD20). One pass over Arrow batches, a document at a time (TV17)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^ \t.,;:!?|]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Places to which similarities and their percentile are rounded before they are compared.
DIGITS = 9

Embedder = Callable[[list[str]], np.ndarray]


def sentences(text: str) -> list[str]:
    """Sentences by their end marks and line ends, trimmed of spaces and tabs."""
    return [s for s in (m.strip(" \t") for m in _SENTENCE.findall(text)) if s]


def _near_dots(parts: list[str], reach: int, embedder: Embedder | None) -> list[np.ndarray]:
    """Dot products of each sentence with the k-th behind it, for k = 0 .. reach."""
    n = len(parts)
    if embedder is not None:
        v = np.asarray(embedder(parts), float)
        return [(v[: n - k] * v[k:]).sum(1) if k < n else np.zeros(0) for k in range(reach + 1)]
    counts = [Counter(_WORD.findall(s.translate(_LOWER))) for s in parts]
    out = []
    for k in range(reach + 1):
        dots = []
        for a, b in zip(counts, counts[k:], strict=False):
            if len(b) < len(a):
                a, b = b, a
            dots.append(float(sum(c * b[w] for w, c in a.items() if w in b)))
        out.append(np.array(dots))
    return out


def similarities(parts: list[str], window: int, embedder: Embedder | None = None) -> np.ndarray:
    """The cosine of the windows on both sides of each boundary; 0 where one has no words."""
    n = len(parts)
    dots = _near_dots(parts, 2 * window - 1, embedder)
    # the sum of all products within a stretch of sentences, and across a boundary
    out = np.zeros(max(0, n - 1))
    for i in range(n - 1):
        left, right = range(max(0, i - window + 1), i + 1), range(i + 1, min(n, i + 1 + window))
        cross = sum(dots[b - a][a] for a in left for b in right)
        sizes = [sum(dots[abs(a - b)][min(a, b)] for a in side for b in side) for side in (left, right)]
        out[i] = cross / math.sqrt(sizes[0] * sizes[1]) if sizes[0] > 0 and sizes[1] > 0 else 0.0
    return np.round(out, DIGITS)


def boundaries(parts: list[str], window: int = 3, percentile: float = 0.2, size: int | None = None, embedder: Embedder | None = None) -> list[int]:
    """Numbers of the sentences that begin a chunk. With ``size`` a chunk of more characters is cut
    before the sentence that would pass it, if it has one already."""
    if not parts:
        return []
    sims = similarities(parts, window, embedder)
    least = round(float(np.quantile(sims, percentile)), DIGITS) if len(sims) else 0.0
    starts, held = [0], len(parts[0])
    for i, s in enumerate(parts[1:]):
        if sims[i] < least or (size is not None and held + 1 + len(s) > size):
            starts.append(i + 1)
            held = len(s)
        else:
            held += 1 + len(s)
    return starts


#: Texts whose chunks a task holds as objects.
TEXTS_AT_ONCE = 128


def semantic_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, percentile: float = 0.2, size: int | None = None, overlap_words: int = 0, embedder: Embedder | None = None) -> DataFrame:
    """(doc_id, chunk, first_sentence, sentences, content) of every whole text, its sentences joined
    by a space. ``overlap_words``: so many words of the chunk before are put in front. Null and empty
    texts have no chunks; repeated ids are documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few texts at once: an Arrow batch would hold the chunks of ten thousand as objects
        for b in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = sentences(text or "")
                starts = boundaries(parts, window, percentile, size, embedder)
                before: list[str] = []
                for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(parts)], strict=False)):
                    content = " ".join(parts[lo:hi])
                    words = content.split() if overlap_words else []
                    rows.append((doc, k, lo, hi - lo, " ".join([*before, content])))
                    before = words[-overlap_words:] if overlap_words else []
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "chunk", "first_sentence", "sentences", "content"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, chunk long, first_sentence long, sentences long, content string")

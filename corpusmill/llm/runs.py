"""Periodic runs of words: stretches that repeat a block of words, found by probing harmonic grids.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least
``exponent`` periods and ``least`` words, that no neighbouring word extends. For each period p the
words at 0, p, 2p, ... are compared with their successors in that grid. A run of ``exponent``
periods shows as ``exponent - 1`` equal pairs in a row, wherever it begins, so only such places are
followed further: words are compared p apart, to both sides, in growing chunks of arrays. All grids
together hold n/1 + n/2 + ... words, not n times the periods.

Places inside a run that is known already are skipped, and so are stretches that turn out to be
such a run. That loses nothing: where ``exponent - 1``
steps of p, two at least, lie inside a run of a smaller period d, d divides p and the stretch of p
is that run.
Texts are probed together, laid end to end with a separator that equals nothing else, those of about
one length in one array.

Each document is a row by itself, nothing is shuffled, and the memory of a task follows its longest
text. Null and empty texts have no words and no runs; null and repeated ids are rows like any other;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of texts that are probed together; a longer text is probed alone.
GROUP_BYTES = 4 << 20


def _same_until(x: np.ndarray, p: int, at: int) -> int:
    """The first i >= at with x[i] != x[i + p] (or no x[i + p])."""
    chunk = 32
    while at + p < len(x):
        n = min(chunk, len(x) - p - at)
        differ = x[at : at + n] != x[at + p : at + p + n]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at += n
        chunk = min(chunk * 2, 1 << 16)
    return at


def _same_from(x: np.ndarray, p: int, at: int) -> int:
    """The least i <= at with x[k] == x[k + p] for all k in i..at."""
    chunk = 32
    while at > 0:
        n = min(chunk, at)
        differ = x[at - n : at] != x[at - n + p : at + p]
        k = int(differ[::-1].argmax())
        if differ[n - 1 - k]:
            return at - k
        at -= n
        chunk = min(chunk * 2, 1 << 16)
    return at


def find_runs(x: np.ndarray, longest: int | None = None, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period.

    ``longest``: no run is longer than that (the longest text of several that separators part)."""
    if exponent < 3:
        raise ValueError("runs of fewer than three periods may hide in those of smaller ones")
    found: list[tuple[int, int, int]] = []
    starts = reach = np.zeros(0, np.int64)  # known runs by start, and how far those begun so far reach
    for p in range(1, (len(x) if longest is None else longest) // exponent + 1):
        grid = x[::p]
        equal = grid[1:] == grid[:-1]
        row = equal[: len(equal) - exponent + 2].copy()
        for k in range(1, exponent - 1):
            row &= equal[k : len(equal) - exponent + 2 + k]
        at = np.nonzero(row)[0] * p
        if len(at) and len(starts):
            known = np.searchsorted(starts, at, "right") - 1
            at = at[(known < 0) | (reach[np.maximum(known, 0)] < at + (exponent - 1) * p)]
        n_known, end = len(found), -1
        for i in at.tolist():
            if i < end:
                continue
            end = _same_until(x, p, i)
            begin = _same_from(x, p, i)
            if end - begin + p >= max(least, exponent * p):
                known = int(np.searchsorted(starts, begin, "right")) - 1
                if known < 0 or reach[known] < end + p - 1:  # else it is that run, of a smaller period
                    found.append((begin, end - begin + p, p))
        if len(found) > n_known:
            known = np.array(sorted((s, s + n - 1) for s, n, _ in found), np.int64)
            starts, reach = known[:, 0], np.maximum.accumulate(known[:, 1])
    return sorted(found, key=lambda r: (r[0], r[2]))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _probe(texts: list[bytes], exponent: int, least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs, text without the repeats) of each text."""
    words = [t.split() for t in texts]  # at bytes 9 to 13 and 32
    numbers = _Numbers()
    parts: list[np.ndarray] = []
    for k, w in enumerate(words):
        parts += [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)), np.array([-1 - k])]
    begins = np.cumsum([0] + [len(w) + 1 for w in words])
    of_text: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for start, length, period in find_runs(np.concatenate(parts), max(map(len, words)), exponent, least):
        k = int(np.searchsorted(begins, start, "right")) - 1
        of_text[k].append((start - int(begins[k]), length, period))
    for w, runs in zip(words, of_text, strict=True):
        kept = w
        if runs:
            keep = np.ones(len(w), bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            kept = [w[i] for i in np.nonzero(keep)[0].tolist()]
        yield len(w), runs, b" ".join(kept)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _run_lists(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([r for some in runs for r in some], np.int64).reshape(-1, 3)
    fields = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_RUNS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32()), fields)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """(doc_id, n_words, runs array of (start, length, period), collapsed): every run of each whole
    text by start, then period, and the text without the words that only repeat a run's first period,
    its other words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [x.as_buffer().to_pybytes() for x in b.column(1)]
            by_length = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            group: list[int] = []
            size = 0
            for i in by_length + [None]:
                if group and (i is None or size + len(texts[i]) > GROUP_BYTES):
                    n, runs, kept = zip(*_probe([texts[g] for g in group], exponent, least), strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(group)), pa.array(n, pa.int64()), _run_lists(list(runs)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                    group, size = [], 0
                if i is not None:
                    group.append(i)
                    size += len(texts[i])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeated_tail(text: Column, words: Column, start: Column, period: Column, when: Column) -> Column:
    """``words`` with those from number ``start`` on replaced by repeats of the ``period`` words
    there, joined by one space, where ``when`` holds; the text itself elsewhere."""
    times = F.ceil((F.size(words) - start) / period).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, (start + 1).cast("int"), period.cast("int")), times))
    whole = F.slice(F.concat(F.slice(words, F.lit(1), start.cast("int")), tail), F.lit(1), F.size(words))
    return F.when(when, F.array_join(whole, " ")).otherwise(text)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every tenth document, by crc32 of its id, ends in repeats of a block of its
    own words, whose place and length the crc32 gives; the others are as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("a", F.when(F.col("n_words") > 0, F.col("g") % F.col("n_words")))
    period = 1 + F.floor((F.col("n_words") - F.col("a")) / (3 + F.col("g") % 8))
    return rows.select("doc_id", repeated_tail(F.col("text"), F.col("words"), F.col("a"), period, F.col("n_words") > 0).alias("text"))

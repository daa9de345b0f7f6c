"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

Words: A-Z lower-cased, maximal runs of ASCII digits, ASCII letters and all characters beyond
ASCII. The automaton of all items is small and each task builds it once from the broadcast words;
a document's words stream through it while the longest match ending at each word is tracked. Words
inside a match of at least ``window`` words (or inside an occurrence of a whole shorter item) are
hit. Items are taken in blocks of at most ``block_words`` words, one pass a block, so what is
broadcast is bounded whatever the size of the test set.

Null and empty texts have no words and no hits. Items without words take no part; words of an item
with a null id are hit, but it has no name to be listed by; items of equal text all count. Rows are judged one by one, so repeated rows repeat. An
empty table gives an empty result, an empty test set no hits. Columns of the scan's result clash
with none: only id and text are read by :func:`scan`; :func:`decontaminate` keeps every column.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, materialize

#: Each byte to itself, A-Z lower-cased, ASCII outside 0-9 and a-z to a space.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class ItemAutomaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = [name for name, _ in items]
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: for the state of each whole window: the items that hold it
        self.window_items: dict[int, set[int]] = {}
        #: for the state of each whole shorter item: its length and the items
        self.short_items: dict[int, dict[int, set[int]]] = {}
        self._anchor: dict[int, int] = {}
        for k, seq in enumerate(coded):
            state = 0
            for at, c in enumerate(seq):
                state = self.next[state][c]
                if at + 1 >= window:
                    self.window_items.setdefault(self.anchor(state), set()).add(k)
            if len(seq) < window:
                while self.length[self.link[state]] >= len(seq):
                    state = self.link[state]
                self.short_items.setdefault(state, {}).setdefault(len(seq), set()).add(k)
        #: nearest state at or above each that ends a shorter item, else 0
        self.short_up = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short_up[s] = s if s in self.short_items else self.short_up[self.link[s]]
        #: no run of known words below this length can be hit
        self.least = min((min(window, len(s)) for s in coded), default=window)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        """Split off from q the part of at most length[p] + 1 words."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def anchor(self, state: int) -> int:
        """The state of the last ``window`` words, for a state of at least as many."""
        got = self._anchor.get(state)
        if got is None:
            got = state
            while self.length[self.link[got]] >= self.window:
                got = self.link[got]
            self._anchor[state] = got
        return got

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit spans (first and last word), indexes of the items found and the longest match."""
        get = self.vocab.get
        ids = [get(w, -1) for w in words]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        longest, n, at = 0, len(ids), 0
        while at < n:
            if ids[at] < 0:
                at += 1
                continue
            end = at + 1
            while end < n and ids[end] >= 0:
                end += 1
            if end - at >= self.least:
                longest = max(longest, self._run(ids, at, end, spans, found))
            at = end
        return spans, found, longest

    def _run(self, ids: list[int], first: int, end: int, spans: list, found: set) -> int:
        nxt, link, length, window, short_up = self.next, self.link, self.length, self.window, self.short_up
        state = size = longest = 0
        for i in range(first, end):
            c = ids[i]
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c not in nxt[state]:
                continue
            state = nxt[state][c]
            size += 1
            if size > longest:
                longest = size
            hit = 0
            if size >= window:
                found |= self.window_items[self.anchor(state)]
                hit = window
            up = short_up[state]
            while up:
                for k, items in self.short_items[up].items():
                    if k <= size:
                        found |= items
                        hit = max(hit, k)
                up = short_up[link[up]]
            if hit:
                lo = i - hit + 1
                while spans and spans[-1][1] >= lo - 1:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, i))
        return longest


def _item_blocks(bench: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items with words, in blocks of at most ``block_words`` words (one item at least); the
    driver holds a block and a partition of the test set at a time."""
    rows = bench.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for r in rows.toLocalIterator():
        ws = words_of(bytes(r.t))
        if not ws:
            continue
        if block and size + len(ws) > block_words:
            yield block
            block, size = [], 0
        block.append((r.i, ws))
        size += len(ws)
    yield block


_BUILT: dict[str, ItemAutomaton] = {}


def _automaton(shipped, window: int) -> ItemAutomaton:
    key, items = shipped.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemAutomaton(items, window)
    return _BUILT[key]


def scan(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 100_000, keep: tuple[str, ...] = (), cut: bool = False) -> DataFrame:
    """(doc_id, *keep, n_words, n_hit, longest, spans, items) for every row of ``docs``; with ``cut``
    also clean, the text without its hit spans.

    spans: hit words, as first and last index from 0, disjoint and in order; longest: words of the
    longest match; items: ids found, sorted as strings."""
    spark = docs.sparkSession
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    found = "n_words long, longest long, spans array<struct<first:long,last:long>>, items array<string>, clean string"
    added = [x.split()[0] for x in found.split(", ")]
    empty = [F.expr(f"cast({v} as {t}) AS {c}") for c, v, t in (("n_words", "0", "long"), ("longest", "0", "long"), ("spans", "array()", "array<struct<first:long,last:long>>"), ("items", "array()", "array<string>"), ("clean", "null", "string"))]
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, F.col(text_col).cast("binary").alias("t"), *empty)
    schema = T.StructType([f for f in out.schema.fields if f.name not in added] + T.StructType.fromDDL(found).fields)
    n_own = len(schema) - len(added)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string()), pa.string())
    blocks = _item_blocks(bench, item_col, item_text_col, block_words)
    items, path = next(blocks), None
    while items is not None:
        coming = next(blocks, None)
        shipped = spark.sparkContext.broadcast((uuid.uuid4().hex, items))
        cut_now = cut and coming is None

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, cut_now=cut_now) -> Iterator[pa.RecordBatch]:
            auto = _automaton(shipped, window)
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    b = whole.slice(at, 500)
                    got: tuple[list, ...] = ([], [], [], [], [])
                    for t, longest, s0, i0 in zip(*(b.column(n_own - 1 + j).to_pylist() for j in (0, 2, 3, 4)), strict=True):
                        ws = words_of(t)
                        spans, names, n = auto.scan(ws)
                        spans = _merged([(x["first"], x["last"]) for x in s0] + spans)
                        clean = None if not cut_now or t is None else cut_spans(t, spans) if spans else t.decode()
                        for to, v in zip(got, (len(ws), max(longest, n), [{"first": a, "last": z} for a, z in spans], sorted({*i0, *(auto.items[x] for x in names)} - {None}), clean), strict=True):
                            to.append(v)
                    yield pa.RecordBatch.from_arrays([*b.columns[:n_own], *(pa.array(v, t) for v, t in zip(got, kinds, strict=True))], b.schema.names)

        out = out.mapInArrow(run, schema)
        if coming is not None:
            spent = path
            out, path = materialize(out, "decontam")
            if spent:
                drop_path(spark, spent)
        items = coming
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return out.select("doc_id", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", covered.alias("n_hit"), "longest", "spans", "items", *(["clean"] if cut else []))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans; the rest joined by single spaces."""
    at = [m.span() for m in _WORD.finditer(raw)]
    parts, pos = [], 0
    for a, z in spans:
        parts.append(raw[pos : at[a][0]].strip())
        pos = at[z][1]
    parts.append(raw[pos:].strip())
    return b" ".join(p for p in parts if p).decode()


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = 10, max_coverage: float = 0.5, **names) -> DataFrame:
    """``docs`` (every column) with hit spans cut out of the text; rows of which more than
    ``max_coverage`` of the words are hit go. Rows without hits stay as they are, byte for byte."""
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    text = f"c{cols.index(text_col)}"
    others = tuple(c for c in plain.columns if c != text)
    tagged = scan(plain.withColumn("no_id", F.lit(None).cast("long")), bench, id_col="no_id", text_col=text, window=window, keep=others, cut=True, **names)
    kept = tagged.where(F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage))
    return kept.withColumnRenamed("clean", text).select(*plain.columns).toDF(*cols)

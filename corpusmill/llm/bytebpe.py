"""Byte-level BPE: texts to token ids by a file of ranks, and ids back to bytes.

A text is cut by a pattern and each piece is encoded by itself. A piece that is a token is that
token; any other starts as its bytes and merges, again and again, its leftmost pair of least rank.
Pieces that a worker has not met lately are encoded together: pieces of about one length are the
rows of a padded matrix, and in each round every row merges one pair. The ranks of pairs stand in a
hash table of numpy arrays, only the two pairs beside a merge are looked up anew, and rows without
a pair to merge leave the matrix.

Pieces beyond :data:`LONG_BYTES` are cut first where no token of the vocabulary can lie across the
cut (told by the three bytes around it); what is longer still is a row of its own that merges all
occurrences of its least pair in one round, where that gives what one after the other would give.

The text's pattern is run by the ``regex`` library with the letters, numbers and white space of the
Rust library that applies the pattern for ``tiktoken`` (their Unicode versions differ).

Each document is a row by itself: nothing is shuffled, and long texts are worked on in parts. Null
and empty texts have no tokens; null and repeated ids and ties are rows like any other; an empty
table gives an empty result; columns other than id and text are not read and may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Pieces of more bytes are cut before they are merged.
LONG_BYTES = 256
#: Pieces, and words, whose ids a worker remembers, in each of two generations.
MEMO_PIECES = 250_000
#: Characters of texts that are worked on together, and pieces of a long text.
BATCH_CHARS, PART_PIECES = 1 << 20, 1 << 17
NONE = np.int64(1) << 40  # the rank of pairs that are no token
_FREE = np.int64(-1)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Pairs of token ids to the rank of their concatenation: open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(8, int(2 * max(1, len(rank)) - 1).bit_length() + 1)
        self.keys = np.full(1 << self.bits, _FREE, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        while len(key):  # those that meet a taken slot move on by one
            first = np.unique(slot, return_index=True)[1]
            first = first[self.keys[slot[first]] == _FREE]
            self.keys[slot[first]], self.ranks[slot[first]] = key[first], rank[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE for pairs that are no token. Ids below 0 are padding."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        on = np.nonzero((found != key) & (found != _FREE))[0]
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[on]]
            hit = found == key[on]
            out[on[hit]] = self.ranks[slot[on[hit]]]
            on = on[~hit & (found != _FREE)]
        return out


class Vocabulary:
    """Tokens, their ranks (which are their ids) and the tables that encoding and decoding need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.packed = {t: np.array([r], "<u4").tobytes() for t, r in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no token")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        # tokens of two bytes, and three bytes inside any token
        self.two = np.zeros(1 << 16, bool)
        self.three = np.zeros(1 << 24, bool)
        for t in ranks:
            if len(t) == 2:
                self.two[t[0] << 8 | t[1]] = True
            elif len(t) > 2:
                b = np.frombuffer(t, np.uint8).astype(np.int64)
                self.three[b[:-2] << 16 | b[1:-1] << 8 | b[2:]] = True
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for t, r in ranks.items():
            lengths[r] = len(t)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        blob = np.zeros(int(lengths.sum()), np.uint8)
        for t, r in ranks.items():
            blob[self.starts[r] : self.starts[r] + len(t)] = np.frombuffer(t, np.uint8)
        self.blob = blob

    # ------------------------------------------------------------ merging

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [self.packed.get(p, b"") for p in pieces]
        short = []
        for k, p in enumerate(pieces):
            if p and not out[k]:
                if len(p) <= LONG_BYTES:
                    short.append(k)
                else:
                    out[k] = self._encode_long(p)
        for k, ids in zip(short, self._encode_short([pieces[k] for k in short]), strict=True):
            out[k] = ids
        return out

    def _encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces as rows of matrices, each of those whose widths are about the same."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        flat = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        width = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        width = np.where((width >= 8) & (sizes <= width * 3 // 4), width * 3 // 4, width)
        for w in np.unique(width).tolist():
            every = np.nonzero(width == w)[0]
            for lo in range(0, len(every), max(1, (1 << 20) // w)):
                at = every[lo : lo + max(1, (1 << 20) // w)]
                col = np.arange(w)[None, :]
                inside = col < sizes[at][:, None]
                ids = np.full((len(at), w), -1, np.int64)
                ids[inside] = flat[(starts[at][:, None] + col)[inside]]
                for rows, merged in self.merge_rows(ids):
                    kept = merged >= 0
                    data = merged[kept].astype("<u4").tobytes()
                    ends = np.cumsum(kept.sum(axis=1)) * 4
                    begin = 0
                    for k, end in zip(at[rows].tolist(), ends.tolist(), strict=True):
                        out[k] = data[begin:end]
                        begin = end
        return out

    def _encode_long(self, piece: bytes) -> bytes:
        parts = self.cut(np.frombuffer(piece, np.uint8))
        short = iter(self._encode_short([p.tobytes() for p in parts if len(p) <= LONG_BYTES]))
        return b"".join(next(short) if len(p) <= LONG_BYTES else self.merge_long(self.of_byte[p]).astype("<u4").tobytes() for p in parts)

    def merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ids, padded with -1 behind, each merged to its end: (rows, their ids), as they end."""
        own = np.arange(len(ids))
        ranks = self.pairs.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(own):
            if ids.shape[1] == 1:
                yield own, ids
                return
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(own)), at]
            over = best == NONE
            if over.any():
                yield own[over], ids[over]
                go = ~over
                own, ids, ranks, at, best = own[go], ids[go], ranks[go], at[go], best[go]
            row = np.arange(len(own))
            ids[row, at] = best
            # the token behind the merged one goes: what follows moves up, and the row is one shorter
            later = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            ids = np.where(later, ids[:, 1:], ids[:, :-1])
            if ids.shape[1] == 1:
                continue
            ranks = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
            right = np.nonzero(at < ids.shape[1] - 1)[0]
            ranks[right, at[right]] = self.pairs.look(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.nonzero(at > 0)[0]
            ranks[left, at[left] - 1] = self.pairs.look(ids[left, at[left] - 1], ids[left, at[left]])

    def cut(self, b: np.ndarray) -> list[np.ndarray]:
        """Parts of a long piece that merge independently: no token holds the bytes on both sides of
        a cut, neither as its two bytes nor with a third one."""
        x = b.astype(np.int64)
        joined = self.two[x[:-1] << 8 | x[1:]]  # between byte i and i + 1
        three = self.three[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
        joined[:-1] |= three
        joined[1:] |= three
        return np.split(b, np.nonzero(~joined)[0] + 1)

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row: a round merges all occurrences of its least rank from the left, unless a
        merge makes a pair of lower rank, which would come before the next; then only the first."""
        ranks = self.pairs.look(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.nonzero(ranks == best)[0]
            # of occurrences that overlap, every other one from the left
            head = np.concatenate([[True], np.diff(at) > 1])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = ids.copy()
            new[at] = best
            after = at + 2 < len(ids)
            lower = (self.pairs.look(np.full(after.sum(), best), ids[at[after] + 2]) < best).any()
            new = new[keep]
            where = at - np.arange(len(at))  # the merged tokens' places
            before = where > 0
            lower = lower or (self.pairs.look(new[where[before] - 1], new[where[before]]) < best).any()
            if lower:
                ids = ids.copy()
                ids[at[0]] = best
                ids = np.delete(ids, at[0] + 1)
                ranks = self.pairs.look(ids[:-1], ids[1:])
                continue
            ids = new
            ranks = ranks[np.nonzero(keep)[0][:-1]] if len(ids) > 1 else ranks[:0]
            for w in (where[where < len(ids) - 1], where[where > 0] - 1):
                ranks[w] = self.pairs.look(ids[w], ids[w + 1])
        return ids

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the table of all tokens."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ids) else 0
        return self.blob[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(total)].tobytes()


# ---------------------------------------------------------------- cutting texts


@lru_cache(maxsize=1)
def _class_changes() -> dict[int, str]:
    """Characters that Python's ``regex`` and the library behind ``tiktoken`` class differently, each
    with a character of the latter's class. The library is asked by encodings of single bytes that
    keep one class alone."""
    import regex
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    changes: dict[int, str] = {}
    classes = ((r"\p{L}", "b"), (r"\p{N}", "0"), (r"\s", " "))
    theirs = {}
    for name, _ in classes:
        e = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs[name] = set(bytes(e.encode_ordinary(every)).decode())
    for name, _ in classes:
        for c in theirs[name] ^ set(regex.findall(name, every)):
            changes[ord(c)] = next((stand for other, stand in classes if c in theirs[other]), "#")
    return changes


#: A pattern whose matches never go on over the start of white space: no match has white space behind
#: its first character, but for runs of white space alone. Texts are cut faster by such a pattern.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Cutter:
    """The matches of a pattern in a text."""

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.changes = _class_changes()
        self.least = min(self.changes, default=0x110000)
        self.rare = regex.compile("[" + "".join(map(chr, sorted(self.changes))) + "]") if self.changes else None
        self.by_space = pattern == SPACED_PATTERN
        white = regex.findall(r"\s", "".join(map(chr, range(0x3001)))) + ["\x1c", "\x1d", "\x1e", "\x1f"]
        self.ascii_pairs = [c + " " for c in white if c < "\x80"]
        self.other_pair = regex.compile("[" + "".join(c for c in white if c >= "\x80") + "] ")

    def pieces(self, text: str) -> Iterable[str]:
        if self.rare is not None and not text.isascii() and max(text) >= chr(self.least) and self.rare.search(text):
            stand_in = text.translate(self.changes)
            return (text[m.start() : m.end()] for m in self.pattern.finditer(stand_in))
        if len(text) <= BATCH_CHARS:
            return self.pattern.findall(text)
        return (m.group() for m in self.pattern.finditer(text))

    def cuts_at_spaces(self, text: str) -> bool:
        """Whether a match starts at every space of the text: no space follows white space."""
        return self.by_space and not any(p in text for p in self.ascii_pairs) and (text.isascii() or not self.other_pair.search(text))


class Encoder:
    """A vocabulary, a pattern, and the ids of the words (with the space before them) and pieces met
    lately."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(read_ranks(path))
        self.cutter = Cutter(pattern)
        self.memos: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {"pieces": ({}, {}), "words": ({}, {})}

    def _ids(self, kind: str, keys: list[str]) -> dict[str, bytes]:
        """A table that holds the ids of all keys, at least."""
        now, before = self.memos[kind]
        if len(now) > MEMO_PIECES:
            now, before = {}, now
            self.memos[kind] = now, before
        unmet = []
        for k in set(keys).difference(now):
            known = before.get(k)
            if known is None:
                unmet.append(k)
            else:
                now[k] = known
        if not unmet:
            return now
        if kind == "pieces":
            now.update(zip(unmet, self.vocabulary.encode_pieces([p.encode() for p in unmet]), strict=True))
        else:
            cut = [list(self.cutter.pieces(" " + w)) for w in unmet]
            look = self._ids("pieces", list(itertools.chain.from_iterable(cut))).__getitem__
            now.update(zip(unmet, (b"".join(map(look, c)) for c in cut), strict=True))
        return now

    def parts(self, text: str) -> Iterator[bytes]:
        """A text's ids, packed, in parts of bounded length."""
        if not self.cutter.cuts_at_spaces(text):
            pieces = iter(self.cutter.pieces(text))
            while some := list(itertools.islice(pieces, PART_PIECES)):
                yield b"".join(map(self._ids("pieces", some).__getitem__, some))
            return
        begin = 0
        while begin < len(text):
            end = text.find(" ", begin + BATCH_CHARS)
            end = len(text) if end < 0 else end
            head, *words = text[begin:end].split(" ")
            pieces = list(self.cutter.pieces(head))
            yield b"".join(map(self._ids("pieces", pieces).__getitem__, pieces)) + b"".join(map(self._ids("words", words).__getitem__, words))
            begin = end

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        pieces, words = [], []
        for t in texts:
            if self.cutter.cuts_at_spaces(t):
                t, *spaced = t.split(" ")
            else:
                spaced = []
            pieces.append(list(self.cutter.pieces(t)))
            words.append(spaced)
        of_word = self._ids("words", list(itertools.chain.from_iterable(words))).__getitem__
        of_piece = self._ids("pieces", list(itertools.chain.from_iterable(pieces))).__getitem__
        return [b"".join(map(of_piece, p)) + b"".join(map(of_word, w)) for p, w in zip(pieces, words, strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


# ---------------------------------------------------------------- the operators


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in order, in groups of about BATCH_CHARS characters; a long text is a group of its own."""
    group: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > BATCH_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): every whole text as packed little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks, pattern)
        for b in slices(batches):
            at = 0
            for group in _groups(b.column(1).to_pylist()):
                ids = enc.batch(group) if len(group) > 1 else [b"".join(enc.parts(group[0]))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(group)), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                at += len(group)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, text): packed ids back to text; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(read_ranks(ranks))
        for b in slices(batches):
            texts = [None if x is None else vocabulary.decode(np.frombuffer(x, "<u4")).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id"), F.col("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded and decoded again.

    What leaves a worker is a row of digests: ids and bytes of long texts are hashed part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks, pattern)
        for b in slices(batches):
            rows: list[tuple[int, str, str]] = []
            for group in _groups(b.column(1).to_pylist()):
                for parts in map(lambda x: [x], enc.batch(group)) if len(group) > 1 else [enc.parts(group[0])]:
                    n, ids, text = 0, hashlib.sha256(), hashlib.sha256()
                    for packed in parts:
                        n += len(packed) // 4
                        ids.update(packed)
                        text.update(enc.vocabulary.decode(np.frombuffer(packed, "<u4")))
                    rows.append((n, ids.hexdigest(), text.hexdigest()))
            n_tokens, ids_sha, text_sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

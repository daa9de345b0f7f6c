"""Phrase collocations: word-id suffix arrays per shard, n-gram counts from their LCP intervals, and
scores over the counts of the whole corpus.

Texts are lower-cased (A-Z), cut into pieces at marks and line ends, and pieces into words at spaces
and tabs. A shard is the words of some documents of one label as numbers, with 0 between pieces. Its
suffix array is built by prefix doubling, as far as phrases reach; neighbours in it that share their
first n words are one interval, whose length is the count of that n-gram in the shard.

Phrases that few texts hold are most of all, so two passes are made over the shards:

1. counts of words and pairs under a 48-bit hash, summed over all shards; each pile of shards gets
   back the hashes of its own that reach ``least`` in the corpus. Two phrases of one hash only add up, so
   nothing that reaches it is missed.
2. words and pairs below it become breaks (a phrase is no commoner than its parts), and what is left
   is counted by name, for all lengths, and merged by label and phrase.

Both passes deal rows by hash, phrase or pile of shards: a label or phrase that holds a third of all words is
one row a shard, no more. Shards are written to the shared folder once.

Null texts have no words; a null label counts as ``und``; repeated rows count each time. A very long
text is spread over several shards between its pieces; a piece is never parted. Ties are ordered by
count, then phrase in byte order. An empty table gives an empty result. Columns other than text and
label are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize, slices

#: Words of a shard, about, and shards of a label that are counted in one task, at most.
SHARD_WORDS = 2_000_000
PILE_SHARDS = 4
#: Bytes of a text that are cut into words at a time, about.
PART_BYTES = 8 << 20
_BREAK = b"\xff"  # in no UTF-8 text
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


# ---------------------------------------------------------------- suffix arrays


def suffix_array(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): positions by what follows there, compared as far as ``depth`` numbers, and how
    many numbers (``depth`` at most) each shares with the one before it in that order."""
    ranks = [x.astype(np.int32)]
    h = 1
    order = np.argsort(ranks[0], kind="stable")
    while h < depth:
        key = ranks[-1].astype(np.int64)
        key *= int(ranks[-1].max(initial=0)) + 2
        key[: max(0, len(x) - h)] += ranks[-1][h:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(len(x), np.int32)
        new[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])[: len(x)], dtype=np.int32)
        del key
        ranks.append(new)
        h *= 2
    lcp = np.zeros(len(x), np.int8)
    if len(x) > 1:
        a, b, shared = order[:-1], order[1:], np.zeros(len(x) - 1, np.int8)
        for k in range(len(ranks) - 1, -1, -1):
            i, j = a + shared, b + shared
            on = (np.maximum(i, j) < len(x)) & (shared < depth)
            on[on] = ranks[k][i[on]] == ranks[k][j[on]]
            shared[on] += 1 << k
        lcp[1:] = np.minimum(shared, depth)
    return order, lcp


def before_break(x: np.ndarray, depth: int) -> np.ndarray:
    """How many words, at most ``depth``, stand from each position on before the next 0."""
    at = np.where(x == 0, np.arange(len(x)), len(x))
    at = np.minimum.accumulate(at[::-1])[::-1] - np.arange(len(x))
    return np.minimum(at, depth).astype(np.int8)


def intervals(order: np.ndarray, lcp: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a position, count) of every n-gram without a 0: the runs of neighbours that share n words."""
    heads = np.nonzero(lcp < n)[0]
    counts = np.diff(np.append(heads, len(order)))
    at = order[heads]
    whole = room[at] >= n
    return at[whole], counts[whole]


# ---------------------------------------------------------------- shards


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts that end between pieces."""
    begin = 0
    while len(text) - begin > PART_BYTES:
        end = text.find(_BREAK, begin + PART_BYTES)
        if end < 0:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:]


def _packed(x: np.ndarray) -> bytes:
    """32-bit numbers as four runs of bytes of the same weight: the upper ones are nearly constant, as
    common words have small numbers, and so compress to little."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


_SHARD = "pile long, lang string, n long, vocabulary binary, ids binary"


def shards(docs: DataFrame, label_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(pile, lang, n, vocabulary, ids): the words of the texts, a row a shard. A pile is a few shards of
    one label, from neighbouring partitions. n counts words; ids are numbers of
    words, 0 for breaks, as :func:`_packed` stores them; the vocabulary's words are parted by byte 255, in order from number 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        flushed = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal flushed, size, held
            for label, (numbers, ids) in held.items():
                x = np.concatenate(ids)
                pile = zlib.crc32(label.encode()) << 31 ^ TaskContext.get().partitionId() // PILE_SHARDS << 12 ^ flushed
                row = [[pile], [label], [int((x > 0).sum())], [_BREAK.join(list(numbers)[1:])], [_packed(x)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["pile", "lang", "n", "vocabulary", "ids"])
            held, size, flushed = {}, 0, flushed + 1

        for b in slices(batches):
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for part in _parts(text.as_buffer().to_pybytes().translate(_PLAIN)):
                    words = part.replace(_BREAK, b" \xff ").split()
                    words.append(_BREAK)
                    numbers, ids = held.setdefault(label, (_Numbers({_BREAK: 0}), []))
                    ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                    if size >= shard_words:
                        yield from flush()
        yield from flush()

    label = F.coalesce(F.col(label_col).cast("string"), F.lit("und"))
    return docs.where(F.octet_length(text_col) > 0).select(label, F.col(text_col).cast("binary")).mapInArrow(run, _SHARD)


#: Bits of a hash: two phrases of one hash are only kept together, and what is dealt out is smaller.
_HASH_BITS = np.uint64((1 << 48) - 1)


def _word_hashes(label: str, vocabulary: list[bytes]) -> np.ndarray:
    """A hash of label and word by word number; that of the break is not used."""
    import xxhash

    head = label.encode() + _BREAK
    return np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in [b"", *vocabulary]), np.uint64, len(vocabulary) + 1) & _HASH_BITS


def _pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & _HASH_BITS


def _vocabulary(data: bytes) -> list[bytes]:
    return data.split(_BREAK) if data else []


def hashed_counts(made: DataFrame) -> DataFrame:
    """(hash, pile, c): counts of the words and pairs of each shard, under a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pile, label, words, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x = _unpacked(data)
                h = _word_hashes(label, _vocabulary(words))
                order, lcp = suffix_array(x, 2)
                room = before_break(x, 2)
                for n in (1, 2):
                    at, counts = intervals(order, lcp, room, n)
                    hashes = h[x[at]] if n == 1 else _pair_hashes(h[x[at]], h[x[at + 1]])
                    for lo in range(0, len(at), 1 << 16):
                        some = slice(lo, lo + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(hashes[some].view(np.int64)), pa.array(np.full(len(at[some]), pile)), pa.array(counts[some])], ["hash", "pile", "c"])

    return made.select("pile", "lang", "vocabulary", "ids").mapInArrow(run, "hash long, pile long, c long")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def frequent_part(x: np.ndarray, hashes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The sequence with breaks in place of words, and between pairs, whose hash is not kept."""
    good = _among(hashes, kept)
    good[0] = False
    at = np.nonzero(good[x])[0]
    if not len(at):
        return np.zeros(0, np.int32)
    joined = np.zeros(len(at), bool)  # with the word behind
    near = np.nonzero(np.diff(at) == 1)[0]
    joined[near] = _among(_pair_hashes(hashes[x[at[near]]], hashes[x[at[near] + 1]]), kept)
    out = np.zeros(len(at) + int((~joined).sum()), np.int32)
    out[np.arange(len(at)) + np.cumsum(~joined) - ~joined] = x[at]
    return out


def phrase_counts(made: DataFrame, kept: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, words, c): the n-grams of each shard whose words and pairs are kept."""
    fields = [("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("c", pa.int64())]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[pa.Table] = []
        kept_here = np.sort(right.column("hash").to_numpy().view(np.uint64))
        for i in range(left.num_rows):
            label, words, data = (left.column(c)[i].as_py() for c in ("lang", "vocabulary", "ids"))
            vocabulary = _vocabulary(words)
            hashes = _word_hashes(label, vocabulary)
            names = pa.array([b"", *vocabulary], pa.binary()).cast(pa.string())
            del vocabulary
            x = frequent_part(_unpacked(data), hashes, kept_here)
            order, lcp = suffix_array(x, longest)
            room = before_break(x, longest)
            for n in range(1, longest + 1):
                at, counts = intervals(order, lcp, room, n)
                phrase = pc.binary_join_element_wise(*(names.take(pa.array(x[at + k])) for k in range(n)), " ")
                rows.append(pa.table([pa.array([label] * len(at), pa.string()), phrase, pa.array(np.full(len(at), n, np.int32)), pa.array(counts)], schema=pa.schema(fields)))
        return pa.concat_tables(rows) if rows else pa.schema(fields).empty_table()

    # a pile's shards are of one label, so Spark adds up their counts before they are shuffled
    pairs = made.select("pile", "lang", "vocabulary", "ids").groupBy("pile").cogroup(kept.groupBy("pile"))
    return pairs.applyInArrow(count, "lang string, phrase string, words int, c long")


# ---------------------------------------------------------------- phrases of the corpus


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, label_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, list[str]]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words that occur ``least`` times or
    more, (lang, n) with all words of a label, and the paths of the tables that both are read from."""
    spark = docs.sparkSession
    made, made_path = materialize(shards(docs, label_col, text_col, shard_words), "phrase-shards")
    # equal hashes lie together already, so what is distinct is told without another shuffle
    everywhere = Window.partitionBy("hash")
    kept = hashed_counts(made).withColumn("f", F.sum("c").over(everywhere)).where(F.col("f") >= least).select("pile", "hash").distinct()
    counts = phrase_counts(made, kept, longest).groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    counts, counts_path = materialize(counts, "phrase-counts")
    return counts, made.groupBy("lang").agg(F.sum("n").alias("n")), [made_path, counts_path]


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, shadow_pct: int = 80, scale: int = 2_000_000, label_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or more words of each label.

    a, l and r count the phrase, its first part and the rest at the cut whose score, the integer part
    of scale * a / (l + r), is least (then the shortest first part); n is all words of the label. A
    phrase inside a longer one that occurs in ``shadow_pct`` % of its places or more is left out."""
    spark = docs.sparkSession
    counts, totals, paths = frequent_phrases(docs, longest, least, label_col, text_col, shard_words)
    several = counts.where(F.col("words") > 1).withColumnRenamed("f", "a")
    cuts = several.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    part = counts.select("lang", "phrase", "f")
    cuts = cuts.join(part.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"]).join(part.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"])
    # decimals: the product may pass 64 bits
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * CAST({scale} AS DECIMAL(10, 0)) div CAST(CAST(l AS DECIMAL(20, 0)) + r AS DECIMAL(21, 0))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = several.where(F.col("words") > 2).select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    shadowed = F.expr(f"CAST(longer AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {shadow_pct}")
    alone = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~shadowed)
    order = [F.col("cut.score").desc(), F.col("a").desc(), "phrase"]
    # a label's phrases are ranked in parts first, so that no task sorts all of them
    in_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    best = alone.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    out, _ = materialize(out, "phrases")
    drop_path(spark, *paths)
    return out

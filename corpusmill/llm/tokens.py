"""Token-id output as length-delimited binary records, with an offset index for shuffled reads.

A data file is a run of frames::

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

all little-endian. A payload is: i64 document id, u8 flags (1: the id is null), u8 bytes an id
(2 or 4), then the token ids. Masked: the CRC-32 of zlib rotated right by 15 bits plus 0xA282EAD8
(stored next to the bytes that it covers, a plain CRC of data that hold CRCs is weak). The index
beside it holds 16 bytes a record: u64 offset of its frame, u64 token ids of the file before it.

Files are written by the executors to a shared folder, under a name of the attempt first and then
renamed, so a lost or repeated task leaves one whole file; the driver writes a manifest of them.

Null texts are encoded as empty: their record holds the end id alone. A null id is kept by its
flag and sorts first. Repeated ids are records of their own, ordered by their text's hash. An empty
table gives no files and an empty result. Only id and text are read; other names do not matter.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, new_path, open_fs

_HEAD = struct.Struct("<QI")
_CRC = struct.Struct("<I")
_PAYLOAD = struct.Struct("<qBB")
_INDEX = struct.Struct("<QQ")
#: Words whose ids a worker remembers, in each of two generations.
MEMO_WORDS = 500_000
#: Bytes of text a file, on average, at most; small tables get files for as many tasks as run at once.
BYTES_A_FILE = 256 << 20


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


# ---------------------------------------------------------------- encoding


#: Classes of bytes: a letter or digit, "." full stop or comma, p other ASCII sign or control byte,
#: u beyond ASCII; white space is that of bytes.split().
_KINDS = bytes(ord("u") if b >= 128 else ord("a") if chr(b).isalnum() else 32 if b == 32 or 9 <= b <= 13 else ord(".") if chr(b) in ".," else ord("p") for b in range(256))
_BESIDE = re.compile(r"([^\x00-\x7f])(?=[.,])|(?<=[.,])([^\x00-\x7f])")
#: The byte-level alphabet: bytes that print stand for themselves, the others for 256 and on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512), strict=False))


@lru_cache(maxsize=100_000)
def _stays_letter(c: str) -> bool:
    """Whether a character's composed small form begins and ends in a letter or digit. The capital I
    with a dot and letters that composition takes apart (such as those of Hindi with a dot below)
    end in a mark, which a full stop behind it is joined with."""
    n = unicodedata.normalize("NFC", c.lower())
    return n[0].isalnum() and n[-1].isalnum() and all(x.isalnum() for x in unicodedata.normalize("NFC", c))


def _byte_letters(word: bytes) -> str | None:
    """A word of Latin letters, lower-cased, in the byte-level alphabet; None for other words."""
    if word.isalpha():  # of ASCII letters
        return word.decode().lower()
    s = word.decode()
    if not s.isalpha() or max(s) >= "\u0250" or "\u0130" in s:
        return None
    return s.lower().encode().decode("latin-1").translate(_ALPHABET)


class _Memo(dict):
    """Words to their packed ids; a word that is not there is looked up in the generation before,
    else encoded."""

    def __init__(self, encoder: WordEncoder, before: dict[bytes, bytes]):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, word: bytes) -> bytes:
        packed = self.before.get(word)
        if packed is None:
            packed = self.encoder.pack_word(word)
        self[word] = packed
        return packed


class WordEncoder:
    """Encodes texts with a tokenizers file, word by word, remembering words.

    Words end at ASCII white space. That gives the ids of the whole text for tokenizers that drop
    white space and never join across it (as the word-end BPE does). Where the tokenizer also
    lower-cases and takes single marks as tokens, which is tried on construction, more is shared.
    For any other tokenizer pass ``by_word=False``, which encodes whole texts in one call."""

    def __init__(self, path: str, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.by_word = by_word
        self.memo = _Memo(self, {})
        # words of Latin letters alone go straight to the model where that gives the same ids
        probes = "a z qu hello tokenization xylophones thth zqxjkv s ll don é été größe niñoç ærø Łódź Äpfel straße".split()
        self.direct = all(self._ids(w) == self._ids(w.lower()) == [t.id for t in self.tokenize(_byte_letters(w.encode()))] for w in probes)
        self.direct = self.direct and all(self._ids(f"{a}{m}{z}") == self._ids(f"{a} {m} {z}") for a in ("a", "é", "1") for m in ".," for z in ("b", "ñ", "2", " c", ""))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pack_word(self, word: bytes) -> bytes:
        spelt = _byte_letters(word) if self.direct else None
        ids = self._ids(word.decode()) if spelt is None else [t.id for t in self.tokenize(spelt)]
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, packed as ``dtype``."""
        if not self.by_word:
            encoded = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() for e in encoded]
        if len(self.memo) > MEMO_WORDS:  # two generations: the full one becomes the one before
            self.memo = _Memo(self, dict(self.memo))
        look = self.memo.__getitem__
        return [b"".join(map(look, self._words(t))) for t in texts]

    def _words(self, text: bytes) -> list[bytes]:
        """A text's words. Full stops and commas between letters, digits and white space are tokens
        of their own, and so become words of their own, which leaves fewer different words."""
        if not self.direct or b"<" in text:  # special tokens are found in the text as it stands
            return text.split()
        kinds = text.translate(_KINDS)
        alone = b"p." not in kinds and b".p" not in kinds and b".." not in kinds
        if alone and (b"u." in kinds or b".u" in kinds):
            alone = all(_stays_letter(a or z) for a, z in _BESIDE.findall(text.decode()))
        text = text.translate(LOWER_AZ)
        return text.replace(b".", b" . ").replace(b",", b" , ").split() if alone else text.split()


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def _encoder(path: str, by_word: bool) -> WordEncoder:
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = WordEncoder(path, by_word)
    return _ENCODERS[path, by_word]


# ---------------------------------------------------------------- the format


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One frame."""
    payload = _PAYLOAD.pack(0 if doc_id is None else doc_id, int(doc_id is None), width) + ids
    size = struct.pack("<Q", len(payload))
    return size + _CRC.pack(masked_crc(size)) + payload + _CRC.pack(masked_crc(payload))


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, width = _PAYLOAD.unpack_from(payload)
    return (None if flags & 1 else doc_id), np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD.size)


def _frame(stream) -> bytes | None:
    """The next payload of a stream, checked; None at its end."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("a frame's head is cut short")
    size, crc = _HEAD.unpack(head)
    if crc != masked_crc(head[:8]):
        raise ValueError("a frame's length is damaged")
    payload, tail = stream.read(size), stream.read(_CRC.size)
    if len(payload) < size or len(tail) < _CRC.size or _CRC.unpack(tail)[0] != masked_crc(payload):
        raise ValueError("a frame's payload is damaged")
    return payload


def read_records(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a data file, in order."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, buffer_size=1 << 20) as f:
        while (payload := _frame(f)) is not None:
            yield unpack(payload)


class RecordFile:
    """Shuffled reads of a data file by its index."""

    def __init__(self, uri: str):
        self.fs, path = open_fs(uri)
        self.file = self.fs.open_input_file(path)
        with self.fs.open_input_stream(path.removesuffix(".rec") + ".idx") as f:
            self.index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        self.file.seek(int(self.index[i, 0]))
        return unpack(_frame(self.file))


# ---------------------------------------------------------------- the operator


def _write_file(folder: str, part: int, records: Iterable[tuple[int | None, bytes]], width: int) -> dict | None:
    fs, at = open_fs(folder)
    attempt = uuid.uuid4().hex
    names = [(f"{at}/_tmp-{attempt}.{x}", f"{at}/part-{part:06d}.{x}") for x in ("rec", "idx")]
    offset = tokens = n = 0
    first = last = None
    rec = idx = None
    for doc_id, ids in records:
        if rec is None:
            rec, idx = (fs.open_output_stream(tmp, buffer_size=1 << 20) for tmp, _ in names)
            first = doc_id
        frame = pack(doc_id, ids, width)
        rec.write(frame)
        idx.write(_INDEX.pack(offset, tokens))
        offset, tokens, n, last = offset + len(frame), tokens + len(ids) // width, n + 1, doc_id
    if rec is None:
        return None
    for f in (rec, idx):
        f.close()
    for tmp, name in reversed(names):  # the data file comes last: where it is, its index is
        fs.move(tmp, name)
    return {"part": part, "uri": f"{folder}/part-{part:06d}.rec", "records": n, "tokens": tokens, "bytes": offset, "first_id": first, "last_id": last}


_MANIFEST = "part long, uri string, records long, tokens long, bytes long, first_id long, last_id long"


def write_token_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> list[dict]:
    """Encode every whole text and write the records in ascending id order; returns the manifest,
    a row a file in that order, which is also written as ``manifest.json``."""
    fs, at = open_fs(folder)
    fs.create_dir(at, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    at_once = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_files = max(1, -(-size // BYTES_A_FILE), min(at_once, n // 1000))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("t").asc()]  # rows of one id may fill several files
    ordered = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, by_word)
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()

        def records() -> Iterator[tuple[int | None, bytes]]:
            for b in batches:
                ids = b.column(0).to_pylist()
                for lo in range(0, len(ids), 256):
                    texts = [x.as_buffer().to_pybytes() for x in b.column(1)[lo : lo + 256]]
                    for doc_id, packed in zip(ids[lo : lo + 256], enc.batch(texts), strict=True):
                        yield doc_id, packed + tail

        made = _write_file(folder, TaskContext.get().partitionId(), records(), enc.dtype.itemsize)
        yield pa.RecordBatch.from_pylist([made] if made else [], pa.schema([("part", pa.int64()), ("uri", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    files = sorted((r.asDict() for r in ordered.mapInArrow(run, _MANIFEST).collect()), key=lambda r: r["part"])
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(files).encode())
    return files


def read_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, record) of every record, read from the files:
    start counts the token ids of all records before; ids_crc32 covers them as unsigned 32 bits."""
    fs, at = open_fs(folder)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        files = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, part long, record long"
    if not files:
        return spark.createDataFrame([], schema)
    before = np.concatenate([[0], np.cumsum([x["tokens"] for x in files])]).tolist()
    plan = spark.createDataFrame([(k, x["part"], x["uri"], int(b)) for k, (x, b) in enumerate(zip(files, before[:-1], strict=True))], "k int, part long, uri string, start long")
    plan = plan.repartitionById(len(files), "k").drop("k")  # a file a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, uri, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[tuple] = []
                for k, (doc_id, ids) in enumerate(read_records(uri)):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), part, k))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return plan.mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "record"])


def tokenize_to_records(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the records to the shared folder and read them back."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-records")
    write_token_records(docs, folder, tokenizer, **options)
    return read_token_records(spark, folder)

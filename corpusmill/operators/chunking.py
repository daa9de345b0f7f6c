"""Chunking: text, Markdown sections, lists, tables and structured blocks to chunks.

The chunkers are sequential, so they run over Arrow batches, a document at a time; what can be said
of chunks afterwards (neighbours, quality filter, duplicates) is DataFrame code."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import medical
from ..functions.text import chunk_hash, source_kind

_SENTENCE_END = re.compile(r"[.!?]\s")
_HEADING = re.compile(r"(?m)^#{1,6}\s+.+$")
_ITEM = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+")


def split_place(text: str, start: int, end: int, size: int, least: int) -> int:
    """Where a chunk from ``start`` ends, at most at ``end`` (TV2): after the last blank line, line
    end, sentence, or lesser mark that leaves it long enough; else at ``end``."""
    floor = min(end, start + max(max(1, min(least, max(1, int(size * 0.6)))), size // 4))
    for mark in ("\n\n", "\n"):
        at = text.rfind(mark, floor, end)
        if at > start:
            return at + len(mark)
    # the last sentence end whose mark and space lie in the window and end at or beyond the floor
    for m in reversed(list(_SENTENCE_END.finditer(text, max(start, floor - 2), end))):
        if m.end() >= floor:
            return m.end()
    for mark in ("; ", ", ", " "):
        at = text.rfind(mark, floor, end)
        if at > start:
            return at + len(mark)
    return end


def chunk_spans(text: str, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the trimmed chunks (TV1). Every step goes at least one character forward, so
    an overlap as large as a chunk cannot stall it."""
    out: list[tuple[int, int]] = []
    start, n = 0, len(text)
    while start < n:
        end = start + size
        if end < n:
            end = split_place(text, start, end, size, least)
        end = min(end, n) if end > start else min(start + size, n)
        piece = text[start:end]
        body = piece.strip()
        if body:
            lead = len(piece) - len(piece.lstrip())
            out.append((start + lead, start + lead + len(body)))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def markdown_sections(text: str) -> list[tuple[int, str]]:
    """Sections with their places; text before the first heading counts unless blank (TV3)."""
    starts = [m.start() for m in _HEADING.finditer(text)]
    if not starts:
        return [(0, text)]
    edges = ([0] if starts[0] > 0 else []) + starts + [len(text)]
    return [(a, text[a:z]) for a, z in zip(edges, edges[1:], strict=False) if text[a:z].strip()]


def list_items(text: str) -> list[str]:
    """Whole items; lines that begin none belong to the item before (TV6)."""
    groups: list[list[str]] = []
    for line in (x.rstrip() for x in text.splitlines()):
        if line.strip() and (_ITEM.match(line) or not groups):
            groups.append([line])
        elif groups:
            groups[-1].append(line if line.strip() else "")
    return [g for g in ("\n".join(x).strip() for x in groups) if g]


def group_items(items: list[str], limit: int) -> list[str]:
    """Items joined as long as they fit; an item is never split (TV7)."""
    groups: list[str] = []
    for item in items:
        joined = f"{groups[-1]}\n{item}".strip() if groups else item
        if groups and len(joined) <= max(1, limit):
            groups[-1] = joined
        else:
            groups.append(item)
    return [g.strip() for g in groups]


def group_rows(text: str, limit: int, repeat_header: bool = True) -> list[tuple[str, bool]]:
    """Table rows in groups that fit, each under the header (TV8)."""
    rows = [r.strip() for r in text.splitlines() if r.strip()]
    if len(rows) <= 1 or len(text.strip()) <= limit:
        return [("\n".join(rows), False)] if rows else []
    head = [rows[0]] if repeat_header else []
    groups: list[list[str]] = []
    for row in rows[1:]:
        if groups and len("\n".join([*head, *groups[-1], row]).strip()) <= limit:
            groups[-1].append(row)
        else:
            groups.append([row])
    return [("\n".join([*head, *g]).strip(), repeat_header) for g in groups]


_CHUNK = "doc_id long, source string, page int, chunk_index int, content string, content_type string, section_path array<string>, start_char int, end_char int, quality_score double, parent_block_id string"
_NAMES = [c.split()[0] for c in _CHUNK.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.float64(), pa.string()]


def _emit(docs: DataFrame, cut: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in cut(r)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)

    out = docs.mapInArrow(run, _CHUNK)
    stem = F.concat_ws("", F.col("doc_id").cast("string"), F.lit("_p"), F.col("page").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return out.withColumns({"id": stem, "char_count": F.length("content"), "token_count": F.size(F.filter(F.split("content", r"(?U)\s+"), lambda x: x != ""))})


def chunk_texts(docs: DataFrame, size: int = 1024, overlap: int = 128, least: int = 100) -> DataFrame:
    """Chunks of (doc_id, source, text); Markdown sources are cut by sections first (TV4, TV9)."""

    def cut(r: tuple) -> Iterator[tuple]:
        doc_id, source, text = r
        sections = markdown_sections(text or "") if str(source or "").lower().endswith(".md") else [(0, text or "")]
        k = 0
        for at, body in sections:
            for a, z in chunk_spans(body, size, overlap, least):
                yield (doc_id, source, 1, k, body[a:z], "paragraph", [], at + a, at + z, 1.0, None)
                k += 1

    return _emit(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")), cut)


def chunk_blocks(blocks: DataFrame, size: int = 1024, overlap: int = 128, least: int = 100) -> DataFrame:
    """Chunks of structured blocks (doc_id, source, blocks array<struct<id, block_type, text,
    section_path, page, quality>>): headings are skipped, lists and tables keep their rows whole (TV5)."""
    limit = max(900, size)

    def cut(r: tuple) -> Iterator[tuple]:
        doc_id, source, items = r
        k = 0
        for b in items or []:
            text, kind = (b["text"] or "").strip(), b["block_type"] or "paragraph"
            if not text or kind == "heading":
                continue
            path, page, q = b["section_path"] or [], b["page"] or 1, 1.0 if b["quality"] is None else b["quality"]
            if kind == "table":
                pieces = [(t, 0, len(t)) for t, _ in group_rows(text, limit)]
            elif kind == "list":
                pieces = [(t, 0, len(t)) for t in group_items(list_items(text), limit)]
            else:
                pieces = [(text[a:z], a, z) for a, z in chunk_spans(text, size, overlap, least)]
            for t, a, z in pieces:
                yield (doc_id, source, page, k, t, kind if kind in ("table", "list") else "paragraph", path, a, z, q, b["id"])
                k += 1

    return _emit(blocks.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "blocks"), cut)


def filter_chunks(chunks: DataFrame, least: int = 100) -> DataFrame:
    """Short, poor and repeated chunks of a document's page go (PF1)."""
    group = Window.partitionBy("doc_id", "page")
    keep_short = (F.count("*").over(group) <= 2) | F.col("content_type").isin("list", "table") | (F.col("quality_score") >= 0.8)
    marked = chunks.withColumns({"keep": ((F.length("content") >= least) | keep_short) & (F.col("quality_score") >= 0.45), "hash": chunk_hash(F.col("content"))}).where("keep")
    first = F.row_number().over(Window.partitionBy("doc_id", "page", "hash").orderBy("chunk_index"))
    return marked.withColumn("n", first).where("n = 1 OR hash = ''").drop("n", "keep")


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Each chunk with its neighbours' ids and its place (WN5)."""
    w = Window.partitionBy("doc_id").orderBy("page", "chunk_index")
    return chunks.withColumns({"previous_chunk_id": F.lag("id").over(w), "next_chunk_id": F.lead("id").over(w), "section_sibling_rank": F.row_number().over(w) - 1, "source_type": source_kind(F.col("source"))})


def seed_contexts(chunks: DataFrame) -> DataFrame:
    """(id, context): a chunk's text with its neighbours', each cut to 900 characters, 3000 in all."""
    w = Window.partitionBy("doc_id").orderBy("page", "chunk_index")
    part = lambda c: F.nullif(F.substring(c, 1, 900), F.lit(""))
    around = F.concat_ws("\n\n", part(F.col("content")), part(F.lag("content").over(w)), part(F.lead("content").over(w)))
    return chunks.select("doc_id", "id", F.substring(around, 1, 3000).alias("context"))


def overlapped(chunks: DataFrame, n_words: int) -> DataFrame:
    """Each chunk after the last ``n_words`` words of the one before (WN7)."""
    w = Window.partitionBy("doc_id").orderBy("page", "chunk_index")
    tail = F.split(F.lag("content").over(w), " ")
    return chunks.withColumn("content", F.concat_ws(" ", F.array_join(F.slice(tail, F.greatest(F.lit(1), F.size(tail) - n_words + 1), n_words), " "), "content"))


def merge_pairs(chunks: DataFrame, merges: Callable[[Column, Column], Column], key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """Chunks in which neighbours that belong together are one, in pairs from the first on, numbered
    anew (TV20). In a run of chunks that each go with the next, every other one takes its next in."""
    w = Window.partitionBy(key).orderBy(order)
    flagged = chunks.withColumn("__next", F.lead("content").over(w)).withColumn("__with", F.coalesce(merges(F.col("content"), F.col("__next")) & F.col("__next").isNotNull(), F.lit(False)))
    run = F.coalesce(F.sum(F.when(F.col("__with"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = flagged.withColumn("__run", run).withColumn("__place", F.row_number().over(Window.partitionBy(key, "__run").orderBy(order)))
    kept = placed.where(F.col("__place") % 2 == 1)
    content = F.when(F.col("__with"), F.concat("content", F.lit(" "), "__next")).otherwise(F.col("content"))
    out = kept.withColumns({"content": content, "merged": F.col("__with"), order: (F.row_number().over(w) - 1).cast("int")})
    return out.drop("__next", "__with", "__run", "__place")


def medical_chunks(docs: DataFrame, drugs: list[str], size: int = 512, overlap: int = 64, least: int = 100) -> DataFrame:
    """Chunks of (doc_id, source, text) cut at clinical section headers first; neighbours that belong
    together are merged in pairs; each has its preservation score (TV18)."""

    def cut(r: tuple) -> Iterator[tuple]:
        doc_id, source, text, heads = r
        k, text = 0, text or ""
        edges = [0, *(heads or []), len(text)]
        for a, z in zip(edges, edges[1:], strict=False):
            body = text[a:z].strip()
            lead = a + len(text[a:z]) - len(text[a:z].lstrip())
            for x, y in chunk_spans(body, size, overlap, least):
                yield (doc_id, source, 1, k, body[x:y], "paragraph", [], lead + x, lead + y, 1.0, None)
                k += 1

    text = F.col("text").cast("string")
    raw = _emit(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text.alias("text"), medical.header_positions(text).alias("heads")), cut)
    found = lambda a, b: F.regexp_extract_all(F.concat_ws(" ", a, b), F.lit("(?i)(?:" + "|".join(drugs) + ")"), F.lit(0))
    merged = merge_pairs(raw.drop("id", "char_count", "token_count"), lambda a, b: medical.should_merge(a, b, found(a, b)))
    name = F.concat_ws("", F.col("doc_id").cast("string"), F.lit("_p1_chunk_"), F.col("chunk_index").cast("string"))
    return merged.withColumns({"id": name, "char_count": F.length("content"), "preservation": medical.preservation_score(F.col("content"))})


#: Chunkers by the names that settings use (UD8); the other names need a library that is not here.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"recursive": chunk_texts, "section_aware": chunk_blocks, "medical": medical_chunks, "medical_semantic": medical_chunks}


def chunk_by(strategy: str, docs: DataFrame, external: dict[str, Callable[..., DataFrame]] | None = None, **options) -> DataFrame:
    """Chunks by a named strategy; ``external`` adds chunkers of the caller's, such as semantic ones."""
    known = STRATEGIES | (external or {})
    if strategy not in known:
        raise ValueError(f"no chunker of that name: {strategy}; there are {sorted(known)}")
    return known[strategy](docs, **options)

"""Tables in plain text: columns from the white space that consecutive lines share.

A line's gaps are its runs of two or more spaces, and all behind its end. Down a block of lines the
gaps are intersected, interval by interval; as long as one gap between words is left, the lines are
rows of one table, and the gaps left at its end are its columns' borders (TV15, SC6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAR = 1 << 60
Gap = tuple[int, int]


def gaps(line: str, least: int) -> list[Gap]:
    """Runs of spaces as (start, end), the last of them everything behind the line."""
    body = line.rstrip(" ")
    return [m.span() for m in re.finditer(" {%d,}" % least, body)] + [(len(body), _FAR)]


def shared(a: list[Gap], b: list[Gap], least: int) -> list[Gap]:
    """Parts of at least ``least`` positions that lie in a gap of both; one pass over both lists."""
    out, i, k = [], 0, 0
    while i < len(a) and k < len(b):
        lo, hi = max(a[i][0], b[k][0]), min(a[i][1], b[k][1])
        if hi - lo >= least:
            out.append((lo, hi))
        if a[i][1] < b[k][1]:
            i += 1
        else:
            k += 1
    return out


def _inner(found: list[Gap], width: int) -> list[Gap]:
    """Gaps that part words: neither before all lines nor behind them."""
    return [g for g in found if g[0] > 0 and g[1] < width]


def tables(lines: list[str], least: int = 2, rows: int = 2) -> Iterator[tuple[int, list[list[str]]]]:
    """(number of the first line, cells of each row) of every table of at least ``rows`` lines."""
    at = 0
    while at < len(lines):
        found, width, end = [(0, _FAR)], 0, at
        while end < len(lines):
            own = gaps(lines[end], least)
            left = shared(found, own, least)
            wide = max(width, own[-1][0])
            if not _inner(own, own[-1][0]) or not _inner(left, wide):
                break
            found, width, end = left, wide, end + 1
        if end - at < rows:
            at = max(end, at + 1) if end - at < 2 else end
            continue
        inner = _inner(found, width)
        starts, ends = [0] + [g[1] for g in inner], [g[0] for g in inner] + [width]
        yield at, [[line[a:z].strip(" ") for a, z in zip(starts, ends, strict=True)] for line in lines[at:end]]
        at = end


def text_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_gap: int = 2, least_rows: int = 2) -> DataFrame:
    """(doc_id, table, first_line, row, cells array) of every table of each whole text. Null and empty
    texts have none; repeated ids are documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, (first, body) in enumerate(tables((text or "").split("\n"), least_gap, least_rows)):
                    out.extend((doc, n, first, r, cells) for r, cells in enumerate(body))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "table", "first_line", "row", "cells"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, table long, first_line long, row long, cells array<string>")


def table_blocks(found: DataFrame) -> DataFrame:
    """(doc_id, table, rows, columns, empty_share, text) of each table: its rows as lines, cells that
    are not empty joined by " | "."""
    line = F.array_join(F.filter("cells", lambda c: c != ""), " | ")
    blank = F.size(F.filter("cells", lambda c: c == ""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda x: x["line"])
    g = found.groupBy("doc_id", "table").agg(F.count("*").alias("rows"), F.max(F.size("cells")).cast("long").alias("columns"), F.sum(blank).alias("blank"), F.array_join(lines, "\n").alias("text"))
    return g.select("doc_id", "table", "rows", "columns", (F.col("blank") / (F.col("rows") * F.col("columns"))).alias("empty_share"), "text")

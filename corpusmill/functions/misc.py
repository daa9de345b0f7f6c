"""Smaller Column functions: contexts, labels, hashes, timestamps, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sources import readable_label
from .text import content_hash, normalize_space, source_type_of


def text_hash(text: Column) -> Column:
    """Hash of the normalised text (SF8)."""
    return content_hash(normalize_space(text))


def overlap_length(a: Column, b: Column, most: int) -> Column:
    """The longest end of ``a`` that begins ``b``, up to ``most`` characters (SF13)."""
    n = F.least(F.length(a), F.length(b), F.lit(most))
    hits = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: F.right(a, k) == F.left(b, k))
    return F.coalesce(F.array_max(hits), F.lit(0))


def flat_source(label: Column, source: Column, url: Column) -> Column:
    """SF23."""
    return F.lower(F.concat_ws(" ", label, source, url))


def expected_source_type(explicit: Column, types: Column, sources: Column) -> Column:
    """The type as told, else the first of a list, else by the first source's name (SF24)."""
    named = F.when(F.size(sources) > 0, source_type_of(F.get(sources, F.lit(0))))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.get(types, F.lit(0)), named, F.lit("unknown"))


def canonical_label(source: Column, logical_name: Column) -> Column:
    """SF26."""
    return F.coalesce(F.nullif(F.trim(logical_name), F.lit("")), readable_label(source))


def context_of(rows: Column) -> Column:
    """Context text of an array of struct<rank, label, content> in rank order (SF28)."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(F.lit("[Source: "), r["label"], F.lit("]\n"), r["content"])), "\n\n")


def full_context(history: Column, retrieved: Column) -> Column:
    """SF49."""
    return F.when(F.coalesce(history, F.lit("")) == "", retrieved).otherwise(F.concat(F.lit("Conversation so far:\n"), history, F.lit("\n\n"), retrieved))


def table_boost(content_type: Column, query_type: Column) -> Column:
    """SF36."""
    return F.when((content_type == "table") & (query_type == "reference_range"), 0.2).otherwise(0.0)


def clean_html_text(html: Column) -> Column:
    """Lines over two characters of a page without scripts, styles and furniture (SF51)."""
    bare = html
    for tag in ("script", "style", "nav", "footer", "header"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}>", "\n")
    lines = F.transform(F.split(F.regexp_replace(bare, r"(?s)<[^>]*>", "\n"), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 2), "\n")


def metric_key(name: Column) -> Column:
    """ndcg@5 and the like as the names of metrics at k (SF52)."""
    return F.regexp_replace(F.lower(name), r"@\d+$", "_at_k")


def cut_query(query: Column, most: int = 4000) -> Column:
    """struct<query, cut> (SF54)."""
    return F.struct(F.substring(query, 1, most).alias("query"), (F.length(query) > most).alias("cut"))


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words, the clamp of SF57 applied (SF55)."""
    return F.array_join(F.slice(F.split(normalize_space(text), " "), F.lit(1), F.greatest(F.lit(50), F.least(n, F.lit(500)))), " ")


def boundary_hints(spans: Column, length: Column) -> Column:
    """Places before and after entities, array of struct<at, why>, from array<struct<start, end, label>> (SF46)."""
    before = F.transform(F.filter(spans, lambda s: s["start"] > 0), lambda s: F.struct(s["start"].alias("at"), F.concat(F.lit("before_"), F.lower(s["label"])).alias("why")))
    after = F.transform(F.filter(spans, lambda s: s["end"] < length), lambda s: F.struct(s["end"].alias("at"), F.concat(F.lit("after_"), F.lower(s["label"])).alias("why")))
    return F.array_sort(F.concat(before, after))


def identity_hash(value: Column) -> Column:
    """SHA-256 of a struct as JSON: name its fields in sorted order (SU11, SU12, SU15, SU18)."""
    return F.sha2(F.to_json(value), 256)


def file_hash(content: Column) -> Column:
    """SU14."""
    return F.sha2(content, 256)


def epoch_seconds(value: Column) -> Column:
    """Seconds from seconds or milliseconds (SU16)."""
    return F.when(value > 10_000_000_000, value / 1000).otherwise(value.cast("double"))


def run_time(name: Column) -> Column:
    """The time in a run folder's name, 20260102T030405 or 20260102_030405 (SU17)."""
    digits = F.regexp_extract(name, r"(\d{8})[T_-]?(\d{6})", 0)
    return F.try_to_timestamp(F.regexp_replace(digits, r"[^0-9]", ""), F.lit("yyyyMMddHHmmss"))


def percent_delta(base: Column, value: Column) -> Column:
    """A relative change as text (SU20)."""
    change = F.try_divide(value - base, F.abs(base)) * 100
    return F.when(change.isNull(), "n/a").otherwise(F.format_string("%+.1f%%", change))

"""URLs, domains, source labels and classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a source class adds to a score.
PRIORS = {"guideline_pdf": 0.15, "guideline_html": 0.10, "ace_drug_guidance": 0.08, "hpp_guideline": 0.07, "healthhub_html": 0.06, "reference_csv": 0.12, "international_html": 0.03, "index_page": 0.02}
DEFAULT_PRIOR = 0.05
#: Domains of the class international_html.
INTERNATIONAL = ("nice.org.uk", "cdc.gov", "who.int", "nih.gov", "mayoclinic.org", "webmd.com")


def source_prior(source_class: Column) -> Column:
    """SU9."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORS.items() for x in kv]), source_class), F.lit(DEFAULT_PRIOR))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no parameters or fragment, no slash at the end (SU1)."""
    head, path, query = (F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)([^?#;]*)[^?#]*(\?[^#]*)?", k) for k in (1, 2, 3))
    bare = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"/+$", "")
    return F.concat(F.lower(head), F.when(bare == "", "/").otherwise(bare), F.when(query == "?", "").otherwise(query))


def strip_tracking(url: Column) -> Column:
    """Without query and fragment (SU2)."""
    return F.regexp_replace(url, r"[?#].*$", "")


def safe_url(url: Column) -> Column:
    """The URL if it is http(s) with a host, else null (SU3)."""
    t = F.trim(url)
    return F.when(t.rlike(r"^(?i:https?)://[^/?#]+"), t)


def domain(url: Column) -> Column:
    """SU4."""
    return F.nullif(F.lower(F.regexp_extract(safe_url(url), r"^[^:]+://([^/?#]*)", 1)), F.lit(""))


def domain_type(name: Column) -> Column:
    """SU5."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"^www\.", "")
    return (
        F.when(low.isNull() | (low == ""), "unknown")
        .when(low.endswith(".gov") | F.contains(low, F.lit(".gov.")), "government")
        .when(low.endswith(".edu") | F.contains(low, F.lit(".edu.")), "education")
        .when(low.endswith(".org"), "organization")
        .when(low.endswith(".com"), "commercial")
        .otherwise("unknown")
    )


def source_type(source: Column, explicit: Column | None = None) -> Column:
    """SU6."""
    low = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    by_name = F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".csv"), "reference_csv").when(low.endswith(".md") | low.endswith(".html"), "html").otherwise("other")
    if explicit is None:
        return by_name
    told = F.lower(F.trim(explicit))
    return F.when(told == "csv", "reference_csv").when(told.isin("pdf", "html", "reference_csv", "other"), told).otherwise(by_name)


def source_class(source: Column, kind: Column | None = None, page_type: Column | None = None, logical_name: Column | None = None, host: Column | None = None) -> Column:
    """SU7, in the order in which the tests apply."""
    none = F.lit("")
    t = source_type(source, kind)
    page, name, h = (F.lower(F.trim(F.coalesce(c, none))) if c is not None else none for c in (page_type, logical_name, host))
    world = F.lit(False)
    for d in INTERNATIONAL:
        world = world | F.contains(h, F.lit(d))
    html = (
        F.when(F.contains(name, F.lit("drug_guidance")) | F.contains(name, F.lit("drug-guidance")), "ace_drug_guidance")
        .when(F.contains(name, F.lit("guideline")) | (h == "hpp.moh.gov.sg"), "hpp_guideline")
        .when(F.contains(h, F.lit("healthhub")), "healthhub_html")
        .when(world, "international_html")
        .otherwise("guideline_html")
    )
    return F.when(t == "pdf", "guideline_pdf").when(t == "reference_csv", "reference_csv").when(page.isin("index/listing", "navigation-heavy"), "index_page").when(t == "html", html).otherwise("unknown")


def readable_label(source: Column) -> Column:
    """SF25."""
    t = F.trim(F.coalesce(source, F.lit("")))
    stem = F.regexp_replace(F.regexp_extract(t, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when((t == "") | (F.lower(t) == "unknown"), "Unknown source").otherwise(F.coalesce(F.nullif(F.trim(F.regexp_replace(stem, r"[_\-\s]+", " ")), F.lit("")), F.lit("Unknown source")))


def display_label(label: Column, page: Column) -> Column:
    """SF27."""
    return F.when(page > 0, F.concat(label, F.lit(" page "), page.cast("string"))).otherwise(label)


def url_file_name(url: Column, extension: str) -> Column:
    """SU8: the last part of the URL, cut and made safe, and eight digits of its MD5."""
    tag = F.substring(F.md5(url), 1, 8)
    safe = F.regexp_replace(F.substring(F.substring_index(url, "/", -1), 1, 50), r"[^\p{L}\p{N}_\-]", "_")
    stem = F.when((safe == "") | safe.endswith("_"), F.concat(F.lit("content_"), tag)).otherwise(safe)
    return F.concat(stem, F.lit("_"), tag, F.lit("." + extension))

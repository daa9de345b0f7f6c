"""Text functions as Column expressions: the analyzer, hashes, normalisers and quality marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself "
    "she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as "
    "until while of at by for with about against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain "
    "aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
#: Stop words of the domain.
DOMAIN_STOPWORDS = "patient patients year years month months old male female gender age case cases study group result results data analysis method methods background objective conclusion".split()
STOPWORDS = sorted({*ENGLISH_STOPWORDS, *DOMAIN_STOPWORDS})
#: Spellings that one token stands for.
SYNONYMS = {"ldl-c": "ldlc", "ldl": "ldlc", "cholesterol": "lipid", "familial-hypercholesterolemia": "fh", "atherosclerotic": "ascvd"}
#: Words that an acronym adds.
ACRONYMS = {"fh": ["familial", "hypercholesterolemia"], "ascvd": ["atherosclerotic", "cardiovascular", "disease"], "ldlc": ["ldl", "cholesterol"]}
#: Unit spellings, replaced as written and in capitals.
UNITS = {"mmol/l": "mmoll", "mg/dl": "mgdl", "kg/m2": "kgm2", "%": "percent"}
#: Words of page furniture in blocks, and in pages.
BLOCK_TERMS = ("cookie", "privacy", "navigation", "subscribe")
PAGE_TERMS = ("cookie", "privacy", "terms", "navigation", "subscribe", "feedback", "share", "scamshield")
MAX_TEXT = 50_000
#: Letters, digits and underscores, joined by hyphens. Java's \w is ASCII, hence the classes.
WORD = r"[\p{L}\p{N}_]+(?:-+[\p{L}\p{N}_]+)*"


def sanitize_text(text: Column) -> Column:
    """Control characters go, unit spellings are normalised, the text is cut and trimmed (SF1)."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for raw, short in UNITS.items():
        for spelling in dict.fromkeys((raw, raw.upper())):
            out = F.replace(out, F.lit(spelling), F.lit(short))
    return F.regexp_replace(F.substring(out, 1, MAX_TEXT), r"(?U)^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256 (SF6)."""
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_hash(text: Column) -> Column:
    """The same of the lower-cased text, empty for none (SO5)."""
    return F.when(text == "", F.lit("")).otherwise(content_hash(F.lower(text)))


def normalize_space(text: Column) -> Column:
    """Runs of white space become one space; none at the ends (SF7)."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Lower-cased words (SF2)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """The analyzer without stemming: alphabetic words that are no stop words, synonyms applied."""
    kept = F.filter(words(text), lambda w: ~w.isin(STOPWORDS) & ~w.rlike(r"[^\p{L}-]"))
    synonyms = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.transform(kept, lambda w: F.coalesce(F.try_element_at(synonyms, w), w))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a substring that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def boilerplate_ratio(text: Column, terms: tuple[str, ...] = PAGE_TERMS) -> Column:
    """Occurrences of furniture words by characters (SF9)."""
    low = F.lower(text)
    return sum((count_of(low, t) for t in terms), F.lit(0)) / F.greatest(F.lit(1), F.length(low))


def density(text: Column, html: Column) -> Column:
    """Characters of normalised text by characters of its page (SF10)."""
    return F.length(normalize_space(text)) / F.greatest(F.lit(1), F.length(html))


def block_quality(text: Column, confidence: Column, min_chunk: int) -> Column:
    """A block's quality from 0 to 1 (SF11)."""
    hits = sum((count_of(F.lower(text), t) for t in BLOCK_TERMS), F.lit(0))
    short = F.when(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) < min_chunk, 0.35).otherwise(0.0)
    unsure = F.when(confidence == "medium", 0.15).when(confidence == "low", 0.35).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - short - F.least(F.lit(0.4), hits * 0.08) - unsure))


def source_kind(source: Column) -> Column:
    """pdf, markdown or default by the name's end (SF12)."""
    low = F.lower(source)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".md"), "markdown").otherwise("default")


def source_type_of(name: Column) -> Column:
    """pdf, csv, html or other by the name's end (SF16, SF17)."""
    low = F.lower(name)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".csv"), "csv").when(low.endswith(".md") | low.endswith(".html"), "html").otherwise("other")


def source_family(name: Column) -> Column:
    """The first three words of a source's name (SF14)."""
    bare = F.regexp_replace(F.lower(name), r"\.(pdf|md|html)$", "")
    parts = F.filter(F.split(F.regexp_replace(bare, r"[^a-z0-9]+", " "), " "), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, 3), " "), F.lit("")), F.lit("unknown"))


def assign_split(name: Column) -> Column:
    """dev, test or regression by the family's code points (SF15)."""
    total = F.aggregate(F.split(source_family(name), ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c)) % 10
    return F.when(total <= 4, "dev").when(total <= 7, "test").otherwise("regression")


def difficulty(token_count: Column) -> Column:
    """easy, medium or hard by tokens (SF18)."""
    return F.when(token_count >= 120, "hard").when(token_count >= 60, "medium").otherwise("easy")


def page_confidence(text: Column, replaced: Column, lines: Column) -> Column:
    """high, medium or low for extracted page text (SF29)."""
    n = F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when((n >= 400) & (replaced == 0) & (lines >= 3), "high").when((n >= 120) & (replaced <= 2), "medium").otherwise("low")


def trimmed_lines(text: Column) -> Column:
    """Lines without the blank ones, trimmed (SF32)."""
    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def suspected_tables(text: Column) -> Column:
    """Lines that look like table rows (SF30)."""
    return F.size(F.filter(trimmed_lines(text), lambda x: (count_of(x, "|") >= 2) | (F.contains(x, F.lit("  ")) & (F.size(F.split(normalize_space(x), " ")) >= 4))))


def slugify(text: Column) -> Column:
    """Lower case, runs of other characters to one hyphen (SF53)."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def looks_copied(question: Column, evidence: Column) -> Column:
    """Over 0.8 of a question's different words are in the evidence (PF9)."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    q, e = tokens(question), tokens(evidence)
    return F.when((F.size(q) == 0) | (F.size(e) == 0), False).otherwise(F.size(F.array_intersect(q, e)) / F.size(q) > 0.8)


def leaks_source(question: Column, source: Column) -> Column:
    """The question names its source (PF8)."""
    low = F.lower(question)
    return F.contains(low, source_family(source)) | F.contains(low, F.lit(".pdf")) | F.contains(low, F.lit(".md"))


def evidence_phrase(text: Column, keywords: list[str], window: int = 60) -> Column:
    """Up to 220 characters around the first keyword that occurs (SF19)."""
    low = F.lower(text)
    at = F.coalesce(*[F.nullif(F.locate(k.lower(), low), F.lit(0)) for k in keywords])
    size = F.coalesce(*[F.when(F.locate(k.lower(), low) > 0, len(k)) for k in keywords])
    start = F.greatest(F.lit(1), at - window)
    cut = F.substring(text, start, at + size + window - start)
    return F.coalesce(F.substring(F.regexp_replace(cut, r"(?U)^\s+|\s+$", ""), 1, 220), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays, as sets; 0 if either is empty (SO4)."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))

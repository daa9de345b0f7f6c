"""Structure of clinical texts as Column expressions: headers, dosing, tables, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of sections in clinical notes and in guidelines.
CLINICAL_SECTIONS = ("CHIEF COMPLAINT", "HISTORY OF PRESENT ILLNESS", "PAST MEDICAL HISTORY", "MEDICATIONS", "ALLERGIES", "SOCIAL HISTORY", "FAMILY HISTORY", "PHYSICAL EXAMINATION", "ASSESSMENT", "PLAN", "SUBJECTIVE", "OBJECTIVE", "VITAL SIGNS", "LABORATORY RESULTS", "RADIOLOGY", "DIAGNOSIS", "DISPOSITION")
GUIDELINE_SECTIONS = ("KEY MESSAGES", "RECOMMENDATIONS", "BACKGROUND", "INTRODUCTION", "METHODS", "RESULTS", "DISCUSSION", "CONCLUSION", "TREATMENT", "MANAGEMENT", "MONITORING", "FOLLOW-UP", "FOLLOW UP", "SCREENING", "PREVENTION", "DIAGNOSIS", "REFERRAL", "SPECIAL POPULATIONS", "ADVERSE EFFECTS", "CONTRAINDICATIONS", "DRUG INTERACTIONS", "DOSAGE", "ADMINISTRATION", "PATIENT EDUCATION", "LIFESTYLE", "PHARMACOLOGICAL", "NON-PHARMACOLOGICAL")
SECTIONS = tuple(dict.fromkeys(CLINICAL_SECTIONS + GUIDELINE_SECTIONS))
#: Patterns of header lines, dosing and laboratory tables.
HEADERS = (r"(?i)^#{1,4}\s+\w+", r"^\d+\.\s+[A-Z][A-Za-z\s]{3,}$", r"^[A-Z][A-Z\s]{3,}:$", r"(?i)^Recommendation\s+\d+")
DOSING = (r"(?:dosage|dose|administer|administration)\s*:?\s*", r"(?:take|takes?|taking)\s+.+?\s+(?:daily|twice daily|bid|tid|qid|prn)", r"\d+\s*(?:mg|mcg|g|ml|units?)\s*(?:daily|twice daily|bid|tid|qid|prn|every \d+ hours?)")
LAB_TABLES = (r"(?:test|lab|laboratory|value|reference|range|unit)s?\s*\|\s*", r"\|\s*(?:normal|abnormal|high|low|result)\s*\|", r"(?:hemoglobin|hematocrit|wbc|rbc|platelet|glucose|creatinine|bun|sodium|potassium)\s*\|")
AMOUNT = r"(?i)\d+\s*(?:mg|mcg|g|ml|units?)"


def _any(text: Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    return text.rlike(flags + "(?:" + "|".join(patterns) + ")")


def is_section_header(line: Column) -> Column:
    """A known name, a header pattern, or a known name before a colon (SF39)."""
    t = F.trim(line)
    known = F.upper(t).isin(*SECTIONS) | F.upper(F.regexp_replace(t, ":$", "")).isin(*SECTIONS)
    shaped = F.lit(False)
    for p in HEADERS:
        shaped = shaped | t.rlike(p)
    return (t != "") & (known | shaped)


def has_dosing(text: Column) -> Column:
    """SF40."""
    return _any(text, DOSING)


def is_lab_table(text: Column) -> Column:
    """SF41."""
    return F.contains(text, F.lit("|")) & _any(text, LAB_TABLES)


def header_positions(text: Column) -> Column:
    """Places of header lines, in characters from 0 (SF42)."""
    lines = F.split(text, "\n")
    walk = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda a, line: F.struct((a["at"] + F.length(line) + 1).alias("at"), F.when(is_section_header(line), F.concat(a["found"], F.array(a["at"]))).otherwise(a["found"]).alias("found")),
    )
    return walk["found"]


DOSE, FREQUENCY = r"\d+\s*(?:mg|mcg|g|ml|units?)", r"(?:daily|bid|tid|qid|prn)"


def preservation_score(text: Column) -> Column:
    """How much of a chunk's structure is whole, from 0 to 1 (SF44): dosing counts for it with amount
    and frequency, against it with one of them; a table counts for it from two rows on, else against it."""
    lines = F.split(text, "\n")
    dose, often = text.rlike(DOSE), text.rlike(FREQUENCY)
    rows = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|"))))
    head = F.when(is_section_header(F.element_at(lines, 1)), 0.2).otherwise(0.0)
    dosing = F.when(has_dosing(text) & dose & often, 0.15).when(has_dosing(text) & (dose | often), -0.1).otherwise(0.0)
    lab = F.when(is_lab_table(text), F.when(rows >= 2, 0.15).otherwise(-0.2)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + head + dosing + lab))


def avoids_split(before: Column, after: Column) -> Column:
    """A place between two texts that had better not be a chunk's end (SF43): dosing on both sides
    that the last line before it belongs to, or a table's row that follows a bare bar."""
    lines, first = F.split(before, "\n"), F.element_at(F.split(after, "\n"), 1)
    dosing = has_dosing(before) & has_dosing(after) & has_dosing(F.element_at(lines, -1))
    return dosing | ((is_lab_table(before) | is_lab_table(after)) & F.array_contains(lines, "|") & F.contains(first, F.lit("|")))


def keeps_together(text: Column, drugs: Column) -> Column:
    """A drug and an amount in one text (SF47); ``drugs``: names found in it."""
    return (F.size(drugs) > 0) & text.rlike(AMOUNT)


def _matches(text: Column, pattern: str, label: str, confidence: float) -> Column:
    """Matches with their places: the texts between them say how far each is from the start."""
    found, gaps = F.regexp_extract_all(text, F.lit("(?i)(?:" + pattern + ")"), F.lit(0)), F.split(text, "(?i)(?:" + pattern + ")")
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    start = lambda i: total(F.slice(gaps, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
    return F.transform(found, lambda m, i: F.struct(m.alias("text"), F.lit(label).alias("label"), start(i).alias("start"), (start(i) + F.length(m)).alias("end"), F.lit(confidence).alias("confidence")))


def entities(text: Column, drugs: list[str], conditions: list[str]) -> Column:
    """array<struct<text, label, start, end, confidence>>, pattern by pattern: drugs with confidence
    0.7, then conditions with 0.8 (SF45)."""
    return F.concat(*[_matches(text, p, "DRUG", 0.7) for p in drugs], *[_matches(text, p, "DISEASE", 0.8) for p in conditions])


def should_merge(left: Column, right: Column, drugs: Column) -> Column:
    """Neighbours that belong together: a drug with its amount, a table, an amount without how often (TV19)."""
    open_dose = has_dosing(left) & left.rlike(DOSE) & ~left.rlike(FREQUENCY)
    return keeps_together(F.concat_ws(" ", left, right), drugs) | is_lab_table(left) | is_lab_table(right) | open_dose

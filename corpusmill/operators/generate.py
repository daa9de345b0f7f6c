"""Synthetic questions with a log: seeds drawn by stratum, generation in rounds, ordered checks, and
retries until each stratum has its quota (UD17, UD21, PF7-PF9, TK8)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import leaks_source, looks_copied
from ..sources.shared import written
from .enrich import json_object, run_calls
from .sampling import stratified_sample

#: From (context, source, attempt) to a JSON object with question, evidence_span, answer_summary.
Generator = Callable[[str, str, int], str]
_CANDIDATE = "question string, evidence_span string, answer_summary string"


def stub_generator(context: str, source: str, attempt: int) -> str:
    """A deterministic stand-in for a model: copies first, may name its source next, then asks."""
    evidence = context[:40].strip(" ")
    question = evidence
    if attempt > 1:
        question = f"What is said of {context.split(' ')[-1]} in part {attempt}?"
    if attempt == 2 and len(context) % 3 == 0:
        question += f" See {source}.pdf"
    return json.dumps({"question": question, "evidence_span": evidence, "answer_summary": evidence})


def verdict(question: Column, evidence: Column, answer: Column, context: Column, source: Column) -> Column:
    """Why a candidate is rejected, the first reason that holds, or "accepted" (PF7)."""
    low = F.lower(context)
    heads = F.slice(F.regexp_extract_all(F.lower(answer), F.lit("[a-z0-9]+"), F.lit(0)), 1, 3)
    ungrounded = (F.trim(answer) != "") & ~F.exists(heads, lambda t: F.contains(low, t))
    return (
        F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "empty_question")
        .when((F.coalesce(evidence, F.lit("")) == "") | ~F.contains(context, evidence), "invalid_evidence_span")
        .when(leaks_source(question, source), "source_title_leakage")
        .when(looks_copied(question, evidence), "question_too_copied")
        .when(F.coalesce(ungrounded, F.lit(False)), "answer_not_grounded")
        .otherwise("accepted")
    )


def generate_questions(rows: DataFrame, stratum: str, id_col: str, text_col: str, source_col: str, quota: int, generator: Generator = stub_generator, spare: int = 2, tries: int = 3, seed: int = 0, timeout_s: float | None = 30.0, at_once: int = 4) -> DataFrame:
    """The log: (stratum, id, place, attempt, status, reason, question, evidence, kept).

    ``quota * spare`` seeds of each stratum are drawn by a hash. In a round every seed without an
    accepted question gets a call, as long as its stratum is short of its quota; calls of a task run
    ``at_once`` and each for ``timeout_s`` at most. The first ``quota`` accepted of a stratum, by place,
    are kept. A stratum that stays short has a log row with a reason for every try."""
    seeds = rows.where(F.length(F.trim(text_col)) > 0).select(F.col(stratum).cast("string").alias("stratum"), F.col(id_col).alias("id"), F.col(text_col).alias("context"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    drawn = written(stratified_sample(seeds, [F.col("stratum")], F.col("id"), quota * spare, seed), "seeds")

    def rounds(attempt: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                calls = [lambda c=c, s=s: generator(c, s, attempt) for c, s in zip(p["context"], p["source"], strict=True)]
                got = run_calls(calls, timeout_s, at_once)
                yield p.assign(answer=[g[0] for g in got], failure=[g[1] for g in got])

        return run

    log, open_seeds = None, drawn
    for attempt in range(1, tries + 1):
        asked = open_seeds.mapInPandas(rounds(attempt), "stratum string, id long, context string, source string, place int, answer string, failure string")
        made = F.from_json(json_object(F.col("answer")), _CANDIDATE)
        why = verdict(made["question"], made["evidence_span"], F.coalesce(made["answer_summary"], F.lit("")), F.col("context"), F.col("source"))
        judged = asked.select("stratum", "id", "place", F.lit(attempt).alias("attempt"), F.coalesce("failure", why).alias("reason"), made["question"].alias("question"), made["evidence_span"].alias("evidence"))
        judged = written(judged, "generated")
        log = judged if log is None else log.unionByName(judged)
        if attempt == tries:
            break
        short = drawn.select("stratum").distinct().join(log.where("reason = 'accepted'").groupBy("stratum").count(), "stratum", "left").where(F.coalesce("count", F.lit(0)) < quota).select("stratum")
        open_seeds = drawn.join(judged.where("reason <> 'accepted'").select("stratum", "id"), ["stratum", "id"], "left_semi").join(short, "stratum", "left_semi")
        open_seeds = written(open_seeds.select("stratum", "id", "context", "source", "place"), "open-seeds")
        if open_seeds.isEmpty():
            break
    taken = log.where("reason = 'accepted'").withColumn("n", F.row_number().over(Window.partitionBy("stratum").orderBy("place")))
    kept = taken.where(F.col("n") <= quota).select("stratum", "id", "attempt", F.lit(True).alias("kept"))
    status = F.when(F.col("reason") == "accepted", "accepted").otherwise("rejected")
    out = log.join(kept, ["stratum", "id", "attempt"], "left")
    return out.select("stratum", "id", F.col("place").cast("long").alias("place"), "attempt", status.alias("status"), "reason", "question", "evidence", F.coalesce("kept", F.lit(False)).alias("kept"))

"""Enrichment by models that the caller supplies: embeddings, keywords, summaries, questions.

A client is any function from a list of texts to a list of answers; it runs on the executors, a
batch at a time. The default clients are deterministic and need no network."""

from __future__ import annotations

import hashlib
import json
import queue
import re
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[str]]
_WORDS = re.compile(r"[^\W\d_]{4,}")


def hashing_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors from hashed words (UD2's offline default)."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w, n in Counter(_WORDS.findall(t.lower())).items():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            out[i, h % dim] += n if h >> 63 else -n
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def embed(rows: DataFrame, text_col: str, embedder: Callable[[list[str]], np.ndarray] = hashing_embedder, batch: int = 50) -> DataFrame:
    """Rows with an embedding; each different text of a batch is embedded once (UD2, UD3)."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            different = list(dict.fromkeys(p.fillna("")))
            made: dict[str, list] = {}
            for at in range(0, len(different), batch):
                part = different[at : at + batch]
                made.update(zip(part, np.asarray(embedder(part), np.float32).tolist(), strict=True))
            yield p.fillna("").map(made)

    return rows.withColumn("embedding", run(F.col(text_col)))


def stub_client(texts: list[str]) -> list[str]:
    """Keywords by count and the first sentence, as the JSON that models are asked for."""
    out = []
    for t in texts:
        words = [w for w, _ in sorted(Counter(_WORDS.findall(t.lower())).items(), key=lambda x: (-x[1], x[0]))[:5]]
        out.append("```json\n" + json.dumps({"keywords": words, "summary": t.split(". ")[0][:200]}) + "\n```")
    return out


def run_calls(calls: Sequence[Callable[[], Any]], timeout_s: float | None = None, at_once: int = 4) -> list[tuple[Any, str | None]]:
    """(result, reason) of each call, in order: ``at_once`` of them run at a time, each for ``timeout_s``
    seconds at most. The reason is null for a result, "timeout", or the name of the error. A call that
    is late is left behind: another takes its place, and what it may still return is not looked at."""
    out: list[tuple[Any, str | None]] = [(None, "timeout")] * len(calls)
    running: dict[int, float] = {}
    done: queue.SimpleQueue[tuple[int, Any, str | None]] = queue.SimpleQueue()

    def run(k: int) -> None:
        try:
            done.put((k, calls[k](), None))
        except Exception as e:  # noqa: BLE001  the row says what went wrong
            done.put((k, None, type(e).__name__))

    todo = iter(range(len(calls)))
    left = len(calls)
    while left:
        while len(running) < at_once and (k := next(todo, None)) is not None:
            running[k] = time.monotonic()
            threading.Thread(target=run, args=(k,), daemon=True).start()
        wait = None if timeout_s is None else max(0.0, min(running.values()) + timeout_s - time.monotonic())
        try:
            k, value, reason = done.get(timeout=wait)
            if running.pop(k, None) is not None:
                out[k] = (value, reason)
                left -= 1
        except queue.Empty:
            late = [k for k, began in running.items() if time.monotonic() - began >= timeout_s]
            for k in late:
                del running[k]
            left -= len(late)
    return out


def ask(rows: DataFrame, text_col: str, client: Client, batch: int = 10, timeout_s: float | None = 30.0, at_once: int = 4, reason_col: str | None = None) -> DataFrame:
    """Rows with the client's answer; a batch that fails or takes longer than ``timeout_s`` has none
    (UD5-UD7), and ``reason_col``, if named, says why."""

    @F.pandas_udf("answer string, reason string")
    def run(p: pd.Series) -> pd.DataFrame:
        parts = [p.iloc[at : at + batch].fillna("").tolist() for at in range(0, len(p), batch)]
        got = run_calls([lambda x=x: client(x) for x in parts], timeout_s, at_once)
        answers = [a for x, (result, why) in zip(parts, got, strict=True) for a in (result if why is None else [None] * len(x))]
        reasons = [why for x, (_, why) in zip(parts, got, strict=True) for _ in x]
        return pd.DataFrame({"answer": pd.Series(answers, dtype=object), "reason": pd.Series(reasons, dtype=object)})

    both = rows.withColumn("__asked", run(F.col(text_col)))
    out = both.withColumn("answer", F.col("__asked.answer"))
    return (out.withColumn(reason_col, F.col("__asked.reason")) if reason_col else out).drop("__asked")


def json_object(answer: Column) -> Column:
    """The outermost JSON object in an answer (SF20)."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))


def parse_enrichment(answer: Column) -> Column:
    """struct<keywords, summary>: up to 15 keywords, in lower case (SF21, TK14)."""
    x = F.from_json(json_object(answer), "keywords array<string>, summary string")
    words = F.filter(F.transform(F.coalesce(x["keywords"], F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    return F.struct(F.slice(words, 1, 15).alias("keywords"), F.nullif(F.trim(x["summary"]), F.lit("")).alias("summary"))


def parse_questions(answer: Column, n: int = 2) -> Column:
    """The first ``n`` lines over ten characters, without their numbers (SF56)."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*•])\s*", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 10), 1, n)


def apply_by_id(chunks: DataFrame, found: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Chunks with the columns of what was found for their ids."""
    extra = found.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns]).dropDuplicates(["__id"])
    joined = chunks.join(extra, F.col(id_col) == F.col("__id"), "left").drop("__id")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"__{c}", c) if c in chunks.columns else F.col(f"__{c}")).drop(f"__{c}")
    return joined


def cached(rows: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Values by key from a cache table, computed where it has none."""
    known = rows.join(cache, key)
    return known.unionByName(compute(rows.join(cache, key, "left_anti")), allowMissingColumns=True)


def with_retries(client: Client, tries: int = 3, wait_s: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Client:
    """A client that is called again when it fails, after waits that double (UD18)."""

    def call(texts: list[str]) -> list[str]:
        for k in range(tries):
            try:
                return client(texts)
            except Exception:  # noqa: BLE001  the last failure is raised
                if k + 1 == tries:
                    raise
                sleep(wait_s * 2**k)
        return []

    return call


Judge = Callable[[str, str, str], float]


def overlap_judge(question: str, context: str, answer: str) -> float:
    """Share of the answer's words that the context has: an offline stand-in for a model's judgement."""
    a, c = set(_WORDS.findall(answer.lower())), set(_WORDS.findall(context.lower()))
    return len(a & c) / len(a) if a else 0.0


def judged(answers: DataFrame, judges: dict[str, Judge], thresholds: dict[str, float], tries: int = 2, timeout_s: float | None = 30.0, at_once: int = 4) -> DataFrame:
    """(query_id, metric, score, passed, reason) of (query_id, question, context, answer): each judge by
    itself, ``at_once`` calls of a task at a time, each for ``timeout_s`` at most, and tried again while
    it fails. One that fails for good leaves a null score that has not passed, and the last reason:
    "timeout" or the error's name (UD13, UD14)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            asked = [(i, name, judge, q or "", c or "", a or "") for i, q, c, a in p[["query_id", "question", "context", "answer"]].itertuples(index=False) for name, judge in sorted(judges.items())]
            got: list[tuple[Any, str | None]] = [(None, "")] * len(asked)
            for _ in range(tries):
                again = [k for k, (_, why) in enumerate(got) if why is not None]
                calls = [lambda j=asked[k]: float(j[2](*j[3:])) for k in again]
                for k, result in zip(again, run_calls(calls, timeout_s, at_once), strict=True):
                    got[k] = result
            yield pd.DataFrame([(i, name, score, why) for (i, name, *_), (score, why) in zip(asked, got, strict=True)], columns=["query_id", "metric", "score", "reason"])

    out = answers.select("query_id", "question", "context", "answer").mapInPandas(run, "query_id long, metric string, score double, reason string")
    least = F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("metric"))
    return out.withColumn("passed", F.coalesce(F.col("score") >= least, F.lit(False))).select("query_id", "metric", "score", "passed", "reason")


def expansions(queries: DataFrame, provider: DataFrame | None, tokens: Callable[[Column], Column]) -> DataFrame:
    """(query_id, term, expansion, source, relation): what a provider's table (term, expansion, source,
    relation) has for the tokens of a query, each once; nothing without a provider (SF38, UD11)."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    if provider is None:
        return asked.select("query_id", "term", *[F.lit(None).cast("string").alias(c) for c in ("expansion", "source", "relation")]).limit(0)
    return asked.join(provider.select("term", "expansion", "source", "relation").distinct(), "term").select("query_id", "term", "expansion", "source", "relation")

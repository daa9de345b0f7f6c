"""Maximal marginal relevance and quotas of sources, a query at a time (TK3, TK4, WN6).

The choice of each row depends on those chosen before, so a query's candidates, of which there are
k times the overfetch, are chosen from in one group."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mmr_order(scores: list[float], tokens: list[set], k: int, lam: float) -> list[int]:
    """Places in the order of choice: lam x score / best - (1 - lam) x likeness to what is chosen."""
    if len(scores) <= 1:
        return list(range(min(len(scores), k)))
    best = max(scores) or 1.0
    left, chosen, alike = list(range(len(scores))), [], [0.0] * len(scores)
    while left and len(chosen) < k:
        i = max(left, key=lambda j: (lam * scores[j] / best - (1 - lam) * alike[j], -j))
        left.remove(i)
        chosen.append(i)
        for j in left:
            union = tokens[i] | tokens[j]
            if tokens[i] and tokens[j]:
                alike[j] = max(alike[j], len(tokens[i] & tokens[j]) / len(union))
    return chosen


def choose(rows: list[dict], k: int, lam: float, overfetch: int, per_page: int, per_source: int) -> list[dict]:
    """Rows (id, content, source, page, score, tokens) under quotas, filled up if these leave too few:
    then a page may have one more, sources any number, and equal contents count again."""
    pool = [rows[i] for i in mmr_order([r["score"] for r in rows], [r["tokens"] for r in rows], max(k, k * max(1, overfetch)), lam)]
    out: list[dict] = []
    ids, texts, pages, sources = set(), set(), Counter(), Counter()

    def take(r: dict) -> None:
        out.append(r)
        ids.add(r["id"])
        pages[r["source"], r["page"]] += 1

    for r in pool:
        text = r["content"].strip()
        if len(out) < k and r["id"] not in ids and (not text or text not in texts) and pages[r["source"], r["page"]] < per_page and sources[r["source"]] < per_source:
            take(r)
            texts.add(text)
            sources[r["source"]] += 1
    for r in pool:
        if len(out) < k and r["id"] not in ids and pages[r["source"], r["page"]] < per_page + 1:
            take(r)
    return out


def diversify(results: DataFrame, k: int = 5, lam: float = 0.75, overfetch: int = 4, per_page: int = 2, per_source: int = 3) -> DataFrame:
    """(query_id, doc_id, place) from (query_id, rank, doc_id, content, source, page, score, tokens)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        rows = [{"id": r.doc_id, "content": r.content or "", "source": r.source, "page": r.page, "score": r.score, "tokens": set(r.tokens)} for r in pdf.itertuples()]
        got = choose(rows, k, lam, overfetch, per_page, per_source)
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "doc_id": [r["id"] for r in got], "place": range(1, len(got) + 1)})

    cols = ["query_id", "rank", "doc_id", "content", "source", "page", "score", "tokens"]
    return results.select(*cols).groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, place long")


def capped(results: DataFrame, key: str, cap: int) -> DataFrame:
    """At most ``cap`` rows a query and key, in rank order: the quota without its order of choice (WN6)."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", key).orderBy("rank")
    return results.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")



"""The lexical index as tables: postings with document lengths, and corpus figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_tokens

K1, B = 1.5, 0.75


@dataclass
class LexicalIndex:
    """postings(doc_id, token, tf, doc_len) and stats(n_docs, avg_len), one row."""

    postings: DataFrame
    stats: DataFrame

    def write(self, path: str) -> None:
        """Postings sorted by token, so that a query's tokens prune row groups (SK8)."""
        self.postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark, path: str) -> LexicalIndex:
        return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))


def tokenized(docs: DataFrame, text: Column, analyzer: Callable[[Column], Column] = plain_tokens) -> DataFrame:
    return docs.withColumn("tokens", analyzer(text))


#: Tokens that go out with a broadcast, at most; more are joined.
BROADCAST_TOKENS = 100_000


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: Callable[[Column], Column] = plain_tokens, only: DataFrame | None = None) -> LexicalIndex:
    """Term and document frequencies of every text (AG1, AG2). Null texts count as documents.

    ``only``: a table of tokens (column token); postings of others are left out before they are
    counted, which is all that a batch of queries needs. Lengths and figures are of whole texts."""
    toks = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(analyzer(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))
    words = toks.select("doc_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("token"))
    if only is not None:
        wanted = only.select("token").distinct()
        words = words.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TOKENS else wanted, "token", "left_semi")
    postings = words.groupBy("doc_id", "token", "doc_len").agg(F.count("*").alias("tf"))
    stats = toks.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))
    return LexicalIndex(postings.select("doc_id", "token", "tf", "doc_len"), stats)


def bm25(index: LexicalIndex, queries: DataFrame, query_id: str = "query_id", text_col: str = "query", analyzer: Callable[[Column], Column] = plain_tokens) -> DataFrame:
    """(query_id, doc_id, bm25) of documents that share a token with the query.

    Postings are cut down to the queries' tokens before anything is shuffled; document frequencies
    are counted on what is left, which holds every posting of those tokens."""
    tokens = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(analyzer(F.col(text_col)))).alias("token"))
    wanted = tokens.select("token").distinct()
    hit = index.postings.join(wanted, "token", "left_semi")
    df = hit.groupBy("token").agg(F.count("*").alias("df"))
    n, avg = F.col("n_docs"), F.col("avg_len")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - B + B * (F.col("doc_len") / avg)
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * length)
    weighted = hit.join(df, "token").crossJoin(F.broadcast(index.stats)).select("token", "doc_id", part.alias("part"))  # stats: one row
    return tokens.join(weighted, "token").groupBy("query_id", "doc_id").agg(F.sum("part").alias("bm25"))


def keyword_bonus(scores: DataFrame, asked: DataFrame, held: DataFrame, weight: float = 0.5) -> DataFrame:
    """(query_id, doc_id, bm25, bonus): each extracted keyword equal to a query token adds ``weight``
    of the base score (J2). ``asked``: (query_id, token) and ``held``: (doc_id, token), each pair once."""
    n = asked.join(held, "token").groupBy("query_id", "doc_id").agg(F.count("*").alias("matches"))
    return scores.join(n, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "bm25", (F.col("bm25") * weight * F.coalesce("matches", F.lit(0))).alias("bonus"))

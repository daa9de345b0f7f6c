"""A written lexical index with block-max skipping.

Documents are dealt into blocks by a hash of their id. The index has a row for each token and block:
the postings of that block with their BM25 parts, and the largest part. A batch of queries first reads
the largest parts alone (a column by itself), which bound what any document of a block can score. Each
query's most promising blocks are scored; the score of the last place found so far then rules out all
blocks whose bound lies below it, and only the others' postings are read and scored. The results are
those of scoring everything."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_tokens
from ..sources.shared import written
from .index import B, BROADCAST_TOKENS, K1, build_index
from .search import top_k

#: Documents of a block, about.
BLOCK_DOCS = 64
#: Scores are compared after rounding to so many places, ties to smaller ids.
DIGITS = 6


def write_blocks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", analyzer: Callable[[Column], Column] = plain_tokens, block_docs: int = BLOCK_DOCS) -> None:
    """Write the index of all texts: (token, block, best, postings), sorted by token, so that a
    query's tokens prune row groups (J1, AG1, AG2, SK8). Frequencies and lengths are those of whole texts."""
    index = build_index(docs, id_col, text_col, analyzer)
    postings = written(index.postings, "postings")  # read for document frequencies and for parts
    n_docs, avg = index.stats.first()
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * (F.col("doc_len") / F.lit(avg))))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n_docs // block_docs)))).alias("block")
    parts = postings.join(df, "token").select("token", block, "doc_id", part.alias("part"))
    rows = parts.groupBy("token", "block").agg(F.max("part").alias("best"), F.collect_list(F.struct("doc_id", "part")).alias("postings"))
    rows.repartitionByRange("token").sortWithinPartitions("token", "block").write.mode("overwrite").parquet(path)


@dataclass
class BlockIndex:
    """A written index."""

    rows: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> BlockIndex:
        return BlockIndex(spark.read.parquet(path))

    def of(self, asked: DataFrame) -> DataFrame:
        """The index rows of the tokens of (query_id, token), a row for each query that asks."""
        few = asked.select("token").distinct().count() <= BROADCAST_TOKENS and asked.count() <= 8 * BROADCAST_TOKENS
        return self.rows.join(F.broadcast(asked) if few else asked, "token")

    def scores(self, asked: DataFrame) -> DataFrame:
        """(query_id, doc_id, bm25) of every document that shares a token with the query."""
        return _summed(self.of(asked))


def asked_tokens(queries: DataFrame, query_id: str = "query_id", text_col: str = "query", analyzer: Callable[[Column], Column] = plain_tokens) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(analyzer(F.col(text_col)))).alias("token"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.explode("postings").alias("p")).groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(F.sum("p.part").alias("bm25"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores.select("query_id", "doc_id", F.round("bm25", DIGITS).alias("score")), k, [F.col("score").desc(), F.col("doc_id")])


def search(index: BlockIndex, asked: DataFrame, k: int, first_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best documents of each query, (query_id, doc_id, score, rank), and what that took:
    (query_id, blocks, postings, scored_blocks, scored_postings).

    ``first_blocks``: blocks that are scored before any is ruled out; ``k`` of them hold ``k``
    documents at least."""
    hits = index.of(asked)
    # the columns of bounds alone are read here
    bounds = hits.groupBy("query_id", "block").agg(F.sum("best").alias("bound"))
    ranked = written(top_k(bounds, 2**31 - 1, [F.col("bound").desc(), F.col("block")], name="place"), "bounds")
    first = ranked.where(F.col("place") <= (first_blocks or k)).select("query_id", "block")
    found = written(_best(_summed(hits.join(first, ["query_id", "block"])), k), "found")
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = ranked.where(F.col("place") > (first_blocks or k)).join(least, "query_id", "left")
    # scores are compared rounded, so the bound has to lie below by more than rounding moves them
    rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS)).select("query_id", "block")
    later = _best(_summed(hits.join(rest, ["query_id", "block"])), k)
    best = top_k(found.drop("rank").unionByName(later.drop("rank")), k, [F.col("score").desc(), F.col("doc_id")])
    scored = first.unionByName(rest).withColumn("scored", F.lit(1))
    sizes = hits.select("query_id", "block", F.size("postings").alias("n")).groupBy("query_id", "block").agg(F.sum("n").alias("n")).join(scored, ["query_id", "block"], "left")
    effort = sizes.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("postings"), F.count("scored").alias("scored_blocks"), F.coalesce(F.sum(F.when(F.col("scored") == 1, F.col("n"))), F.lit(0)).alias("scored_postings"))
    return best.select("query_id", "doc_id", "score", "rank"), effort

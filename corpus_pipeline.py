"""The corpus pipeline: documents to identified, deduplicated, decontaminated, mixed shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.

1. language_id: texts without a letter, or whose language is found with a score below 0.4, go.
2. near_duplicates: of each group of texts alike in 0.8 of their 5-word shingles, one row stays.
3. decontamination: words of benchmark passages are cut out; rows that are mostly such words go.
4. mixing: rows are repeated or left out until sources meet their target shares.
5. sharding: every row gets one of 16 shards of nearly equal bytes, and a slot in it.

Null and empty texts, and texts without a letter, have no language and go in stage 1. Null ids and
sources are kept; rows that are equal in all columns are near duplicates, of which one stays (the
least id, and of equal ids any, since their texts are alike). Texts are read whole at every length.
An empty table passes all stages empty. Columns besides doc_id, text, lang and source are carried
along under their names, whatever those are; stage 5 returns doc_id, size, text_crc32, shard, slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontam, kdshard, langid, mixing, simhash
from corpusmill.llm.common import drop_path, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.select("doc_id", "text", "lang"), learn=F.lit(True))
    return langid.keep_identified(docs, model, min_score=0.4)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kdshard.assign(docs, shards=16)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", sharding),
]

#: Learned models and hashed fingerprints are not SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spent = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = materialize(docs, f"stage-{name}")
            if spent is not None:  # the stage before is read no more
                drop_path(spark, spent)
            spent = path
    return docs

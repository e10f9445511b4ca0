"""From raw documents to shuffled shards, in five stages; each works on all that its predecessor kept.

1. toxicity: documents that the span tagger scores as toxic go.
2. jaccard_join: of each group of linked documents the one with the smallest id stays.
3. decontamination: documents that hold a benchmark item go.
4. mixing: sources to target weights; documents are repeated or left out.
5. sharding: two-pass shuffle into equal shards; the documents' columns with size, text_crc32, law, shard and slot (a
   column of such a name comes out with in_ before it).

Odd rows: null and empty texts are clean, link with nothing, hold no item and have no words, so they pass stages 1 to 3 and
are taken 0 times in stage 4; rows with a null id pass stage 2; repeated rows with one id and text are one document from
stage 2 on; an empty table passes all stages as it is; further columns are carried.

A stage's function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontam, jaccard_join, mixing, sharding, toxicity
from touchline.llm.common import small_batches, stage_folder, table

N_SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixed_documents(docs, F.array("source"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    own = ("size", "text_crc32", "law", "shard", "slot")
    docs = docs.select([F.col(c).alias(f"in_{c}" if c in own else c) for c in docs.columns])
    return sharding.shuffle_into_shards(docs, N_SHARDS, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]
#: SQL can't express the trained span tagger, nor the seeded shuffle; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again as the next one's documents."""
    docs, folder = table(spark, sf_dir, "documents"), stage_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

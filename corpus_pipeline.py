"""The corpus pipeline: documents through five stages, each written as Parquet and read by the next.

toxicity: toxic documents go. near_duplicates: one document of each group stays (five words, similarity
0.8 or more). decontamination: documents with benchmark passages go. mixing: documents are taken as often
as their source's target asks, in the order of the curriculum. sharding: the mixed rows are dealt to shards
of equal counts that each match the mixture; it returns where each row lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densel.llm import decontamination, jaccard, mixing, sharding, toxicity
from densel.llm.queries import fold
from densel.llm.tables import aside, table, written

N_SHARDS = 24


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the machine learns from the labels of folds 1 to 4."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold() != 0)
    rows, back = aside(docs, "score", "best")
    scored = toxicity.score_texts(rows, machine, keep_text=True)
    return scored.filter("score < 0.5").drop("score").withColumnsRenamed(back).select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    rows, back = aside(docs, "_id", "_gone", "_again", "_sid_of_row", "_turn")
    return jaccard.keep_one(rows, k=5, p=80, q=100).withColumnsRenamed(back).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the contamination rule (1 word in 20 inside a 13-word match)."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                      F.coalesce(F.xxhash64("text"), F.lit(0)).cast("string"))
    index = decontamination.build_index(docs.withColumn("_key", key).select("_key", "text"), key="_key")
    found = decontamination.search(index, table(spark, sf_dir, "benchmark"), window=13)
    bad = (found.filter(decontamination.contaminated(F.col("n_words"), decontamination.n_hit(F.col("spans"))))
           .select(F.col("key").alias("_key")).distinct())
    rows, back = aside(docs, "_key")
    return (rows.withColumn("_key", key).join(written(bad, "contaminated"), "_key", "left_anti")
            .drop("_key").withColumnsRenamed(back).select(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The taken documents in curriculum order, a row per copy."""
    rows, back = aside(docs, "copy", "position", "_text", "_turn", "_copy", "_doc", "_source", "_t", "_n", "_position")
    return mixing.curriculum(rows).drop("copy", "position").withColumnsRenamed(back).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each mixed row."""
    return sharding.shard_documents(docs, N_SHARDS)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", keep_one_of_near_duplicates), ("decontamination", decontaminate),
          ("mixing", mix), ("sharding", shard)]

#: Toxicity scores and near-duplicate components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

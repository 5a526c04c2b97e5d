"""Registered queries of the training-data operators and their SQL restatements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densel.llm import (
    decontamination,
    extraction,
    jaccard,
    lm,
    mixing,
    phrases,
    sharding,
    spelling,
    token_files,
    toxicity,
    urls,
    vectors,
    warc,
)
from densel.llm.tables import table
from densel.session import scratch_dir


def fold(key: str = "doc_id"):
    """crc32 of a key as text, modulo 5; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5


def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in segments, and read back, reassembled, decoded and verified."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url",
                                                 F.col("html").cast("binary").alias("payload"))
    path = scratch_dir(spark, "archives")
    warc.write_archives(pages, path)
    back = warc.read_archives(spark, path, keep_payload=False)
    return back.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                       F.col("kind").alias("record_type"), F.col("refers_to_key").cast("long").alias("refers_to"), "status")


def op2_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings within their label, by search of robust-pruned flat graphs."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents joined by 3-word n-gram sets of Jaccard similarity 0.9 or more."""
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op4_proportional_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, each matching the source mixture."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")


def op5_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by markup and the suffix arrays of their hosts."""
    out = extraction.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labelled ones of folds 1 to 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold() != 0)
    out = toxicity.score_texts(docs, machine)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and a character language-model ratio judge the urls of all pages."""
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched for 13-word windows of the benchmark through the positional index."""
    index = decontamination.build_index(table(spark, sf_dir, "documents"))
    found = decontamination.search(index, table(spark, sf_dir, "benchmark"), window=13)
    hits = found.withColumn("n_hit", decontamination.n_hit(F.col("spans")))
    return hits.select(F.col("key").cast("long").alias("doc_id"), "n_words", "n_hit",
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       decontamination.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def op9_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' target token shares; position of the first copy in training."""
    plan = mixing.curriculum_plan(table(spark, sf_dir, "documents"))
    first = F.when(F.col("copies") > 0, mixing.position(F.lit(0)))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies",
                       F.round(first, 6).alias("first_position"))


def op10_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a bigram model with deleted interpolation, trained on the folds other than 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, facts = lm.score_texts(docs, fold() != 1, fold() == 2)
    return out.select(F.col("key").cast("long").alias("doc_id"), (fold("key") == 1).alias("held_out"), "n_tokens", "n_known",
                      F.lit(facts["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op11_partitioned_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of 2 to 4 words of all documents, per language, by partitioned mining."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, by a bit-sliced position index."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in bit-plane files, and read back from them."""
    import public_tokenizers

    path = scratch_dir(spark, "token-ids")
    n = token_files.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    out = token_files.positions(spark, path, n, F.crc32("ids").alias("ids_crc32"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {f.__name__: f for f in (
    op1_warc_reassembly, op2_pruned_graph, op3_ngram_jaccard_join, op4_proportional_interleaving, op5_host_suffix_array,
    op6_string_kernel, op7_url_language_models, op8_positional_index, op9_curriculum_mixing, op10_deleted_interpolation,
    op11_partitioned_phrases, op12_position_index, op13_bit_planes)}


def queries() -> dict:
    return dict(QUERIES)

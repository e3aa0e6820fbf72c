"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm import chunk_bpe, fingerprints, hard_negatives, lexical, line_dedup, mixing, ngram_join, oracles, repair, sharding, toxicity, vector_join
from tactus.llm import licenses as license_ops
from tactus.llm import repetition as repetition_ops
from tactus.llm.registry import query
from tactus.llm.shared import table


@query("op4_repetition", oracles.REPETITION)
def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_ops.repetition(table(spark, sf_dir, "documents"))


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_ops.licenses(table(spark, sf_dir, "documents"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_ngram_join", oracles.NGRAM_JOIN)
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("op2_repair")
def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.stored(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), _partitions(spark))
    return found.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op9_vector_join", oracles.VECTOR_JOIN)
def op9_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.vector_join(table(spark, sf_dir, "embeddings"))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_lines(table(spark, sf_dir, "documents"))


@query("op6_chunk_bpe")
def op6_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_lexical_search", oracles.LEXICAL_SEARCH)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", oracles.HARD_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", relabelled), F.col("vec_id") % 50 == 0)

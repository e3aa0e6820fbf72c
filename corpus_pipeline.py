"""From raw documents to token ids: five stages, each over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tactus.llm import chunk_bpe, line_dedup, mixing, ngram_join, toxicity
from tactus.llm.shared import settle, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones not held out, does not reject."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one nearly; those left without a line go."""
    return line_dedup.without_copies(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that shares most of its word n-grams (5 words, 0.8)."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the tempered weight of its source asks for, at least once."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of token ids of each text, and digests of the ids and of what they decode to."""
    return chunk_bpe.digests(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_copies),
    ("mixing", mix_sources),
    ("chunk_bpe", encode_texts),
]

#: No SQL: a trained classifier, MinHash and a tokenizer are among the stages. Tests compare each stage
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs

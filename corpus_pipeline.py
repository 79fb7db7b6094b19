"""Corpus cleaning in five stages over the documents table, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import small_batches, table, written
from rillflow.llm.debruijn import remove_repeats
from rillflow.llm.decontaminate import without_leaks
from rillflow.llm.langid import with_language
from rillflow.llm.packing import pack
from rillflow.llm.simhash_grid import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages learned from the others, go."""
    small_batches(spark)
    return with_language(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles the one with the smallest id stays."""
    small_batches(spark)
    return keep_one(docs, shingle=5, least=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more stay where they come first and are cut out elsewhere."""
    small_batches(spark)
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go."""
    small_batches(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut into sequences of 2048 tokens."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats),
          ("benchmark", benchmark), ("packing", packing)]

# Fingerprints, tokenizers and learned probabilities are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
sql = ORACLE_SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

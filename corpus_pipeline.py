"""Documents from raw to token files: five stages, each written as Parquet and read again.

All stages but the last return rows of their input with its columns, whatever these are named besides doc_id, text,
lang and source. An empty table passes through all of them as an empty one. Null doc_ids and texts are values like any
other: a text is told by its doc_id and its hash, so that of a null or repeated doc_id each text is judged for itself."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language, mixing, simhash, tokens
from tidemark.llm.common import new_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Texts without letters (null, empty) go; repeated rows go or stay together; a table
    whose column lang names no known language has nothing to judge by and stays whole."""
    return language.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; of repeated rows one. Texts without
    words are one group; a null doc_id stays only where its group has no other."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay; an empty benchmark takes none."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows are repeated or left out. Null is a source like any other; a
    source without words gives no rows."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written as token ids; a row for each document of the files: ``doc_id, start, n_tokens, ids_crc32``. A
    null text is an empty one, of its end id alone."""
    return tokens.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("token-ID / binary output", token_output),
]

#: Cube sampling and byte-pair encoding have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

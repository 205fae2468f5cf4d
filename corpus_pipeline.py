"""A training corpus from raw documents, in five stages.

Every stage takes the documents that the one before kept, is written as Parquet and read
again, so a lost executor costs at most the stage that runs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegauge.llm import bpe, decontaminate, langid, partenum, secret_scan  # noqa: E402
from tidegauge.llm.base import materialize, prepared, table  # noqa: E402
from tidegauge.llm.bpe_query import PATTERN, RANKS  # noqa: E402


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: those without a letter, and those that fit no learnt language."""
    prepared(spark)
    return langid.in_a_language(docs, langid.learn(langid.labelled(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, the first of those of the least id, of each group of near-equal ones."""
    prepared(spark)
    return partenum.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    prepared(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; ``n_chars`` follows the text."""
    prepared(spark)
    masked = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, packed as little-endian unsigned 32-bit integers."""
    prepared(spark)
    own = docs.select("doc_id", "lang", "source", "text")
    coded = bpe.encode(own, bpe.read_ranks(RANKS), PATTERN)
    return coded.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("tokens", tokens),
]

# Neither trained language trees nor byte-pair merges can be written in SQL; tests compare
# the rows that every stage keeps with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

"""A corpus pipeline of five stages, each an operator of the llm subpackage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternrank.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from lanternrank.llm.shared import part_files
from lanternrank.sources.session import prepare


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters go. ``lang`` is the one
    that the text is in, as learned from the documents of this stage."""
    model = language_id.model_for(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.relabel(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur before, exactly or nearly, go; a document of which only
    blank space is left goes too."""
    left = line_dedup.dedup(docs)
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return left.select([(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns])


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their 5-word shingles, one stays."""
    return jaccard_join.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, nor one with few edits."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    words = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode_checked(docs, words)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", join_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("bpe", encode_tokens),
]

# Trained scores, SimHash and tokens are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result a table in the shared folder."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = part_files(stage(spark, docs, sf_dir), name)
    return docs

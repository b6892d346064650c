"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns rows of ``documents`` (the last one adds token ids and
the decoded bytes' digest). :func:`run` writes what a stage returns as a table in the shared folder and hands
the reread table to the next one, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from knowloom.llm import byte_bpe, decontaminate, near_copies, quality_cnn, unit_dedup
from knowloom.llm.shared import free_name, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles stays; found by SimHash ball search, then by minima."""
    return near_copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated units are cut out of the texts; ``n_chars`` follows; every document stays."""
    return unit_dedup.dedup(docs).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, encoded from the whole text and decoded again."""
    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    made = bpe.round_trip(docs)
    ids, digest = made.columns[-2:]
    return made.select(*docs.columns, ids, F.size(ids).cast("long").alias(free_name(docs, "n_tokens")), digest)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("token_ids", token_ids)]

#: Networks, fingerprints, alignments and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: quality rules, line dedup, near-dedup and packing, each stage over what the one before it kept.

Every stage is written as Parquet into the shared folder and read back as the next one's documents. All stages but the
last return the columns of ``documents``; the last returns the packed pieces.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arrearscope.llm import linededup, neardup, packing, quality
from arrearscope.llm.common import stored, table
from arrearscope.llm.queries import WORD_TOKENIZER

SEQUENCE = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit go from the others."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of every group of similar lines stays; documents without a line left keep the empty text."""
    return linededup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies stays."""
    return neardup.kept_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences."""
    return packing.pack(packing.token_pieces(docs, WORD_TOKENIZER, SEQUENCE), SEQUENCE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Components of similar lines and texts and the packing aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

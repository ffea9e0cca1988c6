"""Registered queries of the corpus operators: key -> (builder, DuckDB SQL or None)."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import fim, fingerprints, htmltext, interaction, licenses, linededup, neardup, packing, pieces, quality, sharding, tokenfiles, urlfilter
from ..session import shared_dir
from .common import table

#: Vocabulary files; override to run with others.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_pages(table(spark, sf_dir, "pages"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), WORD_TOKENIZER, 2048), 2048)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER, folder, end_id=1)
    return tokenfiles.read_digests(spark, folder)


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"), seed=42)


QUERIES = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_licenses": (op2_licenses, None),
    "op3_urls": (op3_urls, urlfilter.oracle_sql()),
    "op4_neardup": (op4_neardup, None),
    "op5_fingerprints": (op5_fingerprints, None),
    "op6_html": (op6_html, None),
    "op7_sharding": (op7_sharding, None),
    "op8_linededup": (op8_linededup, None),
    "op9_packing": (op9_packing, None),
    "op10_quality": (op10_quality, quality.oracle_sql()),
    "op11_tokenfiles": (op11_tokenfiles, None),
    "op12_audit": (op12_audit, interaction.oracle_sql()),
    "op13_fim": (op13_fim, fim.oracle_sql()),
}

"""Helpers shared by the corpus operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage with a table every executor can read, so a lost executor re-reads files instead of
    recomputing what lies beneath, and a table used by several branches is computed once.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_per_content(members: DataFrame, item: str, key: str = "key") -> DataFrame:
    """One key of every set of items: buckets that hold the same items hold the same pairs. Sets are told apart by 128 hash bits and size."""
    hashes = [F.bit_xor(F.xxhash64(item, F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)]
    same = members.groupBy(key).agg(F.count("*").alias("items"), *hashes)
    return same.groupBy("items", "x1", "x2").agg(F.min(key).alias(key)).select(key)


def per_worker(key: tuple, make):
    """``make()`` once per Python worker and key: tables that are costly to fill serve all tasks of a worker."""
    import sys
    import types
    kept = sys.modules.setdefault("arrearscope_worker", types.ModuleType("arrearscope_worker"))
    if key not in kept.__dict__.setdefault("made", {}):
        kept.made[key] = make()
    return kept.made[key]


def pieces_of(text: str, limit: int):
    """``text`` in slices of at most ``limit`` characters (for bounded working memory, not for cutting work)."""
    for i in range(0, len(text), limit):
        yield text[i:i + limit]


def no_text(column: str):
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def as_record(docs: DataFrame):
    """All columns of a table as one struct, so that helper columns beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def with_text(record, text, docs: DataFrame):
    """The record with another text, and its length in ``n_chars`` where the table has that column."""
    record = record.withField("text", text)
    if "n_chars" in docs.columns:
        record = record.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return record

"""Registry of named queries: key -> (spark builder, DuckDB oracle SQL or None)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query key {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # Importing the modules fills REGISTRY.
    from . import (message_queries, model_queries, ops_queries, report_queries, retrieval_queries,  # noqa: F401
                   rule_queries, scoring_queries, stream_queries)
    return REGISTRY

"""All queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extraction_queries, lexical_queries, nested_queries, profile_queries, retrieval_queries, stream_queries, vector_queries

MODULES = (lexical_queries, nested_queries, retrieval_queries, vector_queries, profile_queries, stream_queries, extraction_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_queries.hybrid_topk(spark, folder)

"""Queries of the nested-record operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import nested
from ..operators.scratch import Scratch
from ..sources.tables import table

LISTS = [f[0] for f in nested.FIELDS]


def _tables(spark: SparkSession, folder: str) -> nested.VariantTables:
    return nested.route(nested.typed_records(table(spark, folder, "inspection")), "record_id", LISTS, Scratch(spark))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-null list element with its own pointer and its parent's: the common keys of all variant tables."""
    return _tables(spark, folder).keys().select("record_id", "pointer", "parent_pointer")


def p4_variants(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder).variants()


def _kind(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _tables(spark, folder).table(name)

    query.__doc__ = f"The typed table of ``{name}``, all variants."
    return query


QUERIES = {f.__name__: f for f in (p4_found, p4_variants)} | {f"p4_{name}": _kind(name) for name in nested.KINDS}
SQL: dict[str, str] = {}

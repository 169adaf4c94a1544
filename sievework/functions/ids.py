"""Canonical spelling of record ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: ASCII, the separators of Unicode, and the control characters that Unicode counts as white space.
WHITE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"


def _bare(column: Column) -> Column:
    return F.regexp_replace(column, WHITE, "")


def case_key(column: str | Column) -> Column:
    """Lower case without white space; null for null and blank ids."""
    col = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(_bare(col)), F.lit(""))


def trial_key(column: str | Column) -> Column:
    """Upper case without white space; null for null and blank ids."""
    col = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.upper(_bare(col)), F.lit(""))

"""Conservative metadata filters: only an explicit contradiction removes a row, an unknown never does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-8
DAYS = {"day": 1.0, "week": 7.0, "month": 30.436875, "year": 365.2425}
MINUTES_A_DAY = 1440


def compatible(age: str = "age_days", sex: str = "sex", low: str = "min_days", high: str = "max_days", wanted: str = "wanted_sex",
               tolerance: float = 0.0, known_values_only: bool = False) -> Column:
    """True unless the age lies outside the bounds or the sexes differ.

    A blank sex, ``all`` and ``both`` rule out nothing. With
    ``known_values_only`` only male and female can differ, any other value
    rules out nothing either.
    """
    a, want = F.col(age), F.lower(F.trim(F.col(wanted)))
    below = F.coalesce(a + tolerance < F.col(low), F.lit(False))
    above = F.coalesce(a - tolerance > F.col(high), F.lit(False))
    binding = want.isin("male", "female") if known_values_only else ~want.isin("all", "both", "")
    differs = F.coalesce(binding & (want != F.lower(F.col(sex))), F.lit(False))
    return ~below & ~above & ~differs


def compatible_counts(topics: DataFrame, documents: DataFrame, topic: str, key: str, condition: Column, columns: list[str]) -> DataFrame:
    """``(topic, documents, first_doc)``: how many documents the condition leaves each topic, and the smallest id among them.

    Documents that agree in all ``columns`` of the condition are counted as one
    row first, so the condition joins topics with combinations of bounds and not
    with documents.
    """
    kinds = documents.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"))
    return topics.join(kinds, condition).groupBy(topic).agg(F.sum("n").alias("documents"), F.min("least").alias("first_doc"))


def derived_topics(items: DataFrame) -> DataFrame:
    """Topics with an age and a sex made from their ids: the data have none of their own."""
    i = F.col("item_id")
    return items.select("item_id", F.nullif((i % 90).cast("double"), F.lit(0.0)).alias("age_days"), F.when(i % 2 == 0, "Female").otherwise("Male").alias("sex"))


def derived_bounds(documents: DataFrame) -> DataFrame:
    """Bounds and wanted sex of documents made from their ids."""
    return documents.select("doc_id", *(c.alias(n) for n, c in bound_columns().items()))


def bound_columns() -> dict[str, Column]:
    d = F.col("doc_id")
    wanted = F.when(d % 4 == 0, "all").when(d % 4 == 1, " Male").when(d % 4 == 2, "FEMALE")
    return {
        "min_days": (F.nullif(d % 7, F.lit(0)) * 5).cast("double"), "max_days": (F.nullif(d % 5, F.lit(0)) * 20).cast("double"), "wanted_sex": wanted,
    }


SQL_TOPICS = """topics AS (SELECT item_id, nullif((item_id % 90)::DOUBLE, 0.0) AS age_days,
    CASE WHEN item_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex FROM eval_items)"""
SQL_BOUNDS = """bounds AS (SELECT doc_id, (nullif(doc_id % 7, 0) * 5)::DOUBLE AS min_days, (nullif(doc_id % 5, 0) * 20)::DOUBLE AS max_days,
    CASE doc_id % 4 WHEN 0 THEN 'all' WHEN 1 THEN ' Male' WHEN 2 THEN 'FEMALE' END AS wanted_sex FROM documents)"""
SQL_COMPATIBLE = """NOT coalesce(age_days < min_days, false) AND NOT coalesce(age_days > max_days, false)
    AND NOT coalesce(lower(trim(wanted_sex)) NOT IN ('all', 'both', '') AND lower(trim(wanted_sex)) != lower(sex), false)"""

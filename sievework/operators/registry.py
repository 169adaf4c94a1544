"""Incremental registry: classification of captures, regressions, windows and chains of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def classify(captures: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """Each capture as ``added``, ``changed`` or ``unchanged`` against the one before it of the same key.

    Nothing is deleted: a key absent from later captures keeps its last state.
    """
    hashed = captures.withColumn("__h", F.sha2(content, 256))
    before = F.lag("__h").over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return hashed.withColumn("state", F.when(first, "added").when(before == F.col("__h"), "unchanged").otherwise("changed")).drop("__h")


def merge(registry: DataFrame | None, batch: DataFrame, key: str, order: list[str], content: Column) -> tuple[DataFrame, DataFrame]:
    """``(new registry, states of the batch's keys)``: a keyed upsert by content hash, for micro-batches.

    The registry has one row per key with ``content_sha256``; of several
    captures in a batch the last one counts.
    """
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    new = batch.withColumn("content_sha256", F.sha2(content, 256)).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    if registry is None:
        return new, new.select(key, F.lit("added").alias("state"))
    old = registry.select(key, F.col("content_sha256").alias("__old"))
    state = F.when(F.col("__old").isNull(), "added").when(F.col("__old") == F.col("content_sha256"), "unchanged").otherwise("changed")
    states = new.join(old, key, "left").select(key, state.alias("state"))
    return registry.join(new.select(key), key, "left_anti").unionByName(new), states


def regressions(captures: DataFrame, key: str, order: list[str], date: str) -> DataFrame:
    """Captures whose date lies before the latest one captured earlier; only whole dates count."""
    whole = captures.where(F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    earlier = F.max(date).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return whole.withColumn("latest", earlier).where(F.col(date) < F.col("latest"))


def windows(days: DataFrame, day: str, overlap: int = 1) -> DataFrame:
    """Watermarks of daily windows: each ends at its day, the next starts ``overlap`` days before; ``chained`` if it joins the one before."""
    until = F.to_date(day)
    found = days.groupBy(until.alias("until")).agg(F.count(F.lit(1)).alias("records"), F.max(day).alias("latest"))
    # A window is joined where one of the days before that it reaches has records too: found by the day, not by an order of all.
    reached = found.select(F.explode(F.sequence(F.lit(1), F.lit(max(1, overlap)))).alias("d"), F.col("until").alias("__before"))
    reached = reached.select(F.date_add("__before", F.col("d")).alias("until"), F.lit(True).alias("met")).distinct()
    start = found.agg(F.min("until").alias("start"))
    return found.join(reached, "until", "left").crossJoin(F.broadcast(start)).select(
        "until", "records", F.date_sub("until", overlap).alias("next_start"), F.coalesce("met", F.col("until") == F.col("start")).alias("chained")
    )


def pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Pages of consecutive keys: rows, repeated keys, first and last key, and whether the page follows the one before."""
    found = rows.groupBy(F.floor(F.col(key) / size).alias("page")).agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("repeated"), F.min(key).alias("first"), F.max(key).alias("last"),
    )
    # The page before is found by its number, not by a window over all pages in one task.
    before = found.select((F.col("page") + 1).alias("page"), (F.col("last") + 1).alias("expected"))
    start = found.agg(F.min("page").alias("start"))
    joined = found.join(before, "page", "left").crossJoin(F.broadcast(start))
    return joined.withColumn("follows", F.coalesce(F.col("first") == F.col("expected"), F.col("page") == F.col("start"))).drop("expected", "start")

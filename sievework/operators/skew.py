"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 500_000
MOST_HOT_KEYS = 10_000
#: Rows of so many bytes in all may meet in one task whatever their keys, so nothing is counted first.
SMALL_BYTES = 32 << 20


def estimated_bytes(frame: DataFrame) -> int:
    """What the optimizer knows of the size of a frame: that of its files for a scan, a bound from above otherwise."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame | None, bool]:
    """Keys with at least ``hot_rows`` rows (or None), and whether null is one.

    The count combines map-side, so a hot key never meets in one task before
    it is reduced to one row per input partition. At most ``MOST_HOT_KEYS``
    keys come back, the largest, which bounds what is broadcast. Rows known to
    be small are not counted.
    """
    if hot_rows >= HOT_ROWS and estimated_bytes(rows) <= SMALL_BYTES:
        return None, False
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    found = counts.where(F.col("__n") >= hot_rows).orderBy(F.desc("__n")).limit(MOST_HOT_KEYS).collect()
    values = [(r[key],) for r in found if r[key] is not None]
    frame = rows.sparkSession.createDataFrame(values, rows.select(key).schema) if values else None
    return frame, any(r[key] is None for r in found)


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` (keys may repeat) with ``lookup`` (one row per key) on ``key``.

    Rows of hot keys meet their few lookup rows by broadcast and never
    shuffle, rows of a hot null key are set apart; all others use the
    ordinary join. ``how`` is inner or left. Null keys match nothing.
    """
    hot, null_is_hot = hot_keys(rows, key, hot_rows)
    if hot is None and not null_is_hot:
        return rows.join(lookup, key, how)
    parts = []
    tail = rows
    if null_is_hot:
        if how == "left":
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in lookup.schema if f.name != key]
            parts.append(rows.where(F.col(key).isNull()).select("*", *empty))
        tail = rows.where(F.col(key).isNotNull())
    if hot is not None:
        few = F.broadcast(hot)
        hot_lookup = lookup.join(few, key, "left_semi")
        parts.append(rows.join(few, key, "left_semi").join(F.broadcast(hot_lookup), key, how))
        tail = tail.join(few, key, "left_anti")
    out = tail.join(lookup, key, how)
    for part in parts:
        out = out.unionByName(part)
    return out


def salted_join(rows: DataFrame, others: DataFrame, key: str, spread_by: str, hot_rows: int = HOT_ROWS, salts: int = 64) -> DataFrame:
    """Inner join on ``key``, which may repeat on both sides, where ``rows`` may hold very many rows of a key.

    Rows of a hot key are spread over ``salts`` parts by the hash of their
    column ``spread_by``, and only for hot keys are the others copied to every
    part. All other keys meet in one.
    """
    hot, _ = hot_keys(rows.where(F.col(key).isNotNull()), key, hot_rows)
    if hot is None:
        return rows.join(others, key)
    few = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)
    left = rows.join(few, key, "left").withColumn("__part", part).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = others.join(few, key, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return left.join(right, [key, "__part"]).drop("__part")

"""Problem 1: consolidating pairwise matches into groups by hash-to-min.

Every vertex keeps a cluster set. In a round it sends its whole set to the
smallest member and that smallest member to all others; the sets it receives
make up its next set. When nothing changes any more, the smallest vertex of a
component holds all of it and every other vertex holds just that smallest one.

The sets are rows ``(v, u)``, never arrays, so no task holds a component.

Edge cases: a null or blank id names no record and its row links nothing; a
record compared with itself, repeated and reversed rows add nothing; undecided
rows (null ``is_match``) and rows of an unknown kind link nothing; empty tables
give an empty result. Only the columns named in the arguments are read, so
extra columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import case_key, trial_key
from ..operators.scratch import Scratch
from ..operators.skew import HOT_ROWS, MOST_HOT_KEYS

MOST_ROUNDS = 100


def _print_of(state: DataFrame) -> tuple:
    """A fingerprint of a set of rows: their number and two sums of hashes."""
    whole = "decimal(38,0)"
    return tuple(
        state.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("v", "u").cast(whole)),
            F.sum(F.xxhash64(F.lit(7), "u", "v").cast(whole)),
        ).first()
    )


def hash_to_min(edges: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Components of an undirected graph: ``(a, b)`` edges to ``(record_id, group_id)``.

    A vertex whose set has ``hot_rows`` rows or more gets its minimum by
    broadcast, so its rows aren't brought together; there are at most
    rows / ``hot_rows`` such vertices. Rows with a null end are ignored.
    """
    edges = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).where("v is not null and u is not null")
    back = edges.select(F.col("u").alias("v"), F.col("v").alias("u"))
    own = edges.select("v", F.col("v").alias("u")).union(edges.select(F.col("u").alias("v"), "u"))
    state = scratch.save(edges.union(back).union(own).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        now = _print_of(state)
        if now == before:
            break
        before = now
        least = scratch.save(state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")))
        limit = max(hot_rows, now[0] // MOST_HOT_KEYS)
        hot = least.where(F.col("n") >= limit)
        if hot.limit(1).count():
            few = F.broadcast(hot.select("v", "m"))
            cold = state.join(F.broadcast(hot.select("v")), "v", "left_anti").join(least.select("v", "m"), "v")
            sent = state.join(few, "v").unionByName(cold)
        else:
            sent = state.join(least.select("v", "m"), "v")
        message = F.explode(
            F.array(
                F.struct(F.col("m").alias("v"), F.col("u").alias("u")),
                F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
            )
        )
        following = scratch.save(sent.select(message.alias("x")).select("x.v", "x.u").distinct())
        scratch.drop(state, least)
        state = following
    else:
        raise RuntimeError(f"hash-to-min still changes after {MOST_ROUNDS} rounds")
    return state.groupBy("v").agg(F.min("u").alias("group_id")).withColumnRenamed("v", "record_id")


def match_edges(matches: DataFrame) -> DataFrame:
    """``(a, b, linked)``: the canonical ids of each comparison and whether it links them."""

    def key(column: str):
        return (
            F.when(F.lower(F.trim("kind")) == "case", case_key(column))
            .when(F.lower(F.trim("kind")) == "trial", trial_key(column))
        )

    return matches.select(
        key("left_id").alias("a"), key("right_id").alias("b"), F.coalesce("is_match", F.lit(False)).alias("linked")
    )


def link_edges(matches: DataFrame) -> DataFrame:
    """Distinct linked pairs, smaller id first, without self-links."""
    return (
        match_edges(matches)
        .where("linked and a is not null and b is not null and a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def record_groups(pairs: DataFrame, matches: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(record_id, group_id)`` for every case and trial named in either table."""
    named = match_edges(matches).select(F.explode(F.array("a", "b")).alias("record_id"))
    mined = pairs.select(F.explode(F.array(case_key("case_id"), trial_key("trial_id"))).alias("record_id"))
    records = mined.union(named).where("record_id is not null").distinct()
    groups = hash_to_min(link_edges(matches), scratch, hot_rows)
    return records.join(groups, "record_id", "left").select(
        "record_id", F.coalesce("group_id", "record_id").alias("group_id")
    )

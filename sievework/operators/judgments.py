"""Joins of rankings, judgments and records, and checks of their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import case_key, trial_key


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """One row per named case and trial: highest grade, best ranks and scores."""
    keyed = pairs.withColumn("c", case_key("case_id")).withColumn("t", trial_key("trial_id")).where("c is not null and t is not null")
    return keyed.groupBy(F.col("c").alias("case_id"), F.col("t").alias("trial_id")).agg(
        F.max("grade").alias("grade"), F.min("dense_rank").alias("dense_rank"), F.min("bm25_rank").alias("bm25_rank"),
        F.max("dense_score").alias("dense_score"), F.max("bm25_score").alias("bm25_score"),
    )


def judged_left_join(run: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """The run with its grades; what isn't judged has grade 0 and ``judged`` false."""
    known = judgments.where("grade is not null").select(*keys, "grade")
    return run.join(known, keys, "left").withColumn("judged", F.col("grade").isNotNull()).withColumn("grade", F.coalesce("grade", F.lit(0)))


def pool(run: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """Only what is judged."""
    return run.join(judgments.where("grade is not null").select(*keys), keys, "left_semi")


def uncovered(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Ids that are wanted and not held."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(held.select(key), key, "left_anti")


def set_equality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(only_left, only_right, equal)`` of two sets of ids, counted by one aggregation."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    n = per.agg(F.count_if(F.col("l") > F.col("r")).alias("only_left"), F.count_if(F.col("r") > F.col("l")).alias("only_right"))
    return n.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def trace(pairs: DataFrame, cases: DataFrame, trials: DataFrame) -> DataFrame:
    """Each pair with what is known of its ends: ``linked``, ``case_only``, ``trial_only`` or ``neither``."""
    c = cases.select("case_id").distinct().withColumn("c", F.lit(True))
    t = trials.select("trial_id").distinct().withColumn("t", F.lit(True))
    joined = pairs.join(c, "case_id", "left").join(t, "trial_id", "left")
    state = (
        F.when(F.col("c") & F.col("t"), "linked").when(F.col("c"), "case_only").when(F.col("t"), "trial_only").otherwise("neither")
    )
    return joined.withColumn("trace", state).drop("c", "t")


def validate(pairs: DataFrame) -> DataFrame:
    """``(issue, rows)``: every issue of a table of judgments at once, none silently repaired."""
    case_, trial_ = case_key("case_id"), trial_key("trial_id")
    issues = F.array_compact(
        F.array(
            F.when(case_.isNull(), "case_missing"), F.when(trial_.isNull(), "trial_missing"),
            F.when(~F.coalesce(trial_.rlike(r"^NCT\d{8}$"), F.lit(True)), "trial_malformed"), F.when(F.col("grade").isNull(), "grade_missing"),
            F.when(~F.coalesce(F.col("grade").between(0, 2), F.lit(True)), "grade_out_of_range"),
            F.when(F.col("case_id") != case_, "case_spelling"), F.when(F.col("trial_id") != trial_, "trial_spelling"),
        )
    )
    single = pairs.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))
    repeated = (
        pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .agg(F.lit("pair_repeated").alias("issue"), F.sum(F.col("n") - 1).alias("rows")).where("rows > 0")
    )
    return single.unionByName(repeated)

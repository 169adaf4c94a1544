"""Graded retrieval metrics, comparisons of runs, calibration and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .skew import lookup_join

METRICS = (
    "ndcg_at_5", "ndcg_at_10", "mrr", "precision_at_10", "recall_at_100", "success_at_5", "eligible_recall_at_100", "excluded_recall_at_100",
)
DEPTH = 100


def _gain(rank: str, cutoff: int) -> Column:
    return F.sum(F.when(F.col(rank) <= cutoff, F.col("grade") / F.log2(F.col(rank) + 1.0)))


def query_metrics(run: DataFrame, judgments: DataFrame, query: str, key: str) -> DataFrame:
    """The eight metrics of each judged query.

    ``run`` is ``(query, key, rank)`` of at most 100 ranks, ``judgments`` is
    ``(query, key, grade)``. The gain is linear in the grade; the ideal order
    takes all judgments of the query, retrieved or not; unjudged documents
    gain nothing; a denominator of zero gives zero. Null grades are no
    judgments.
    """
    judgments = judgments.where("grade is not null").select(query, key, "grade")
    hits = run.where(F.col("rank") <= DEPTH).join(judgments, [query, key], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    seen = hits.groupBy(query).agg(
        _gain("rank", 5).alias("dcg5"), _gain("rank", 10).alias("dcg10"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.count_if((F.col("grade") > 0) & (F.col("rank") <= 10)).alias("top10"), F.count_if(F.col("grade") > 0).alias("top100"),
        F.count_if((F.col("grade") > 0) & (F.col("rank") <= 5)).alias("top5"),
        F.count_if(F.col("grade") == 2).alias("eligible"), F.count_if(F.col("grade") == 1).alias("excluded"),
    )
    best = Window.partitionBy(query).orderBy(F.desc("grade"), key)
    ideal = (
        judgments.withColumn("place", F.row_number().over(best)).where("place <= 10")
        .groupBy(query).agg(_gain("place", 5).alias("ideal5"), _gain("place", 10).alias("ideal10"))
    )
    totals = judgments.groupBy(query).agg(
        F.count_if(F.col("grade") > 0).alias("relevant"), F.count_if(F.col("grade") == 2).alias("all_eligible"),
        F.count_if(F.col("grade") == 1).alias("all_excluded"),
    )

    def share(part: str, whole: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(part), F.nullif(F.col(whole), F.lit(0))), F.lit(0.0)), 6)

    return totals.join(ideal, query).join(seen, query, "left").select(
        query,
        share("dcg5", "ideal5").alias("ndcg_at_5"), share("dcg10", "ideal10").alias("ndcg_at_10"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        (F.coalesce("top10", F.lit(0)) / 10.0).alias("precision_at_10"), share("top100", "relevant").alias("recall_at_100"),
        F.when(F.col("top5") > 0, 1.0).otherwise(0.0).alias("success_at_5"),
        share("eligible", "all_eligible").alias("eligible_recall_at_100"), share("excluded", "all_excluded").alias("excluded_recall_at_100"),
    )


def macro_mean(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    grouped = per_query.groupBy(*by) if by else per_query.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("topics"), *(F.round(F.avg(m), 5).alias(m) for m in METRICS))


def deltas(base: DataFrame, candidate: DataFrame, query: str, metric: str = "ndcg_at_10") -> DataFrame:
    """``(query, delta)`` of two runs; queries of only one of them are left out."""
    a, b = base.select(query, F.col(metric).alias("a")), candidate.select(query, F.col(metric).alias("b"))
    return a.join(b, query).select(query, F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def win_loss_tie(delta: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    d = F.col("delta")
    return delta.agg(
        F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties"),
        F.round(F.avg(d), 5).alias("mean_delta"),
    )


def extremes(frame: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The ``n`` highest and the ``n`` lowest rows, ties by id, with ``end`` and ``place``."""
    parts = []
    for end, order in (("highest", F.desc(value)), ("lowest", F.asc(value))):
        some = frame.orderBy(order, key).limit(n)
        w = Window.orderBy(order, key)
        parts.append(some.select(F.lit(end).alias("end"), key, value, F.row_number().over(w).alias("place")))
    return parts[0].unionByName(parts[1])


BOOTSTRAP_PART, DRAWS = 100_000, 2_000_000


def paired_bootstrap(delta: DataFrame, query: str, seed: int = 0, repeats: int = 10_000, part: int = BOOTSTRAP_PART) -> DataFrame:
    """Percentile interval of the mean difference over resampled queries.

    Queries are cut into parts of about ``part`` by hash. Of each resample a
    multinomial draw says how many come from which part (every task makes the
    same draws), and a part draws its own, in the order of ids. So the resamples
    are those of all queries at any number of them, and no task holds more than
    a part. An empty table gives no row.
    """
    import numpy as np
    import pandas as pd

    parts = max(1, -(-delta.count() // part))
    keyed = delta.select(query, "delta", F.pmod(F.xxhash64(query), F.lit(parts)).cast("int").alias("part"))
    # One row per part, that is, per ``part`` queries.
    held = {r["part"]: r["n"] for r in keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([held.get(p, 0) for p in range(parts)])
    total = int(sizes.sum())

    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values(query)["delta"].to_numpy()
        own = int(rows["part"].iloc[0])
        shares = np.random.default_rng([seed, 0])
        rng = np.random.default_rng([seed, 1, own])
        sums = np.empty(repeats)
        for i in range(0, repeats, 100):
            drawn = shares.multinomial(total, sizes / total, size=min(100, repeats - i))[:, own]
            for k, m in enumerate(drawn):
                sums[i + k] = sum(float(d[rng.integers(0, len(d), min(DRAWS, m - at))].sum()) for at in range(0, m, DRAWS))
        return pd.DataFrame({"draw": np.arange(repeats), "s": sums})

    means = keyed.groupBy("part").applyInPandas(resample, "draw int, s double").groupBy("draw").agg((F.sum("s") / F.lit(float(max(1, total)))).alias("m"))
    bounds = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    whole = delta.agg(F.count(F.lit(1)).alias("topics"), F.avg("delta").alias("mean_delta")).where("topics > 0")
    return whole.crossJoin(bounds).select("topics", "mean_delta", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def wilson_lower(correct: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of a share; null for no trials."""
    n, p = F.nullif(total.cast("double"), F.lit(0.0)), correct / F.nullif(total.cast("double"), F.lit(0.0))
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Probabilities of an array of logits."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def reliability(frame: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Count, accuracy and mean confidence by bin; the last bin is closed above."""
    index = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return frame.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(confidence), 6).alias("confidence"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")
    return bins.agg(F.sum("n").alias("n"), F.round(gap, 5).alias("ece"))


#: Ranks on either side of a wanted one that the sketch may be wrong by, as a share of all.
SKETCH_ERROR = 2e-4


def quantiles(frame: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """``(by, n, least, p)``: exact quantiles of each group, interpolated between the two values around the rank.

    A mergeable sketch brackets each quantile; then the rows below the bracket
    are counted, and only the values inside it, at most a few in ten thousand of
    the group's rows, are ordered. Null values don't count; a group without
    values has null quantiles.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    rows = frame.select(F.col(by).alias("__by"), group.alias("__k"), F.col(value).cast("double").alias("__v"))
    sides = [min(1.0, max(0.0, s + e)) for s in shares for e in (-SKETCH_ERROR, SKETCH_ERROR)]
    known = rows.groupBy("__k", "__by").agg(
        F.count("__v").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.percentile_approx("__v", sides, int(2 / SKETCH_ERROR)).alias("b")
    )
    # In a small group a bracket would be narrower than the two values to interpolate between: there it takes all.
    few = F.col("n") <= int(2 / SKETCH_ERROR)
    low, high = (lambda i: F.when(few, F.col("least")).otherwise(F.col("b")[2 * i])), (lambda i: F.when(few, F.col("most")).otherwise(F.col("b")[2 * i + 1]))
    brackets = F.array(*(
        F.struct(F.lit(i).alias("i"), low(i).alias("low"), high(i).alias("high"), (F.lit(s) * (F.col("n") - 1)).alias("rank"))
        for i, s in enumerate(shares)
    ))
    met = lookup_join(rows.where("__v is not null").select("__k", "__v"), known.select("__k", brackets.alias("x")), "__k")
    each = met.select("__k", "__v", F.explode("x").alias("x")).where(F.col("__v") <= F.col("x.high"))
    # What lies below a bracket becomes one row; equal values inside it become one row.
    at = F.when(F.col("__v") >= F.col("x.low"), F.col("__v"))
    counted = each.groupBy("__k", F.col("x.i").alias("i"), F.col("x.rank").alias("rank"), at.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ordered = Window.partitionBy("__k", "i").orderBy(F.asc_nulls_first("v"))
    placed = counted.withColumn("last", F.sum("c").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    at_rank = lambda r: F.max(F.when(r.between(F.col("first"), F.col("last")), F.col("v")))
    found = placed.groupBy("__k", "i", "rank").agg(at_rank(F.floor("rank")).alias("a"), at_rank(F.ceil("rank")).alias("z"))
    between = F.col("a") + (F.col("z") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    picked = found.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("q")))), lambda s: s["q"]).alias("p"))
    return known.join(picked, "__k", "left").select(F.col("__by").alias(by), "n", "least", "p")


def latency_summary(frame: DataFrame, by: str, value: str) -> DataFrame:
    """Count, least, exact median and 95th percentile (interpolated)."""
    return quantiles(frame, by, value, [0.5, 0.95]).select(
        by, "n", "least", F.round(F.col("p")[0], 6).alias("median"), F.round(F.col("p")[1], 6).alias("p95")
    )


def confusion(expected: DataFrame, actual: DataFrame, key: list[str], label: str) -> DataFrame:
    """``(expected, actual, n)``; rows of one side only count as missing or unexpected."""
    e, a = expected.select(*key, F.col(label).alias("e")), actual.select(*key, F.col(label).alias("a"))
    both = e.join(a, key, "full")
    return both.groupBy(F.coalesce("e", F.lit("(unexpected)")).alias("expected"), F.coalesce("a", F.lit("(missing)")).alias("actual")).agg(
        F.count(F.lit(1)).alias("n")
    )


def multiset_prf(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """True and false positives and negatives as multisets, with precision, recall and F1."""
    e = expected.groupBy(*columns).agg(F.count(F.lit(1)).alias("e"))
    a = actual.groupBy(*columns).agg(F.count(F.lit(1)).alias("a"))
    e, a = (x.withColumn("__k", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) for x in (e, a))
    both = e.select("__k", "e").join(a.select("__k", "a"), "__k", "full").select(F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))
    s = both.agg(F.sum(F.least("e", "a")).alias("tp"), F.sum("e").alias("e"), F.sum("a").alias("a"))
    return s.select(
        "tp", (F.col("a") - F.col("tp")).alias("fp"), (F.col("e") - F.col("tp")).alias("fn"),
        F.round(F.try_divide("tp", "a"), 6).alias("precision"), F.round(F.try_divide("tp", "e"), 6).alias("recall"),
        F.round(F.try_divide(2 * F.col("tp"), F.col("a") + F.col("e")), 6).alias("f1"),
    )

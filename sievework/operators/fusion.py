"""Rank assignment, reciprocal-rank fusion, pooling of passages and prefix reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF = 60


def ranked(scored: DataFrame, query: str, key: str, order: Column, depth: int) -> DataFrame:
    """The first ``depth`` of each query in the order, ties by id, with ``rank`` from 1."""
    w = Window.partitionBy(query).orderBy(order, F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def rrf(branches: DataFrame, query: str, key: str, k: int, constant: int = RRF) -> DataFrame:
    """Fuse ``(query, key, branch, rank)`` to ``(query, key, score, branches, rank)``.

    One aggregation over the union of the branches instead of outer joins;
    scores of unlike kind are never added, only ranks count.
    """
    if not 1 <= constant <= 1000:
        raise ValueError("the constant must be 1..1000")
    fused = branches.groupBy(query, key).agg(
        F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("branches")
    )
    return ranked(fused.withColumn("__s", F.round("score", 9)), query, key, F.desc("__s"), k).drop("__s")


def max_pool(segments: DataFrame, by: list[str], position: str, score: str = "score") -> DataFrame:
    """The best segment of each group; the first one wins a tie."""
    best = F.max_by(F.struct(position, score), F.struct(F.round(score, 9), -F.col(position))).alias("best")
    return segments.groupBy(*by).agg(best).select(*by, F.col(f"best.{position}").alias(position), F.col(f"best.{score}").alias(score))


def prefix_rerank(ranking: DataFrame, query: str, key: str, new_score: str, depth: int) -> DataFrame:
    """New order for the first ``depth`` by ``new_score``; the tail keeps its places, nothing is dropped."""
    head = F.col("rank") <= depth
    w = Window.partitionBy(query).orderBy(
        F.when(head, 0).otherwise(1), F.when(head, -F.col(new_score)), F.when(head, F.col(key)), F.col("rank")
    )
    return ranking.withColumn("original_rank", F.col("rank")).withColumn("rank", F.row_number().over(w))

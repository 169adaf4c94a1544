"""Strong three-valued logic over nullable booleans; an unknown is never silently true or false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LEVELS = 12


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def unless(a: Column, b: Column) -> Column:
    """``a`` holds and its exception ``b`` doesn't."""
    return a & ~b


def every(c: Column) -> Column:
    """Conjunction of a group: the built-in aggregate would leave the unknowns out."""
    return F.when(F.count_if(~c) > 0, F.lit(False)).when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.lit(True))


def some(c: Column) -> Column:
    return F.when(F.count_if(c) > 0, F.lit(True)).when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.lit(False))


def evaluate(nodes: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """``(tree, node, truth)`` of all nodes of flat trees ``(tree, node, parent, operator, truth, level)``.

    ``operator`` is null for leaves, else and, or, not. Levels are evaluated
    from the deepest up, one grouping each; trees are never gathered.
    """
    if not 1 <= levels <= MOST_LEVELS:
        raise ValueError(f"1..{MOST_LEVELS} levels")
    done = nodes.where("operator is null").select("tree", "node", "parent", "truth", "level")
    for level in range(levels - 1, -1, -1):
        inner = nodes.where((F.col("operator").isNotNull()) & (F.col("level") == level)).select("tree", "node", "parent", "operator", "level")
        t = F.col("truth")
        child = done.where(F.col("level") == level + 1).groupBy("tree", F.col("parent").alias("node")).agg(
            every(t).alias("all_"), some(t).alias("any_"), F.first("truth").alias("one")
        )
        value = F.when(F.col("operator") == "and", F.col("all_")).when(F.col("operator") == "or", F.col("any_")).otherwise(~F.col("one"))
        done = done.unionByName(inner.join(child, ["tree", "node"]).select("tree", "node", "parent", value.alias("truth"), "level"))
    return done.select("tree", "node", "truth")

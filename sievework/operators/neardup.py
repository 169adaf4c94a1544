"""Near-duplicate texts by word shingles, exactly, by a prefix filter.

Equal texts are one class; links are sought between classes only. A pair of
similarity ``t`` shares one of the ``n - ceil(t n) + 1`` rarest shingles of
either side, so classes meet only on those, if their sizes allow the
similarity, and are then compared in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_words, shingles
from .graph import min_label
from .scratch import Scratch
from .skew import lookup_join

WORDS, SIMILARITY = 5, 0.8


def classes(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, class_id)``: documents with equal words share the smallest id; texts without a word have none."""
    worded = documents.select(key, F.sha2(F.nullif(normal_words(text), F.lit("")), 256).alias("digest")).where("digest is not null")
    first = worded.groupBy("digest").agg(F.min(key).alias("class_id"))
    return lookup_join(worded.select(key, "digest"), first, "digest").select(key, "class_id")


def class_links(documents: DataFrame, key: str, scratch: Scratch, text: str = "text", similarity: float = SIMILARITY, n: int = WORDS, known: DataFrame | None = None) -> DataFrame:
    """``(a, b, similarity)`` of classes, ``a < b``; ``known`` are the classes where they are at hand."""
    named = (classes(documents, key, text) if known is None else known).where(F.col(key) == F.col("class_id")).select(key)
    sets = documents.join(named, key, "left_semi").select(F.col(key).alias("id"), F.transform(shingles(text, n), lambda s: F.xxhash64(s)).alias("set"))
    sets = scratch.save(sets.withColumn("set", F.array_sort(F.array_distinct("set"))).withColumn("n", F.size("set")).where("n > 0"))
    single = sets.select("id", "n", F.explode("set").alias("h"))
    df = single.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rarest = lookup_join(single, df.where("df > 1"), "h").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("by_df"))
    # Shingles of one class only come first in the order and can't match: they use up places of the prefix.
    kept = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9).cast("int") + 1 - (F.col("n") - F.size("by_df"))
    prefix = scratch.save(rarest.where(kept > 0).select("id", "n", F.explode(F.slice("by_df", F.lit(1), kept)).alias("x")).select("id", "n", "x.h"))
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("m"), "h")
    pairs = prefix.join(other, "h").where((F.col("id") < F.col("b")) & (F.col("m") >= F.col("n") * similarity - 1e-9) & (F.col("n") >= F.col("m") * similarity - 1e-9))
    pairs = pairs.select(F.col("id").alias("a"), "b").distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    j = F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared"))
    return both.select("a", "b", j.alias("similarity")).where(F.col("similarity") >= similarity)


def components(documents: DataFrame, key: str, scratch: Scratch, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(key, class_id, group_id, links)``: one row per document with words.

    ``group_id`` is the smallest id among all documents linked directly or
    indirectly, ``links`` the number of other classes its class is linked to.
    """
    known = scratch.save(classes(documents, key, text))
    links = scratch.save(class_links(documents, key, scratch, text, similarity, known=known))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    labels = min_label(links, scratch).select(F.col("node").alias("class_id"), "label")
    found = known.join(labels, "class_id", "left").join(degree, "class_id", "left")
    return found.select(key, "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def component_stats(grouped: DataFrame) -> DataFrame:
    per = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("groups_of_several"), F.max("n").alias("largest"))

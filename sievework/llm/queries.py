"""Queries of the training-data operators, by name, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from ..sources.tables import table
from . import chunks, components, encode, leak, neighbors, overlap, splits, subjects


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every case and trial."""
    return components.record_groups(table(spark, folder, "hard_negatives"), table(spark, folder, "record_matches"), Scratch(spark))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Bundle of every pair that names a case or shares one."""
    pairs, matches = table(spark, folder, "hard_negatives"), table(spark, folder, "record_matches")
    scratch = Scratch(spark)
    _, split = splits.assign_splits(pairs, matches, scratch, store=splits.component_store(spark, f"{scratch.root}/components"))
    return splits.bundles(split).select("pair_id", "bundle_id")


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Split of every pair after two batches: what was delivered up to 2031-08-31, then the rest."""
    scratch = Scratch(spark)
    pairs, matches = table(spark, folder, "hard_negatives"), table(spark, folder, "record_matches")
    early = "delivered_at < timestamp'2031-09-01' or delivered_at is null"
    store = splits.component_store(spark, f"{scratch.root}/components")
    splits.assign_splits(pairs.where(early), None, scratch, store=store)
    grown, _ = splits.assign_splits(pairs.where(f"not ({early})"), matches, scratch, earlier=pairs.where(early), store=store)
    return splits.split_pairs(splits.pair_ends(pairs), grown).select("pair_id", "component", "split")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of narratives across train and evaluation that are the same or nearly so."""
    found = overlap.overlaps(table(spark, folder, "independent"), Scratch(spark))
    return found.select(F.least("train_key", "eval_key").alias("topic_a"), F.greatest("train_key", "eval_key").alias("topic_b")).distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping pairs, evaluation narratives and covered characters per split and source."""
    narratives = table(spark, folder, "independent")
    found = overlap.overlaps(narratives, Scratch(spark))
    sources = narratives.select(F.col("topic_id").alias("eval_key"), "source").distinct()
    return found.join(sources, "eval_key").groupBy("eval_split", "source").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_key").alias("narratives"), F.sum("covered").alias("covered_chars")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of every usable vector."""
    return neighbors.neighbors(table(spark, folder, "encoded_batch"), Scratch(spark)).select("vec_id", "neighbor_id")


PASSAGE_TEXTS, PASSAGE_ARRAYS = ["brief_summary", "detailed_description"], ["interventions"]


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every oversized item."""
    return chunks.split_items(table(spark, folder, "field_passages"), "passage_id", PASSAGE_TEXTS, PASSAGE_ARRAYS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that had to be cut."""
    return p6_pieces(spark, folder).where("piece_no = 1").select("passage_id", "field_name", "item_no")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_corpus(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    found = leak.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of every document."""
    documents = table(spark, folder, "documents")
    return subjects.assign_subjects(documents, table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas")).distinct()


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per subject."""
    return p9_found(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p2_found, p2_splits, p3_found, p3_report, p5_found, p6_found, p6_pieces, p7_ids, p8_found, p9_found, p9_composition)
    }


def oracle_sql() -> dict[str, str]:
    return {}

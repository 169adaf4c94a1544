"""BM25 over DataFrames: postings, statistics, document vectors, scores and top-k.

The postings are independent of queries; a query meets only the postings of
its own terms. Scores are sums of ``idf * tf / (tf + k1 (1 - b + b len / avg))``
and rank by the score to nine decimals, ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from .scratch import Scratch

K1, B = 1.2, 0.75


def postings(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, term, tf, length)``; documents without a term have none."""
    listed = documents.select(F.col(key), tokens(text).alias("t")).select(key, F.size("t").alias("length"), F.explode("t").alias("term"))
    return listed.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf")).select(key, "term", "tf", "length")


def corpus_stats(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(documents, terms, average_length)`` over documents with a text."""
    sized = documents.where(F.col(text).isNotNull()).select(F.size(tokens(text)).alias("n"))
    return sized.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms"), F.avg("n").alias("average_length"))


def idf(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """``(term, df, idf)``."""
    n = F.col("documents")
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats.select("documents"))).select(
        "term", "df", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )


def document_vectors(posted: DataFrame, stats: DataFrame, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``(key, term, weight)`` and the columns named: the saturated term frequency."""
    return posted.crossJoin(F.broadcast(stats.select("average_length"))).select(
        key, *more, "term", (F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average_length")))).alias("weight")
    )


def query_terms(queries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, term, count)``."""
    return queries.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("count"))


def scores(
    queries: DataFrame, documents: DataFrame, query_key: str, key: str, scratch: Scratch, condition: Column | None = None,
    query_columns: tuple[str, ...] = (), document_columns: tuple[str, ...] = (),
) -> DataFrame:
    """``(query_key, key, score)`` of every pair that shares a term, and of these only such as the ``condition`` allows.

    The corpus is tokenised once. Postings are made for the terms of the queries
    alone, before anything is shuffled; term frequencies, document frequencies
    and weights all come from these. The condition may use the columns named of
    either side: they travel with the postings, so a pair that it rules out is
    neither scored nor shuffled. Statistics are those of all documents.
    """
    listed = scratch.save(documents.where(F.col("text").isNotNull()).select(key, *document_columns, tokens("text").alias("t")).withColumn("length", F.size("t")))
    stats = listed.agg(F.count(F.lit(1)).alias("documents"), F.sum("length").alias("terms"), F.avg("length").alias("average_length"))
    asked = scratch.save(query_terms(queries, query_key))
    wanted = asked.select("term").distinct()
    spelled = listed.select(key, *document_columns, "length", F.explode("t").alias("term")).join(wanted, "term", "left_semi")
    posted = scratch.save(spelled.groupBy(key, *document_columns, "length", "term").agg(F.count(F.lit(1)).alias("tf")))
    rare = idf(posted, stats)
    weighed = document_vectors(posted, stats, key, document_columns)
    terms = asked.join(rare, "term").select(query_key, "term", (F.col("idf") * F.col("count")).alias("w"))
    if query_columns:
        terms = terms.join(queries.select(query_key, *query_columns), query_key)
    pairs = terms.join(weighed, "term")
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.groupBy(query_key, key).agg(F.sum(F.col("w") * F.col("weight")).alias("score"))


def top_k(scored: DataFrame, query_key: str, key: str, k: int, score: str = "score", positive: bool = False) -> DataFrame:
    """The best ``k`` of each query with their rank; ties at nine decimals go to the smaller id.

    The window is limited on both sides of the shuffle, so a query's hits
    never meet in full.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must be 1..1000")
    rounded = scored.withColumn("__s", F.round(score, 9))
    if positive:
        rounded = rounded.where("__s > 0")
    order = Window.partitionBy(query_key).orderBy(F.desc("__s"), key)
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("__s")


def query_audit(queries: DataFrame, documents: DataFrame, query_key: str, key: str) -> DataFrame:
    """``(query_key, tokens, known_terms, unknown_terms, empty_query)``."""
    vocabulary = postings(documents, key).select("term").distinct().withColumn("known", F.lit(True))
    asked = query_terms(queries, query_key).join(vocabulary, "term", "left")
    found = asked.groupBy(query_key).agg(
        F.sum("count").alias("tokens"),
        F.count_if("known").alias("known_terms"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("term")))), " ").alias("unknown_terms"),
    )
    return queries.select(query_key).join(found, query_key, "left").select(
        query_key, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("known_terms", F.lit(0)).alias("known_terms"),
        F.coalesce("unknown_terms", F.lit("")).alias("unknown_terms"), (F.coalesce("known_terms", F.lit(0)) == 0).alias("empty_query"),
    )


def run_lines(ranked: DataFrame, query_key: str, key: str, name: str) -> DataFrame:
    """Lines ``topic Q0 document rank score name`` of a run file."""
    line = F.concat_ws(
        " ", F.col(query_key).cast("string"), F.lit("Q0"), F.col(key).cast("string"), F.col("rank").cast("string"),
        F.format_string("%.6f", F.round("score", 6)), F.lit(name),
    )
    return ranked.select(F.col(query_key), "rank", line.alias("line"))


def read_run(lines: DataFrame, depth: int = 1000) -> DataFrame:
    """``(topic_id, document_id, rank, score, name)`` of run-file lines in a column ``value``."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.select(
        p[0].alias("topic_id"), p[2].alias("document_id"), p[3].try_cast("int").alias("rank"), p[4].try_cast("double").alias("score"), p[5].alias("name")
    ).where(F.col("rank") <= depth)

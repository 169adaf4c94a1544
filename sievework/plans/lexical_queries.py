"""Queries over texts: BM25, tokens, hashes, samples and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import filters, lexical
from ..operators.scratch import Scratch
from ..sources.tables import table
from . import sql

RUN = "bm25"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def tokenize(spark, folder):
    return _docs(spark, folder).select("doc_id", F.explode(T.tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def normalize_words(spark, folder):
    return _docs(spark, folder).where("text is not null").select("doc_id", T.normal_words("text").alias("words"))


def bm25_stats(spark, folder):
    return lexical.corpus_stats(_docs(spark, folder)).select("documents", "terms", F.round("average_length", 6).alias("average_length"))


def bm25_idf(spark, folder):
    d = _docs(spark, folder)
    return lexical.idf(lexical.postings(d, "doc_id"), lexical.corpus_stats(d)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_doc_vectors(spark, folder):
    d = _docs(spark, folder)
    found = lexical.document_vectors(lexical.postings(d, "doc_id"), lexical.corpus_stats(d), "doc_id")
    return found.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _scores(spark, folder):
    return lexical.scores(table(spark, folder, "eval_items"), _docs(spark, folder), "item_id", "doc_id", Scratch(spark))


def bm25_scores(spark, folder):
    """Top ten documents of every evaluation item."""
    return lexical.top_k(_scores(spark, folder), "item_id", "doc_id", 10).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def bm25_filtered_topk(spark, folder):
    """Top ten among the documents that age and sex don't rule out."""
    items = table(spark, folder, "eval_items")
    topics = items.join(filters.derived_topics(items), "item_id")
    bounds = filters.bound_columns()
    allowed = lexical.scores(
        topics, _docs(spark, folder).withColumns(bounds), "item_id", "doc_id", Scratch(spark), filters.compatible(), ("age_days", "sex"), tuple(bounds)
    )
    return lexical.top_k(allowed, "item_id", "doc_id", 10).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _allowed(spark, folder, **more):
    """Documents that a woman of forty days isn't ruled out of."""
    bounds = filters.derived_bounds(_docs(spark, folder)).withColumns({"age_days": F.lit(40.0), "sex": F.lit("Female")})
    return bounds.where(filters.compatible(**more)).select("doc_id")


def compat_filter(spark, folder):
    return _allowed(spark, folder)


def compat_filter_tolerant(spark, folder):
    return _allowed(spark, folder, tolerance=filters.TOLERANCE, known_values_only=True)


def compat_theta_join(spark, folder):
    """Documents that each topic isn't ruled out of, counted: the topics are a stated set, the condition is the join's own."""
    topics, bounds = filters.derived_topics(table(spark, folder, "eval_items")), filters.derived_bounds(_docs(spark, folder))
    return filters.compatible_counts(topics, bounds, "item_id", "doc_id", filters.compatible(), ["min_days", "max_days", "wanted_sex"])


def query_audit(spark, folder):
    return lexical.query_audit(table(spark, folder, "eval_items"), _docs(spark, folder), "item_id", "doc_id")


def run_file_lines(spark, folder):
    return lexical.run_lines(lexical.top_k(_scores(spark, folder), "item_id", "doc_id", 10), "item_id", "doc_id", RUN)


def content_hash(spark, folder):
    return _docs(spark, folder).select("doc_id", F.sha2("text", 256).alias("content_sha256"))


def hash_split(spark, folder):
    return _docs(spark, folder).select("doc_id", T.hash_split(F.concat(F.lit("split:"), F.col("doc_id").cast("string"))).alias("split"))


def _sample_key():
    return F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)


def hash_sample(spark, folder):
    """The hundred documents with the lowest hashes."""
    return _docs(spark, folder).select("doc_id", _sample_key().alias("h")).orderBy("h", "doc_id").limit(100)


def stratified_hash_sample(spark, folder):
    """Five documents with the lowest hashes per language."""
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    d = _docs(spark, folder).select(F.coalesce(F.lower("lang"), F.lit("-")).alias("lang"), "doc_id", _sample_key().alias("h"))
    return d.withColumn("place", F.row_number().over(w)).where("place <= 5").select("lang", "doc_id", "place")


def shingles(spark, folder):
    return _docs(spark, folder).where("text is not null").select("doc_id", F.size(T.shingles("text")).alias("shingles"))


def char_grams(spark, folder):
    return _docs(spark, folder).where("text is not null").select("doc_id", F.size(T.char_grams("text")).alias("grams"))


def passage_windows(spark, folder):
    d = _docs(spark, folder).select("doc_id", F.size(T.words("text")).alias("n")).where("n > 0")
    w = d.select("doc_id", "n", F.posexplode(T.window_starts(F.col("n"), 192, 32)).alias("window", "start_at"))
    return w.select("doc_id", "window", "start_at", F.least(F.col("start_at") + 192, F.col("n")).alias("end_at"))


def token_prefix(spark, folder):
    """What a model of 192 words sees of each document."""
    d = _docs(spark, folder).where("text is not null").select("doc_id", T.words("text").alias("w"))
    return d.select("doc_id", F.least(F.size("w"), F.lit(192)).alias("kept"), F.sha2(F.array_join(F.slice("w", 1, 192), " "), 256).alias("prefix_sha256"))


def truncation_audit(spark, folder):
    d = _docs(spark, folder).where("text is not null").select(F.coalesce(F.lower("lang"), F.lit("-")).alias("lang"), F.size(T.words("text")).alias("n"))
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") > 192).alias("truncated"),
        F.sum(F.greatest(F.col("n") - 192, F.lit(0))).alias("words_lost"), F.max("n").alias("longest"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, normalize_words, bm25_stats, bm25_idf, bm25_doc_vectors, bm25_scores, bm25_filtered_topk, query_audit, run_file_lines,
        compat_filter, compat_filter_tolerant, compat_theta_join,
        content_hash, hash_split, hash_sample, stratified_hash_sample, shingles, char_grams, passage_windows, token_prefix, truncation_audit,
    )
}

_TOP = "SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM "
SQL = {
    "tokenize": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY ALL",
    "normalize_words": f"SELECT doc_id, array_to_string({sql.words('text')}, ' ') AS words FROM documents WHERE text IS NOT NULL",
    "bm25_stats": f"WITH {sql.POSTINGS} SELECT documents, terms::BIGINT AS terms, round(average_length, 6) AS average_length FROM stats",
    "bm25_idf": f"WITH {sql.POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_doc_vectors": f"WITH {sql.POSTINGS} SELECT doc_id, term, round(weight, 6) AS weight FROM vectors",
    "bm25_scores": f"WITH {sql.POSTINGS} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM ({_TOP} scored) WHERE rank <= 10",
    "bm25_filtered_topk": f"""WITH {sql.POSTINGS}, {filters.SQL_TOPICS}, {filters.SQL_BOUNDS}
        SELECT item_id, doc_id, rank, round(score, 6) AS score
        FROM ({_TOP} (SELECT s.* FROM scored s JOIN topics USING (item_id) JOIN bounds USING (doc_id) WHERE {filters.SQL_COMPATIBLE})) WHERE rank <= 10""",
    "compat_filter": f"""WITH {filters.SQL_BOUNDS} SELECT doc_id FROM (SELECT *, 40.0::DOUBLE AS age_days, 'Female' AS sex FROM bounds) WHERE {filters.SQL_COMPATIBLE}""",
    "compat_filter_tolerant": f"""WITH {filters.SQL_BOUNDS} SELECT doc_id FROM bounds WHERE NOT coalesce(40.0 + 1e-8 < min_days, false)
        AND NOT coalesce(40.0 - 1e-8 > max_days, false) AND coalesce(lower(trim(wanted_sex)), '') != 'male'""",
    "compat_theta_join": f"""WITH {filters.SQL_TOPICS}, {filters.SQL_BOUNDS}
        SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc FROM topics JOIN bounds ON {filters.SQL_COMPATIBLE} GROUP BY 1""",
    "query_audit": f"""WITH {sql.POSTINGS} SELECT item_id, coalesce(tokens, 0) AS tokens, coalesce(known_terms, 0) AS known_terms,
        coalesce(unknown_terms, '') AS unknown_terms, coalesce(known_terms, 0) = 0 AS empty_query
        FROM eval_items LEFT JOIN (SELECT item_id, sum(n)::BIGINT AS tokens, count(df) AS known_terms,
        string_agg(CASE WHEN df IS NULL THEN term END, ' ' ORDER BY term) AS unknown_terms
        FROM asked LEFT JOIN idf USING (term) GROUP BY item_id) USING (item_id)""",
    "run_file_lines": f"""WITH {sql.POSTINGS} SELECT item_id, rank,
        concat_ws(' ', item_id, 'Q0', doc_id, rank, printf('%.6f', round(score, 6)), '{RUN}') AS line FROM ({_TOP} scored) WHERE rank <= 10""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_sha256 FROM documents",
    "hash_split": """SELECT doc_id, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'dev' ELSE 'test' END AS split
        FROM (SELECT doc_id, cast('0x' || substr(sha256('split:' || doc_id), 1, 8) AS BIGINT) % 100 AS b FROM documents)""",
    "hash_sample": "SELECT doc_id, sha256('7:' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 100",
    "stratified_hash_sample": """SELECT lang, doc_id, place FROM (SELECT coalesce(lower(lang), '-') AS lang, doc_id,
        row_number() OVER (PARTITION BY coalesce(lower(lang), '-') ORDER BY sha256('7:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 5""",
    "shingles": f"""SELECT doc_id, CASE WHEN len(w) < 5 THEN 0 ELSE
        len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS shingles
        FROM (SELECT doc_id, {sql.words('text')} AS w FROM documents WHERE text IS NOT NULL)""",
    "char_grams": f"""SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(1, length(t) - 4) + 1), lambda i: substr(t, i, 5)))) AS grams
        FROM (SELECT doc_id, array_to_string({sql.words('text')}, ' ') AS t FROM documents WHERE text IS NOT NULL)""",
    "passage_windows": f"""SELECT doc_id, i AS "window", i * 160 AS start_at, least(i * 160 + 192, n) AS end_at
        FROM (SELECT doc_id, n, unnest(range(0, greatest(cast(ceil((n - 192) / 160.0) AS BIGINT), 0) + 1)) AS i
              FROM (SELECT doc_id, len({sql.words('text')}) AS n FROM documents) WHERE n > 0)""",
    "token_prefix": f"""SELECT doc_id, least(len(w), 192) AS kept, sha256(array_to_string(w[1:192], ' ')) AS prefix_sha256
        FROM (SELECT doc_id, {sql.words('text')} AS w FROM documents WHERE text IS NOT NULL)""",
    "truncation_audit": f"""SELECT coalesce(lower(lang), '-') AS lang, count(*) AS documents, count(*) FILTER (n > 192) AS truncated,
        sum(greatest(n - 192, 0))::BIGINT AS words_lost, max(n) AS longest
        FROM (SELECT lang, len({sql.words('text')}) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
}

"""Queries over vectors and near-duplicate texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import filters, fusion, lexical, neardup, overlap, vector
from ..operators.scratch import Scratch
from ..sources.tables import table
from . import sql

WEIGHTS = [((i * 37) % 11 - 5) / 10 for i in range(64)]


def _rows(spark, folder):
    return table(spark, folder, "embeddings")


def _queries(spark, folder):
    """The stated query set: every row whose id is divisible by fifty."""
    return _rows(spark, folder).where("vec_id % 50 = 0")


def vector_validate(spark, folder):
    v = table(spark, folder, "encoded_batch")
    return v.groupBy(vector.vector_state(F.col("vectors"), 128).alias("state")).agg(F.count(F.lit(1)).alias("vectors"))


def linear_head_score(spark, folder):
    return _rows(spark, folder).select("vec_id", F.round(vector.linear_head(F.col("embedding"), WEIGHTS), 6).alias("score"))


def dense_scores(spark, folder):
    """Cosine of each vector with the mean of its label."""
    rows = _rows(spark, folder)
    centre = vector.centroids(rows, "label", "embedding")
    c = F.col("centroid")
    score = vector.clipped(vector.dot(F.col("embedding"), c) / F.sqrt(vector.dot(c, c)))
    return rows.join(F.broadcast(centre), "label").select("vec_id", F.round(score, 5).alias("score"))


def dense_topk(spark, folder):
    found = vector.exact_top_k(_queries(spark, folder), _rows(spark, folder), "vec_id", "embedding", 10)
    return found.select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def topk_tie_stable(spark, folder):
    """The twenty best of each label by a coarse score, with all that tie with the last."""
    coarse = F.round(vector.linear_head(F.col("embedding"), WEIGHTS), 1)
    w = Window.partitionBy("label").orderBy(F.desc("coarse"))
    return _rows(spark, folder).select("label", "vec_id", coarse.alias("coarse")).withColumn("rank", F.rank().over(w)).where("rank <= 20")


def ann_recall(spark, folder):
    """Recall of the search in the three nearest cells, per query."""
    rows, q = _rows(spark, folder), _queries(spark, folder)
    exact = vector.exact_top_k(q, rows, "vec_id", "embedding", 10)
    near = vector.probed_top_k(q, rows, "vec_id", "embedding", "label", 10, 3)
    return vector.recall(exact, near, "query_id", "vec_id")


def _filtered(spark, folder):
    """Exact and approximate answers among the rows of even labels."""
    rows, q, allowed = _rows(spark, folder), _queries(spark, folder), F.col("label") % 2 == 0
    exact = vector.exact_top_k(q, rows.where(allowed), "vec_id", "embedding", 10)
    centres, probes = vector.fit_cells(rows, "vec_id", "embedding", 10)
    return exact, vector.cell_top_k(q, rows, "vec_id", "embedding", centres, 10, probes, allowed)


def ann_search(spark, folder):
    """Approximate neighbours under a filter; the cells are fitted to a sample, so there is no SQL."""
    return _filtered(spark, folder)[1].select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def ann_index_recall(spark, folder):
    """Recall of ``ann_search`` per query."""
    return vector.recall(*_filtered(spark, folder), "query_id", "vec_id")


def hybrid_search(spark, folder):
    """Documents for every evaluation item by fusion of a dense and a sparse search, both among the documents that one filter allows.

    An item's vector is the embedding numbered a thousand below it, a document's that of its own number.
    """
    items, docs = table(spark, folder, "eval_items"), table(spark, folder, "documents")
    bounds = filters.derived_bounds(docs).withColumns({"age_days": F.lit(40.0), "sex": F.lit("Female")})
    allowed = Scratch(spark).save(bounds.where(filters.compatible()).select("doc_id"))
    mine = docs.withColumns(filters.bound_columns() | {"age_days": F.lit(40.0), "sex": F.lit("Female")})
    sparse = lexical.scores(items, mine, "item_id", "doc_id", Scratch(spark), filters.compatible(), (), ("min_days", "max_days", "wanted_sex", "age_days", "sex"))
    vectors = _rows(spark, folder).select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.withColumn("doc_id", F.col("doc_id") + 1000).join(items.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    dense = vector.exact_top_k(asked, vectors.join(allowed, "doc_id", "left_semi"), "doc_id", "embedding", 100, exclude_self=False)
    branches = [
        lexical.top_k(sparse, "item_id", "doc_id", 100).select("item_id", "doc_id", "rank", F.lit("sparse").alias("branch")),
        dense.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.lit("dense").alias("branch")),
    ]
    fused = fusion.rrf(branches[0].unionByName(branches[1]), "item_id", "doc_id", 10)
    return fused.select("item_id", "doc_id", "rank", "branches", F.round("score", 6).alias("score"))


def _segments(spark, folder):
    """A hundred best segments of each query; segment ``3 d + f`` is field ``f`` of document ``d``."""
    found = vector.exact_top_k(_queries(spark, folder), _rows(spark, folder), "vec_id", "embedding", 100)
    return found.select("query_id", F.floor(F.col("vec_id") / 6).alias("doc"), (F.col("vec_id") % 3).alias("field"), "vec_id", "score")


def passage_max_pool(spark, folder):
    pooled = fusion.max_pool(_segments(spark, folder), ["query_id", "doc", "field"], "vec_id")
    return pooled.select("query_id", "doc", "field", "vec_id", F.round("score", 5).alias("score"))


def passage_rrf(spark, folder):
    """Documents by fusion of their fields, each field ranked by its best segment."""
    pooled = fusion.max_pool(_segments(spark, folder), ["query_id", "doc", "field"], "vec_id")
    w = Window.partitionBy("query_id", "field").orderBy(F.desc(F.round("score", 9)), "doc")
    branches = pooled.withColumn("rank", F.row_number().over(w)).where("rank <= 100").select("query_id", "doc", "field", "rank")
    return fusion.rrf(branches, "query_id", "doc", 10).select("query_id", "doc", "rank", F.round("score", 6).alias("score"))


def near_dup_pairs(spark, folder):
    """Linked classes of equal documents; membership is in ``dup_components``."""
    links = neardup.class_links(table(spark, folder, "documents"), "doc_id", Scratch(spark))
    return links.select("a", "b", F.round("similarity", 6).alias("similarity"))


def dup_components(spark, folder):
    return neardup.components(table(spark, folder, "documents"), "doc_id", Scratch(spark))


def component_stats(spark, folder):
    return neardup.component_stats(dup_components(spark, folder))


def overlap_audit(spark, folder):
    """The document most like each evaluation item."""
    found = overlap.most_similar(table(spark, folder, "eval_items"), table(spark, folder, "documents"), "item_id", "doc_id")
    return found.select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"))


def overlap_gate(spark, folder):
    """Whether no document reaches a similarity of 0.8 with any item."""
    found = overlap_audit(spark, folder)
    return found.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("similarity") >= 0.8).alias("over_limit"), F.bool_and(F.col("similarity") < 0.8).alias("passes")
    )


QUERIES = {
    f.__name__: f
    for f in (
        vector_validate, linear_head_score, dense_scores, dense_topk, topk_tie_stable, ann_recall, ann_search, ann_index_recall, hybrid_search, passage_max_pool, passage_rrf, near_dup_pairs,
        dup_components, component_stats, overlap_audit, overlap_gate,
    )
}

_W = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"
_E = "embedding::DOUBLE[]"
_COS = "round(greatest(-1, least(1, list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(d.e, d.e)))), 9)"
_EXACT = f"""v AS (SELECT vec_id, label, {_E} AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id, d.label, {_COS} AS score FROM v q JOIN v d ON q.vec_id != d.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"""
_CENTRE = f"""centre AS (SELECT label, list(x ORDER BY p) AS c FROM (
  SELECT label, p, avg(x) AS x FROM (SELECT label, unnest({_E}) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
_POOL = """segments AS (SELECT query_id, vec_id // 6 AS doc, vec_id % 3 AS field, vec_id, score FROM ranked WHERE rank <= 100),
pooled AS (SELECT query_id, doc, field, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc, field ORDER BY score DESC, vec_id) AS n
           FROM segments) WHERE n = 1)"""
_LINKS = f"""worded AS (SELECT doc_id, {sql.words('text')} AS w FROM documents WHERE len({sql.words('text')}) > 0),
member AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM worded),
s AS (SELECT doc_id AS id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS g
      FROM worded SEMI JOIN member ON worded.doc_id = member.class_id WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM (SELECT p.id AS a, r.id AS b, count(*)::DOUBLE AS c FROM s p JOIN s r ON p.g = r.g AND p.id < r.id GROUP BY 1, 2)
          JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.8)"""
_GROUPS = f"""{_LINKS}, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
label AS (SELECT a AS class_id, least(a, min(b)) AS label FROM reach GROUP BY a),
degree AS (SELECT a AS class_id, count(*) AS links FROM both_ways GROUP BY a),
grouped AS (SELECT doc_id, class_id, coalesce(label, class_id) AS group_id, coalesce(links, 0) AS links
            FROM member LEFT JOIN label USING (class_id) LEFT JOIN degree USING (class_id))"""
_GRAMS = "list_distinct(list_transform(range(1, greatest(1, length(t) - 4) + 1), lambda i: substr(t, i, 5)))"
_AUDIT = f"""d AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, array_to_string({sql.words('text')}, ' ') AS t FROM documents) WHERE t != ''),
i AS (SELECT item_id, unnest({_GRAMS}) AS g FROM (SELECT item_id, array_to_string({sql.words('text')}, ' ') AS t FROM eval_items) WHERE t != ''),
nd AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), ni AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
j AS (SELECT item_id, doc_id, c / (nd.n + ni.n - c) AS s FROM (SELECT item_id, doc_id, count(*)::DOUBLE AS c FROM i JOIN d USING (g) GROUP BY 1, 2)
      JOIN nd USING (doc_id) JOIN ni USING (item_id)),
audit AS (SELECT item_id, doc_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS n FROM j) WHERE n = 1)"""
SQL = {
    "vector_validate": """SELECT CASE WHEN v IS NULL OR len(v) = 0 THEN 'missing' WHEN len(v) != 128 THEN 'wrong_size'
        WHEN len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not_finite' WHEN list_dot_product(v, v) = 0 THEN 'zero'
        WHEN abs(sqrt(list_dot_product(v, v)) - 1) > 1e-5 THEN 'not_unit' ELSE 'ok' END AS state, count(*) AS vectors
        FROM (SELECT vectors::DOUBLE[] AS v FROM encoded_batch) GROUP BY 1""",
    "linear_head_score": f"SELECT vec_id, round(list_dot_product({_E}, {_W}), 6) AS score FROM embeddings",
    "dense_scores": f"""WITH {_CENTRE} SELECT vec_id, round(greatest(-1, least(1, list_dot_product({_E}, c) / sqrt(list_dot_product(c, c)))), 5) AS score
        FROM embeddings JOIN centre USING (label)""",
    "dense_topk": f"WITH {_EXACT} SELECT query_id, vec_id, rank, round(score, 5) AS score FROM ranked WHERE rank <= 10",
    "topk_tie_stable": f"""SELECT label, vec_id, coarse, rank FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY coarse DESC) AS rank
        FROM (SELECT label, vec_id, round(list_dot_product({_E}, {_W}), 1) AS coarse FROM embeddings)) WHERE rank <= 20""",
    "ann_recall": f"""WITH {_EXACT}, {_CENTRE}, cells AS (SELECT query_id, label FROM (SELECT q.vec_id AS query_id, centre.label,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, c) / sqrt(list_dot_product(c, c)), 9) DESC, centre.label) AS n
        FROM v q, centre WHERE q.vec_id % 50 = 0) WHERE n <= 3),
        near AS (SELECT query_id, vec_id FROM (SELECT p.query_id, p.vec_id, row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, vec_id) AS n
        FROM pairs p JOIN cells c ON p.query_id = c.query_id AND p.label = c.label) WHERE n <= 10)
        SELECT r.query_id, round(count(n.vec_id) / count(*), 6) AS recall FROM ranked r LEFT JOIN near n ON r.query_id = n.query_id AND r.vec_id = n.vec_id
        WHERE rank <= 10 GROUP BY 1""",
    "hybrid_search": f"""WITH {sql.POSTINGS}, {filters.SQL_BOUNDS},
        allowed AS (SELECT doc_id FROM (SELECT *, 40.0::DOUBLE AS age_days, 'Female' AS sex FROM bounds) WHERE {filters.SQL_COMPATIBLE}),
        v AS (SELECT vec_id, {_E} AS e FROM embeddings),
        sparse AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored SEMI JOIN allowed USING (doc_id)),
        dense AS (SELECT q.vec_id + 1000 AS item_id, d.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, d.vec_id) AS rank
                  FROM v q SEMI JOIN eval_items i ON q.vec_id + 1000 = i.item_id JOIN v d ON true SEMI JOIN allowed a ON d.vec_id = a.doc_id),
        fused AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s, count(*) AS branches
                  FROM (FROM sparse UNION ALL FROM dense) WHERE rank <= 100 GROUP BY 1, 2)
        SELECT item_id, doc_id, rank, branches, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM fused)
        WHERE rank <= 10""",
    "passage_max_pool": f"WITH {_EXACT}, {_POOL} SELECT query_id, doc, field, vec_id, round(score, 5) AS score FROM pooled",
    "passage_rrf": f"""WITH {_EXACT}, {_POOL}, branch AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, doc) AS rank FROM pooled)
        SELECT query_id, doc, rank, score FROM (SELECT query_id, doc, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc) AS rank
        FROM (SELECT query_id, doc, sum(1.0::DOUBLE / (60 + rank)) AS s FROM branch WHERE rank <= 100 GROUP BY 1, 2)) WHERE rank <= 10""",
    "near_dup_pairs": f"WITH {_LINKS} SELECT a, b, round(similarity, 6) AS similarity FROM links",
    "dup_components": f"WITH RECURSIVE {_GROUPS} SELECT * FROM grouped",
    "component_stats": f"""WITH RECURSIVE {_GROUPS} SELECT count(*) AS groups, count(*) FILTER (n > 1) AS groups_of_several, max(n) AS largest
        FROM (SELECT group_id, count(*) AS n FROM grouped GROUP BY 1)""",
    "overlap_audit": f"WITH {_AUDIT} SELECT * FROM audit",
    "overlap_gate": f"WITH {_AUDIT} SELECT count(*) AS items, count(*) FILTER (similarity >= 0.8) AS over_limit, bool_and(similarity < 0.8) AS passes FROM audit",
}

"""Queries over rankings and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import case_key, trial_key
from ..operators import evaluation as E
from ..operators import fusion, judgments
from ..sources.tables import table
from . import sql

KEYS = ["case_id", "trial_id"]


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return judgments.canonical_pairs(table(spark, folder, "hard_negatives"))


def _run(pairs: DataFrame, branch: str, depth: int = 100) -> DataFrame:
    """The ranking of a branch: its own ranks made gapless, ties by id."""
    some = pairs.where(F.col(branch).isNotNull()).select(*KEYS, branch)
    return fusion.ranked(some, "case_id", "trial_id", F.asc(branch), depth).select(*KEYS, "rank")


def _branches(pairs: DataFrame, depth: int = 100) -> DataFrame:
    parts = [_run(pairs, b, depth).withColumn("branch", F.lit(b)) for b in ("dense_rank", "bm25_rank")]
    return parts[0].unionByName(parts[1])


def rrf_fusion(spark, folder):
    fused = fusion.rrf(_branches(judged(spark, folder)), "case_id", "trial_id", 100)
    return fused.select(*KEYS, "rank", "branches", F.round("score", 6).alias("score"))


def _hybrid(pairs: DataFrame) -> DataFrame:
    return fusion.rrf(_branches(pairs), "case_id", "trial_id", 100).select(*KEYS, "rank")


def hybrid_topk(spark, folder):
    """Ten trials of every case by fusion of both branches, with the ranks they had."""
    pairs = judged(spark, folder)
    fused = fusion.rrf(_branches(pairs), "case_id", "trial_id", 10)
    dense, lexical = (_run(pairs, b).withColumnRenamed("rank", n) for b, n in (("dense_rank", "dense_place"), ("bm25_rank", "bm25_place")))
    return fused.join(dense, KEYS, "left").join(lexical, KEYS, "left").select(*KEYS, "rank", "dense_place", "bm25_place", F.round("score", 6).alias("score"))


def rank_compare(spark, folder):
    """Both top tens of every case side by side."""
    pairs = judged(spark, folder)
    a, b = _run(pairs, "dense_rank", 10).withColumnRenamed("rank", "dense_place"), _run(pairs, "bm25_rank", 10).withColumnRenamed("rank", "bm25_place")
    return a.join(b, KEYS, "full").select(*KEYS, "dense_place", "bm25_place")


def prefix_rerank(spark, folder):
    """The dense ranking with its first twenty in the order of the lexical score."""
    pairs = judged(spark, folder)
    run = _run(pairs, "dense_rank").join(pairs.select(*KEYS, F.coalesce("bm25_score", F.lit(0.0)).alias("s")), KEYS)
    return fusion.prefix_rerank(run, "case_id", "trial_id", "s", 20).select(*KEYS, "original_rank", "rank")


def judged_left_join(spark, folder):
    pairs = judged(spark, folder)
    return judgments.judged_left_join(_run(pairs, "dense_rank"), pairs, KEYS)


def pool_semi_join(spark, folder):
    pairs = judged(spark, folder)
    return judgments.pool(_run(pairs, "dense_rank"), pairs, KEYS)


def _matched_trials(spark, folder):
    m = table(spark, folder, "record_matches").where("lower(trim(kind)) = 'trial'")
    return m.select(F.explode(F.array(trial_key("left_id"), trial_key("right_id"))).alias("trial_id"))


def coverage_anti_join(spark, folder):
    """Compared trials that no pair holds."""
    return judgments.uncovered(_matched_trials(spark, folder), judged(spark, folder), "trial_id")


def missing_ids(spark, folder):
    """Trials of pairs that no captured study describes."""
    return judgments.uncovered(judged(spark, folder), table(spark, folder, "inspection").select(trial_key("trial_id").alias("trial_id")), "trial_id")


def set_equality(spark, folder):
    held = table(spark, folder, "inspection").select(trial_key("trial_id").alias("trial_id"))
    return judgments.set_equality(_matched_trials(spark, folder), held, "trial_id")


def trace_join(spark, folder):
    pairs = judged(spark, folder).select(*KEYS)
    m = table(spark, folder, "record_matches").where("lower(trim(kind)) = 'case'")
    cases = m.select(F.explode(F.array(case_key("left_id"), case_key("right_id"))).alias("case_id"))
    return judgments.trace(pairs, cases, _matched_trials(spark, folder)).groupBy("trace").agg(F.count(F.lit(1)).alias("pairs"))


def qrels_validate(spark, folder):
    return judgments.validate(table(spark, folder, "hard_negatives"))


def query_metrics(spark, folder):
    pairs = judged(spark, folder)
    return E.query_metrics(_run(pairs, "dense_rank"), pairs, "case_id", "trial_id")


def _runs(pairs):
    return {"dense": _run(pairs, "dense_rank"), "bm25": _run(pairs, "bm25_rank"), "hybrid": _hybrid(pairs)}


def evaluate_run(spark, folder):
    """Metrics of every case under three rankings."""
    pairs = judged(spark, folder)
    parts = [E.query_metrics(r, pairs, "case_id", "trial_id").withColumn("run", F.lit(n)) for n, r in _runs(pairs).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def metrics_macro(spark, folder):
    return E.macro_mean(evaluate_run(spark, folder), ["run"])


def best_run(spark, folder):
    """The ranking with the highest mean, later in the alphabet on a tie."""
    m = metrics_macro(spark, folder)
    return m.agg(F.max_by("run", F.struct("ndcg_at_10", "run")).alias("run"), F.max("ndcg_at_10").alias("ndcg_at_10"))


def judged_at_10(spark, folder):
    pairs = judged(spark, folder)
    run = judgments.judged_left_join(_run(pairs, "dense_rank", 10), pairs, KEYS)
    return run.groupBy("case_id").agg((F.count_if("judged") / 10.0).alias("judged_at_10"))


def _delta(spark, folder):
    pairs = judged(spark, folder)
    a, b = (E.query_metrics(_run(pairs, x), pairs, "case_id", "trial_id") for x in ("bm25_rank", "dense_rank"))
    return E.deltas(a, b, "case_id")


def win_loss_tie(spark, folder):
    return E.win_loss_tie(_delta(spark, folder))


def largest_deltas(spark, folder):
    return E.extremes(_delta(spark, folder), "delta", "case_id", 5)


def extreme_topics(spark, folder):
    pairs = judged(spark, folder)
    return E.extremes(E.query_metrics(_run(pairs, "dense_rank"), pairs, "case_id", "trial_id"), "ndcg_at_10", "case_id", 5)


def paired_bootstrap(spark, folder):
    return E.paired_bootstrap(_delta(spark, folder), "case_id")


def hard_negatives(spark, folder):
    """Two hard negatives per case: grade 0, in the first fifty of a branch, by fusion of those ranks."""
    pairs = judged(spark, folder).where("grade = 0")
    near = lambda c: F.when(F.col(c) <= 50, F.lit(1.0) / (60 + F.col(c))).otherwise(0.0)
    scored = pairs.withColumn("rrf", near("dense_rank") + near("bm25_rank")).where("rrf > 0")
    return fusion.ranked(scored.withColumn("__s", F.round("rrf", 9)), "case_id", "trial_id", F.desc("__s"), 2).select(
        *KEYS, "rank", F.round("rrf", 6).alias("rrf")
    )


def latency_summary(spark, folder):
    return E.latency_summary(table(spark, folder, "events"), "event_type", "value")


QUERIES = {
    f.__name__: f
    for f in (
        rrf_fusion, hybrid_topk, rank_compare, prefix_rerank, judged_left_join, pool_semi_join, coverage_anti_join, missing_ids, set_equality,
        trace_join, qrels_validate, query_metrics, evaluate_run, metrics_macro, best_run, judged_at_10, win_loss_tie, largest_deltas, extreme_topics,
        paired_bootstrap, hard_negatives, latency_summary,
    )
}

_RUNS = sql.JUDGED + """,
dense AS (SELECT * FROM (SELECT case_id, trial_id, row_number() OVER (PARTITION BY case_id ORDER BY dense_rank, trial_id) AS rank
          FROM judged WHERE dense_rank IS NOT NULL) WHERE rank <= 100),
bm25 AS (SELECT * FROM (SELECT case_id, trial_id, row_number() OVER (PARTITION BY case_id ORDER BY bm25_rank, trial_id) AS rank
         FROM judged WHERE bm25_rank IS NOT NULL) WHERE rank <= 100),
fused AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, trial_id) AS rank FROM (
          SELECT case_id, trial_id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS branches
          FROM (SELECT * FROM dense UNION ALL SELECT * FROM bm25) GROUP BY 1, 2)),
hybrid AS (SELECT case_id, trial_id, rank FROM fused WHERE rank <= 100)"""
_MATCHED = f"""matched AS (SELECT DISTINCT {sql.trial_key('x')} AS trial_id FROM (
  SELECT left_id AS x FROM record_matches WHERE lower(trim(kind)) = 'trial' UNION ALL SELECT right_id FROM record_matches WHERE lower(trim(kind)) = 'trial'))"""


def _metrics_sql(run: str) -> str:
    return f"""(SELECT case_id,
  round(coalesce(dcg5 / nullif(ideal5, 0), 0), 6) AS ndcg_at_5, round(coalesce(dcg10 / nullif(ideal10, 0), 0), 6) AS ndcg_at_10,
  round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, coalesce(top10, 0) / 10.0::DOUBLE AS precision_at_10,
  round(coalesce(top100 / nullif(relevant, 0), 0), 6) AS recall_at_100, CASE WHEN top5 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS success_at_5,
  round(coalesce(eligible / nullif(all_eligible, 0), 0), 6) AS eligible_recall_at_100,
  round(coalesce(excluded / nullif(all_excluded, 0), 0), 6) AS excluded_recall_at_100
 FROM (SELECT case_id, count(*) FILTER (grade > 0) AS relevant, count(*) FILTER (grade = 2) AS all_eligible, count(*) FILTER (grade = 1) AS all_excluded
       FROM judged WHERE grade IS NOT NULL GROUP BY 1)
 JOIN (SELECT case_id, sum(grade / log2(place + 1.0)) FILTER (place <= 5) AS ideal5, sum(grade / log2(place + 1.0)) AS ideal10
       FROM (SELECT case_id, grade, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, trial_id) AS place FROM judged WHERE grade IS NOT NULL)
       WHERE place <= 10 GROUP BY 1) USING (case_id)
 LEFT JOIN (SELECT case_id, sum(g / log2(rank + 1.0)) FILTER (rank <= 5) AS dcg5, sum(g / log2(rank + 1.0)) FILTER (rank <= 10) AS dcg10,
       min(rank) FILTER (g > 0) AS first, count(*) FILTER (g > 0 AND rank <= 10) AS top10, count(*) FILTER (g > 0) AS top100,
       count(*) FILTER (g > 0 AND rank <= 5) AS top5, count(*) FILTER (g = 2) AS eligible, count(*) FILTER (g = 1) AS excluded
       FROM (SELECT r.*, coalesce(j.grade, 0) AS g FROM {run} r LEFT JOIN judged j USING (case_id, trial_id)) GROUP BY 1) USING (case_id))"""


_NAMES = ", ".join(f"round(avg({m}), 5) AS {m}" for m in E.METRICS)
_ALL = " UNION ALL ".join(f"SELECT *, '{n}' AS run FROM {_metrics_sql(n)}" for n in ("dense", "bm25", "hybrid"))
_DELTA = f"SELECT case_id, round(b.ndcg_at_10 - a.ndcg_at_10, 6) AS delta FROM {_metrics_sql('bm25')} a JOIN {_metrics_sql('dense')} b USING (case_id)"


def _extremes_sql(source: str, value: str) -> str:
    parts = [
        f"""SELECT '{end}' AS "end", case_id, {value}, place
            FROM (SELECT *, row_number() OVER (ORDER BY {value} {way}, case_id) AS place FROM s) WHERE place <= 5"""
        for end, way in (("highest", "DESC"), ("lowest", "ASC"))
    ]
    return f"WITH {_RUNS}, s AS ({source}) " + " UNION ALL ".join(parts)


_VALID = f"""SELECT {sql.case_key('case_id')} AS c, {sql.trial_key('trial_id')} AS t, * FROM hard_negatives"""
SQL = {
    "rrf_fusion": f"WITH {_RUNS} SELECT case_id, trial_id, rank, branches, round(score, 6) AS score FROM fused WHERE rank <= 100",
    "hybrid_topk": f"""WITH {_RUNS} SELECT f.case_id, f.trial_id, f.rank, d.rank AS dense_place, b.rank AS bm25_place, round(score, 6) AS score
        FROM fused f LEFT JOIN dense d USING (case_id, trial_id) LEFT JOIN bm25 b USING (case_id, trial_id) WHERE f.rank <= 10""",
    "rank_compare": f"""WITH {_RUNS} SELECT case_id, trial_id, d.rank AS dense_place, b.rank AS bm25_place
        FROM (SELECT * FROM dense WHERE rank <= 10) d FULL JOIN (SELECT * FROM bm25 WHERE rank <= 10) b USING (case_id, trial_id)""",
    "prefix_rerank": f"""WITH {_RUNS} SELECT case_id, trial_id, rank AS original_rank, row_number() OVER (PARTITION BY case_id ORDER BY
        CASE WHEN rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rank <= 20 THEN -coalesce(bm25_score, 0) END, CASE WHEN rank <= 20 THEN trial_id END, rank) AS rank
        FROM (SELECT r.*, j.bm25_score FROM dense r JOIN judged j USING (case_id, trial_id))""",
    "judged_left_join": f"""WITH {_RUNS} SELECT case_id, trial_id, rank, grade IS NOT NULL AS judged, coalesce(grade, 0) AS grade
        FROM (SELECT r.*, j.grade FROM dense r JOIN judged j USING (case_id, trial_id))""",
    "pool_semi_join": f"WITH {_RUNS} SELECT r.* FROM dense r JOIN judged j USING (case_id, trial_id) WHERE grade IS NOT NULL",
    "coverage_anti_join": f"""WITH {sql.JUDGED}, {_MATCHED} SELECT trial_id FROM matched
        WHERE trial_id IS NOT NULL AND trial_id NOT IN (SELECT trial_id FROM judged)""",
    "missing_ids": f"""WITH {sql.JUDGED} SELECT DISTINCT trial_id FROM judged
        WHERE trial_id NOT IN (SELECT {sql.trial_key('trial_id')} FROM inspection WHERE {sql.trial_key('trial_id')} IS NOT NULL)""",
    "set_equality": f"""WITH {_MATCHED}, held AS (SELECT DISTINCT {sql.trial_key('trial_id')} AS trial_id FROM inspection)
        SELECT count(*) FILTER (h.trial_id IS NULL) AS only_left, count(*) FILTER (m.trial_id IS NULL) AS only_right,
        count(*) FILTER (h.trial_id IS NULL OR m.trial_id IS NULL) = 0 AS equal
        FROM (SELECT * FROM matched WHERE trial_id IS NOT NULL) m FULL JOIN (SELECT * FROM held WHERE trial_id IS NOT NULL) h ON m.trial_id = h.trial_id""",
    "trace_join": f"""WITH {sql.JUDGED}, {_MATCHED}, cases AS (SELECT DISTINCT {sql.case_key('x')} AS case_id FROM (
        SELECT left_id AS x FROM record_matches WHERE lower(trim(kind)) = 'case' UNION ALL SELECT right_id FROM record_matches WHERE lower(trim(kind)) = 'case'))
        SELECT CASE WHEN c.case_id IS NOT NULL AND m.trial_id IS NOT NULL THEN 'linked' WHEN c.case_id IS NOT NULL THEN 'case_only'
        WHEN m.trial_id IS NOT NULL THEN 'trial_only' ELSE 'neither' END AS trace, count(*) AS pairs
        FROM judged j LEFT JOIN cases c ON j.case_id = c.case_id LEFT JOIN matched m ON j.trial_id = m.trial_id GROUP BY 1""",
    "qrels_validate": f"""WITH v AS ({_VALID}) SELECT * FROM (
        SELECT 'case_missing' AS issue, count(*) FILTER (c IS NULL) AS rows FROM v UNION ALL SELECT 'trial_missing', count(*) FILTER (t IS NULL) FROM v
        UNION ALL SELECT 'trial_malformed', count(*) FILTER (NOT regexp_full_match(t, 'NCT\\d{{8}}')) FROM v
        UNION ALL SELECT 'grade_missing', count(*) FILTER (grade IS NULL) FROM v UNION ALL SELECT 'grade_out_of_range', count(*) FILTER (grade NOT BETWEEN 0 AND 2) FROM v
        UNION ALL SELECT 'case_spelling', count(*) FILTER (case_id != c) FROM v UNION ALL SELECT 'trial_spelling', count(*) FILTER (trial_id != t) FROM v
        UNION ALL SELECT 'pair_repeated', count(*) - count(DISTINCT pair_id) FROM v) WHERE rows > 0""",
    "query_metrics": f"WITH {_RUNS} SELECT * FROM {_metrics_sql('dense')}",
    "evaluate_run": f"WITH {_RUNS} {_ALL}",
    "metrics_macro": f"WITH {_RUNS} SELECT run, count(*) AS topics, {_NAMES} FROM ({_ALL}) GROUP BY run",
    "best_run": f"""WITH {_RUNS} SELECT run, ndcg_at_10 FROM (SELECT run, round(avg(ndcg_at_10), 5) AS ndcg_at_10 FROM ({_ALL}) GROUP BY run)
        ORDER BY ndcg_at_10 DESC, run DESC LIMIT 1""",
    "judged_at_10": f"""WITH {_RUNS} SELECT case_id, count(grade) / 10.0::DOUBLE AS judged_at_10
        FROM dense JOIN judged USING (case_id, trial_id) WHERE rank <= 10 GROUP BY 1""",
    "win_loss_tie": f"""WITH {_RUNS} SELECT count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (delta < -1e-12) AS losses,
        count(*) FILTER (abs(delta) <= 1e-12) AS ties, round(avg(delta), 5) AS mean_delta FROM ({_DELTA})""",
    "largest_deltas": _extremes_sql(_DELTA, "delta"),
    "extreme_topics": _extremes_sql(f"SELECT * FROM {_metrics_sql('dense')}", "ndcg_at_10"),
    "hard_negatives": f"""WITH {sql.JUDGED} SELECT case_id, trial_id, rank, round(rrf, 6) AS rrf FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(rrf, 9) DESC, trial_id) AS rank FROM (
        SELECT case_id, trial_id, coalesce(CASE WHEN dense_rank <= 50 THEN 1.0::DOUBLE / (60 + dense_rank) END, 0)
               + coalesce(CASE WHEN bm25_rank <= 50 THEN 1.0::DOUBLE / (60 + bm25_rank) END, 0) AS rrf FROM judged WHERE grade = 0) WHERE rrf > 0) WHERE rank <= 2""",
    "latency_summary": """SELECT event_type, count(value) AS n, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS median,
        round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""",
}

"""Pieces of the SQL that checks the queries."""

from __future__ import annotations

from ..functions.text import STOP_WORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({STOP}, x))"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


WHITE = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]+"


def case_key(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '{WHITE}', '', 'g')), '')"


def trial_key(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '{WHITE}', '', 'g')), '')"


#: Judged pairs of cases and trials, one row each.
JUDGED = f"""judged AS (
  SELECT case_id, trial_id, max(grade) AS grade, min(dense_rank) AS dense_rank, min(bm25_rank) AS bm25_rank,
         max(dense_score) AS dense_score, max(bm25_score) AS bm25_score
  FROM (SELECT {case_key('case_id')} AS case_id, {trial_key('trial_id')} AS trial_id, grade, dense_rank, bm25_rank, dense_score, bm25_score
        FROM hard_negatives)
  WHERE case_id IS NOT NULL AND trial_id IS NOT NULL GROUP BY 1, 2)"""

POSTINGS = f"""sized AS (SELECT doc_id, {tokens('text')} AS t FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS documents, sum(len(t)) AS terms, avg(len(t)) AS average_length FROM sized),
postings AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS length
             FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM sized) GROUP BY doc_id, term),
idf AS (SELECT term, df, ln(1 + (documents - df + 0.5) / (df + 0.5)) AS idf
        FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats),
vectors AS (SELECT doc_id, term, tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average_length)) AS weight FROM postings, stats),
asked AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({tokens('text')}) AS term FROM eval_items) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(n * idf * weight) AS score FROM asked JOIN idf USING (term) JOIN vectors USING (term) GROUP BY ALL)"""

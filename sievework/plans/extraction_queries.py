"""Queries of text extraction, and of checks that SQL can't express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical_values as V
from ..functions.ids import trial_key
from ..operators import extraction as X
from ..operators import judgments
from ..operators.scratch import Scratch
from ..sources.tables import table

def _eligibility(spark, folder):
    return table(spark, folder, "documents").where("doc_kind = 'eligibility' and text is not null").select("doc_id", "text")


def clauses(spark, folder):
    return X.spread(table(spark, folder, "independent"), "topic_id", "text", X.clauses, "start_at int, end_at int")


def clause_counts(spark, folder):
    """Clauses of each narrative that has any."""
    return clauses(spark, folder).groupBy("topic_id").agg(F.count(F.lit(1)).alias("clauses"))


def extract_facts(spark, folder):
    return X.spread(table(spark, folder, "independent"), "topic_id", "text", X.facts, X.FACTS)


def sex_mentions(spark, folder):
    """Words of a sex in each narrative, by sex."""
    found = extract_facts(spark, folder).where("kind = 'sex' and rule = 'narrative-sex-label'")
    return found.groupBy("topic_id").agg(F.count_if(F.col("value_text") == "Female").alias("female"), F.count_if(F.col("value_text") == "Male").alias("male"))


def age_mentions(spark, folder):
    """Ages in each narrative, also those that can't be right: how many, their sum, the oldest."""
    found = extract_facts(spark, folder).where("rule = 'age-unit'")
    return found.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("ages"), F.round(F.sum("value_number"), 3).alias("total"), F.max("value_number").alias("highest")
    )


def fact_issues(spark, folder):
    """Issues by name."""
    found = extract_facts(spark, folder).where("kind = 'issue'")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("topic_id").alias("narratives"))


def missing_kinds(spark, folder):
    """Kinds of facts that a narrative lacks."""
    return X.spread(table(spark, folder, "independent"), "topic_id", "text", X.missing_kinds, "kind string")


def lexicon_hits(spark, folder):
    found = X.spread(table(spark, folder, "documents"), "doc_id", "text", X.facts, X.FACTS).where("kind in ('condition', 'medication', 'treatment')")
    return found.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"))


def parse_sections(spark, folder):
    return X.spread(_eligibility(spark, folder), "doc_id", "text", X.sections, X.SECTIONS)


def section_labels(spark, folder):
    """Headed sections of each document of any kind, by label."""
    found = X.spread(table(spark, folder, "documents"), "doc_id", "text", X.sections, X.SECTIONS).where("label != 'unknown'")
    return found.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("sections"))


def parse_criteria(spark, folder):
    return X.spread(_eligibility(spark, folder), "doc_id", "text", X.criteria, X.CRITERIA)


def criterion_reasons(spark, folder):
    """What criteria need review for, by section."""
    one = parse_criteria(spark, folder).where("reasons != ''").select("section", F.explode(F.split("reasons", ",")).alias("reason"))
    return one.groupBy("section", "reason").agg(F.count(F.lit(1)).alias("criteria"))


def criterion_negations(spark, folder):
    return X.spread(_eligibility(spark, folder), "doc_id", "text", X.negation_cues, "ordinal int, start_at int, end_at int, cue string")


def eligibility_issues(spark, folder):
    return X.spread(_eligibility(spark, folder), "doc_id", "text", X.document_issues, "issue string")


def numeric_constraints(spark, folder):
    return X.spread(table(spark, folder, "documents"), "doc_id", "text", X.numeric_limits, X.LIMITS)


def _limit_texts(spark, folder):
    """Limits worded from the numbers of every order, one wording per quantity and sign, with decoys that are none."""
    n = lambda c: F.col(c).cast("string")
    k = F.col("o_orderkey").cast("long")
    rows = table(spark, folder, "orders").select(
        k.alias("key"), (k % 60 + 1).alias("a"), (k % 60 + 1 + k % 9).alias("b"), (k % 17 + 1).alias("c"),
    )
    text = F.concat(
        F.lit("Age "), n("a"), F.lit(" to "), n("b"), F.lit(" years; haemoglobin at least "), n("c"), F.lit(".5 g/dl, HbA1c <= "), n("c"),
        F.lit(" %, serum creatinine no more than "), n("a"), F.lit(" \u00b5mol/L, BMI between "), n("b"), F.lit(" and "), n("a"),
        F.lit(" kg/m\u00b2; platelet count > "), n("a"), F.lit(" x10^9/L. Hb 9 mg per visit, creatinine < "), n("c"), F.lit(" mg/dL per week"),
    )
    return rows.select("key", text.alias("text"))


def limit_round_trip(spark, folder):
    """Limits worded from numbers and read back: all that were meant, and none of the decoys."""
    return X.spread(_limit_texts(spark, folder), "key", "text", X.numeric_limits, X.LIMITS).select("key", "name", "operator", "value", "upper", "unit")


def _lines(spark, folder):
    """Lines of eligibility texts with their indent."""
    lines = _eligibility(spark, folder).select("doc_id", F.posexplode(F.split("text", r"\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(r"\S")).select("doc_id", "n", "line", F.length(F.regexp_extract("line", r"^ *", 0)).alias("indent"))


def criterion_types(spark, folder):
    line = F.col("line")
    tags = F.array_compact(F.array(*(F.when(line.rlike(f"(?i){p}"), t) for t, p in V.CRITERION_TYPES.items())))
    return _lines(spark, folder).select("doc_id", "n", F.when(F.size(tags) == 0, "other").otherwise(F.array_join(tags, ",")).alias("types"))


def criterion_logic(spark, folder):
    found = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"\b(and|or)\b"), F.lit(1)))
    tag = F.when(F.size(found) > 1, "mixed").when(F.size(found) == 1, found[0]).otherwise("unspecified")
    return _lines(spark, folder).groupBy(tag.alias("logic")).agg(F.count(F.lit(1)).alias("lines"))


def _stacked(spark, folder):
    """Per text, each line with the lines above it that are indented less: a stack carried through the lines."""
    lines = _lines(spark, folder).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "indent"))).alias("l"))
    empty = F.array().cast("array<struct<n:int,indent:int>>")
    walked = F.aggregate(
        "l", F.struct(empty.alias("open"), F.array().cast("array<struct<n:int,path:string,parent:int>>").alias("done")),
        lambda acc, x: F.struct(
            F.concat(F.filter(acc["open"], lambda o: o["indent"] < x["indent"]), F.array(x)).alias("open"),
            F.concat(
                acc["done"],
                F.array(
                    F.struct(
                        x["n"].alias("n"),
                        F.array_join(F.transform(F.filter(acc["open"], lambda o: o["indent"] < x["indent"]), lambda o: o["n"].cast("string")), "/").alias("path"),
                        F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform(F.filter(acc["open"], lambda o: o["indent"] < x["indent"]), lambda o: o["n"])), -1).alias("parent"),
                    )
                ),
            ).alias("done"),
        ),
        lambda acc: acc["done"],
    )
    return lines.select("doc_id", F.inline(walked))


def indent_parent(spark, folder):
    return _stacked(spark, folder).select("doc_id", "n", "parent")


def ancestor_text(spark, folder):
    """The chain of lines above each line, from the outermost down."""
    return _stacked(spark, folder).select("doc_id", "n", "path")


def canonical_digest(spark, folder):
    return X.canonical_digest(table(spark, folder, "inspection").drop("captured_at"), "record_id")


def readback_verify(spark, folder):
    """Vectors written and read back, by state: rows, their numbers, and their sum as it was read."""
    v = table(spark, folder, "encoded_batch").select("vec_id", "vectors", F.xxhash64("vectors").alias("h"))
    held = Scratch(spark).save(v.select("vec_id", "vectors")).withColumn("g", F.xxhash64("vectors"))
    both = v.select("vec_id", "h").join(held.select("vec_id", "g", F.col("vectors").alias("read")), "vec_id", "full")
    same = F.when(F.col("h").eqNullSafe(F.col("g")), "same").otherwise("different")
    finite = F.filter("read", lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf")))
    total = F.aggregate(finite, F.lit(0.0), lambda s, x: s + F.round(x.cast("double") * 1000))
    return both.groupBy(same.alias("state")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(F.size("read"), F.lit(0))).cast("long").alias("numbers"), F.sum(F.round(total)).cast("long").alias("total")
    )


MOST_REVIEWED = 10


def pick_for_review(pairs, order, most=MOST_REVIEWED):
    """Pairs for review, in turn one of each grade: the first by ``order`` whose trial and case are both new, else whose trial is.

    A trial is taken once. At most ``most`` pairs are picked, which is the
    feature, so the driver holds that many; each pick is one aggregation.
    """
    fields = [*order, "case_id", "trial_id"]
    picked, grades = [], [0, 1, 2]

    def first(grade, fresh_case):
        some = pairs.where((F.col("grade") == grade) & ~F.col("trial_id").isin([p["trial_id"] for p in picked]))
        if fresh_case:
            some = some.where(~F.col("case_id").isin([p["case_id"] for p in picked]))
        return some.agg(F.min(F.struct(*fields)).alias("m")).first()["m"]

    while grades and len(picked) < most:
        for grade in list(grades):
            row = len(picked) < most and (first(grade, True) or first(grade, False))
            if row:
                picked.append(row.asDict() | {"grade": grade})
            elif row is None:
                grades.remove(grade)
    rows = [(i, p["grade"], p["case_id"], p["trial_id"]) for i, p in enumerate(picked, 1)]
    return pairs.sparkSession.createDataFrame(rows, "place int, grade int, case_id string, trial_id string")


def review_pair_pick(spark, folder):
    """Ten judged pairs for review whose studies are held, cycling through the grades."""
    held = table(spark, folder, "inspection").select(trial_key("trial_id").alias("trial_id"))
    judged = judgments.canonical_pairs(table(spark, folder, "hard_negatives")).where("grade between 0 and 2")
    saved = Scratch(spark).save(judged.select("grade", "case_id", "trial_id").join(held, "trial_id", "left_semi"))
    return pick_for_review(saved, ["case_id", "trial_id"])


QUERIES = {
    f.__name__: f
    for f in (
        clauses, clause_counts, extract_facts, sex_mentions, age_mentions, fact_issues, missing_kinds, lexicon_hits, parse_sections, section_labels,
        parse_criteria, criterion_reasons, criterion_negations, eligibility_issues, numeric_constraints, limit_round_trip, criterion_types,
        criterion_logic, indent_parent, ancestor_text, canonical_digest, readback_verify, review_pair_pick,
    )
}
_LINES = """lines AS (SELECT doc_id, n, line, length(regexp_extract(line, '^ *')) AS indent FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
  FROM documents WHERE doc_kind = 'eligibility' AND text IS NOT NULL) WHERE regexp_matches(line, '\\S'))"""
_PARENT = """parents AS (SELECT a.doc_id, a.n, max(b.n) AS parent FROM lines a LEFT JOIN lines b ON a.doc_id = b.doc_id AND b.n < a.n AND b.indent < a.indent GROUP BY 1, 2)"""
_TAGS = ", ".join(f"CASE WHEN regexp_matches(line, '(?i){p}') THEN '{t}' END" for t, p in V.CRITERION_TYPES.items())
SQL = {
    "criterion_types": f"WITH {_LINES} SELECT doc_id, n, coalesce(nullif(concat_ws(',', {_TAGS}), ''), 'other') AS types FROM lines",
    "criterion_logic": f"""WITH {_LINES} SELECT CASE WHEN a AND o THEN 'mixed' WHEN a THEN 'and' WHEN o THEN 'or' ELSE 'unspecified' END AS logic, count(*) AS lines
        FROM (SELECT regexp_matches(lower(line), '\\band\\b') AS a, regexp_matches(lower(line), '\\bor\\b') AS o FROM lines) GROUP BY 1""",
    "indent_parent": f"WITH {_LINES}, {_PARENT} SELECT * FROM parents",
    "ancestor_text": f"""WITH RECURSIVE {_LINES}, {_PARENT}, chain AS (SELECT doc_id, n, '' AS path FROM parents WHERE parent IS NULL
        UNION ALL SELECT p.doc_id, p.n, CASE WHEN c.path = '' THEN p.parent::VARCHAR ELSE c.path || '/' || p.parent END FROM parents p JOIN chain c ON p.doc_id = c.doc_id AND p.parent = c.n)
        SELECT * FROM chain""",
    "readback_verify": """SELECT 'same' AS state, count(*) AS rows, sum(coalesce(len(vectors), 0))::BIGINT AS numbers,
        sum(round(list_sum(list_transform(list_filter(vectors, lambda x: x IS NOT NULL AND isfinite(x)), lambda x: round(x::DOUBLE * 1000)))))::BIGINT AS total FROM encoded_batch""",
    # Points between digits are no ends of clauses.
    "clause_counts": """WITH t AS (SELECT topic_id, regexp_replace(regexp_replace(text, '(\\d)\\.(\\d)', '\\1_\\2', 'g'), '(\\d)\\.(\\d)', '\\1_\\2', 'g') AS t FROM independent),
        c AS (SELECT topic_id, unnest(regexp_split_to_array(t, '(?i)\\.|[!?;\\n]|\\b(?:but|however|whereas)\\b|,?[ \\t\\r\\f\\x0B]+and[ \\t\\r\\f\\x0B]+(?:the patient|he|she)\\b')) AS clause FROM t)
        SELECT topic_id, count(*) AS clauses FROM c WHERE regexp_matches(clause, '[^\\s\\p{Z}\\x0B\\x1C-\\x1F\\x{85}]') GROUP BY 1""",
    "sex_mentions": f"""WITH w AS (SELECT topic_id, lower(unnest(regexp_extract_all(text, '(?i){V.SEX}'))) AS w FROM independent)
        SELECT topic_id, count(*) FILTER (WHERE w IN {V.FEMALE}) AS female, count(*) FILTER (WHERE w NOT IN {V.FEMALE}) AS male FROM w GROUP BY 1""",
    "age_mentions": f"""WITH a AS (SELECT topic_id, unnest(regexp_extract_all(text, '(?i){V.AGE}', 1))::DOUBLE AS v FROM independent)
        SELECT topic_id, count(*) AS ages, round(sum(v), 3) AS total, max(v) AS highest FROM a GROUP BY 1""",
    "section_labels": """WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?im)\\b(?:inclusion|exclusion)\\s+criteria\\s*:|^[ \\t]*(?:inclusion|exclusion)(?:\\s+criteria)?[ \\t]*:?[ \\t\\r]*$')) AS h FROM documents)
        SELECT doc_id, CASE WHEN contains(lower(h), 'inclusion') THEN 'inclusion' ELSE 'exclusion' END AS label, count(*) AS sections FROM h GROUP BY 1, 2""",
    "limit_round_trip": """WITH n AS (SELECT o_orderkey::BIGINT AS key, o_orderkey % 60 + 1 AS a, o_orderkey % 60 + 1 + o_orderkey % 9 AS b, o_orderkey % 17 + 1 AS c FROM orders)
        SELECT key, 'age' AS name, 'range' AS operator, a::DOUBLE AS value, b::DOUBLE AS upper, 'year' AS unit FROM n
        UNION ALL SELECT key, 'hemoglobin', 'ge', c + 0.5, NULL, 'g/dL' FROM n
        UNION ALL SELECT key, 'hba1c', 'le', c, NULL, '%' FROM n
        UNION ALL SELECT key, 'creatinine', 'le', a, NULL, 'umol/L' FROM n
        UNION ALL SELECT key, 'bmi', 'range', b, a, 'kg/m2' FROM n WHERE b = a
        UNION ALL SELECT key, 'platelets', 'gt', a, NULL, 'x10^9/L' FROM n""",
}

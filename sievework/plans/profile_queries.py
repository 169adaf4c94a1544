"""Queries of profiles, registries, logic, calibration and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import demographics
from ..functions.ids import case_key, trial_key
from ..operators import evaluation as E
from ..operators import logic, nested, profile, registry
from ..sources import xmlrecords
from ..sources.tables import table
from . import sql
from .retrieval_queries import judged

DOC_FIELDS = ["text", "lang", "source", "doc_kind", "trial_id"]
STUDY_FIELDS = ["overall_status", "phases", "conditions", "interventions", "locations", "raw_record"]


def field_state_counts(spark, folder):
    a = profile.field_states(table(spark, folder, "documents"), DOC_FIELDS)
    b = profile.field_states(table(spark, folder, "inspection"), STUDY_FIELDS)
    return a.withColumn("of", F.lit("documents")).unionByName(b.withColumn("of", F.lit("inspection")))


def categorical_profile(spark, folder):
    d = profile.categories(table(spark, folder, "documents"), {"lang": F.lower("lang"), "source": F.col("source"), "doc_kind": F.col("doc_kind")})
    s = table(spark, folder, "inspection")
    phases = F.when(F.size("phases") > 0, F.array_join("phases", ",", "(null)")).when(F.size("phases") == 0, "(empty)")
    return d.unionByName(
        profile.categories(s, {"overall_status": F.col("overall_status"), "phases": phases, "date_length": F.length("last_update_date")})
    )


def json_field_state(spark, folder):
    """How each module stands in the raw records."""
    raw = table(spark, folder, "inspection").where("raw_record is not null")
    parts = None
    for m in ("designModule", "conditionsModule", "armsInterventionsModule", "contactsLocationsModule"):
        one = raw.select(F.lit(m).alias("module"), profile.json_state(F.col("raw_record"), f"$.protocolSection.{m}").alias("state"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("module", "state").agg(F.count(F.lit(1)).alias("records"))


def json_path_inventory(spark, folder):
    return profile.path_inventory(table(spark, folder, "inspection"), "raw_record")


def missing_info_list(spark, folder):
    """Sources of each language in the order of their first document."""
    d = table(spark, folder, "documents").select(F.coalesce(F.lower("lang"), F.lit("-")).alias("lang"), "doc_id", "source")
    return profile.ordered_distinct(d, "lang", "doc_id", "source")


def render_representations(spark, folder):
    found = profile.render(
        table(spark, folder, "field_passages"), "passage_id",
        {"summary": ["brief_summary"], "full": ["brief_summary", "detailed_description", "interventions"]},
    )
    return found.select("passage_id", "summary", F.sha2("full", 256).alias("content_sha256"), F.length("full").alias("chars"))


def catalog_page(spark, folder):
    s = table(spark, folder, "inspection").select("record_id", "trial_id", "overall_status")
    return profile.page(s, ["trial_id", "record_id"], 20, 50)


def _studies(spark, folder):
    """All studies, parsed and raw alike; those of damaged raw records have no conditions."""
    own = F.struct("record_id", "trial_id", "overall_status")
    return nested.typed_records(table(spark, folder, "inspection").select(own.alias("own"), "raw_record", *(f[0] for f in nested.FIELDS)), "own").select("own.*", "conditions")


def xml_extract_fields(spark, folder):
    """Fields of XML records, read back by path, white space normalised; as in its SQL, those of parsed records only."""
    s = table(spark, folder, "inspection").where("raw_record is null")
    return xmlrecords.extract(s.select("record_id", xmlrecords.write().alias("xml")), "record_id", "xml")


def xml_extract_all(spark, folder):
    """What ``xml_extract_fields`` gives, of all records; there is no SQL, since conditions of raw records come from the automaton."""
    return xmlrecords.extract(_studies(spark, folder).select("record_id", xmlrecords.write().alias("xml")), "record_id", "xml")


def corpus_validate(spark, folder):
    """Studies packed into archives of XML records, scanned member by member and held against the judged trials."""
    s = _studies(spark, folder).select(trial_key("trial_id").alias("trial_id"), xmlrecords.write().alias("xml"))
    members = xmlrecords.scan_archives(xmlrecords.archives_of(s, "trial_id", "xml"))
    return xmlrecords.validate_corpus(members, judged(spark, folder))


def _captures(spark, folder):
    return table(spark, folder, "inspection").where("trial_id is not null").select("record_id", "trial_id", "captured_at", "overall_status", "last_update_date")


def _content():
    return F.concat_ws("|", F.coalesce("overall_status", F.lit("-")), F.coalesce("last_update_date", F.lit("-")))


def registry_classify(spark, folder):
    return registry.classify(_captures(spark, folder), "trial_id", ["captured_at", "record_id"], _content()).select("record_id", "trial_id", "state")


def late_regressions(spark, folder):
    found = registry.regressions(_captures(spark, folder), "trial_id", ["captured_at", "record_id"], "last_update_date")
    return found.select("record_id", "trial_id", "last_update_date", "latest")


def date_window(spark, folder):
    """Captures last updated in a closed window, per month; partial dates are in none."""
    d = F.try_to_date("last_update_date", "yyyy-MM-dd")
    s = _captures(spark, folder).where(F.col("last_update_date").rlike(r"^\d{4}-\d{2}-\d{2}$")).withColumn("d", d)
    return s.where(F.col("d").between("2031-02-01", "2031-09-30")).groupBy(F.month("d").alias("month")).agg(F.count(F.lit(1)).alias("captures"))


def watermark_chain(spark, folder):
    return registry.windows(table(spark, folder, "events"), "ts").select(F.col("until").cast("string"), "records", F.col("next_start").cast("string"), "chained")


def page_issues(spark, folder):
    return registry.pages(table(spark, folder, "events"), "event_id", 100).select("page", "rows", "repeated")


def cursor_chain(spark, folder):
    return registry.pages(table(spark, folder, "events"), "event_id", 100).select("page", "first", "last", "follows")


def kleene_ops(spark, folder):
    """All nine pairs of truth values under the four connectives."""
    v = spark.sql("select a, b from (values (true), (false), (cast(null as boolean))) x(a) cross join (values (true), (false), (cast(null as boolean))) y(b)")
    a, b = F.col("a"), F.col("b")
    return v.select(
        "a", "b", logic.both(a, b).alias("both_"), logic.either(a, b).alias("either_"), logic.implies(a, b).alias("implies_"), logic.unless(a, b).alias("unless_")
    )


def logic_eval(spark, folder):
    """Trees of three levels: a case holds if in all its grades some pair is confirmed; a missing score is unknown."""
    p = table(spark, folder, "hard_negatives").withColumn("tree", case_key("case_id")).where("tree is not null").select("tree", "pair_id", "grade", "dense_score")
    leaf = F.col("dense_score") > 0.9
    group = F.concat(F.lit("g"), F.coalesce(F.col("grade").cast("string"), F.lit("-")))
    null = F.lit(None).cast("string")
    leaves = p.select("tree", F.col("pair_id").cast("string").alias("node"), group.alias("parent"), null.alias("operator"), leaf.alias("truth"), F.lit(2).alias("level"))
    none = F.lit(None).cast("boolean")
    groups = p.select("tree", group.alias("node"), F.lit("root").alias("parent"), F.lit("or").alias("operator"), none.alias("truth"), F.lit(1).alias("level")).distinct()
    roots = p.select("tree", F.lit("root").alias("node"), null.alias("parent"), F.lit("and").alias("operator"), none.alias("truth"), F.lit(0).alias("level")).distinct()
    return logic.evaluate(leaves.unionByName(groups).unionByName(roots), 3).where("node = 'root'").select("tree", "truth")


def _logits(spark, folder):
    return judged(spark, folder).where("dense_score is not null and bm25_score is not null and grade is not null")


def softmax(spark, folder):
    logits = F.array(F.col("dense_score"), F.col("bm25_score") / 10, F.lit(0.5).cast("double"))
    p = E.softmax(logits, 3.0)
    return _logits(spark, folder).select("case_id", "trial_id", *(F.round(p[i], 6).alias(f"p{i}") for i in range(3)))


def nli_proposal(spark, folder):
    """How often the most probable of three classes is decided or left open at 0.7."""
    p = E.softmax(F.array(F.col("dense_score"), F.col("bm25_score") / 10, F.lit(0.5).cast("double")))
    top = F.array_max("p")
    decided = F.when(F.round(top, 9) < 0.7, "open").otherwise(F.concat(F.lit("class "), (F.array_position("p", top) - 1).cast("string")))
    return _logits(spark, folder).select(p.alias("p")).select(decided.alias("proposal")).groupBy("proposal").agg(F.count(F.lit(1)).alias("pairs"))


def _confidence(spark, folder):
    return _logits(spark, folder).select(F.least(F.greatest("dense_score", F.lit(0.0)), F.lit(1.0)).alias("confidence"), (F.col("grade") > 0).alias("correct"))


def calibration(spark, folder):
    return E.reliability(_confidence(spark, folder), "confidence", "correct")


def calibration_error(spark, folder):
    return E.calibration_error(calibration(spark, folder))


def choose_temperature(spark, folder):
    """The temperature with the smallest loss, nearest to one on a tie."""
    grid = spark.createDataFrame([(t,) for t in (0.5, 1.0, 2.0, 3.0)], "t double")
    p = F.lit(1.0) / (1 + F.exp(-(4 * F.col("confidence") - 2) / F.col("t")))
    loss = -F.log(F.greatest(F.when(F.col("correct"), p).otherwise(1 - p), F.lit(1e-15)))
    each = _confidence(spark, folder).crossJoin(F.broadcast(grid)).groupBy("t").agg(F.round(F.avg(loss), 5).alias("nll"))
    return each.agg(F.min_by("t", F.struct("nll", F.abs(F.col("t") - 1), "t")).alias("t"), F.min("nll").alias("nll"))


def wilson_lower(spark, folder):
    s = table(spark, folder, "hard_negatives").where("grade is not null").groupBy("sampler").agg(F.count_if(F.col("grade") > 0).alias("c"), F.count(F.lit(1)).alias("n"))
    return s.select("sampler", "n", F.round(E.wilson_lower(F.col("c"), F.col("n")), 6).alias("lower"))


def topic_demographics(spark, folder):
    t = table(spark, folder, "independent").where("text is not null")
    return t.select("topic_id", F.round(demographics.opening_age_days(F.col("text")), 4).alias("age_days"), demographics.opening_sex(F.col("text")).alias("sex"))


BOUNDS = ("18 Years", "6 Months", "1 Year", " 90 Minutes ", "3.5 Weeks", "2 days", "N/A", "", "Years", "10 Days")
_VALUES = ", ".join(f"('{b}')" for b in BOUNDS)


def age_bound_days(spark, folder):
    v = spark.sql(f"select v from (values {_VALUES}, (cast(null as string))) t(v)")
    return v.select("v", F.round(demographics.bound_days(F.col("v")), 6).alias("days"))


def confusion_matrix(spark, folder):
    """First and last subject of each labelled document."""
    s = table(spark, folder, "subject_labels").where("doc_id is not null and subject is not null")
    first = s.groupBy("doc_id").agg(F.min_by("subject", F.struct("labelled_at", "subject")).alias("subject"))
    last = s.where("annotator != 'annotator-1'").groupBy("doc_id").agg(F.max_by("subject", F.struct("labelled_at", "subject")).alias("subject"))
    return E.confusion(first, last, ["doc_id"], "subject")


def multiset_prf(spark, folder):
    """Labels of the odd annotators against those of all, as multisets of subjects and languages."""
    s = table(spark, folder, "subject_labels").join(table(spark, folder, "documents").select("doc_id", F.lower("lang").alias("lang")), "doc_id")
    odd = s.where(F.substring("annotator", -1, 1).isin("1", "3", "5", "7", "9"))
    return E.multiset_prf(s, odd, ["subject", "lang"])


def outcome_transitions(spark, folder):
    """Comparisons by what a threshold of 0.5 would say and what was decided."""
    m = table(spark, folder, "record_matches")
    say = lambda c: F.when(c, "match").when(~c, "different").otherwise("undecided")
    return m.groupBy("kind", say(F.col("jaccard") >= 0.5).alias("before"), say(F.col("is_match")).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def coverage_summary(spark, folder):
    p = table(spark, folder, "hard_negatives")
    return p.groupBy("sampler", "grade").agg(
        F.count(F.lit(1)).alias("pairs"), F.count("dense_rank").alias("with_dense"), F.count("bm25_rank").alias("with_bm25"),
        F.round(F.count("reason") / F.count(F.lit(1)), 6).alias("reason_share"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        field_state_counts, categorical_profile, json_field_state, json_path_inventory, missing_info_list, render_representations, catalog_page,
        xml_extract_fields, xml_extract_all, corpus_validate, registry_classify, late_regressions, date_window, watermark_chain, page_issues, cursor_chain, kleene_ops, logic_eval, softmax,
        nli_proposal, calibration, calibration_error, choose_temperature, wilson_lower, topic_demographics, age_bound_days, confusion_matrix, multiset_prf,
        outcome_transitions, coverage_summary,
    )
}


def _states(name: str, fields: list[str], lists: set[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "of", '{f}' AS field, CASE WHEN {f} IS NULL THEN 'null' WHEN {f"len({f}) = 0" if f in lists else f"NOT regexp_matches({f}, '[^\\s\\p{{Z}}]')"}
            THEN 'empty' ELSE 'present' END AS state, count(*) AS n FROM {name} GROUP BY ALL"""
        for f in fields
    )


_LOGITS = f"WITH {sql.JUDGED}, l AS (SELECT *, [dense_score, bm25_score / 10, 0.5::DOUBLE] AS x FROM judged WHERE dense_score IS NOT NULL AND bm25_score IS NOT NULL AND grade IS NOT NULL)"
_SOFT = "list_transform(x, lambda v: exp((v - list_max(x)) / {t}) / list_sum(list_transform(x, lambda w: exp((w - list_max(x)) / {t}))))"
_CONF = ", c AS (SELECT least(greatest(dense_score, 0), 1) AS confidence, grade > 0 AS correct FROM l)"
_BINS = """, b AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(confidence), 6) AS confidence
    FROM c GROUP BY 1)"""
_ALL3 = "CASE WHEN count(*) FILTER (NOT {x}) > 0 THEN false WHEN count(*) FILTER ({x} IS NULL) > 0 THEN NULL ELSE true END"
_ANY3 = "CASE WHEN count(*) FILTER ({x}) > 0 THEN true WHEN count(*) FILTER ({x} IS NULL) > 0 THEN NULL ELSE false END"
_CAPTURES = """captures AS (SELECT record_id, trial_id, captured_at, last_update_date,
    concat_ws('|', coalesce(overall_status, '-'), coalesce(last_update_date, '-')) AS content FROM inspection WHERE trial_id IS NOT NULL)"""
_ORDER = "PARTITION BY trial_id ORDER BY captured_at, record_id"
_PAGES = """p AS (SELECT event_id // 100 AS page, count(*) AS rows, count(*) - count(DISTINCT event_id) AS repeated, min(event_id) AS first, max(event_id) AS last
    FROM events GROUP BY 1)"""
_SPACE = "nullif(trim(regexp_replace({c}, '[\\s\\p{{Z}}]+', ' ', 'g')), '')"
_AGE, _FEMALE, _MALE = demographics.AGE, demographics.FEMALE, demographics.MALE
_UNIT = "CASE lower({u}) WHEN 'minute' THEN {n} / 1440 WHEN 'day' THEN {n} WHEN 'week' THEN {n} * 7 WHEN 'month' THEN {n} * 30.436875 WHEN 'year' THEN {n} * 365.2425 END"
SQL = {
    "field_state_counts": _states("documents", DOC_FIELDS, set()) + " UNION ALL " + _states("inspection", STUDY_FIELDS, {"phases", "conditions", "interventions", "locations"}),
    "categorical_profile": """SELECT 'lang' AS field, coalesce(lower(lang), '(null)') AS value, count(*) AS n FROM documents GROUP BY ALL
        UNION ALL SELECT 'source', coalesce(source, '(null)'), count(*) FROM documents GROUP BY ALL
        UNION ALL SELECT 'doc_kind', coalesce(doc_kind, '(null)'), count(*) FROM documents GROUP BY ALL
        UNION ALL SELECT 'overall_status', coalesce(overall_status, '(null)'), count(*) FROM inspection GROUP BY ALL
        UNION ALL SELECT 'phases', CASE WHEN phases IS NULL THEN '(null)' WHEN len(phases) = 0 THEN '(empty)'
            ELSE array_to_string(list_transform(phases, lambda x: coalesce(x, '(null)')), ',') END, count(*) FROM inspection GROUP BY ALL
        UNION ALL SELECT 'date_length', coalesce(length(last_update_date)::VARCHAR, '(null)'), count(*) FROM inspection GROUP BY ALL""",
    "json_field_state": " UNION ALL ".join(
        f"""SELECT '{m}' AS module, CASE WHEN NOT json_valid(raw_record) THEN 'invalid' ELSE CASE json_type(CASE WHEN json_valid(raw_record) THEN raw_record END, '$.protocolSection.{m}')
            WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' ELSE 'absent' END END AS state,
            count(*) AS records FROM inspection WHERE raw_record IS NOT NULL GROUP BY ALL"""
        for m in ("designModule", "conditionsModule", "armsInterventionsModule", "contactsLocationsModule")
    ),
    "missing_info_list": """SELECT lang, string_agg(source, '|' ORDER BY o, source) AS "values" FROM (SELECT coalesce(lower(lang), '-') AS lang, source, min(doc_id) AS o
        FROM documents WHERE source IS NOT NULL GROUP BY ALL) GROUP BY lang""",
    "render_representations": f"""SELECT passage_id, coalesce({_SPACE.format(c='brief_summary')}, '') AS summary, sha256(f) AS content_sha256, length(f) AS chars FROM (
        SELECT *, concat_ws(chr(10), {_SPACE.format(c='brief_summary')}, {_SPACE.format(c='detailed_description')},
        {_SPACE.format(c="array_to_string(list_filter(interventions, lambda x: x IS NOT NULL), ' ')")}) AS f FROM field_passages)""",
    "catalog_page": "SELECT record_id, trial_id, overall_status FROM inspection ORDER BY trial_id NULLS FIRST, record_id LIMIT 50 OFFSET 20",
    "xml_extract_fields": f"""SELECT record_id, coalesce({_SPACE.format(c='trial_id')}, '') AS trial_id, coalesce({_SPACE.format(c='overall_status')}, '') AS overall_status,
        coalesce({_SPACE.format(c="array_to_string(list_filter(conditions, lambda x: x IS NOT NULL), ' ')")}, '') AS conditions,
        coalesce(len(list_filter(conditions, lambda x: x IS NOT NULL)), 0) AS n_conditions,
        CASE WHEN overall_status IS NULL THEN 'absent' WHEN trim(overall_status) = '' THEN 'empty' ELSE 'present' END AS status_state
        FROM inspection WHERE raw_record IS NULL""",
    "registry_classify": f"""WITH {_CAPTURES} SELECT record_id, trial_id, CASE WHEN row_number() OVER w = 1 THEN 'added'
        WHEN lag(content) OVER w = content THEN 'unchanged' ELSE 'changed' END AS state FROM captures WINDOW w AS ({_ORDER})""",
    "late_regressions": f"""WITH {_CAPTURES} SELECT record_id, trial_id, last_update_date, latest FROM (SELECT *, max(last_update_date) OVER
        ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM captures WHERE regexp_full_match(last_update_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}'))
        WHERE last_update_date < latest""",
    "date_window": """SELECT month(d) AS month, count(*) AS captures FROM (SELECT try_cast(last_update_date AS DATE) AS d FROM inspection
        WHERE trial_id IS NOT NULL AND regexp_full_match(last_update_date, '\\d{4}-\\d{2}-\\d{2}')) WHERE d BETWEEN DATE '2031-02-01' AND DATE '2031-09-30' GROUP BY 1""",
    "watermark_chain": """SELECT until::VARCHAR AS until, records, (until - 1)::VARCHAR AS next_start, coalesce(until - lag(until) OVER (ORDER BY until) <= 1, true) AS chained
        FROM (SELECT ts::DATE AS until, count(*) AS records FROM events GROUP BY 1)""",
    "page_issues": f"WITH {_PAGES} SELECT page, rows, repeated FROM p",
    "cursor_chain": f"WITH {_PAGES} SELECT page, first, last, coalesce(first = lag(last) OVER (ORDER BY page) + 1, true) AS follows FROM p",
    "kleene_ops": """SELECT a, b, a AND b AS both_, a OR b AS either_, NOT a OR b AS implies_, a AND NOT b AS unless_
        FROM (VALUES (true), (false), (NULL::BOOLEAN)) x(a), (VALUES (true), (false), (NULL::BOOLEAN)) y(b)""",
    "logic_eval": f"""SELECT tree, {_ALL3.format(x='t')} AS truth FROM (SELECT {sql.case_key('case_id')} AS tree, grade, {_ANY3.format(x='(dense_score > 0.9)')} AS t
        FROM hard_negatives WHERE {sql.case_key('case_id')} IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "softmax": f"{_LOGITS} SELECT case_id, trial_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2 FROM (SELECT *, {_SOFT.format(t='3.0')} AS p FROM l)",
    "nli_proposal": f"""{_LOGITS} SELECT CASE WHEN round(list_max(p), 9) < 0.7 THEN 'open' ELSE 'class ' || (list_position(p, list_max(p)) - 1) END AS proposal, count(*) AS pairs
        FROM (SELECT {_SOFT.format(t='1.0')} AS p FROM l) GROUP BY 1""",
    "calibration": f"{_LOGITS}{_CONF}{_BINS} SELECT * FROM b",
    "calibration_error": f"{_LOGITS}{_CONF}{_BINS} SELECT sum(n)::BIGINT AS n, round(sum(n * abs(accuracy - confidence)) / sum(n), 5) AS ece FROM b",
    "choose_temperature": f"""{_LOGITS}{_CONF}, e AS (SELECT t, round(avg(-ln(greatest(CASE WHEN correct THEN p ELSE 1 - p END, 1e-15))), 5) AS nll
        FROM (SELECT t, correct, 1 / (1 + exp(-(4 * confidence - 2) / t)) AS p FROM c, (VALUES (0.5::DOUBLE), (1.0), (2.0), (3.0)) g(t)) GROUP BY 1)
        SELECT t, nll FROM e ORDER BY nll, abs(t - 1), t LIMIT 1""",
    "wilson_lower": """SELECT sampler, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lower
        FROM (SELECT sampler, count(*)::DOUBLE AS n, count(*) FILTER (grade > 0) / count(*) AS p FROM hard_negatives WHERE grade IS NOT NULL GROUP BY 1)""",
    "topic_demographics": f"""SELECT topic_id, round(coalesce({_UNIT.format(u="regexp_extract(s, '(?i)" + _AGE + "', 2)", n="try_cast(regexp_extract(s, '(?i)" + _AGE + "', 1) AS DOUBLE)")},
        try_cast(regexp_extract(s, '{demographics.COMPACT}', 1) AS DOUBLE) * 365.2425), 4) AS age_days,
        CASE WHEN f AND NOT m THEN 'Female' WHEN m AND NOT f THEN 'Male' END AS sex
        FROM (SELECT *, regexp_matches(s, '(?i)\\b({_FEMALE})\\b') OR k = 'F' AS f, regexp_matches(s, '(?i)\\b({_MALE})\\b') OR k = 'M' AS m
        FROM (SELECT topic_id, substr(text, 1, 240) AS s, regexp_extract(substr(text, 1, 240), '{demographics.COMPACT}', 2) AS k FROM independent WHERE text IS NOT NULL))""",
    "age_bound_days": f"""SELECT v, round({_UNIT.format(u="rtrim(lower(regexp_extract(trim(v), '" + demographics.BOUND + "', 2)), 's')",
        n="try_cast(regexp_extract(trim(v), '" + demographics.BOUND + "', 1) AS DOUBLE)")}, 6) AS days FROM (VALUES {_VALUES}, (NULL)) t(v)""",
    "confusion_matrix": """WITH s AS (SELECT * FROM subject_labels WHERE doc_id IS NOT NULL AND subject IS NOT NULL),
        a AS (SELECT doc_id, subject FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY labelled_at, subject) AS n FROM s) WHERE n = 1),
        b AS (SELECT doc_id, subject FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY labelled_at DESC, subject DESC) AS n FROM s
              WHERE annotator != 'annotator-1') WHERE n = 1)
        SELECT coalesce(a.subject, '(unexpected)') AS expected, coalesce(b.subject, '(missing)') AS actual, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1, 2""",
    "multiset_prf": """WITH s AS (SELECT subject, lower(lang) AS lang, annotator FROM subject_labels JOIN documents USING (doc_id)),
        g AS (SELECT subject, lang, count(*) AS e, count(*) FILTER (right(annotator, 1) IN ('1', '3', '5', '7', '9')) AS a FROM s GROUP BY 1, 2)
        SELECT tp, a - tp AS fp, e - tp AS fn, round(tp / a, 6) AS "precision", round(tp / e, 6) AS recall, round(2 * tp / (a + e), 6) AS f1
        FROM (SELECT sum(least(e, a))::BIGINT AS tp, sum(e)::BIGINT AS e, sum(a)::BIGINT AS a FROM g)""",
    "outcome_transitions": """SELECT kind, CASE WHEN jaccard >= 0.5 THEN 'match' WHEN jaccard < 0.5 THEN 'different' ELSE 'undecided' END AS before,
        CASE WHEN is_match THEN 'match' WHEN NOT is_match THEN 'different' ELSE 'undecided' END AS after, count(*) AS n FROM record_matches GROUP BY ALL""",
    "coverage_summary": """SELECT sampler, grade, count(*) AS pairs, count(dense_rank) AS with_dense, count(bm25_rank) AS with_bm25,
        round(count(reason) / count(*), 6) AS reason_share FROM hard_negatives GROUP BY 1, 2""",
}

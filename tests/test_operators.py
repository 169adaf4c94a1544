import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import extraction as X
from sievework.operators import fusion, lexical, logic, neardup, registry
from sievework.operators.graph import min_label
from sievework.operators.scratch import Scratch
from sievework.operators.skew import lookup_join, salted_join
from sievework.sources import xmlrecords
from sievework.streaming import upserts


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_lookup_join_equals_join(spark, how, hot):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 6 + ["b"] * 3 + ["c", None, None, None, None])], "k string, i int")
    look = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "k string, v int")
    want = sorted(map(str, rows.join(look, "k", how).select("k", "i", "v").collect()))
    assert sorted(map(str, lookup_join(rows, look, "k", how, hot).select("k", "i", "v").collect())) == want


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_salted_join_equals_join(spark, hot):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 6 + ["b"] * 3 + ["c", None, None, None, None])], "k string, i int")
    others = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("z", 3), (None, 4)], "k string, v int")
    want = sorted(map(str, rows.join(others, "k").select("k", "i", "v").collect()))
    assert sorted(map(str, salted_join(rows, others, "k", "i", hot, salts=4).select("k", "i", "v").collect())) == want


def test_scratch_writes_below_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sievework.operators.scratch.checkpoint_dir", lambda s: f"file://{tmp_path}")
    scratch = Scratch(spark)
    saved = scratch.save(spark.range(5))
    assert saved.count() == 5 and any(tmp_path.rglob("*.parquet"))
    scratch.drop(saved)
    assert not any(tmp_path.rglob("*.parquet"))


def test_min_label_on_chain_and_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["label"] for x in min_label(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 140)) and len(got) == 71


def test_near_duplicates_match_brute_force(spark):
    import random

    r = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(60)]
        for _ in range(5):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(60)] = r.choice(words)
            texts.append(" ".join(w))
    texts += [None, "", "one two", "one two", texts[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "a", "set", "h")})
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        if len(w) >= 5 and texts.index(t) == i:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert {(x["a"], x["b"]) for x in neardup.class_links(frame, "doc_id", Scratch(spark)).collect()} == want
    rows = {x["doc_id"]: x for x in neardup.components(frame, "doc_id", Scratch(spark)).collect()}
    assert rows[63]["class_id"] == 62 and rows[64]["class_id"] == 0 and 60 not in rows and 61 not in rows
    assert all(rows[a]["group_id"] == rows[b]["group_id"] for a, b in want)


def test_top_k_ties_and_bounds(spark):
    frame = spark.createDataFrame([(1, i, 0.5) for i in range(9)] + [(1, 20, 0.5 + 1e-12), (1, 21, 0.7), (2, 5, 0.0)], "q int, d int, score double")
    got = [x["d"] for x in lexical.top_k(frame.where("q = 1"), "q", "d", 4).orderBy("rank").collect()]
    assert got == [21, 0, 1, 2]
    assert lexical.top_k(frame, "q", "d", 3, positive=True).where("q = 2").count() == 0
    with pytest.raises(ValueError):
        lexical.top_k(frame, "q", "d", 0)


def test_prefix_rerank_keeps_the_tail(spark):
    frame = spark.createDataFrame([(1, f"d{i}", i + 1, float(i == 2)) for i in range(6)], "q int, d string, rank int, s double")
    got = fusion.prefix_rerank(frame, "q", "d", "s", 4).orderBy("rank").collect()
    assert [x["d"] for x in got] == ["d2", "d0", "d1", "d3", "d4", "d5"] and [x["original_rank"] for x in got] == [3, 1, 2, 4, 5, 6]


def test_windows_end_at_the_end(spark):
    for n, want in ((0, 0), (1, 1), (192, 1), (193, 2), (352, 2), (353, 3)):
        starts = spark.range(1).select(T.window_starts(F.lit(n), 192, 32).alias("s")).first()["s"]
        assert len(starts) == want and all(s == 160 * i for i, s in enumerate(starts)) and (not n or min(starts[-1] + 192, n) == n)


def test_three_valued_aggregates(spark):
    for values, every, some in (([True, None], None, True), ([False, None], False, None), ([True], True, True), ([None], None, None), ([False, True], False, True)):
        x = spark.createDataFrame([(v,) for v in values], "v boolean").agg(logic.every(F.col("v")).alias("e"), logic.some(F.col("v")).alias("s")).first()
        assert (x["e"], x["s"]) == (every, some)


def test_clauses_tile_and_keep_decimals():
    text = "Hb is 9.5 g/dL. He denies asthma; but he has COPD!\nDone"
    assert [text[a:b].strip() for a, b in X.clauses(text)] == ["Hb is 9.5 g/dL", "He denies asthma", "he has COPD", "Done"]


@pytest.mark.parametrize(
    ("text", "name", "who", "assertion", "when"),
    [
        ("The patient has asthma.", "asthma", "patient", "present", "current"),
        ("She denies asthma.", "asthma", "patient", "absent", "current"),
        ("Her mother had breast cancer.", "breast_cancer", "family", "present", "historical"),
        ("Possible pneumonia.", "pneumonia", "patient", "uncertain", "current"),
        ("Surgery is planned.", "surgery", "patient", "present", "planned"),
        ("His father had stroke and the patient has hypertension.", "hypertension", "patient", "present", "current"),
        ("A friend takes metformin.", "metformin", "other", "present", "current"),
        ("𝛼 History of type 2 diabetes.", "type_2_diabetes", "patient", "present", "historical"),
    ],
)
def test_mentions_in_context(text, name, who, assertion, when):
    found = [f for f in X.facts(text) if f[1] == name]
    assert [(f[8], f[9], f[10]) for f in found] == [(who, assertion, when)]
    assert all(text[f[6] : f[7]] for f in found) and not [f for f in X.facts(text) if f[1] == "diabetes"]


def test_measurements_need_a_known_unit():
    got = {(f[0], f[1], f[3], f[4], f[5]) for f in X.facts("Platelet count of 120 x10^9/L, weight 70 stones, creatinine < 1.2 mg/dL and a 45-year-old woman, 200-year-old man.")}
    assert {("measurement", "platelets", 120.0, "x10^9/L", "eq"), ("measurement", "creatinine", 1.2, "mg/dL", "lt"), ("issue", "unsupported_measurement", 70.0, None, "eq"),
            ("age", "age", 45.0, "year", "eq"), ("issue", "invalid_age", 200.0, "year", "eq")} <= got


def test_sections_tile_and_criteria_nest():
    text = "Intro\nInclusion Criteria:\n* one\n  - two\n* three\n\nExclusion Criteria:\nfirst para\n\nor more\n\nlast"
    spans = X.sections(text)
    assert [s[1] for s in spans] == ["unknown", "inclusion", "exclusion"]
    assert spans[0][2] == 0 and spans[-1][4] == len(text) and all(a[4] == b[2] for a, b in zip(spans, spans[1:]))
    got = X.criteria(text)
    assert [(c[1], c[2], c[5]) for c in got] == [
        ("unknown", None, "Intro"), ("inclusion", None, "one"), ("inclusion", 2, "two"), ("inclusion", None, "three"),
        ("exclusion", None, "first para\n\nor more"), ("exclusion", None, "last"),
    ]
    assert all(text[c[3] : c[4]] == c[5] for c in got) and X.criteria("") == [] and X.sections("") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("weight about 70 kg", ("measurement", "weight", None, 70.0, "kg", "approx")),
        ("HbA1c ~7 %", ("measurement", "hba1c", None, 7.0, "%", "approx")),
        ("platelet count approximately 150 /mm³", ("measurement", "platelets", None, 150.0, "/mm3", "approx")),
        ("BP 120/80 mmHg", ("measurement", "systolic_blood_pressure", None, 120.0, "mmHg", "eq")),
        ("BP: 120/80 mmHg", ("measurement", "diastolic_blood_pressure", None, 80.0, "mmHg", "eq")),
        ("blood pressure 140/90", ("issue", "unsupported_measurement", None, 140.0, None, "eq")),
        ("height -3 cm", ("issue", "unsupported_measurement", None, -3.0, "cm", "eq")),
        ("67F with asthma", ("age", "age", None, 67.0, "year", "eq")),
        ("67F with asthma", ("sex", "sex", "Female", None, None, "eq")),
        ("199M with asthma", ("issue", "invalid_age", None, 199.0, "year", "eq")),
        ("The patient is 45-50-year-old.", ("issue", "invalid_age", None, 50.0, "year", "eq")),
        ("Nothing of note.", ("issue", "unparsed_clause", None, None, None, None)),
        ("Sex unknown.", ("issue", "sex_requires_review", None, None, None, None)),
        ("A 40-year-old woman. Sex: male.", ("issue", "conflicting_sex", None, None, None, None)),
    ],
)
def test_facts_of_every_form(text, want):
    assert want in {tuple(f)[:6] for f in X.facts(text)}


@pytest.mark.parametrize(
    ("text", "when", "sure"),
    [
        ("A 70-year-old man has asthma.", "current", "asserted"), ("His 70-year-old father has asthma.", "unknown", "asserted"),
        ("The patient was a 70-year-old man at diagnosis.", "historical", "asserted"), ("The patient may be 70-year-old.", "unknown", "asserted"),
        ("Asthma. The patient is a 70-year-old man.", "current", "asserted"), ("Aged: 70 year old", "current", "asserted"),
        ("The patient is about 70 years old.", "unknown", "uncertain"),
    ],
)
def test_ages_are_current_only_in_the_opening_or_after_a_label(text, when, sure):
    assert [(f[10], f[11]) for f in X.facts(text) if f[0] == "age"] == [(when, sure)]


def test_missing_kinds_and_blank_texts():
    assert X.missing_kinds("A 40-year-old woman has asthma.") == [("medication",), ("treatment",), ("measurement",)]
    assert X.facts("") == X.facts("  \n ") == [] and X.clauses(" . ") == [] and len(X.missing_kinds("")) == 6


def test_criteria_are_cut_at_safe_semicolons_and_reviewed():
    text = "Inclusion criteria:\n- Age 18 to 65 years; BMI < 30 kg/m2\n- Heart failure (stable; treated); sex female\n- No cancer unless cured; age any\n- Hb 9 units\n  - either:\nNone."
    got = X.criteria(text)
    assert [c.wording for c in got] == [
        "Age 18 to 65 years", "BMI < 30 kg/m2", "Heart failure (stable; treated)", "sex female", "No cancer unless cured; age any", "Hb 9 units", "either:\nNone.",
    ]
    by = {c.wording: c for c in got}
    assert by["No cancer unless cured; age any"].negations == 1 and by["No cancer unless cured; age any"].types == "age,condition"
    assert by["No cancer unless cured; age any"].reasons == "conditional_or_exception,unsplit_semicolon"
    assert by["Hb 9 units"].reasons == "unsupported_numeric_expression:hemoglobin" and by["BMI < 30 kg/m2"].limits == 1
    assert by["either:\nNone."].parent == by["Hb 9 units"].ordinal and by["Age 18 to 65 years"].reasons == ""
    assert len({c.criterion_id for c in got}) == len(got) and all(text[c.start_at : c.end_at] == c.wording for c in got)
    assert X.document_issues("x") == [("no_recognized_section_headers",)] and X.document_issues("") == [("empty_eligibility_text",), ("no_recognized_section_headers",)]
    assert X.document_issues("Inclusion criteria: a\nInclusion criteria: b") == [("repeated_inclusion_sections",)]
    assert [c[3] for c in X.negation_cues("Inclusion criteria: no cancer, never smoked")] == ["no", "never"]


@pytest.mark.parametrize("unit", ["years", "months", "weeks", "days"])
def test_limits_of_every_age_unit(unit):
    assert [c[:5] for c in X.numeric_limits(f"aged >= 2 {unit}")] == [("age", "ge", 2.0, None, unit[:-1])]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hb of at least 9 g/L", ("hemoglobin", "ge", 9.0, None, "g/L")), ("HbA1c 48 – 53 mmol/mol", ("hba1c", "range", 48.0, 53.0, "mmol/mol")),
        ("creatinine less than 1.5 mg/dL", ("creatinine", "lt", 1.5, None, "mg/dL")), ("creatinine: <= 90 μmol/L", ("creatinine", "le", 90.0, None, "umol/L")),
        ("body mass index = 20 kg/m²", ("bmi", "eq", 20.0, None, "kg/m2")), ("platelets must be more than 100 /mm³", ("platelets", "gt", 100.0, None, "/mm3")),
    ],
)
def test_limits_of_every_unit(text, want):
    assert [c[:5] for c in X.numeric_limits(text)] == [want]


@pytest.mark.parametrize("part", [7, 100_000])
def test_bootstrap_at_any_number_of_parts(spark, part):
    from sievework.operators import evaluation

    rows = [(f"q{i}", (i % 11 - 4) / 10) for i in range(60)]
    got = evaluation.paired_bootstrap(spark.createDataFrame(rows, "q string, delta double"), "q", repeats=2000, part=part).collect()
    mean = sum(d for _, d in rows) / 60
    spread = (sum((d - mean) ** 2 for _, d in rows) / 60) ** 0.5 / 60**0.5
    assert len(got) == 1 and got[0]["topics"] == 60 and abs(got[0]["mean_delta"] - mean) < 1e-9
    assert abs(got[0]["low"] - (mean - 1.96 * spread)) < 0.25 * spread and abs(got[0]["high"] - (mean + 1.96 * spread)) < 0.25 * spread
    assert evaluation.paired_bootstrap(spark.createDataFrame([], "q string, delta double"), "q").count() == 0


def test_exact_quantiles_of_ties_nulls_and_many_values(spark):
    import numpy as np
    from sievework.operators import evaluation

    g = np.random.default_rng(0)
    rows = [("many", float(x)) for x in g.integers(0, 5000, 20_000)] + [("tied", 3.0)] * 50 + [("one", 7.0), ("none", None), (None, 1.0), (None, 2.0), ("two", 1.0), ("two", 2.0), ("two", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["least"], r["p"]) for r in evaluation.quantiles(frame, "k", "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for k in ("many", "tied", "one", "two", None):
        v = [x for n, x in rows if n == k and x is not None]
        assert got[k][0] == len(v) and got[k][1] == min(v) and np.allclose(got[k][2], np.quantile(v, [0, 0.5, 0.95, 1]))
    assert got["none"] == (0, None, None)


def test_versions_are_published_whole_and_outlive_the_session(spark, tmp_path):
    from sievework.operators.store import Conflict, VersionedTable

    store = lambda: VersionedTable(spark, f"file://{tmp_path}/t", "k string, v int", "k", compact_after=3)
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    assert store().latest() is None
    for i in range(5):
        assert store().publish(frame(("a", i), (f"b{i}", i))) == i
    assert {tuple(r) for r in store().latest().collect()} == {("a", 4), *((f"b{i}", i) for i in range(5))}
    assert store().read(3).count() == 5 and store().read(4).count() == 2  # the fourth version holds all rows
    assert {tuple(r) for r in store().latest(1).collect()} == {("a", 1), ("b0", 0), ("b1", 1)}
    with pytest.raises(Conflict):
        store().publish(frame(("z", 1)), 4)
    assert store().versions() == [0, 1, 2, 3, 4] and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".staged")]


def test_registry_goes_on_in_a_new_session_and_refuses_duplicates(spark, tmp_path):
    from sievework.operators.store import VersionedTable

    def stream(folder="r", unique=True):
        store = VersionedTable(spark, f"file://{tmp_path}/{folder}", "k string, d int, v string, content_sha256 string", "k")
        return upserts.RegistryStream(Scratch(spark), "k", ["d"], F.col("v"), unique=unique, store=store)

    batch = lambda rows: spark.createDataFrame(rows, "k string, d int, v string")
    stream()(batch([("a", 1, "x"), ("b", 1, "y")]), 0)
    later = stream()
    later(batch([("a", 2, "x"), ("c", 2, "n")]), 1)
    assert {(x["k"], x["state"]) for x in later.states[1].collect()} == {("a", "unchanged"), ("c", "added")}
    with pytest.raises(upserts.Duplicate):
        stream()(batch([("d", 3, "x"), ("d", 4, "x")]), 2)
    with pytest.raises(upserts.Regression):
        stream()(batch([("a", 1, "x")]), 2)
    stream()(batch([("a", 9, "again")]), 1)  # that batch is there already
    assert {(x["k"], x["d"]) for x in stream().store.latest().collect()} == {("a", 2), ("b", 1), ("c", 2)}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from sievework.operators import scratch as module

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        module.checkpoint_dir(Session())


def test_cells_reach_their_recall_under_a_filter(spark, monkeypatch):
    import numpy as np
    from sievework.operators import vector

    monkeypatch.setattr(vector, "ROW_BLOCK", 50)
    g = np.random.default_rng(2)
    m = np.repeat(g.standard_normal((40, 16)), 50, axis=0) + 0.4 * g.standard_normal((2000, 16))
    rows = spark.createDataFrame([(i, [float(x) for x in v], i % 2) for i, v in enumerate(m)], "vec_id long, e array<float>, odd int")
    asked, allowed = rows.where("vec_id % 50 = 0"), F.col("odd") == 0
    centres, probes = vector.fit_cells(rows, "vec_id", "e", 10)
    exact = vector.exact_top_k(asked, rows.where(allowed), "vec_id", "e", 10)
    near = vector.cell_top_k(asked, rows, "vec_id", "e", centres, 10, probes, allowed)
    found = vector.recall(exact, near, "query_id", "vec_id").agg(F.avg("recall").alias("r"), F.count(F.lit(1)).alias("n")).first()
    assert found["n"] == 40 and found["r"] >= 0.95 and probes < len(centres)
    assert near.count() == 400 and near.where("vec_id % 2 = 1").count() == 0
    none = rows.limit(0)
    assert vector.fit_cells(none, "vec_id", "e", 10)[1] == 0 and vector.cell_top_k(asked, none, "vec_id", "e", np.empty((0, 0)), 10, 1).count() == 0


def test_review_picks_cycle_through_grades(spark):
    from sievework.plans.extraction_queries import pick_for_review

    rows = [(0, "c1", "t1"), (0, "c1", "t2"), (1, "c1", "t1"), (1, "c2", "t2"), (1, "c2", "t3"), (2, "c1", "t1"), (0, "c9", "t9")]
    frame = spark.createDataFrame(rows, "grade int, case_id string, trial_id string")
    got = [tuple(r) for r in pick_for_review(frame, ["case_id", "trial_id"]).orderBy("place").collect()]
    assert got == [(1, 0, "c1", "t1"), (2, 1, "c2", "t2"), (3, 0, "c9", "t9"), (4, 1, "c2", "t3")]
    assert pick_for_review(frame.limit(0), ["case_id", "trial_id"]).count() == 0


def test_numeric_limits():
    text = "Age 18 to 65 years; hemoglobin at least 9 g/dL, BMI between 30 and 20 kg/m2, HbA1c <= 7.5 %"
    assert [c[:5] for c in X.numeric_limits(text)] == [
        ("age", "range", 18.0, 65.0, "year"), ("hemoglobin", "ge", 9.0, None, "g/dL"), ("hba1c", "le", 7.5, None, "%"),
    ]


def test_registry_stream_fails_on_regression_and_keeps_absent_keys(spark):
    scratch = Scratch(spark)
    batch = lambda rows: spark.createDataFrame(rows, "k string, d int, v string")
    s = upserts.RegistryStream(scratch, "k", ["d"], F.col("v"))
    s(batch([("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")]), 0)
    s(batch([("a", 2, "x"), ("c", 2, "n"), ("c", 3, "m")]), 1)
    assert {(x["k"], x["state"]) for x in s.states[1].collect()} == {("a", "unchanged"), ("c", "added")}
    assert {(x["k"], x["d"]) for x in s.versions[1].collect()} == {("a", 2), ("b", 1), ("c", 3)} and s.watermarks[1] == 3
    with pytest.raises(upserts.Regression):
        s(batch([("a", 1, "q"), ("b", 9, "q")]), 2)
    assert max(s.versions) == 1
    s(batch([("a", 2, "new")]), 1)  # the batch runs again, from the version before it
    assert {(x["k"], x["v"]) for x in s.versions[1].collect()} == {("a", "new"), ("b", "y")}


def test_classify(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x")], "k string, d int, v string")
    assert [x["state"] for x in registry.classify(rows, "k", ["d"], F.col("v")).orderBy("k", "d").collect()] == ["added", "unchanged", "changed", "added"]


def record(i, inner=None):
    return f"<clinical_study><id_info><nct_id>{inner or i}</nct_id></id_info></clinical_study>"


def test_archives_are_checked_member_by_member(spark, tmp_path):
    good, other = "NCT00000001", "NCT00000002"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr(f"d/{good}.xml", record(good))
        z.writestr(f"{other}.xml", record(other, good))
        z.writestr("../NCT00000003.xml", record("NCT00000003"))
        z.writestr("NCT00000004.xml", "<!DOCTYPE x>" + record("NCT00000004"))
        z.writestr("NCT00000005.xml", "<a")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr(f"{good}.xml", record(good))
    (tmp_path / "c.zip").write_bytes(buffer.getvalue())
    members = xmlrecords.archive_members(spark, str(tmp_path))
    judged = spark.createDataFrame([(good,), ("NCT00000009",)], "trial_id string")
    assert {(x["issue"], x["rows"]) for x in xmlrecords.validate_corpus(members, judged).collect()} == {
        ("id_differs_from_name", 1), ("unsafe_path", 1), ("declares_entities", 1), ("not_xml", 1), ("not_an_archive", 1), ("repeated_id", 1), ("judged_but_missing", 1),
    }


def test_topics():
    assert xmlrecords.load_topics(b'<topics><topic number="2"> a <b>c</b>\n</topic></topics>') == [{"topic_id": "2", "text": "a c", "locator": "/topics/topic[1]"}]
    with pytest.raises(ValueError, match="1: number '0'; 2: no text; 4: number 3 again"):
        xmlrecords.load_topics(b'<topics><topic number="0">x</topic><topic number="1"> </topic><topic number="3">y</topic><topic number="3">z</topic></topics>')
    with pytest.raises(ValueError):
        xmlrecords.load_topics(b"<!DOCTYPE a><topics/>")


def test_entry_without_the_optional_subpackage(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "sievework.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert entry.llm_queries is None and "hybrid_topk" in entry.queries()
    assert not any(name.startswith("p") and name[1:2].isdigit() and not name.startswith("p4_") for name in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_studies_of_raw_records_are_written_and_validated(spark, tmp_path):
    from sievework.plans import profile_queries as P
    from test_nested import SCHEMA, raw, row

    ids = spark.createDataFrame([(1, "NCT90000001", "A"), (2, "NCT90000002", None), (3, "NCT90000003", "B")], "record_id long, trial_id string, overall_status string")
    rows = [row(1, None, conditions=["a", None, "b"]), row(2, raw(conditionsModule=json.dumps({"conditions": ["c & d", None, "e"]}))), row(3, "{damaged")]
    spark.createDataFrame(rows, SCHEMA).join(ids, "record_id").write.parquet(f"{tmp_path}/inspection.parquet")
    pairs = [(i, f"c{i}", f"NCT9000000{i}", 1) for i in range(1, 5)]
    spark.createDataFrame(pairs, "pair_id long, case_id string, trial_id string, grade int").selectExpr(
        "*", "'s' sampler", "1 dense_rank", "1 bm25_rank", "0.5D dense_score", "0.5D bm25_score", "0.5D mining_rrf", "'r' reason", "1L source_line",
        "timestamp'2031-01-01' mined_at", "timestamp'2031-01-01' delivered_at",
    ).write.parquet(f"{tmp_path}/hard_negatives.parquet")
    got = {x["record_id"]: (x["overall_status"], x["conditions"], x["n_conditions"]) for x in P.xml_extract_all(spark, str(tmp_path)).collect()}
    assert got == {1: ("A", "a b", 2), 2: ("", "c & d e", 2), 3: ("B", "", 0)}
    assert {(x["issue"], x["rows"]) for x in P.corpus_validate(spark, str(tmp_path)).collect()} >= {("judged_but_missing", 1)}

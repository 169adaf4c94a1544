import random

from pyspark.sql import functions as F

from sievework.llm import subjects

TERMS = {
    "heart": ["cardiac rhythm", "aortic valve", "heart failure", "coronary flow", "troponin level"],
    "lung": ["airway pressure", "chronic cough", "inhaler usage", "oxygen saturation", "sputum volume"],
    "skin": ["itch score", "plaque area", "hair growth", "lesion count", "acne grade"],
}


def corpus(n, seed=0):
    r = random.Random(seed)
    name = lambda: "".join(r.choice(["lo", "ri", "ma", "su"]) for _ in range(4)).capitalize()

    def main(s):
        a, b = r.sample(TERMS[s], 2)
        return r.choice([f"At {name()}, {a} and {b} were measured.", f"The team in {name()} expected better {a}.", f"Visit 3 covers {a} in {name()}."])

    docs, labels, truth = [], [], {}
    for i in range(n):
        own = r.sample(sorted(TERMS), 2 if r.random() < 0.25 else 1) if i % 10 else []
        text = [main(s) for s in own for _ in range(r.randrange(3, 6))] or [f"The desk in {name()} is open for {i} hours.", "Please return the sheet."]
        if own and r.random() < 0.4:
            text.append(f"A relative had {r.choice(TERMS[r.choice([t for t in TERMS if t not in own])])}, which played no role here.")
        docs.append((i, " ".join(text), r.choice(["s1", None])))
        truth[i] = set(own)
        if own and i < n // 2:
            labels.append((i, r.choice(own) if r.random() < 0.95 else r.choice(sorted(TERMS))))
    return docs, labels, truth


def frames(spark, docs, labels, areas):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("subject", "own", "key")})
    return d, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(a,) for a in areas], "subject string")


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(600)
    docs += [(9000, None, "s1"), (9001, "  ", None), (9002, "", "s1")]
    labels += labels[:20] + [(5, "unknown"), (None, "heart"), (77777, "skin"), (3, None)]
    got = {(x["doc_id"], x["subject"]) for x in subjects.assign_subjects(*frames(spark, docs, labels, [*TERMS, None, "heart"])).collect()}
    held = range(300, 600)
    want = {(i, s) for i in held for s in truth[i]}
    mine = {p for p in got if p[0] in held}
    assert len(mine & want) / len(mine) > 0.95 and len(mine & want) / len(want) > 0.9
    assert not any(d >= 9000 for d, _ in got)


def test_without_labels_or_documents(spark):
    docs, labels, _ = corpus(20)
    assert subjects.assign_subjects(*frames(spark, docs, [], TERMS)).count() == 0
    assert subjects.assign_subjects(*frames(spark, docs, labels, [])).count() == 0
    assert subjects.assign_subjects(*frames(spark, [], [], TERMS)).count() == 0


def test_any_number_of_subjects(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(subjects, "fit", lambda texts, sources, labels, names: seen.append(names))
    docs, labels, _ = corpus(20)
    subjects.assign_subjects(*frames(spark, docs, labels, [f"s{i:04}" for i in range(1500)]))
    assert len(seen[0]) == 1500


def test_second_subjects_without_labels_are_found():
    # Documents of two subjects carry the label of one of them only.
    docs, _, truth = corpus(900, 3)
    r = random.Random(1)
    sample = [(t, s, {r.choice(sorted(truth[i]))}) for i, t, s in docs[:600] if truth[i]]
    model = subjects.fit([t for t, _, _ in sample], [s for _, s, _ in sample], [own for *_, own in sample], sorted(TERMS))
    found = model.predict([t for _, t, _ in docs[600:]], [s for *_, s in docs[600:]])
    want = {(i, s) for i, _, _ in docs[600:] for s in truth[i]}
    got = {(i, s) for (i, _, _), own in zip(docs[600:], found) for s in own}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_beam_of_a_batch_is_that_of_each_document():
    docs, labels, truth = corpus(200, 4)
    model = subjects.fit([t for _, t, _ in docs], [s for *_, s in docs], [truth[i] for i, _, _ in docs], sorted(TERMS))
    texts, sources = [t for _, t, _ in docs[:40]], [s for *_, s in docs[:40]]
    assert model.predict(texts, sources) == [model.predict([t], [s])[0] for t, s in zip(texts, sources)]
    assert all(len(own) <= subjects.MOST_SUBJECTS for own in model.predict(texts, sources))


def test_very_long_text(spark):
    docs, labels, _ = corpus(300)
    docs.append((5000, ("Visit 3 covers itch score in Lorima. " * 20_000), None))
    got = {x["subject"] for x in subjects.assign_subjects(*frames(spark, docs, labels, TERMS)).where("doc_id = 5000").collect()}
    assert got == {"skin"}

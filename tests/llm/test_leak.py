import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sievework.llm import leak


def words(text):
    import re

    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text or "").casefold())
    return re.findall(r"[^\W_]+", "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf")))


def brute(docs, items, n=12):
    runs = {}
    for i, text in items:
        w = words(text)
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, text in docs for w in [words(text)] for k in range(len(w) - n + 1) for i in runs.get(tuple(w[k : k + n]), ())}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["a", "of", "the", "weekly", "Ärzte", "straße", "ﬁbre", "x1"] + ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 10))) for _ in range(40)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(r.randrange(5, 60)))) for i in range(30)] + [(50, None), (51, ""), (52, "a b c d e f g h i j k l m"), (53, "one two"), (0, None)]
    docs = []
    for i in range(120):
        w = say(r.randrange(0, 80))
        if r.random() < 0.6:
            source = (r.choice(items)[1] or "").split()
            a = r.randrange(0, max(1, len(source) - 8))
            part = source[a : a + r.randrange(9, 30)]
            if r.random() < 0.4 and part:
                part[r.randrange(len(part))] = "changed"
            w += [p.upper() if r.random() < 0.2 else p for p in part] + say(r.randrange(0, 30))
        docs.append((i, r.choice([" ", ", ", "\n- ", " ​"]).join(w)))
    docs += [(500, None), (501, " "), (502, "A b-c, d e f g h i j k l m!"), (503, "zz " * 40_000 + items[3][1] + " zz" * 40_000), (503, items[3][1])]
    return docs, items


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_found_matches_brute_force(spark, monkeypatch, edits):
    monkeypatch.setattr(leak, "STEP_CHARS", 3000)
    docs, items = corpus(edits)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "item", "k", "t")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("key", "k", "t")})
    got = {(x["doc_id"], x["item_id"]) for x in leak.leaked_items(d, i, edits=edits).collect()}
    assert got == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_CHARS", 400)
    docs, items = corpus(9)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in leak.leaked_items(d, i).collect()} == brute(docs, items)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leak.leaked_items(d, i).count() == 0
    assert leak.leaked_items(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), i).count() == 0

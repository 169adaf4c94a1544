import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import chunks


def make(seed):
    r = random.Random(seed)
    out = ["x" * 1000, "x" * 1001, "𝛼" * 2500, "á" * 900, " " * 1500, "\r\n" * 900, "", None, "word " * 199 + "end", "\t\n" * 800, "👩‍⚕️" * 700]
    for _ in range(25):
        parts = []
        while sum(map(len, parts)) < r.randrange(900, 6000):
            parts.append("".join(r.choice("abcdefg é𝛼") for _ in range(r.randrange(1, 120))) + r.choice([". ", "; ", ", ", " ", "\n", "\n\n", "\r\n\r\n", "! ", "… "]))
        out.append("".join(parts))
    return out


def test_pieces_cover_overlap_and_stay_below_the_limit(spark):
    texts = make(1)
    rows = [(i, t, [None, t, "short"], "clash") for i, t in enumerate(texts)] + [(99, None, None, "clash")]
    frame = spark.createDataFrame(rows, "id long, body string, items array<string>, piece string").withColumn("text", F.lit("clash"))
    got = {}
    for x in chunks.split_items(frame, "id", ["body"], ["items"]).collect():
        got.setdefault((x["id"], x["field_name"], x["item_no"]), []).append((x["piece_no"], x["start_at"], x["end_at"], x["piece"]))
    want = {(i, f, n): t for i, t in enumerate(texts) if t and len(t) > 1000 for f, n in (("body", 0), ("items", 1))}
    assert set(got) == set(want)
    for key, text in want.items():
        pieces = sorted(got[key])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and len(pieces) >= 2
        assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
        for _, a, b, piece in pieces:
            assert piece == text[a:b] and len(piece) <= 1000
        for before, after in zip(pieces, pieces[1:]):
            assert 80 <= before[2] - after[1] <= 200


def cut(spark, text):
    frame = spark.createDataFrame([(1, text)], "id long, body string")
    return [x["piece"] for x in chunks.split_items(frame, "id", ["body"], []).orderBy("piece_no").collect()]


def test_strongest_boundary_wins(spark):
    text = "a" * 500 + ".\n\n" + "b b. " * 200
    assert cut(spark, text)[0] == "a" * 500 + ".\n\n"
    sentence = ("c" * 60 + ". ") * 30
    assert all(p.endswith(". ") for p in cut(spark, sentence))


@pytest.mark.parametrize("words", [
    ["a" * 299, "b" * 700, "c" * 600],  # only a boundary before the usual ones
    ["a" * 970, "b" * 900, "c" * 500],  # behind them, in the first piece and later
    ["a" * 700, "b" * 49, "c" * 915, "d" * 300],  # nearer than the overlap is long
    ["a" * 150, "b" * 880, "c" * 905],  # the end in reach
])
def test_no_word_is_cut_with_a_boundary_in_reach(spark, words):
    text = " ".join(words)
    pieces = cut(spark, text)
    assert all(p.endswith(" ") for p in pieces[:-1]) and pieces[-1].endswith(words[-1][-80:])
    assert all(len(p) <= 1000 for p in pieces)
    frame = spark.createDataFrame([(1, text)], "id long, body string")
    rows = chunks.split_items(frame, "id", ["body"], []).orderBy("piece_no").collect()
    for before, after in zip(rows, rows[1:]):
        assert 80 <= before["end_at"] - after["start_at"] <= 200 and before["start_at"] < after["start_at"]
    assert all(x["piece"] == text[x["start_at"]:x["end_at"]] for x in rows) and rows[-1]["end_at"] == len(text)


def test_marks_and_line_ends_stay_together(spark):
    for piece in cut(spark, "é" * 1200):
        assert not piece.startswith("́")
    for piece in cut(spark, "ab" * 399 + "x\r\n" + "ab" * 600):
        assert not piece.startswith("\n")


def test_bad_overlap():
    with pytest.raises(ValueError):
        chunks.pieces_of(F.lit("x"), 300, (80, 200))

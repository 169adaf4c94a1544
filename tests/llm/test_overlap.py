import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import overlap
from sievework.operators.scratch import Scratch


def brute(rows):
    import re

    forms = {}
    for key, split, text in rows:
        n = " ".join(re.findall(r"\w+", (text or "").casefold()))
        if n:
            forms[key] = (split, {n[i : i + 5] for i in range(max(1, len(n) - 4))})
    out = set()
    for a, (s, x) in forms.items():
        for b, (t, y) in forms.items():
            if s == "train" and t in ("dev", "test") and 10 * len(x & y) >= 8 * len(x | y):
                out.add((a, b))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeghi") for _ in range(r.randrange(2, 9))) for _ in range(60)] + ["straße", "ÄRZTE", "naïve", "東京"]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(5, 60))) for _ in range(40)]
    rows = []
    for i in range(150):
        text = r.choice(base)
        if r.random() < 0.7:
            w = text.split()
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            text = (" " if r.random() < 0.5 else ",  ").join(w)
        rows.append((f"{i:04}", r.choice(["train", "train", "dev", "test"]), text.upper() if i % 9 == 0 else text))
    rows += [("a1", "train", None), ("a2", "dev", ""), ("a3", "dev", "  ... "), ("a4", "train", "abc"), ("a5", "test", "ABC!"), ("a6", "dev", "abd"),
             ("a7", "other", base[0]), ("a8", None, base[0]), ("a9", "train", base[1] * 300), ("b0", "test", base[1] * 300)]
    return rows


@pytest.mark.parametrize("shard", [2_000_000, 6_000, 400])
def test_pairs_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(overlap, "SHARD_CHARS", shard)
    monkeypatch.setattr(overlap, "TRAIN_CHARS", shard * 2)
    monkeypatch.setattr(overlap, "MOST_HITS", 5000)
    monkeypatch.setattr(overlap, "MOST_CELLS", 500)
    monkeypatch.setattr(overlap, "MOST_LANES", 7)
    rows = corpus(shard)
    frame = spark.createDataFrame(rows, "topic_id string, split string, text string").withColumns({c: F.lit(1) for c in ("key", "norm", "class", "band", "shard")})
    got = [(x["train_key"], x["eval_key"]) for x in overlap.overlaps(frame, Scratch(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_repeated_rows_and_empty(spark):
    rows = [("1", "train", "the same text of some length")] * 3 + [("2", "dev", "The same text, of some length")] * 2
    frame = spark.createDataFrame(rows, "topic_id string, split string, text string")
    assert [(x["train_key"], x["eval_key"]) for x in overlap.overlaps(frame, Scratch(spark)).collect()] == [("1", "2")]
    assert overlap.overlaps(frame.limit(0), Scratch(spark)).count() == 0
    assert overlap.overlaps(frame.where("split = 'train'"), Scratch(spark)).count() == 0


def test_index_finds_every_occurrence():
    import numpy as np

    r = random.Random(1)
    texts = ["".join(r.choice("abc d") for _ in range(r.randrange(0, 80))) for _ in range(30)] + ["aaaaaaaaaaaa"] * 3 + ["", "a"]
    index = overlap.TextIndex.unpack(overlap.TextIndex(texts).pack())
    for size in (1, 2, 5):
        patterns = ["".join(r.choice("abc dx") for _ in range(size)) for _ in range(60)]
        slots = index.slots(np.array([[ord(c) for c in p] for p in patterns]))
        for p, lo, hi in zip(patterns, *index.search(slots)):
            want = sorted(i for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(p, k))
            assert sorted(index.text_of[lo:hi].tolist()) == want
    assert not {"texts", "order"} & {k for k, v in vars(index).items() if isinstance(v, list)}


def brute_matches(a, others):
    out = {}
    for i, x in enumerate(a):
        for j, y in enumerate(others):
            g, h = overlap.stretches(x), overlap.stretches(y)
            if len(x) >= 5 and 10 * len(g & h) >= 8 * len(g | h):
                spans = {p for k in range(len(x) - 4) if x[k : k + 5] in h for p in range(k, k + 5)}
                out[i, j] = (len(g & h), len(g | h), len(spans))
    return out


def found_matches(a, shards, similarity=0.8):
    indexes = [overlap.TextIndex.unpack(overlap.TextIndex(s).pack()) for s in shards]
    first = [sum(map(len, shards[:k])) for k in range(len(shards))]
    return {(i, first[k] + j): tuple(rest) for i, k, j, *rest in overlap.matches(indexes, a, similarity)}


@pytest.mark.parametrize("table", [4_000_000, 0])
def test_counts_and_spans_of_maximal_matches(monkeypatch, table):
    monkeypatch.setattr(overlap, "MOST_SHIFTS", table)
    r = random.Random(4)
    words = ["".join(r.choice("abcde京") for _ in range(r.randrange(2, 5))) for _ in range(40)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(2, 50))) for _ in range(20)]

    def near(text):
        w = text.split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        return " ".join(w)

    a, b = [near(r.choice(base)) for _ in range(80)], [near(r.choice(base)) for _ in range(60)]
    b = [t for t in b if len(t) >= 5]
    want = brute_matches(a, b)
    assert len(want) > 50 and found_matches(a, [b[:20], b[20:]]) == want


def test_five_thousand_characters_and_wide_alphabets():
    r = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 8000)]
    base = ["".join(r.choice(letters) for _ in range(400)) for _ in range(30)]
    a = base + [t[:200] + r.choice(letters) + t[200:] for t in base] + ["".join(r.choice(letters) for _ in range(300)) for _ in range(5)]
    index = overlap.TextIndex(base)
    assert len(index.alphabet) > 5000 and index.last.dtype.itemsize == 2
    want = brute_matches(a, base)
    assert len(want) == 60 and found_matches(a, [base]) == want


def test_texts_too_long_for_one_index(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GIANT_CHARS", 100)
    rows = corpus(9)
    frame = spark.createDataFrame(rows, "topic_id string, split string, text string")
    assert {(x["train_key"], x["eval_key"]) for x in overlap.overlaps(frame, Scratch(spark)).collect()} == brute(rows)


def test_a_text_that_most_topics_have(spark):
    rows = [(f"t{i}", "train", "one text that very many topics have") for i in range(300)] + [("d1", "dev", "One text that very many topics have."), ("d2", "dev", "other words")]
    frame = spark.createDataFrame(rows, "topic_id string, split string, text string")
    got = [(x["train_key"], x["eval_key"]) for x in overlap.overlaps(frame, Scratch(spark), hot_rows=50).collect()]
    assert sorted(got) == sorted((f"t{i}", "d1") for i in range(300))


def test_one_index_is_held_at_a_time():
    import weakref

    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    b = [" ".join(r.choice(words) for _ in range(40)) for _ in range(60)]
    a = [t[: r.randrange(len(t) - 20, len(t))] for t in b]
    alive, most = weakref.WeakSet(), []

    def indexes():
        for k in range(0, 60, 5):
            index = overlap.TextIndex.unpack(overlap.TextIndex(b[k : k + 5]).pack())
            alive.add(index)
            most.append(len(alive))
            yield index
            del index

    got = {(i, k * 5 + j): tuple(rest) for i, k, j, *rest in overlap.matches(indexes(), a, 0.8)}
    assert len(got) >= 60 and got == brute_matches(a, b) and max(most) <= 2


def test_blocks_that_meet_more_shards_than_one_task_takes(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_CHARS", 400)
    monkeypatch.setattr(overlap, "TRAIN_CHARS", 3_000)
    monkeypatch.setattr(overlap, "MOST_SHARDS", 2)
    rows = corpus(12)
    frame = spark.createDataFrame(rows, "topic_id string, split string, text string")
    got = [(x["train_key"], x["eval_key"]) for x in overlap.overlaps(frame, Scratch(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8, 1.0])
def test_sketches_lose_no_pair(monkeypatch, similarity):
    monkeypatch.setattr(overlap, "MOST_CELLS", 300)
    monkeypatch.setattr(overlap, "SHARD_CHARS", 700)
    r = random.Random(7)
    base = ["".join(r.choice("ab") for _ in range(r.randrange(5, 60))) for _ in range(20)] + ["".join(r.choice("abcdefgh ") for _ in range(r.choice((30, 300)))) for _ in range(20)]

    def near(t):
        at = r.randrange(len(t))
        return t[:at] + r.choice(["", "x", "ab", t[: r.randrange(20)]]) + t[at + r.randrange(3) :]

    a, b = ([near(r.choice(base)) for _ in range(120)] for _ in range(2))
    a, b = ([t for t in texts + ["aaaaaaaa", "aaaaa" * 30] if len(t) >= 5] for texts in (a, b))
    part = round(similarity * 10)
    sets = [[overlap.stretches(t) for t in texts] for texts in (a, b)]
    want = {(i, j) for i, x in enumerate(sets[0]) for j, y in enumerate(sets[1]) if 10 * len(x & y) >= part * len(x | y)}
    assert len(want) > 10 and set(found_matches(a, [b[:50], b[50:]], similarity)) == want


def test_texts_too_long_for_one_index_meet_shorter_ones(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GIANT_CHARS", 100)
    text = "a patient of forty years with a rash on both arms asks for a study near home or in the next town"
    long, short = text + " by car", text[:-1]
    assert len(short) < 100 < len(long)
    rows = [("1", "train", long), ("2", "dev", short), ("3", "train", short), ("4", "test", long), ("5", "train", "one two " * 3), ("6", "dev", "one two " * 40),
            ("7", "train", "six ten " * 40), ("8", "test", "six ten " * 4), ("9", "dev", "no other text has these words")]
    want = brute(rows)
    assert {("1", "2"), ("3", "4"), ("5", "6"), ("7", "8")} <= want
    for some in (rows, rows[:2], rows[2:4]):
        frame = spark.createDataFrame(some, "topic_id string, split string, text string")
        got = [(x["train_key"], x["eval_key"]) for x in overlap.overlaps(frame, Scratch(spark)).collect()]
        assert sorted(got) == sorted(brute(some))

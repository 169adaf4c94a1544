import os
import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import encode

PATH = encode.vocabulary()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
TEXTS = ["", "a", " ", "\n\n \t x", "<|endoftext|>", "don't I'LL we've", "naïve Ünïcode ﬁ", "مرحبا بالعالم", "東京都 第七号", "👩🏽‍⚕️👨‍👩‍👧", "a" * 5000, "ab" * 3000, "\x00\x01﻿​",
         "1234567890" * 50, "   leading", "trailing   ", "x" * 70 + " " + "y" * 70, "   ", "zzzzqqqqxxxxjjjj" * 40]


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return [list(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_as_the_public_library(spark):
    r = random.Random(4)
    texts = TEXTS + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 1500), r.randrange(0x4E00, 0x4F00), 0x1F600 + r.randrange(60)])) for _ in range(r.randrange(1, 200))) for _ in range(150)]
    rows = [(i, t, [9], "k") for i, t in enumerate(texts)] + [(900, None, None, None), (900, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, key string").withColumn("extra", F.lit(1))
    got = encode.encode_corpus(frame).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x["ids"] for x in got}
    assert by[900] == [] and [by[i] for i in range(len(texts))] == reference(texts)


def test_round_trip_and_caches():
    e = encode.Encoder(PATH)
    names = {i: t for t, i in e.rank.items()}
    for text in TEXTS:
        ids = e.encode(text)
        assert "".join(names[i] for i in ids).encode("latin-1").decode() == text
        assert e.encode(text) == ids
    assert all(e.backtrack(t.encode().decode("latin-1")) == [n] or len(e.merge(t)) > 1 for t, n in list(e.rank.items())[:300] if t.isascii())


def test_empty_table(spark):
    assert encode.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0

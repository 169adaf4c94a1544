import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import components, splits
from sievework.operators.scratch import Scratch

PAIRS = "pair_id long, case_id string, trial_id string"
MATCHES = "kind string, left_id string, right_id string, is_match boolean"


def brute(pairs, matches):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def key(kind, value):
        if value is None:
            return None
        bare = "".join(value.split())
        return (bare.lower() if kind == "case" else bare.upper()) or None

    for _, c, t in pairs:
        for k, v in (("case", c), ("trial", t)):
            if key(k, v):
                find(key(k, v))
    for kind, a, b, match in matches:
        a, b = key(kind, a), key(kind, b)
        for x in (a, b):
            if x:
                find(x)
        if a and b and match:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in parent}


def frames(spark, pairs, matches):
    # Extra columns whose names clash with those used inside.
    p = spark.createDataFrame(pairs, PAIRS).withColumns({c: F.lit("x") for c in ("a", "b", "v", "u", "record_id", "component", "split", "node")})
    m = spark.createDataFrame(matches, MATCHES).withColumns({c: F.lit("x") for c in ("a", "b", "linked", "group_id", "n")})
    return p, m


@pytest.mark.parametrize("hot", [10**9, 3])
def test_groups_match_brute_force(spark, hot):
    r = random.Random(3)
    pairs = [(i, f"inv:{r.randrange(40)}", f"NCT{r.randrange(60)}") for i in range(120)]
    pairs += [(200, None, "NCT1"), (201, " ", None), (202, " Inv: 7 ", "nct 5")]
    matches = [("trial", f"NCT{r.randrange(90)}", f"nct{r.randrange(90)}", r.choice([True, True, False, None])) for _ in range(70)]
    # A long chain, a star, a self-match, reversed and repeated rows, blank ids, an unknown kind.
    matches += [("case", f"inv:{i}", f"INV:{i + 1}", True) for i in range(100, 130)]
    matches += [("trial", "NCT0", f"NCT{i}", True) for i in range(300, 340)]
    matches += [("case", "inv:1", "inv:1", True), ("trial", "NCT1", "NCT2", True), ("trial", "NCT2", "NCT1", True), ("case", "", "inv:3", True), ("case", None, "inv:4", True)]
    p, m = frames(spark, pairs, matches)
    got = [tuple(x) for x in components.record_groups(p, m, Scratch(spark), hot_rows=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(pairs, matches)


def test_unknown_kind_and_empty(spark):
    p, m = frames(spark, [], [("other", "a", "b", True), (None, "a", "b", True)])
    assert components.record_groups(p, m, Scratch(spark)).count() == 0
    p, m = frames(spark, [], [])
    assert components.record_groups(p, m, Scratch(spark)).count() == 0
    assert splits.bundles(splits.assign_splits(p, m, Scratch(spark))[1]).count() == 0


def bundles_brute(pairs, matches):
    groups = dict(brute(pairs, matches))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    ends = {}
    for i, c, t in pairs:
        c = "".join(c.split()).lower() if c and c.strip() else None
        t = "".join(t.split()).upper() if t and t.strip() else None
        ends[i] = (c, t)
        if c and t:
            parent[find(groups[c])] = find(groups[t])
    smallest = {}
    for c, t in ends.values():
        if c:
            root = find(groups[c])
            smallest[root] = min(smallest.get(root, c), c)
    return {(i, smallest[find(groups[c or t])]) for i, (c, t) in ends.items() if (c or t) and find(groups[c or t]) in smallest}


@pytest.mark.parametrize("hot", [10**9, 2])
def test_bundles_match_brute_force(spark, hot):
    r = random.Random(5)
    pairs = [(i, f"inv:{r.randrange(80)}", f"NCT{r.randrange(120)}") for i in range(90)]
    pairs += [(200, None, "NCT500"), (201, "", ""), (202, None, "nct 3"), (203, "inv:400", None), pairs[0]]
    matches = [("trial", f"NCT{r.randrange(120)}", f"nct{r.randrange(120)}", True) for _ in range(12)] + [("case", "inv:400", "inv:0000", True)]
    p, m = frames(spark, pairs, matches)
    _, split = splits.assign_splits(p, m, Scratch(spark), hot_rows=hot)
    got = [tuple(x) for x in splits.bundles(split, hot).select("pair_id", "bundle_id").collect()]
    assert len(got) == len(set(got)) and set(got) == bundles_brute(pairs, matches)


def test_shares_and_no_leak(spark):
    pairs = [(i, f"c{i // 2}", f"T{i // 3}") for i in range(3000) if i % 7]
    p, _ = frames(spark, pairs, [])
    table, split = splits.assign_splits(p, None, Scratch(spark))
    rows = split.collect()
    for side in ("c", "t"):
        seen = {}
        for x in rows:
            assert seen.setdefault(x[side], x["split"]) == x["split"]
    share = {s: sum(x["split"] == s for x in rows) / len(rows) for s in ("train", "dev", "test")}
    assert abs(share["train"] - 0.6) < 0.02 and abs(share["dev"] - 0.2) < 0.02


def test_later_batches_keep_splits_and_quarantine_conflicts(spark):
    first, _ = frames(spark, [(i, f"c{i}", f"T{i}") for i in range(40)], [])
    scratch = Scratch(spark)
    table, _ = splits.assign_splits(first, None, scratch)
    old = {x["node"]: x["split"] for x in table.collect()}
    a = next(i for i in range(40) if old[f"c|c{i}"] == "train")
    b = next(i for i in range(40) if old[f"c|c{i}"] == "test")
    c = next(i for i in range(40) if i not in (a, b))
    second, _ = frames(spark, [(100, f"c{a}", f"T{b}"), (101, f"c{a}", "T999"), (102, "c500", "T500"), (103, "c501", f"T{c}")], [])
    table, split = splits.assign_splits(second, None, scratch, table)
    new = {x["node"]: x["split"] for x in table.collect()}
    assert all(new[n] == s for n, s in old.items())
    got = {x["pair_id"]: x["split"] for x in split.collect()}
    assert got[100] == "quarantine" and new["t|T999"] == "quarantine"
    assert got[102] in ("train", "dev", "test") and got[103] == old[f"t|T{c}"]


def test_three_batches_in_a_store_give_what_one_table_gives(spark, tmp_path):
    def batch(k):
        return spark.createDataFrame([(100 * k + i, f"c{i % (7 + k)}-{k if i % 3 else 0}", f"t{i}-{k}") for i in range(40)], "pair_id long, case_id string, trial_id string")

    kept, before = None, None
    for k in range(3):
        # A new store object each time, as in a session of its own.
        store = splits.component_store(spark, f"file://{tmp_path}/components")
        stored, pairs = splits.assign_splits(batch(k), None, Scratch(spark), earlier=before, store=store)
        kept, other = splits.assign_splits(batch(k), None, Scratch(spark), kept, earlier=before)
        before = batch(k) if before is None else before.union(batch(k))
        assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in kept.select(stored.columns).collect()}
        assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in other.select(pairs.columns).collect()}
        assert pairs.count() == 40
    assert store.versions() == [0, 1, 2] and store.read(2).count() < stored.count()


def test_no_bundle_in_two_splits_after_a_conflicting_batch(spark):
    pairs = [(i, f"c{i // 2}", f"T{i}") for i in range(80)]
    first, _ = frames(spark, pairs, [])
    scratch = Scratch(spark)
    table, split = splits.assign_splits(first, None, scratch)
    old = {x["pair_id"]: x["split"] for x in split.collect()}
    by = {s: [i // 2 for i in range(0, 80, 2) if old[i] == s] for s in splits.PROPORTIONS}
    # Train joins test by a matched case, dev joins test by a pair; a third batch joins the first conflict to another train part.
    second, matches = frames(
        spark, [(100, f"c{by['dev'][0]}", f"T{2 * by['test'][1]}"), (101, "c900", f"T{2 * by['test'][0]}")], [("case", f"C{by['train'][0]}", f"c{by['test'][0]}", True)]
    )
    table, _ = splits.assign_splits(second, matches, scratch, table)
    third, _ = frames(spark, [(102, f"c{by['train'][1]}", "T900"), (103, f"c{by['test'][0]}", "T900")], [])
    batches = pairs + [(100, f"c{by['dev'][0]}", f"T{2 * by['test'][1]}"), (101, "c900", f"T{2 * by['test'][0]}")]
    seen = None
    for more in ([], [(102, f"c{by['train'][1]}", "T900"), (103, f"c{by['test'][0]}", "T900")]):
        if more:
            table, _ = splits.assign_splits(third, None, scratch, table)
        every, _ = frames(spark, batches + more, [])
        rows = splits.split_pairs(splits.pair_ends(every), table).collect()
        sides = {}
        for x in rows:
            if x["split"] != "quarantine":
                sides.setdefault(x["component"], set()).add(x["split"])
        assert all(len(s) == 1 for s in sides.values())
        new = {x["pair_id"]: x["split"] for x in rows}
        assert all(new[2 * by["train"][0] + k] == "train" and new[2 * by["test"][0] + k] == "quarantine" for k in (0, 1))
        assert all(new[2 * by["dev"][0] + k] == "dev" and new[2 * by["test"][1] + k] == "quarantine" for k in (0, 1))
        assert all(new[i] == s for i, s in old.items() if i // 2 not in (by["test"][0], by["test"][1]))
        assert seen is None or all(new[i] == "quarantine" for i, s in seen.items() if s == "quarantine")
        seen = new


def test_later_batches_make_up_for_a_skewed_one(spark):
    pairs = [(i, "c0" if i < 80 else f"c{i}", f"T{i}") for i in range(100)]
    more = [(i, f"c{i}", f"T{i}") for i in range(100, 200)]
    scratch = Scratch(spark)
    first, _ = frames(spark, pairs, [])
    second, _ = frames(spark, [*more, pairs[5], pairs[90]], [])
    table, _ = splits.assign_splits(first, None, scratch)
    table, _ = splits.assign_splits(second, None, scratch, table, earlier=first)
    every, _ = frames(spark, pairs + more, [])
    rows = splits.split_pairs(splits.pair_ends(every), table).groupBy("split").count().collect()
    assert {x["split"]: round(x["count"] / 200, 1) for x in rows} == {"train": 0.6, "dev": 0.2, "test": 0.2}


def test_bad_proportions(spark):
    p, _ = frames(spark, [(1, "c", "T")], [])
    with pytest.raises(ValueError):
        splits.assign_splits(p, None, Scratch(spark), proportions={"train": 0})

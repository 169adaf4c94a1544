import numpy as np
from pyspark.sql import functions as F

from sievework.llm import neighbors
from sievework.operators.scratch import Scratch


def brute(rows, k):
    ok = [(i, v) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok], np.float32).astype(float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -s[i]))[: min(k, len(ids) - 1)]}


def data(n, seed=0):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((max(1, n // 14), 16))
    rows = [(int(i * 3), [float(x) for x in centres[i % len(centres)] + 0.25 * g.standard_normal(16)]) for i in range(n)]
    same = [float(x) for x in g.standard_normal(16)]
    rows += [(100_000 + i, same) for i in range(25)] + [(200_000 + i, [2 * x for x in same]) for i in range(3)]
    rows += [(1, None), (2, []), (4, [1.0] * 15), (5, [0.0] * 16), (7, [float("nan")] + [1.0] * 15), (8, [float("inf")] + [1.0] * 15), (10, [None] + [1.0] * 15)]
    return rows


def found(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, vectors array<float>").withColumns({c: F.lit(1) for c in ("key", "rep", "node", "vec", "digest")})
    return [(x["vec_id"], x["neighbor_id"]) for x in neighbors.neighbors(frame, Scratch(spark), dimension=16, **more).collect()]


def test_all_in_one_node_is_exact(spark):
    rows = data(150)
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10)


def test_recall_with_small_nodes_and_tiles(spark):
    rows = data(700, 1)
    want = brute(rows, 10)
    got = found(spark, rows, trees=24, cell=120)
    assert len(got) == len(want) and len(set(got) & want) / len(want) >= 0.9


def test_identical_strings_are_tiled_not_dropped(spark):
    # Vectors that differ by length noise only fall on one side of every plane: prefixes can't part them.
    g = np.random.default_rng(2)
    base = g.standard_normal(16)
    rows = [(i, [float(x) for x in base * (1 + 0.1 * i) + 1e-4 * g.standard_normal(16)]) for i in range(90)]
    got = found(spark, rows, trees=2, cell=20)
    assert set(got) == brute(rows, 10)


def test_forest_ascends_in_all_trees_to_enough_candidates():
    g = np.random.default_rng(3)
    centres = g.standard_normal((60, 32))
    m = np.repeat(centres, 20, axis=0) + 0.3 * g.standard_normal((1200, 32))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    forest = neighbors.Forest(unit, 16)
    seen = {}
    for asked, bounds, met in forest.ascend(40):
        for q, a, b in zip(asked, bounds[:-1], bounds[1:]):
            assert q not in seen and q not in met[a:b] and len(set(met[a:b])) == b - a >= 40
            seen[q] = set(met[a:b].tolist())
    assert len(seen) == 1200
    # A vector's candidates are those with its prefix in any tree, at the longest prefixes that give enough.
    codes = np.empty((16, 1200), np.int64)
    for t in range(16):
        codes[t, forest.order[t]] = forest.codes[t]
    for q in range(0, 1200, 97):
        for depth in range(neighbors.TREE_BITS, -1, -1):
            same = set(np.flatnonzero(((codes >> (neighbors.TREE_BITS - depth)) == (codes[:, [q]] >> (neighbors.TREE_BITS - depth))).any(0)).tolist()) - {q}
            if len(same) >= 40:
                break
        assert same == seen[q]


def test_recall_where_candidates_are_few():
    g = np.random.default_rng(4)
    centres = g.standard_normal((600, 64))
    m = np.repeat(centres, 14, axis=0) + 0.4 * g.standard_normal((8400, 64))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    np.fill_diagonal(s, -9)
    ids = np.arange(8400)
    want = {(q, int(j)) for q in range(0, 8400, 7) for j in np.lexsort((ids, -s[q]))[:10]}
    same = neighbors.agreement(float(np.quantile(np.sort(s, 1)[:, -10], 0.1)))
    assert neighbors.candidates_for(8400, same, neighbors.TREES, 10) < 0.05 * 8400
    i, j, _ = neighbors.search_cell(ids, unit, 10, same)
    got = {(int(a), int(b)) for a, b in zip(i, j) if a % 7 == 0}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_sizes_follow_the_similarity_without_a_cap():
    assert neighbors.roots_for(10_000, 0.8) == (0, 1)
    few, many = neighbors.roots_for(10**6, 0.8)[1], neighbors.roots_for(10**9, 0.8)[1]
    assert few < many and (1 - 0.8 ** neighbors.roots_for(10**9, 0.8)[0]) ** many <= neighbors.MISS
    assert neighbors.candidates_for(30_000, 0.65, 64, 10) > 5 * neighbors.candidates_for(30_000, 0.8, 64, 10)


def test_repeated_ids_and_parallel_vectors(spark):
    g = np.random.default_rng(6)
    rows = [(i, [float(x) for x in g.standard_normal(16)]) for i in range(60)]
    rows += [(100 + i, [float(x) * (i + 2) for x in rows[0][1]]) for i in range(30)]
    again = rows + rows[:20] + [(5, [1.0] * 16)]
    got = found(spark, again)
    keys = [i for i, _ in got]
    assert sorted(set(keys)) == sorted({i for i, _ in rows}) and len(got) == len(set(got)) == 10 * len(set(keys))
    assert set(found(spark, rows)) == brute(rows, 10)


def test_few_and_none(spark):
    rows = [(1, [1.0] + [0.0] * 15), (2, [1.0, 1.0] + [0.0] * 14), (3, [-1.0] + [0.0] * 15)]
    assert set(found(spark, rows)) == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 2), (3, 1)}
    assert found(spark, rows[:1]) == [] and found(spark, [(1, None)]) == []
    assert found(spark, rows + rows) and len(found(spark, rows + rows)) == 6

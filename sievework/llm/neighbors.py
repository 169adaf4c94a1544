"""Problem 5: the most similar vectors of every vector, by a hash-prefix forest.

Every tree gives a vector a string of bits, the sides it lies on of random
planes. The vectors of a tree are sorted by these strings, so those that share
a long prefix with a vector stand next to it, and those with a shorter one
around them. A vector descends in all trees to the longest prefixes it shares
with any other vector, and from there ascends in all trees at once, one bit at a
time, until the vectors met in any of them are enough different ones; these are
compared exactly.

*Cells.* Sorted arrays are kept in cells of at most ``CELL`` vectors: a cell is
what shares the first bits of a root, and every vector is in one cell of each
root. So vectors travel once per root and not once per tree, and all trees of a
cell are in one place, where they can ascend together. Cells with too many
vectors are cut at longer prefixes; vectors whose whole root strings agree are
cut into tiles that meet pair by pair, so none is dropped.

*Sizes.* How similar the ``k``-th neighbours are is measured: for at most
``PROBES`` vectors, chosen by hash, against all. Roots and candidates follow
from the similarity that a tenth of them falls below, so that a neighbour that
similar is missed by all roots, and by all trees of a cell, with a probability
of at most ``MISS`` each. Nothing caps either. Where the candidates would be
most of a cell, the cell is compared whole.

Equal vectors are collapsed to one and expanded at the end.

Edge cases: null, short, long, non-finite and all-zero vectors (also with null
elements) are not usable: they get no row and are no neighbours; length doesn't
matter; ties go to the smaller id; with ten or fewer other usable vectors all
of them are neighbours; repeated ids count once, with the vector of the smallest
digest where they differ; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scratch import Scratch
from ..operators.skew import lookup_join

ROOT_BITS, TREE_BITS = 64, 32
K = 10
CELL = 32_768
TREES = 64
LEAST_ROOTS = 3
MISS = 0.01
PROBES = 64
#: The share of a cell from which all of it is compared.
WHOLE = 0.34
SEED = 20310
#: Candidates spelled out at a time.
MOST_PAIRS = 2_000_000


def planes(dimension: int, count: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, count))


def agreement(cosine: float) -> float:
    """The probability that vectors of this cosine lie on the same side of a plane."""
    return 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi


def roots_for(vectors: int, same: float, cell: int = CELL) -> tuple[int, int]:
    """First bits of a cell, and roots for so many vectors."""
    bits = max(0, math.ceil(math.log2(max(1, vectors) / cell)))
    if not bits:
        return 0, 1
    # Crowded cells are cut at longer prefixes than these, so a few roots stand by even where all neighbours are close.
    return bits, max(LEAST_ROOTS, math.ceil(math.log(MISS) / math.log1p(-min(1 - 1e-9, same**bits))))


def candidates_for(vectors: int, same: float, trees: int, k: int) -> int:
    """Candidates among so many vectors: those of the depth at which a neighbour is missed by all trees with ``MISS``."""
    depth = max(0.0, math.log(trees / -math.log(MISS)) / -math.log(same)) if same < 1 else TREE_BITS
    return max(8 * k, math.ceil(trees * vectors * 2.0**-depth))


def usable(vectors: DataFrame, key: str, column: str, dimension: int) -> DataFrame:
    """``(key, v, d)`` of usable vectors; equal vectors share the digest ``d``."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    source = vectors.select(vectors[key].alias("key"), vectors[column].cast("array<float>").alias("v"))
    source = source.where(F.col("key").isNotNull() & (F.size(v) == dimension)).where(finite & F.exists(v, lambda x: x != 0))
    return source.withColumn("d", F.struct(F.xxhash64(v), F.xxhash64(F.lit(1), v)))


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Unit vectors, in double precision, of a column of lists of one length."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    m = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks] or [np.empty(0)]).reshape(-1, dimension).astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def similarity_of_neighbors(reps: DataFrame, dimension: int, k: int, probes: int = PROBES) -> float | None:
    """The cosine that a tenth of the ``k``-th neighbours of the probes falls below; None without neighbours."""
    some = reps.orderBy(F.xxhash64("rep"), "rep").limit(probes).select("v").toArrow()
    if not some.num_rows:
        return None
    asked = reps.sparkSession.sparkContext.broadcast(matrix(some.column(0), dimension))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(asked.value), k + 1), -2.0)
        for part in parts:
            if part.num_rows:
                near = np.concatenate([best, asked.value @ matrix(part.column(0), dimension).T], 1)
                best = np.partition(near, near.shape[1] - k - 1, axis=1)[:, -k - 1 :]
        q, at = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, at])], names=["q", "cosine"])

    found = reps.select("v").mapInArrow(batches, "q int, cosine double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine")))
    # The best of each probe is itself.
    rows = found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("q").agg(F.min("cosine").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").collect()
    return float(np.quantile([r["c"] for r in rows], 0.1)) if rows else None


def hashed(reps: DataFrame, dimension: int, roots: int) -> DataFrame:
    """``(rep, v, tree, hash)``: one row per vector and root; the hash orders like its bits."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = planes(dimension, roots * ROOT_BITS)
        for part in parts:
            n = part.num_rows
            if not n:
                continue
            packed = np.packbits((matrix(part.column(1), dimension) @ sides).reshape(n, roots, ROOT_BITS) > 0, axis=2)
            # Big-endian bits as a signed number with the first bit flipped: signed order is bit order.
            values = (packed.view(">u8").reshape(-1).astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * roots), pa.array(values))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), hashes], names=["rep", "v", "hashes"])

    kind = reps.schema["rep"].dataType.simpleString()
    wide = reps.select("rep", "v").mapInArrow(batches, f"rep {kind}, v array<float>, hashes array<bigint>")
    return wide.select("rep", "v", F.posexplode("hashes").alias("tree", "hash"))


def _prefix(bits: int):
    return F.lit(0).cast("long") if bits <= 0 else F.shiftright(F.col("hash"), ROOT_BITS - bits)


def cells(forest: DataFrame, bits: int, scratch: Scratch, most: int) -> DataFrame:
    """``forest`` with the ``node`` of each row, and ``tiles``: how many its vectors are cut into where prefixes can't.

    Starts at prefixes of ``bits`` and descends, cell by cell, where there are more than twice ``most``.
    """
    keyed = forest.withColumn("node", F.concat_ws(":", "tree", F.lit(bits), _prefix(bits)))
    while True:
        big = keyed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * most)
        if not big.limit(1).count():
            return keyed.withColumn("tiles", F.lit(1))
        big = scratch.save(big)
        if bits >= ROOT_BITS:
            tiles = big.select("node", F.ceil(2 * F.col("n") / most).cast("int").alias("tiles"))
            return lookup_join(keyed, tiles, "node", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        bits = min(ROOT_BITS, bits + 2)
        longer = F.concat_ws(":", "tree", F.lit(bits), _prefix(bits))
        marked = lookup_join(keyed, big.select("node", F.lit(True).alias("big")), "node", "left")
        keyed = scratch.save(marked.withColumn("node", F.when(F.col("big"), longer).otherwise(F.col("node"))).drop("big"))


def tiled(keyed: DataFrame) -> DataFrame:
    """One row per cell and pair of tiles that a vector belongs to; a cell of one tile is itself."""
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    return keyed.withColumn("own", own).select("*", other).select(
        F.concat_ws(":", "node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "v"
    )


class Forest:
    """Sorted arrays of hash strings of the vectors of a cell."""

    def __init__(self, unit: np.ndarray, trees: int):
        # Without what all vectors of the cell share, close ones are told apart as well.
        centred = (unit - unit.mean(0)).astype(np.float32)
        n = len(unit)
        self.order = np.empty((trees, n), np.int32)
        self.place = np.empty((trees, n), np.int32)
        self.codes = np.empty((trees, n), np.uint32)
        sides = planes(unit.shape[1], trees * TREE_BITS, SEED + 1).astype(np.float32)
        for t in range(trees):
            packed = np.packbits(centred @ sides[:, t * TREE_BITS : (t + 1) * TREE_BITS] > 0, axis=1)
            code = packed.view(">u4").reshape(-1).astype(np.int64)
            both = np.sort((code << 31) | np.arange(n))
            self.order[t] = both & ((1 << 31) - 1)
            self.codes[t] = both >> 31
            self.place[t, self.order[t]] = np.arange(n)

    def ranges(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and place of the sorted array, where those with the same prefix begin and end."""
        trees, n = self.codes.shape
        prefix = self.codes >> np.uint32(TREE_BITS - depth) if depth else np.zeros_like(self.codes)
        new = np.ones((trees, n), bool)
        new[:, 1:] = prefix[:, 1:] != prefix[:, :-1]
        at = np.arange(n, dtype=np.int32)
        begin = np.maximum.accumulate(np.where(new, at, 0), axis=1)
        closes = np.ones((trees, n), bool)
        closes[:, :-1] = new[:, 1:]
        end = np.minimum.accumulate(np.where(closes, at + 1, n)[:, ::-1], axis=1)[:, ::-1]
        return begin, end

    def members(self, asked: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``position in asked * n + vector`` of all different vectors met in the ranges of any tree, themselves left out."""
        n = self.codes.shape[1]
        out = []
        for t in range(len(self.order)):
            p = self.place[t, asked]
            a, width = begin[t, p].astype(np.int64), (end[t, p] - begin[t, p]).astype(np.int64)
            met = np.flatnonzero(width > 1)
            a, width = a[met], width[met]
            entry = np.arange(int(width.sum())) + np.repeat(a - (np.cumsum(width) - width), width)
            out.append(np.repeat(met * n, width) + self.order[t, entry])
        both = np.sort(np.concatenate(out))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        return both[both % n != asked[both // n]]

    def ascend(self, enough: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(asked, bounds, vectors)``: groups of vectors and the candidates of each, ``bounds`` apart.

        From the longest prefixes on, all trees give up one bit at a time; a
        vector leaves with the first depth at which ``enough`` different ones
        are met, or all at depth 0.
        """
        n = self.codes.shape[1]
        pending = np.arange(n)
        for depth in range(TREE_BITS, -1, -1):
            begin, end = self.ranges(depth)
            width = np.zeros(n, np.int64)
            for t in range(len(self.order)):
                width[self.order[t]] += end[t] - begin[t] - 1
            ready = pending[width[pending] >= enough] if depth else pending
            left = [pending[width[pending] < enough]] if depth else []
            cuts = np.flatnonzero(np.diff(np.cumsum(width[ready]) // MOST_PAIRS)) + 1
            for asked in np.split(ready, cuts):
                if not len(asked):
                    continue
                both = self.members(asked, begin, end)
                bounds = np.searchsorted(both, np.arange(len(asked) + 1) * n)
                short = np.diff(bounds) < enough if depth else np.zeros(len(asked), bool)
                left.append(asked[short])
                keep = np.flatnonzero(~short)
                if len(keep):
                    rows = ~short[both // n]
                    kept = np.concatenate([[0], np.cumsum(np.diff(bounds)[keep])])
                    yield asked[keep], kept, both[rows] % n
            pending = np.concatenate(left) if left else pending[:0]
            if not len(pending):
                return


def _best(rep: np.ndarray, unit: np.ndarray, rows: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` others of each row by cosine at nine decimals, ties to the smaller id."""
    s = np.concatenate([np.einsum("ij,ij->i", unit[rows[a : a + 50_000]], unit[others[a : a + 50_000]]) for a in range(0, len(rows), 50_000)] or [np.empty(0)])
    s = np.round(s, 9)
    o = np.lexsort((rep[others], -s, rows))
    rows, others, s = rows[o], others[o], s[o]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], others[place < k], s[place < k]


#: Cosines in single precision that differ by less may be in any order.
SLACK = 4e-6


def search_cell(rep: np.ndarray, unit: np.ndarray, k: int, same: float, trees: int = TREES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, other row, cosine)`` of the best ``k`` of every vector of a cell."""
    n = len(rep)
    rows, others = [], []
    single = unit.astype(np.float32)
    enough = candidates_for(n, same, trees, k)

    def shortlist(q: np.ndarray, s: np.ndarray, names: np.ndarray | None) -> None:
        m = min(k, s.shape[-1])
        cut = np.partition(s, s.shape[-1] - m, axis=-1)[..., s.shape[-1] - m] - SLACK
        if names is None:
            i, j = np.nonzero(s >= cut[:, None])
            rows.append(q[i])
            others.append(j)
        else:
            j = names[s >= cut]
            rows.append(np.full(len(j), q))
            others.append(j)

    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if enough >= WHOLE * n:
        for a in range(0, n, 512):
            q = np.arange(a, min(n, a + 512))
            s = single[q] @ single.T
            s[q - a, q] = -4
            shortlist(q, s, None)
    else:
        for asked, bounds, met in Forest(unit, trees).ascend(enough):
            for q, a, b in zip(asked.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if b > a:
                    names = met[a:b]
                    shortlist(q, single[names] @ single[q], names)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    rows, others = np.concatenate(rows), np.concatenate(others)
    other = rows != others
    return _best(rep, unit, rows[other], others[other], k)


def neighbors(
    vectors: DataFrame, scratch: Scratch, key: str = "vec_id", column: str = "vectors", dimension: int = 128, k: int = K,
    cell: int = CELL, trees: int = TREES,
) -> DataFrame:
    """``(key, neighbor_id, rank, cosine)``: ``k`` rows per usable vector."""
    rows = scratch.save(usable(vectors, key, column, dimension))
    kind = rows.schema["key"].dataType.simpleString()
    # Ids only: an id has one vector, a vector is stood for by its smallest id.
    members = rows.select("key", "d").groupBy("key").agg(F.min("d").alias("d"))
    classes = members.groupBy("d").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"))
    named = scratch.save(lookup_join(scratch.save(members), scratch.save(classes), "d").select("key", "d", "rep", "n"))
    if rows.count() != named.count():  # ids given more than once
        chosen = rows.join(named.where("key = rep").select("key", "d"), ["key", "d"], "left_semi")
        reps = scratch.save(chosen.groupBy(F.col("key").alias("rep")).agg(F.first("v").alias("v")))
    else:  # what isn't a representative is a small table as a rule, and then broadcast by its size
        spare = scratch.save(named.where("key != rep").select("key"))
        reps = rows.select(F.col("key").alias("rep"), "v")
        if spare.limit(1).count():
            reps = scratch.save(reps.join(spare.withColumnRenamed("key", "rep"), "rep", "left_anti"))
    count = reps.count()
    cosine = similarity_of_neighbors(reps, dimension, k)
    same = min(max(agreement(cosine), 0.01), 1 - 1e-6) if cosine is not None else 0.5
    bits, roots = roots_for(count, same, cell)
    keyed = cells(hashed(reps, dimension, roots), bits, scratch, cell)

    def search(part: pa.Table) -> pa.Table:
        ids = part.column("rep").combine_chunks()
        number = ids.to_numpy(zero_copy_only=False)
        rank = np.argsort(np.argsort(number, kind="stable"), kind="stable")
        i, j, s = search_cell(rank, matrix(part.column("v"), dimension), k, same, trees)
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
        bounds = pa.array(np.append(first, len(i)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, ids.take(pa.array(j))), pa.ListArray.from_arrays(bounds, pa.array(s))]
        return pa.table([ids.take(pa.array(i[first])), *lists], names=["rep", "others", "cosines"])

    found = tiled(keyed).groupBy("node").applyInArrow(search, f"rep {kind}, others array<{kind}>, cosines array<double>")
    each = F.zip_with("cosines", "others", lambda c, o: F.struct((-c).alias("far"), o.alias("other")))
    # A vector has one list per root and tile.
    near = found.groupBy("rep").agg(F.flatten(F.collect_list(each)).alias("list")).select(
        "rep", F.slice(F.array_sort(F.array_distinct("list")), 1, k).alias("list")
    )
    own = named.where("key = rep and n > 1").select("rep", F.array(F.struct(F.lit(-1.0).alias("far"), F.col("rep").alias("other"))).alias("list"))
    # Of equal vectors only the k + 1 smallest ids can be anyone's neighbours.
    of_class = Window.partitionBy("rep").orderBy("key")
    few = scratch.save(
        named.where("n > 1").withColumn("place", F.row_number().over(of_class)).where(F.col("place") <= k + 1)
        .select(F.col("rep").alias("other"), F.col("key").alias("neighbor"))
    )
    spelled = near.unionByName(own).select("rep", F.explode("list").alias("x")).select("rep", "x.far", "x.other")
    ranked = Window.partitionBy("rep").orderBy("far", "neighbor")
    listed = (
        spelled.join(few, "other", "left").withColumn("neighbor", F.coalesce("neighbor", "other"))
        .withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k + 1)
        .groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("place", "neighbor", "far"))).alias("list"))
    )
    answers = lookup_join(named.select("key", "rep"), listed, "rep")
    others = F.slice(F.filter("list", lambda x: x["neighbor"] != F.col("key")), 1, k)
    return answers.select("key", F.posexplode(others).alias("at", "x")).select(
        F.col("key").alias(key), F.col("x.neighbor").alias("neighbor_id"), (F.col("at") + 1).alias("rank"), (-F.col("x.far")).alias("cosine")
    )

"""Exact and cell-probed vector search, checks of vectors, linear heads."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import top_k

QUERY_BLOCK, ROW_BLOCK = 2048, 32_768


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def vector_state(v: Column, dimension: int, tolerance: float = 1e-5) -> Column:
    """``missing``, ``wrong_size``, ``not_finite``, ``zero``, ``not_unit`` or ``ok``."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    norm = F.sqrt(dot(v, v))
    return (
        F.when(v.isNull() | (F.size(v) == 0), "missing").when(F.size(v) != dimension, "wrong_size").when(bad, "not_finite")
        .when(norm == 0, "zero").when(F.abs(norm - 1) > tolerance, "not_unit").otherwise("ok")
    )


def linear_head(v: Column, weights: list[float], bias: float = 0.0) -> Column:
    return dot(v, F.array(*(F.lit(float(w)) for w in weights))) + bias


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as unit rows, from the values of the column's lists."""
    values = column.combine_chunks()
    m = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best_of_block(left: pa.Table, right: pa.Table, key: str, k: int, exclude_self: bool) -> pa.Table:
    """``(query_id, key, score)``: the best ``k`` rows of a block for each query of a block, ties at nine decimals to the smaller id."""
    arrow = left.column("id").type
    ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
    i, j, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if len(ids) and len(others):
        s = np.round(np.clip(unit_rows(left.column("v")) @ unit_rows(right.column("v")).T, -1, 1), 9)
        if exclude_self:
            s[ids[:, None] == others[None, :]] = -np.inf
        m = min(k, len(others))
        # All that reach the score of the k-th, so that ties are settled by id.
        cut = np.partition(s, len(others) - m, axis=1)[:, len(others) - m]
        i, j = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
        best = s[i, j]
        o = np.lexsort((others[j], -best, i))
        i, j, best = i[o], j[o], best[o]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j, best = i[keep], j[keep], best[keep]
    return pa.table({"query_id": pa.array(ids[i], arrow), key: pa.array(others[j], arrow), "score": pa.array(best, pa.float64())})


def exact_top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, exclude_self: bool = True) -> DataFrame:
    """``(query_id, key, score, rank)``: the best ``k`` by cosine, ties at nine decimals to the smaller id.

    Queries and rows are cut into blocks by hash and each pair of blocks is one
    matrix product in one task, of which the best ``k`` per query go on; so
    neither side has to fit one machine, and no pair is written out. Ten
    thousand times the rows make as many more tasks of the same size.
    """
    q, r = queries.select(F.col(key).alias("id"), F.col(vector).alias("v")), rows.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    q, r = q.where("id is not null and v is not null"), r.where("id is not null and v is not null")
    qb, rb = (max(1, math.ceil(x.count() / size)) for x, size in ((q, QUERY_BLOCK), (r, ROW_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", block(qb)).withColumn("rb", every(rb))
    r = r.withColumn("rb", block(rb)).withColumn("qb", every(qb))
    kind = rows.schema[key].dataType.simpleString()

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of_block(left, right, key, k, exclude_self)

    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(product, f"query_id {kind}, {key} {kind}, score double")
    return top_k(found, "query_id", key, k)


def centroids(rows: DataFrame, cell: str, vector: str) -> DataFrame:
    """``(cell, centroid)``: the mean of each cell, by position, combined before the shuffle."""
    parts = rows.select(cell, F.posexplode(vector).alias("p", "x")).groupBy(cell, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(cell).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"))


def probed_top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, cell: str, k: int, probes: int) -> DataFrame:
    """Approximate search: only the rows of the ``probes`` cells whose centroids are nearest to the query."""
    centres = centroids(rows, cell, vector)
    ask = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    near = ask.crossJoin(F.broadcast(centres)).withColumn("score", dot(F.col("q"), F.col("centroid")) / F.sqrt(dot(F.col("centroid"), F.col("centroid"))))
    cells = top_k(near, "query_id", cell, probes).select("query_id", "q", cell)
    scored = cells.join(rows.select(F.col(key), cell, F.col(vector).alias("v")), cell).where(F.col("query_id") != F.col(key))
    return top_k(scored.select("query_id", key, dot(F.col("q"), F.col("v")).alias("score")), "query_id", key, k)


FIT_ROWS, MOST_CELLS, FIT_STEPS = 20_000, 1024, 8
FIT_QUERIES, FIT_RECALL = 400, 0.98


def fit_cells(rows: DataFrame, key: str, vector: str, k: int, most: int = FIT_ROWS) -> tuple[np.ndarray, int]:
    """Centres of cells, and how many cells a query has to look into.

    Spherical k-means on at most ``most`` rows chosen by hash; one cell per
    hundred of them, at most ``MOST_CELLS``. For ``FIT_QUERIES`` of these rows the
    exact ``k`` neighbours among all of them are looked up: so many of the nearest
    cells are probed that they hold ``FIT_RECALL`` of these neighbours.
    """
    some = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(most).select(vector).toArrow()
    if not some.num_rows:
        return np.empty((0, 0)), 0
    m = unit_rows(some.column(0))
    count = max(1, min(MOST_CELLS, len(m) // 100))
    centres = m[np.random.default_rng(0).choice(len(m), count, replace=False)]
    for _ in range(FIT_STEPS):
        own = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        held = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(held > 0, sums / np.maximum(held, 1e-300), centres)
    own = (m @ centres.T).argmax(1)
    asked = np.arange(min(FIT_QUERIES, len(m)))
    s = m[asked] @ m.T
    s[asked, asked] = -np.inf
    near = np.argpartition(-s, min(k, len(m)) - 1, axis=1)[:, : min(k, len(m))]
    place = np.argsort(np.argsort(-(m[asked] @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[near], 1) + 1
    return centres, int(np.quantile(needed, FIT_RECALL, method="higher"))


def in_cells(rows: DataFrame, centres: np.ndarray, cells: int) -> DataFrame:
    """``(id, v, cell)``: each row once for each of its ``cells`` nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def batches(parts):
        for part in parts:
            if part.num_rows:
                near = np.argsort(-(unit_rows(pa.chunked_array([part.column(1)])) @ shared.value.T), axis=1, kind="stable")[:, :cells].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "v", "cells"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "v")]
    return rows.mapInArrow(batches, f"id {kinds[0]}, v {kinds[1]}, cells array<int>").select("id", "v", F.explode("cells").alias("cell"))


def cell_top_k(
    queries: DataFrame, rows: DataFrame, key: str, vector: str, centres: np.ndarray, k: int, probes: int, allowed: Column | None = None,
    exclude_self: bool = True,
) -> DataFrame:
    """Approximate ``exact_top_k`` in the ``probes`` cells nearest to each query, among the rows that ``allowed`` lets through.

    The filter comes before the search, so ``k`` rows come out where that many are
    allowed in the cells. A cell with more than ``ROW_BLOCK`` rows is cut into
    blocks by hash, which its queries all meet.
    """
    q = queries.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    r = (rows if allowed is None else rows.where(allowed)).select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    kind = rows.schema[key].dataType.simpleString()
    out = f"query_id {kind}, {key} {kind}, score double"
    if not centres.size:
        return top_k(rows.sparkSession.createDataFrame([], out), "query_id", key, k)
    held, asked = in_cells(r, centres, 1), in_cells(q, centres, probes)
    # One row per cell, at most MOST_CELLS.
    blocks = [(x["cell"], max(1, math.ceil(x["n"] / ROW_BLOCK))) for x in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]
    sizes = lambda: F.broadcast(rows.sparkSession.createDataFrame(blocks, "cell int, blocks int"))
    held = held.join(sizes(), "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    asked = asked.join(sizes(), "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of_block(left, right, key, k, exclude_self)

    found = asked.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInArrow(product, out)
    return top_k(found, "query_id", key, k)


def recall(exact: DataFrame, approximate: DataFrame, query: str, key: str) -> DataFrame:
    """``(query, recall)``: the share of the exact answer that was found."""
    found = approximate.select(query, key).withColumn("found", F.lit(1))
    both = exact.select(query, key).join(found, [query, key], "left")
    return both.groupBy(query).agg(F.round(F.count("found") / F.count(F.lit(1)), 6).alias("recall"))

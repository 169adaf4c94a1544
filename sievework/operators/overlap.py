"""How far held-out passages stand in a corpus: for each, its most similar document by character stretches.

The passages (a stated set, taken in blocks of bounded size) go to the workers
and the documents stream past, so no pair of stretches is ever joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 4_000_000
_WORDS = re.compile(r"\w+").findall


def stretches(text: str, n: int) -> set[str]:
    t = " ".join(_WORDS(text.lower()))
    return {t[i : i + n] for i in range(max(1, len(t) - n + 1))} if t else set()


def most_similar(items: DataFrame, documents: DataFrame, item_key: str, key: str, text: str = "text", n: int = 5) -> DataFrame:
    """``(item_key, key, similarity)``: the document with the highest Jaccard, the smaller id on a tie; texts without words have none."""
    known = items.select(F.col(item_key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    chars = known.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    source, best = documents.select(F.col(key), F.col(text)), None
    kinds = known.schema["k"].dataType.simpleString(), documents.schema[key].dataType.simpleString()
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()
        shared = documents.sparkSession.sparkContext.broadcast([(r["k"], r["t"]) for r in rows])

        def batches(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[int]] = {}
            ids, sizes = [], []
            for k, t in shared.value:
                own = stretches(t, n)
                if own:
                    for s in own:
                        held.setdefault(s, []).append(len(ids))
                    ids.append(k)
                    sizes.append(len(own))
            index = {s: np.array(where) for s, where in held.items()}
            sizes = np.array(sizes)
            top = np.full(len(ids), -1.0)
            who: list = [None] * len(ids)
            kind = None
            for part in parts:
                kind = part.column(0).type
                for name, text_ in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = stretches(text_, n) if text_ and ids else set()
                    hits = [index[s] for s in own if s in index]
                    if not hits:
                        continue
                    shared_n = np.bincount(np.concatenate(hits), minlength=len(ids))
                    j = shared_n / (sizes + len(own) - shared_n)
                    for i in np.flatnonzero((j >= top) & (shared_n > 0)):
                        if j[i] > top[i] or who[i] is None or name < who[i]:
                            top[i], who[i] = j[i], name
            keep = [i for i in range(len(ids)) if who[i] is not None]
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in keep]), pa.array([who[i] for i in keep], kind), pa.array([float(top[i]) for i in keep])],
                    names=[item_key, key, "similarity"],
                )

        part = source.mapInArrow(batches, f"{item_key} {kinds[0]}, {key} {kinds[1]}, similarity double")
        best = part if best is None else best.unionByName(part)
    pick = F.max_by(F.struct(key, "similarity"), F.struct("similarity", -F.col(key)))
    return best.groupBy(item_key).agg(pick.alias("x")).select(item_key, f"x.{key}", "x.similarity")

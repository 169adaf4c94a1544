"""Rows made from texts in Arrow batches, and digests of whole rows.

``facts``, ``criteria`` and what they are made of live in ``mentions`` and
``criteria``; their names are kept here.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .criteria import CRITERIA, LIMITS, SECTIONS, criteria, document_issues, negation_cues, numeric_limits, sections  # noqa: F401
from .mentions import FACTS, clauses, facts, missing_kinds  # noqa: F401


def spread(frame: DataFrame, key: str, text: str, make: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """The rows that ``make`` gives for each text, with the key; null texts give none. Arrow batches, no shuffle."""
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    kinds = [types[c.split()[1]] for c in columns.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            owner, rows = [], []
            for i, value in enumerate(part.column(1).to_pylist()):
                if value is not None:
                    made = make(value)
                    owner += [i] * len(made)
                    rows += made
            columns_ = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *columns_], names=[key, *names])

    source = frame.select(key, text)
    return source.mapInArrow(batches, f"{key} {source.schema[key].dataType.simpleString()}, {columns}")


def canonical_digest(frame: DataFrame, key: str) -> DataFrame:
    """``(key, digest)``: SHA-256 of the canonical JSON of the other columns (sorted names, compact, nulls kept)."""
    payload = frame.select(key, F.to_json(F.struct(*(c for c in frame.columns if c != key)), {"ignoreNullFields": "false"}).alias("j"))

    def make(text: str) -> list[tuple]:
        canonical = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return [(hashlib.sha256(canonical.encode("utf-8", "surrogatepass")).hexdigest(),)]

    return spread(payload, key, "j", make, "digest string")

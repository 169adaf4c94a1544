"""Profiles of tables and of semi-structured records."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_states(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``(field, state, n)``: null, empty (blank text or empty list) and present, counted in one pass."""
    kinds = dict(frame.dtypes)

    def state(c: str) -> Column:
        empty = ~F.col(c).rlike(r"[^\s\p{Z}]") if kinds[c] == "string" else F.size(c) == 0 if kinds[c].startswith("array") else F.lit(False)
        return F.when(F.col(c).isNull(), "null").when(empty, "empty").otherwise("present")

    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), state(c).alias("state")) for c in columns)))
    return frame.select(pairs.alias("x")).groupBy("x.field", "x.state").agg(F.count(F.lit(1)).alias("n"))


def categories(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(field, value, n)`` of several columns in one pass; null is ``(null)``."""
    pairs = F.explode(
        F.array(*(F.struct(F.lit(n).alias("field"), F.coalesce(c.cast("string"), F.lit("(null)")).alias("value")) for n, c in columns.items()))
    )
    return frame.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def json_state(raw: Column, path: str) -> Column:
    """``invalid``, ``absent``, ``null``, ``text``, ``object``, ``list`` or ``other`` at a path of JSON text."""
    parsed = F.try_parse_json(raw)
    value = F.try_variant_get(parsed, path, "variant")
    kind = F.schema_of_variant(value)
    return (
        F.when(parsed.isNull(), "invalid").when(value.isNull(), "absent").when(F.is_variant_null(value), "null")
        .when(kind == "STRING", "text").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "list").otherwise("other")
    )


def _walk(value, path: str, found: dict[str, set[str]]) -> None:
    """All paths and types of a JSON value, without recursion; positions fold into ``[]``."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        kind = "null" if v is None else {dict: "object", list: "list", str: "text", bool: "boolean"}.get(type(v), "number")
        found.setdefault(at or "/", set()).add(kind)
        if isinstance(v, dict):
            todo += [(f"{at}/{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{at}/[]", x) for x in v]


def path_inventory(records: DataFrame, raw: str) -> DataFrame:
    """``(path, kind, records)``: records in which a path occurs with a kind; counts combine in the workers first."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts: Counter = Counter()
            for text in part.column(0).to_pylist():
                found: dict[str, set[str]] = {}
                try:
                    _walk(json.loads(text), "", found)
                except (ValueError, RecursionError):
                    found = {"(invalid)": {"text"}}
                counts.update((p, k) for p, kinds in found.items() for k in kinds)
            rows = list(counts.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for (p, _), _ in rows], pa.string()), pa.array([k for (_, k), _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
                names=["path", "kind", "n"],
            )

    some = records.select(raw).where(F.col(raw).isNotNull())
    return some.mapInArrow(batches, "path string, kind string, n long").groupBy("path", "kind").agg(F.sum("n").alias("records"))


def ordered_distinct(frame: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, values)``: the distinct values of a key in the order of their first occurrence, joined by ``|``.

    Repeats are removed by a combining aggregation before anything is
    collected, so a hot key collects its distinct values only.
    """
    first = frame.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", value))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x[value]), "|").alias("values"))


def render(frame: DataFrame, key: str, representations: dict[str, list[str]]) -> DataFrame:
    """Several text representations: the non-blank fields of each, white space normalised, one a line; lists by element."""
    kinds = dict(frame.dtypes)

    def field(c: str) -> Column:
        text = F.array_join(F.filter(c, lambda x: x.isNotNull()), " ") if kinds[c].startswith("array") else F.col(c)
        return F.nullif(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " ")), F.lit(""))

    return frame.select(key, *(F.concat_ws("\n", *map(field, fields)).alias(name) for name, fields in representations.items()))


def page(frame: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of a catalogue in a total order."""
    if not (0 <= offset <= 10_000 and 1 <= limit <= 50):
        raise ValueError("offset 0..10000 and limit 1..50")
    return frame.orderBy(*order).offset(offset).limit(limit)

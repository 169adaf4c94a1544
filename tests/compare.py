"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        f = float(value)
        return repr(int(f)) if math.isfinite(f) and f == int(f) else repr(round(f, 6))
    if isinstance(value, (list, tuple)):
        return repr([plain(v) for v in value])
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, query, text: str, folder: str) -> str:
    """Empty where both give the same columns and rows."""
    frame = query(spark, folder)
    names, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    c = connection(folder)
    c.execute(text)
    want_names, want = rows_of([d[0] for d in c.description], c.fetchall())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} and {len(want)} rows; only here {sorted(a)[:3]}; only there {sorted(b)[:3]}"
    return ""

"""Problem 6: splitting oversized items at natural boundaries.

One regular expression with bounded quantifiers takes the text apart: its
alternatives go from the strongest boundary (blank line) over line end,
sentence end and clause end to white space, each taking as much as fits, then
the same in shorter and in longer cores, with single characters as the
fallback. ``regexp_extract_all`` returns the cores; array functions add up
their lengths to offsets; each piece but the first is lengthened to the left by
a lookback that starts at a natural boundary where there is one. All of it runs
in the JVM; lengths are code points.

With ``limit`` and ``overlap = (least, most)`` a core has at most
``limit - most`` characters if there is a boundary in it, else up to
``limit - least`` (the first up to ``limit``) to reach one or the end; a longer
core gets a shorter overlap, so a piece never exceeds ``limit``. A piece starts
behind the start of the one before it. A core is not cut between a carriage
return and its line feed or before a combining mark or joiner, unless a run of
such marks fills the whole core.

Edge cases: null and blank texts and texts up to the limit are not cut and
give no row; a null array gives none; null elements count as positions but
give none; a text of the limit plus one gives two pieces; repeated rows give
their pieces again (one set per ``key``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1000
OVERLAP = (80, 200)
KEEP = r"(?<!\r(?=\n))(?![\p{M}\x{200D}\x{FE0E}\x{FE0F}])"
#: Boundaries, strongest first, as what stands before the cut; no form is longer than three characters.
BOUNDARIES = (
    r"(?<=\n\n|\n\r\n|\r\r)",
    r"(?<=\n|\r(?!\n))",
    r"(?<=[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}][\s\p{Z}]|[.!?][\x{22}\x{27}\x{201D}\x{2019}\x{BB})\]][\s\p{Z}])",
    r"(?<=[;:,\x{3001}\x{FF0C}][\s\p{Z}])",
    r"(?<=[\s\p{Z}])",
)


def core_pattern(limit: int, overlap: tuple[int, int]) -> str:
    """Takes a text apart into cores that leave room for an overlap.

    The rest is taken whole as soon as it fits; else the core ends at the
    strongest boundary in the second half of its usual length, as late as
    possible; else at one before that, or, with a shorter overlap, behind it;
    else at one so near that the overlap reaches behind the core; else, with no
    boundary in reach, at a character.
    """
    least, most = overlap
    core = limit - most
    half = max(most + 1, core // 2)

    def some(low: int, high: int, how: str = "") -> str:
        return rf"(?s:.){{{low},{high}}}{how}"

    def ends(low: int, high: int, how: str = "", at: str = "") -> list[str]:
        return [at + some(low, high, how) + boundary + KEEP for boundary in BOUNDARIES] if low <= high else []

    parts = [
        some(1, core) + r"\z", *ends(half, core), *ends(most + 1, half - 1), *ends(core + 1, limit, at=r"\A"),
        *([some(core + 1, limit - least) + r"\z", *ends(core + 1, limit - least, "?")] if least < most else []),
        *ends(1, most, at=r"(?!\A)"), *ends(least + 1, most, at=r"\A"), some(half, core) + KEEP, some(1, core),
    ]
    return "|".join(parts)


def lookback_pattern(least: int, most: int) -> str:
    """Of the last ``most`` characters before a cut, those that the next piece repeats.

    They begin behind the strongest boundary that leaves ``least`` to ``most``
    of them, as early as possible; else at the earliest whole character.
    """
    some = rf"(?s:.){{{least},{most}}}\z"
    return "|".join([*(boundary + KEEP + some for boundary in BOUNDARIES), KEEP + some, rf"(?s:.){{{least}}}\z"])


def pieces_of(text: Column, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> Column:
    """``array<struct<piece_no, start_at, end_at, piece>>`` of a text; offsets from 0 in code points, end exclusive."""
    least, most = overlap
    core = limit - most
    if not 0 < least <= most or core < most + 1:
        raise ValueError("the overlap must be positive and less than half the limit")
    cores = F.regexp_extract_all(text, F.lit(core_pattern(limit, overlap)), F.lit(0))

    def tail(before: Column, c: Column) -> Column:
        room = F.least(F.lit(most), F.lit(limit) - F.length(c), F.length(before) - 1)
        return F.regexp_extract(F.right(before, room), lookback_pattern(least, most), 0)

    state = F.aggregate(
        cores,
        F.struct(
            F.lit(0).alias("at"),
            F.lit("").alias("before"),
            F.array().cast("array<struct<piece_no:int,start_at:int,end_at:int,piece:string>>").alias("done"),
        ),
        # An array of one, so that the tail is made once.
        lambda acc, c: F.transform(F.array(F.when(acc["before"] == "", "").otherwise(tail(acc["before"], c))), lambda x: _next(acc, c, x, most))[0],
    )
    return state["done"]


def _next(acc: Column, c: Column, tail: Column, most: int) -> Column:
    """The state after a core: where it ends, the end of its piece, and the pieces so far."""
    piece = F.struct(
        F.size(acc["done"]).alias("piece_no"),
        (acc["at"] - F.length(tail)).alias("start_at"),
        (acc["at"] + F.length(c)).alias("end_at"),
        F.concat(tail, c).alias("piece"),
    )
    return F.struct(
        (acc["at"] + F.length(c)).alias("at"),
        F.right(F.concat(tail, c), F.lit(most + 1)).alias("before"),
        F.concat(acc["done"], F.array(piece)).alias("done"),
    )


def long_items(table: DataFrame, key: str, texts: list[str], arrays: list[str], limit: int = LIMIT) -> DataFrame:
    """``(key, field_name, item_no, text)`` of every text over the limit."""
    parts = []
    for name in texts:
        parts.append(table.select(key, F.lit(name).alias("field_name"), F.lit(0).alias("item_no"), F.col(name).alias("text")))
    for name in arrays:
        parts.append(table.select(key, F.lit(name).alias("field_name"), F.posexplode(name).alias("item_no", "text")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.length("text") > limit)


def split_items(
    table: DataFrame, key: str, texts: list[str], arrays: list[str], limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP,
) -> DataFrame:
    """``(key, field_name, item_no, piece_no, start_at, end_at, piece)`` of every text over the limit."""
    items = long_items(table, key, texts, arrays, limit)
    return items.select(key, "field_name", "item_no", F.inline(pieces_of(F.col("text"), limit, overlap)))

"""Age and sex from the opening of a narrative; bounds from short phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import DAYS, MINUTES_A_DAY

OPENING = 240
# The words that tell the sex and the forms of an age.
FEMALE, MALE = "female|woman|girl|lady", "male|man|boy|gentleman"
AGE = r"\b(\d{1,3}(?:\.\d+)?)\s*[- ]?(year|month|week|day)s?\s*[- ]?old\b"
COMPACT = r"\b(\d{1,3})([MF])\b"
BOUND = r"^(\d+(?:\.\d+)?)\s+(Minute|Minutes|Day|Days|Week|Weeks|Month|Months|Year|Years)$"


def _days(number: Column, unit: Column) -> Column:
    u = F.lower(unit)
    out = F.when(u.startswith("minute"), number / MINUTES_A_DAY)
    for name, days in DAYS.items():
        out = out.when(u.startswith(name), number * days)
    return out


def opening_age_days(text: Column) -> Column:
    start = F.substring(text, 1, OPENING)
    number, unit = (F.regexp_extract(start, f"(?i){AGE}", i) for i in (1, 2))
    years = F.regexp_extract(start, COMPACT, 1)
    return F.coalesce(_days(number.try_cast("double"), unit), years.try_cast("double") * DAYS["year"])


def opening_sex(text: Column) -> Column:
    """Female, Male, or null where the opening tells none or both."""
    start = F.substring(text, 1, OPENING)
    compact = F.regexp_extract(start, COMPACT, 2)
    f = start.rlike(rf"(?i)\b({FEMALE})\b") | (compact == "F")
    m = start.rlike(rf"(?i)\b({MALE})\b") | (compact == "M")
    return F.when(f & ~m, "Female").when(m & ~f, "Male")


def bound_days(value: Column) -> Column:
    """Days of ``18 Years`` and the like; null for anything else."""
    v = F.trim(value)
    return F.when(v.rlike(BOUND), _days(F.regexp_extract(v, BOUND, 1).try_cast("double"), F.regexp_extract(v, BOUND, 2)))

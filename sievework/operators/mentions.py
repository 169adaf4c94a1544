"""Facts in narratives: a stream of typed tokens per clause, read by a small state machine.

``tokens`` makes one ordered stream of a clause: cues (who it is about, whether
it holds, when) and mentions (terms, ages, sexes, quantities). ``Scope`` is fed
the cues in order and answers, at any mention, what governs it; so each cue is
found once per clause, however many mentions there are. Offsets are code points
from 0, end exclusive, and a span's text is always the slice of the source.

Edge cases: null texts give nothing; an empty or blank text has no clause and so
no fact; every clause without a fact gives an ``unparsed_clause``; a mention that
occurs twice gives a row each; texts of any length are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from typing import NamedTuple

from ..functions import clinical_values as V

I = re.IGNORECASE  # noqa: E741


class Fact(NamedTuple):
    """A fact, or an issue (``kind`` is then ``issue``); an issue of the whole text has no span."""

    kind: str
    name: str
    value_text: str | None
    value_number: float | None
    unit: str | None
    operator: str | None
    start_at: int | None
    end_at: int | None
    experiencer: str | None
    assertion: str | None
    temporality: str | None
    certainty: str | None
    clause_start: int | None
    clause_end: int | None
    rule: str


FACTS = (
    "kind string, name string, value_text string, value_number double, unit string, operator string, start_at int, end_at int, "
    "experiencer string, assertion string, temporality string, certainty string, clause_start int, clause_end int, rule string"
)

_END = re.compile(V.CLAUSE_END, I)
#: Cues by what they set in the scope; those of who it is about come first where two start together.
_CUES = [
    (name, re.compile(pattern, I))
    for name, pattern in (
        ("patient", V.PATIENT), ("family", V.FAMILY), ("other", V.OTHERS), ("predicate", V.PREDICATE), ("absent", V.NEGATION),
        ("uncertain", V.UNCERTAIN), ("historical", V.HISTORICAL), ("planned", V.PLANNED),
    )
]
_AFTER = {
    name: re.compile(pattern, I)
    for name, pattern in (
        ("family", V.FAMILY_AFTER), ("other", V.OTHERS_AFTER), ("absent", V.NEGATION_AFTER), ("uncertain", V.UNCERTAIN_AFTER),
        ("historical", V.HISTORICAL_AFTER), ("planned", V.PLANNED_AFTER),
    )
}
_TERMS = [(kind, name, re.compile(rf"\b(?:{p})\b", I)) for kind, names in V.LEXICON.items() for name, p in names.items()]
_ANY_TERM = re.compile("|".join(p for names in V.LEXICON.values() for p in names.values()), I)
_OPERATORS = "|".join(re.escape(o) for o in sorted(V.MEASURED, key=len, reverse=True) if o)
#: All quantities in one pattern: which label matched says which it is.
_QUANTITY = re.compile(
    r"\b(?:" + "|".join(f"(?P<{name}>{label})" for name, (label, _) in V.MEASUREMENTS.items())
    + rf")\b\s*(?:is|of|=|:)?\s*(?P<op>{_OPERATORS})?\s*(?P<value>-?\d+(?:\.\d+)?)\s*(?P<unit>[^\s,;.!?]+)?", I,
)
_UNITS = {name: {u.casefold(): c for u, c in units.items()} for name, (_, units) in V.MEASUREMENTS.items()}
_PRESSURE = re.compile(V.BLOOD_PRESSURE, I)
_AGE, _COMPACT, _SEX, _UNCLEAR = re.compile(V.AGE, I), re.compile(V.AGE_AND_SEX), re.compile(V.SEX, I), re.compile(V.SEX_UNCLEAR, I)
_PRESENTED, _OPENING = re.compile(V.PRESENTED, I), re.compile(V.OPENING, I)
_LABEL, _HEDGE = re.compile(V.LABEL_BEFORE, I), re.compile(V.HEDGE_BEFORE, I)


def clauses(text: str) -> list[tuple[int, int]]:
    """Spans between sentence ends, semicolons, line ends, words of contrast and a new subject; decimals aren't cut."""
    out, start = [], 0
    for end in _END.finditer(text):
        out.append((start, end.start()))
        start = end.end()
    out.append((start, len(text)))
    return [(a, b) for a, b in out if not (a == b or text[a:b].isspace())]


def longest_apart(spans: list[tuple]) -> list[tuple]:
    """Spans ``(start, end, ...)`` that don't overlap: the longest first, then the earliest; in order of place."""
    starts: list[int] = []
    taken: list[tuple] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        at = bisect_left(starts, span[0])
        if (at and taken[at - 1][1] > span[0]) or (at < len(starts) and starts[at] < span[1]):
            continue
        starts.insert(at, span[0])
        taken.insert(at, span)
    return taken


@dataclass
class Scope:
    """What governs the place reached in a clause.

    A patient as subject takes over from a relative or other person before, and
    drops the cues before; a new predicate only drops the cues.
    """

    holder: str = "patient"
    other: bool = False
    floor: int = 0

    def __post_init__(self):
        self.cues: list[tuple[int, str]] = []

    def feed(self, name: str, start: int, end: int) -> None:
        if name == "patient":
            self.holder, self.other, self.floor = "patient", False, max(self.floor, start)
        elif name == "predicate":
            self.floor = max(self.floor, end)
        elif name == "family":
            self.holder = "family"
        elif name == "other":
            self.other = True
        else:
            self.cues.append((start, name))

    def reading(self, text: str, end: int, stop: int) -> dict[str, str]:
        """Experiencer, assertion, temporality and certainty of a mention that ends at ``end``."""
        said = {name for start, name in self.cues if start >= self.floor}
        said |= {name for name, pattern in _AFTER.items() if pattern.match(text, end, stop)}
        who = "other" if self.other or "other" in said else "family" if "family" in said else self.holder
        doubt = "uncertain" in said
        return {
            "experiencer": who, "assertion": "uncertain" if doubt else "absent" if "absent" in said else "present",
            "temporality": "planned" if "planned" in said else "historical" if "historical" in said else "current",
            "certainty": "uncertain" if doubt else "asserted",
        }


def tokens(text: str, a: int, b: int) -> list[tuple]:
    """``(start, end, class, name, ...)`` of the mentions of a clause, in order of place."""
    out = []
    if _ANY_TERM.search(text, a, b):
        found = [(*m.span(), "term", kind, name) for kind, name, p in _TERMS for m in p.finditer(text, a, b)]
        out += longest_apart(found)
    for m in _AGE.finditer(text, a, b):
        signed = m.start() > a and text[m.start() - 1] in "-."
        old = float(m["value"]) > V.OLDEST_YEARS and m["unit"].lower() == "year"
        out.append((*m.span(), "bad_age" if signed or old else "age", float(m["value"]), m["unit"].lower(), "age-unit"))
    for m in _COMPACT.finditer(text, a, b):
        years = float(m["value"])
        if years > V.OLDEST_YEARS:
            out.append((*m.span(), "bad_age", years, "year", "compact-demographic"))
        else:
            out.append((*m.span(), "age", years, "year", "compact-demographic"))
            out.append((*m.span(), "sex", "Female" if m["sex"] == "F" else "Male", "compact-demographic"))
    for m in _SEX.finditer(text, a, b):
        out.append((*m.span(), "sex", "Female" if m[0].lower() in V.FEMALE else "Male", "narrative-sex-label"))
    for m in _QUANTITY.finditer(text, a, b):
        name = next(n for n in V.MEASUREMENTS if m[n] is not None)
        out.append((*m.span(), "quantity", name, V.MEASURED[(m["op"] or "").lower()], float(m["value"]), _UNITS[name].get((m["unit"] or "").casefold())))
    for m in _PRESSURE.finditer(text, a, b):
        for name, value in (("systolic_blood_pressure", m[1]), ("diastolic_blood_pressure", m[2])):
            out.append((*m.span(), "pressure", name, float(value), m[3] is not None))
    return sorted(out, key=lambda t: t[:2])


def _demographic(text: str, a: int, b: int, start: int, read: dict[str, str], opens: bool) -> dict[str, str]:
    """An age or sex is current only in the opening or after a label, and uncertain after a hedge."""
    before = text[a:start]
    if not opens and not _LABEL.search(before) and read["temporality"] == "current":
        read = read | {"temporality": "unknown"}
    if _HEDGE.search(before):
        read = read | {"assertion": "uncertain", "certainty": "uncertain"}
    return read


def _clause_facts(text: str, a: int, b: int, blank: int) -> list[Fact]:
    out: list[Fact] = []
    mentions = tokens(text, a, b)
    if mentions:
        cues = sorted((m.start(), order, m.end(), name) for order, (name, p) in enumerate(_CUES) for m in p.finditer(text, a, b))
        cues.sort(key=lambda c: (c[2], c[0], c[1]))
        opens = (a <= blank or bool(_PRESENTED.match(text, a, b))) and bool(_OPENING.match(text, a, b))
    scope, at = Scope(floor=a), 0
    for start, end, token, *rest in mentions:
        while at < len(cues) and cues[at][2] <= start:
            scope.feed(cues[at][3], cues[at][0], cues[at][2])
            at += 1
        read = scope.reading(text, end, b)

        def fact(kind, name, word, number, unit, operator, rule, read=read, start=start, end=end):
            out.append(Fact(kind, name, word, number, unit, operator, start, end, *(read[k] for k in ("experiencer", "assertion", "temporality", "certainty")), a, b, rule))

        if token == "term":
            fact(rest[0], rest[1], rest[1], None, None, "eq", "lexicon")
        elif token in ("age", "sex"):
            read = _demographic(text, a, b, start, read, opens)
            if token == "age":
                fact("age", "age", None, rest[0], rest[1], "eq", rest[2], read)
            else:
                fact("sex", "sex", rest[0], None, None, "eq", rest[1], read)
        elif token == "bad_age":
            fact("issue", "invalid_age", None, rest[0], rest[1], "eq", rest[2])
        elif token == "quantity":
            name, operator, number, unit = rest
            if unit is None or number < 0:
                fact("issue", "unsupported_measurement", None, number, unit, operator, "quantity")
            else:
                fact("measurement", name, None, number, unit, operator, "quantity")
        elif token == "pressure" and rest[2]:
            fact("measurement", rest[0], None, rest[1], "mmHg", "eq", "blood-pressure")
        elif token == "pressure" and rest[0].startswith("systolic"):
            fact("issue", "unsupported_measurement", None, rest[1], None, "eq", "blood-pressure")
    if all(f.kind == "issue" for f in out):
        out.append(Fact("issue", "unparsed_clause", None, None, None, None, a, b, None, None, None, None, a, b, "clause"))
    return out


def facts(text: str) -> list[Fact]:
    """All facts and issues of a text, in order of place; issues of the whole text come last."""
    out: list[Fact] = []
    blank = len(text) - len(text.lstrip())
    for a, b in clauses(text):
        out += _clause_facts(text, a, b, blank)
    out.sort(key=lambda f: (f.start_at, f.end_at, f.kind, f.name))
    whole = []
    if _UNCLEAR.search(text):
        whole.append("sex_requires_review")
    for kind in ("age", "sex"):
        own = {
            (f.value_text, f.value_number, f.unit) for f in out
            if (f.kind, f.experiencer, f.temporality, f.assertion) == (kind, "patient", "current", "present")
        }
        if len(own) > 1:
            whole.append(f"conflicting_{kind}")
    return out + [Fact("issue", name, *[None] * 12, "text") for name in whole]


def missing_kinds(text: str) -> list[tuple[str]]:
    """Kinds of which the text has no fact."""
    held = {f.kind for f in facts(text)}
    return [(k,) for k in V.KINDS if k not in held]

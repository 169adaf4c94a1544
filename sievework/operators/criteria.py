"""Sections, criteria and numeric limits of eligibility text, without loss of wording.

One scan of a section's body gives its marks (bullets, or blank lines where it
has none); a part runs from mark to mark, is cut at semicolons that begin a new
subject, and trimmed. Indents make the tree of parts. What the wording needs
review for is told by rules, each a name and a test, in a fixed order.
Offsets are code points from 0, end exclusive.

Edge cases: null texts give nothing; an empty text has no section; sections
without a body give no criteria; a repeated text gives the same rows per key.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import NamedTuple

from ..functions import clinical_values as V

I = re.IGNORECASE  # noqa: E741
_HEADER, _BULLET, _BLANK = re.compile(V.SECTION_HEADER), re.compile(V.BULLET, I), re.compile(V.BLANK_LINE)
_CONTINUES, _SHARED, _SUBJECT = re.compile(V.CONTINUATION, I), re.compile(V.SHARED_CONDITION, I), re.compile(V.NEW_SUBJECT, I)
_NEGATED = re.compile(V.CRITERION_NEGATION, I)
_TYPES = {name: re.compile(p, I) for name, p in V.CRITERION_TYPES.items()}
_JOINED = re.compile(r"\b(?:and|or)\b", I)


class Limit(NamedTuple):
    name: str
    operator: str
    value: float
    upper: float | None
    unit: str
    start_at: int
    end_at: int


class Criterion(NamedTuple):
    ordinal: int
    section: str
    parent: int | None
    start_at: int
    end_at: int
    wording: str
    section_ordinal: int
    criterion_id: str
    types: str
    logic: str
    negations: int
    limits: int
    reasons: str


SECTIONS = "ordinal int, label string, start_at int, body_at int, end_at int"
CRITERIA = (
    "ordinal int, section string, parent int, start_at int, end_at int, wording string, section_ordinal int, criterion_id string, "
    "types string, logic string, negations int, limits int, reasons string"
)
LIMITS = "name string, operator string, value double, upper double, unit string, start_at int, end_at int"


def sections(text: str) -> list[tuple[int, str, int, int, int]]:
    """``(ordinal, label, start, body, end)``; the spans tile the text, what stands before the first header is unknown."""
    heads = [(m.start(), m.end(), (m[1] or m[2]).lower()) for m in _HEADER.finditer(text)]
    if text and (not heads or heads[0][0]):
        heads.insert(0, (0, 0, "unknown"))
    ends = [start for start, _, _ in heads[1:]] + [len(text)]
    return [(i, label, start, body, end) for i, ((start, body, label), end) in enumerate(zip(heads, ends), 1)]


def _unit_pattern(units: dict[str, str]) -> str:
    return "|".join(re.escape(u) for u in sorted(units, key=len, reverse=True))


_AMOUNT = r"\d+(?:\.\d+)?"
_SIGNS = "|".join(re.escape(o) for o in sorted(V.LIMITING, key=len, reverse=True))
#: Per quantity its label alone, and the label with a range or a comparison and a unit that nothing goes on.
_LIMITS = {
    name: (
        re.compile(rf"\b(?:{label})\b", I),
        re.compile(
            rf"\b(?:{label})\b\s*(?:must be|of|:|is)?\s*"
            rf"(?:(?:between\s+)?(?P<low>{_AMOUNT})\s*(?:-|–|to|and)\s*(?P<high>{_AMOUNT})|(?P<sign>{_SIGNS})\s*(?P<value>{_AMOUNT}))"
            rf"\s*(?P<unit>{_unit_pattern(units)})(?![\w/^]|\s+per\b)", I,
        ),
        {u.lower(): c for u, c in units.items()},
    )
    for name, (label, units) in V.LIMITED.items()
}
_DIGIT = re.compile(r"\d")


def read_limits(text: str, start: int = 0, end: int | None = None) -> tuple[list[Limit], list[str]]:
    """Explicit limits with a known unit, by place, and what couldn't be read: reversed ranges, labels beside numbers without a limit."""
    end = len(text) if end is None else end
    out, unread = [], []
    numbers = bool(_DIGIT.search(text, start, end))
    for name, (label, whole, units) in _LIMITS.items():
        if not numbers or not label.search(text, start, end):
            continue
        found = list(whole.finditer(text, start, end))
        for m in found:
            unit = units[m["unit"].lower()]
            if m["low"] is None:
                out.append(Limit(name, V.LIMITING[m["sign"].lower()], float(m["value"]), None, unit, *m.span()))
            elif float(m["low"]) <= float(m["high"]):
                out.append(Limit(name, "range", float(m["low"]), float(m["high"]), unit, *m.span()))
            else:
                unread.append("invalid_numeric_constraint")
        if not found:
            unread.append(f"unsupported_numeric_expression:{name}")
    return sorted(out, key=lambda c: c.start_at), unread


def numeric_limits(text: str) -> list[Limit]:
    return read_limits(text)[0]


def _parts(text: str, body: int, end: int) -> list[tuple[int, int, int]]:
    """``(start, end, indent)`` from mark to mark."""
    # The body counts as a text of its own, so that a bullet may follow the header on its line.
    bullets = [(body + m.start(), body + m.end(), len(m["indent"].expandtabs(4))) for m in _BULLET.finditer(text[body:end])]
    if bullets:
        stops = [start for start, _, _ in bullets[1:]] + [end]
        return [(body, bullets[0][0], -1)] + [(after, stop, indent) for (_, after, indent), stop in zip(bullets, stops)]
    starts = [body, *(m.end() for m in _BLANK.finditer(text, body, end))]
    # A paragraph that goes on with a conjunction belongs to the one before.
    starts = [s for k, s in enumerate(starts) if not k or not _CONTINUES.match(text, s, end)]
    return [(s, e, 0) for s, e in zip(starts, starts[1:] + [end])]


def _cut_at_subjects(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Cut after semicolons outside parentheses that a new subject follows, unless a condition may govern both sides."""
    cuts = [start]
    if ";" in text[start:end] and not _SHARED.search(text, start, end):
        depth = 0
        for m in re.compile("[();]").finditer(text, start, end):
            if m[0] != ";":
                depth = depth + 1 if m[0] == "(" else max(0, depth - 1)
            elif not depth and _SUBJECT.match(text, m.end(), end):
                cuts.append(m.end())
    return list(zip(cuts, cuts[1:] + [end]))


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    start += len(piece) - len(piece.lstrip())
    while end > start and (text[end - 1].isspace() or text[end - 1] == ";"):
        end -= 1
    return start, end


#: What the wording needs review for: name, and test of wording, section, parent, conjunctions and types.
_REVIEW = (
    ("unknown_section", lambda w, c: c["section"] == "unknown"),
    ("compound_logic_preserved", lambda w, c: c["joined"]),
    ("conditional_or_exception", lambda w, c: re.search(V.CONDITION_OR_EXCEPTION, w, I)),
    ("parent_context_required", lambda w, c: c["parent"] is not None),
    ("unsplit_semicolon", lambda w, c: ";" in w),
    ("multiple_sentences_preserved", lambda w, c: re.search(r"\.[ \t\r\n]+[A-Z]", w)),
    ("group_heading", lambda w, c: w.endswith(":")),
    ("multiple_paragraphs_preserved", lambda w, c: _BLANK.search(w)),
    ("embedded_heading_requires_review", lambda w, c: re.search(r"(?m)\n[ \t]*[^\r\n]+:[ \t\r]*$", w)),
    ("placeholder_statement", lambda w, c: w.strip(" .;").lower() in V.PLACEHOLDERS),
    ("unclassified_type", lambda w, c: c["types"] == ["other"]),
    ("unbalanced_parentheses", lambda w, c: w.count("(") != w.count(")")),
)


def criteria(text: str) -> list[Criterion]:
    """All criteria; the parent is the nearest earlier one of the section that is indented less.

    The id is a digest of the text and the criterion's place in it.
    """
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    out: list[Criterion] = []
    for number, label, _, body, end in sections(text):
        open_: list[tuple[int, int]] = []
        pieces = [(*piece, indent) for s, e, indent in _parts(text, body, end) for piece in _cut_at_subjects(text, s, e)]
        for start, stop, indent in pieces:
            start, stop = _trimmed(text, start, stop)
            if start >= stop:
                continue
            wording, ordinal = text[start:stop], len(out) + 1
            while open_ and open_[-1][0] >= indent:
                open_.pop()
            parent = open_[-1][1] if open_ else None
            open_.append((indent, ordinal))
            types = [t for t, p in _TYPES.items() if p.search(wording)] or ["other"]
            joined = sorted({m[0].lower() for m in _JOINED.finditer(wording)})
            limits, unread = read_limits(text, start, stop)
            known = {"section": label, "joined": joined, "parent": parent, "types": types}
            reasons = dict.fromkeys(unread + [name for name, test in _REVIEW if test(wording, known)])
            identity = hashlib.sha256(json.dumps([digest, start, stop]).encode()).hexdigest()
            out.append(
                Criterion(
                    ordinal, label, parent, start, stop, wording, number, identity, ",".join(types),
                    "mixed" if len(joined) > 1 else joined[0] if joined else "unspecified",
                    sum(1 for _ in _NEGATED.finditer(wording)), len(limits), ",".join(reasons),
                )
            )
    return out


def negation_cues(text: str) -> list[tuple[int, int, int, str]]:
    """``(ordinal, start, end, cue)`` of the negations in each criterion."""
    return [(c.ordinal, *m.span(), m[0]) for c in criteria(text) for m in _NEGATED.finditer(text, c.start_at, c.end_at)]


def document_issues(text: str) -> list[tuple[str]]:
    """What the whole text needs review for."""
    labels = [s[1] for s in sections(text)]
    out = [] if text.strip() else ["empty_eligibility_text"]
    if not _HEADER.search(text):
        out.append("no_recognized_section_headers")
    return [(i,) for i in out + [f"repeated_{label}_sections" for label in ("inclusion", "exclusion") if labels.count(label) > 1]]

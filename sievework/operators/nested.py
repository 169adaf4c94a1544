"""Problem 4: deeply nested records to flat tables that keep parent–child links.

Raw JSON is read by a bottom-up tree automaton: its rules (``GRAMMAR``) give
the state a value takes from its JSON type and the states of its children
under a node kind. The states sort out what the sources mix: a list, a lone
value in place of a list, a module given as JSON text, an object with unknown
fields, null, and damaged text. Accepted trees come out in the columns' own
types, so that parsed and raw records go the same way from there.

A bottom-up tree automaton then classifies every element by its shape: the
state of a value follows from its kind and the states of its parts alone (a
scalar is absent or there, a list absent, empty or filled, an object absent or in
a state of its own), so a kind has a fixed number of states, which ``catalogue``
lists. ``shred`` runs it over the typed columns once, in the JVM: every non-null
list element becomes a node with the keys common to all kinds (``record_id``,
``pointer``, ``parent_pointer``, ``position``), its state, and its own scalar
fields. ``route`` sends each node by kind and state to the typed table of that
variant, a partition of its own; hot variants are split over files. What holds
for all variants reads the common keys of all tables, and a kind's table is the
union of those of its variants.

Edge cases: null and empty lists give no rows; null elements give none but
count as positions; unknown fields are ignored; text that isn't valid JSON
(also NaN, a second value, or nesting too deep to read) gives no elements;
where a record has ``raw_record`` the list columns are not read; repeated
captures keep their own ``record_id``; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

TEXT, NUMBER = "text", "number"
#: Node kinds: fields of an object as (column name, JSON name, kind of its value); a kind in a list is a list of it.
GRAMMAR = {
    "intervention": [
        ("intervention_type", "type", TEXT), ("title", "name", TEXT), ("description", "description", TEXT),
        ("arm_group_labels", "armGroupLabels", [TEXT]), ("other_names", "otherNames", [TEXT]),
    ],
    "location": [
        ("facility", "facility", TEXT), ("status", "status", TEXT), ("city", "city", TEXT), ("country", "country", TEXT),
        ("geo_point", "geoPoint", "geo_point"), ("contacts", "contacts", ["contact"]),
    ],
    "geo_point": [("lat", "lat", NUMBER), ("lon", "lon", NUMBER)],
    "contact": [("contact_role", "role", TEXT), ("extension", "phoneExt", TEXT), ("languages", "languages", [TEXT])],
}
#: The four list columns: column, module and field in the JSON, kind of an element.
FIELDS = [
    ("phases", "designModule", "phases", TEXT),
    ("conditions", "conditionsModule", "conditions", TEXT),
    ("interventions", "armsInterventionsModule", "interventions", "intervention"),
    ("locations", "contactsLocationsModule", "locations", "location"),
]
MOST_DIGITS = 4000


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


class Digits(str):
    """An integer too long for ``int``, as it is written."""


def _int(digits: str):
    return int(digits) if len(digits) <= MOST_DIGITS else Digits(digits)


def parse(text: str | None):
    """A JSON value, or None for text that isn't JSON."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_refuse, parse_int=_int)
    except (ValueError, RecursionError):
        return None


def _plain(text: str) -> str:
    """Text without unpaired surrogates, which JSON can escape but no column can hold."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def module(value) -> dict:
    """A module's object, also where it is given as JSON text; else an empty one."""
    while isinstance(value, str) and not isinstance(value, Digits):
        value = parse(value)
    return value if isinstance(value, dict) else {}


def accept(value, kind):
    """The typed form of a JSON value under a node kind; None where it takes no state of that kind."""
    if value is None:
        return None
    if isinstance(kind, list):
        return [accept(v, kind[0]) for v in value] if isinstance(value, list) else [accept(value, kind[0])]
    if kind == TEXT:
        return _plain(value if isinstance(value, str) else json.dumps(value))
    if kind == NUMBER:
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < 1e308 else None
    known = value if isinstance(value, dict) else {}
    return {column: accept(known.get(name), inner) for column, name, inner in GRAMMAR[kind]}


def _arrow(kind) -> pa.DataType:
    if isinstance(kind, list):
        return pa.list_(_arrow(kind[0]))
    if kind == TEXT:
        return pa.string()
    if kind == NUMBER:
        return pa.float64()
    return pa.struct([(column, _arrow(inner)) for column, _, inner in GRAMMAR[kind]])


def _ddl(kind) -> str:
    if isinstance(kind, list):
        return f"array<{_ddl(kind[0])}>"
    if kind in (TEXT, NUMBER):
        return "string" if kind == TEXT else "double"
    return "struct<" + ",".join(f"{column}:{_ddl(inner)}" for column, _, inner in GRAMMAR[kind]) + ">"


def read_raw(records: DataFrame, key: str = "record_id", raw: str = "raw_record") -> DataFrame:
    """Raw records in the types of the list columns."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns: list[list] = [[] for _ in FIELDS]
            for text in part.column(1):
                tree = parse(text.as_py())
                root = module(tree.get("protocolSection")) if isinstance(tree, dict) else {}
                for out, (_, name, field, kind) in zip(columns, FIELDS):
                    out.append(accept(module(root.get(name)).get(field), [kind]))
            arrays = [pa.array(out, _arrow([kind])) for out, (*_, kind) in zip(columns, FIELDS)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[key, *(f[0] for f in FIELDS)])

    source = records.select(key, raw)
    ddl = ", ".join([f"{key} {source.schema[key].dataType.simpleString()}", *(f"{c} {_ddl([k])}" for c, _, _, k in FIELDS)])
    return source.mapInArrow(batches, ddl)


def typed_records(records: DataFrame, key: str = "record_id", raw: str = "raw_record") -> DataFrame:
    """Parsed and raw records alike: the key and the four list columns."""
    columns = [F.col(c).cast(_ddl([k])).alias(c) for c, _, _, k in FIELDS]
    parsed = records.where(F.col(raw).isNull()).select(key, *columns)
    return parsed.unionByName(read_raw(records.where(F.col(raw).isNotNull()), key, raw))


#: List columns at any depth: name, and kind of an element.
KINDS: dict[str, str] = {column: kind for column, _, _, kind in FIELDS} | {
    column: inner[0] for fields in GRAMMAR.values() for column, _, inner in fields if isinstance(inner, list)
}
#: Scalar fields of all kinds of elements; ``value`` is that of an element that is text itself.
SCALARS = {"value": TEXT} | {column: inner for fields in GRAMMAR.values() for column, _, inner in fields if inner in (TEXT, NUMBER)}
KEYS = ["pointer", "parent_pointer", "position"]
NODE_COLUMNS = "kind string, state int, pointer string, parent_pointer string, position int, " + ", ".join(f"{c} {_ddl(k)}" for c, k in SCALARS.items())
NODE = "struct<" + NODE_COLUMNS.replace(", ", ",").replace(" ", ":") + ">"


def states(kind) -> list[str]:
    """The shapes of a kind of value, by state; what is absent has none."""
    if isinstance(kind, list):
        return ["[]", "[+]"]
    if kind in (TEXT, NUMBER):
        return [""]
    shapes: list[list[str]] = [[]]
    for column, _, inner in GRAMMAR[kind]:
        shapes = [s + part for part in [[], *([column + x] for x in states(inner))] for s in shapes]
    return ["{" + ",".join(s) + "}" for s in shapes]


def _state(value: Column, kind) -> Column:
    """The transition of the automaton: the state of a value that is there, from those of its parts."""
    if isinstance(kind, list):
        return F.when(F.size(value) == 0, 0).otherwise(1)
    if kind in (TEXT, NUMBER):
        return F.lit(0)
    total, weight = F.lit(0), 1
    for column, _, inner in GRAMMAR[kind]:
        part = value[column]
        total = total + weight * F.when(part.isNull(), 0).otherwise(1 + _state(part, inner))
        weight *= 1 + len(states(inner))
    return total


def catalogue() -> list[tuple[str, int, str]]:
    """``(kind, state, variant)`` of every state of every kind of list element."""
    return [(name, i, shape) for name, kind in KINDS.items() for i, shape in enumerate(states(kind))]


def _scalars(value: Column, kind) -> dict[str, Column]:
    """An element's own scalar fields, those of objects in it included."""
    if kind == TEXT:
        return {"value": value}
    out: dict[str, Column] = {}
    for column, _, inner in GRAMMAR[kind]:
        if inner in (TEXT, NUMBER):
            out[column] = value[column]
        elif not isinstance(inner, list):
            out |= _scalars(value[column], inner)
    return out


def scalar_names(name: str) -> list[str]:
    """The typed columns of a kind of list element."""
    return list(_scalars(F.lit(None), KINDS[name])) if KINDS[name] == TEXT else [c for c in SCALARS if c in _names_below(KINDS[name])]


def _names_below(kind: str) -> set[str]:
    out: set[str] = set()
    for column, _, inner in GRAMMAR[kind]:
        if inner in (TEXT, NUMBER):
            out.add(column)
        elif not isinstance(inner, list):
            out |= _names_below(inner)
    return out


def _nodes(value: Column, name: str, base: Column) -> Column:
    """All nodes below a list, the list's own elements included."""
    kind = KINDS[name]
    nothing = F.array().cast(f"array<{NODE}>")

    def element(x: Column, i: Column) -> Column:
        pointer = F.concat(base, F.lit(f"/{name}/"), i.cast("string"))
        own = _scalars(x, kind)
        node = F.struct(
            F.lit(name).alias("kind"), _state(x, kind).cast("int").alias("state"), pointer.alias("pointer"), base.alias("parent_pointer"),
            i.cast("int").alias("position"), *((own[c] if c in own else F.lit(None)).cast(_ddl(k)).alias(c) for c, k in SCALARS.items()),
        )
        return F.when(x.isNull(), nothing).otherwise(F.concat(F.array(node), *_inner(x, kind, pointer)))

    return F.coalesce(F.flatten(F.transform(value, element)), nothing)


def _inner(value: Column, kind, base: Column) -> list[Column]:
    if kind == TEXT:
        return []
    out = []
    for column, _, inner in GRAMMAR[kind]:
        if isinstance(inner, list):
            out.append(_nodes(value[column], column, base))
        elif inner not in (TEXT, NUMBER):
            out += _inner(value[column], inner, F.concat(base, F.lit(f"/{column}")))
    return out


def shred(records: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """The key and ``NODE_COLUMNS`` of every non-null element at any depth of typed records.

    One pass and no shuffle; a record's nodes are made in its own row.
    """
    return records.select(key, F.inline(F.concat(*(_nodes(F.col(c), c, F.lit("")) for c in lists))))


class VariantTables:
    """Nodes routed by state: one typed table per kind and variant, in a stored form read any number of times."""

    def __init__(self, stored: DataFrame, key: str):
        self.stored, self.key = stored, key

    def keys(self) -> DataFrame:
        """The common keys of the elements of all tables."""
        return self.stored.select(self.key, *KEYS)

    def table(self, name: str, state: int | None = None) -> DataFrame:
        """The typed table of a kind of list, of all its variants or of one; only its own partitions are read."""
        own = self.stored.where(F.col("kind") == name)
        if state is not None:
            own = own.where(F.col("state") == state)
        return named_variants(own).select(self.key, *KEYS, "variant", *scalar_names(name))

    def variants(self) -> DataFrame:
        """``(kind, variant, elements)``: how often each shape occurs."""
        return named_variants(self.stored.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("elements"))).select("kind", "variant", "elements")


def named_variants(nodes: DataFrame) -> DataFrame:
    """Nodes with their ``variant``; the table of names has as many rows as the grammar has states."""
    names = nodes.sparkSession.createDataFrame(catalogue(), "kind string, state int, variant string")
    return nodes.join(F.broadcast(names), ["kind", "state"])


def route(records: DataFrame, key: str, lists: list[str], scratch: Scratch) -> VariantTables:
    """Shred once and store each node in the table of its kind and state.

    Rows are gathered by kind and state before they are written, so a table has
    few files; adaptive execution splits a variant that holds very many.
    """
    nodes = shred(records, key, lists).hint("rebalance", "kind", "state")
    return VariantTables(scratch.save(nodes, partition_by=["kind", "state"]), key)

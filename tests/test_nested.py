import json

from sievework.operators import nested
from sievework.operators.scratch import Scratch

SCHEMA = (
    "record_id long, raw_record string, phases array<string>, conditions array<string>, "
    "interventions array<struct<intervention_type:string,title:string,description:string,arm_group_labels:array<string>,other_names:array<string>>>, "
    "locations array<struct<facility:string,status:string,city:string,country:string,geo_point:struct<lat:double,lon:double>,"
    "contacts:array<struct<contact_role:string,extension:string,languages:array<string>>>>>, pointer string, kind string"
)


def row(i, raw=None, phases=None, conditions=None, interventions=None, locations=None):
    return (i, raw, phases, conditions, interventions, locations, "clash", "clash")


def raw(**modules):
    return json.dumps({"protocolSection": modules, "unknown": [1, [2]]})


def found(spark, *rows):
    frame = nested.typed_records(spark.createDataFrame(list(rows), SCHEMA))
    got = [(x["record_id"], x["pointer"], x["parent_pointer"]) for x in nested.shred(frame, "record_id", [f[0] for f in nested.FIELDS]).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_parsed_lists_keep_positions_and_parents(spark):
    place = ("F", None, None, None, (1.0, None), [None, ("r", None, ["de", None, "fr"])])
    got = found(spark, row(1, None, ["P1", None, "P2"], [], [("t", "n", None, ["a"], None), None], [None, place]))
    assert got == {
        (1, "/phases/0", ""), (1, "/phases/2", ""), (1, "/interventions/0", ""), (1, "/interventions/0/arm_group_labels/0", "/interventions/0"),
        (1, "/locations/1", ""), (1, "/locations/1/contacts/1", "/locations/1"), (1, "/locations/1/contacts/1/languages/0", "/locations/1/contacts/1"),
        (1, "/locations/1/contacts/1/languages/2", "/locations/1/contacts/1"),
    }


def test_raw_lone_values_text_modules_and_names(spark):
    text = raw(
        designModule=json.dumps({"phases": "PHASE1"}), conditionsModule={"conditions": ["a", None, "b"], "note": ["x"]},
        armsInterventionsModule={"interventions": {"name": "n", "otherNames": "o", "armGroupLabels": [None, "g"], "misc": ["z"]}},
        contactsLocationsModule={"locations": [{"contacts": {"languages": "de"}}, 7]},
    )
    assert found(spark, row(2, text)) == {
        (2, "/phases/0", ""), (2, "/conditions/0", ""), (2, "/conditions/2", ""), (2, "/interventions/0", ""),
        (2, "/interventions/0/other_names/0", "/interventions/0"), (2, "/interventions/0/arm_group_labels/1", "/interventions/0"),
        (2, "/locations/0", ""), (2, "/locations/0/contacts/0", "/locations/0"), (2, "/locations/0/contacts/0/languages/0", "/locations/0/contacts/0"),
        (2, "/locations/1", ""),
    }


def test_damaged_and_odd_records_have_no_elements(spark):
    odd = ["", "{", "null", "[]", "3", '"x"', '{"protocolSection": NaN}', "[" * 100_000, '{"protocolSection": {"designModule": "{"}}', raw(designModule={"phases": None}),
           raw(designModule=[1]), '{"protocolSection": {"designModule": {"phases": ["P"]}}} trailing']
    assert found(spark, *(row(i, t) for i, t in enumerate(odd)), row(100), row(101, None, [], [])) == set()


def test_unpaired_surrogates_and_very_long_lists(spark):
    text = '{"protocolSection": {"conditionsModule": {"conditions": ["\\ud800", ""]}}}'
    many = [("F", None, None, None, None, [("r", None, ["de"] * 3)] * 4)] * 2000
    got = found(spark, row(1, text), row(2, None, None, None, None, many))
    assert {(1, "/conditions/0", ""), (1, "/conditions/1", "")} <= got
    assert len(got) == 2 + 2000 * (1 + 4 + 12)


def test_variant_tables_agree_with_nodes_and_variants(spark):
    rows = [row(1, None, ["P"], None, [("t", None, "d", [], ["x"])], [("F", None, None, None, (1.0, 2.0), [("r", "1", [])])]), row(2, raw(conditionsModule={"conditions": "c"}))]
    frame = nested.typed_records(spark.createDataFrame(rows, SCHEMA))
    lists = [f[0] for f in nested.FIELDS]
    nodes = {(x["record_id"], x["pointer"], x["parent_pointer"], x["variant"]) for x in nested.named_variants(nested.shred(frame, "record_id", lists)).collect()}
    tables = nested.route(frame, "record_id", lists, Scratch(spark))
    typed, single = set(), set()
    for name in nested.KINDS:
        typed |= {(x["record_id"], x["pointer"], x["parent_pointer"], x["variant"]) for x in tables.table(name).collect()}
    for name, state, variant in [(n, s, v) for n, s, v in nested.catalogue() if (n, v) in {("interventions", "{intervention_type,description,arm_group_labels[],other_names[+]}"), ("phases", "")}]:
        found = tables.table(name, state).collect()
        assert len(found) == 1 and found[0]["variant"] == variant
        single |= {(x["record_id"], x["pointer"]) for x in found}
    assert typed == nodes and single == {(1, "/interventions/0"), (1, "/phases/0")}
    assert {(x["record_id"], x["pointer"], x["parent_pointer"]) for x in tables.keys().collect()} == {n[:3] for n in nodes}
    assert {v for *_, v in nodes} >= {"{intervention_type,description,arm_group_labels[],other_names[+]}", "{facility,geo_point{lat,lon},contacts[+]}"}
    assert tables.table("locations").columns[-2:] == ["lat", "lon"] and tables.table("languages").columns[-1] == "value"
    assert {(x["kind"], x["variant"], x["elements"]) for x in tables.variants().collect()} >= {("conditions", "", 1), ("contacts", "{contact_role,extension,languages[]}", 1)}


def test_states_are_those_of_the_grammar():
    assert [len(nested.states(k)) for k in ("intervention", "contact", "geo_point", "location")] == [72, 12, 4, 240]
    names = [(n, v) for n, _, v in nested.catalogue()]
    assert len(names) == len(set(names)) and nested.states("geo_point") == ["{}", "{lat}", "{lon}", "{lat,lon}"]


def test_empty_table(spark):
    frame = nested.typed_records(spark.createDataFrame([], SCHEMA))
    assert nested.shred(frame, "record_id", ["phases"]).count() == 0


def test_long_integers_and_many_layers_lose_nothing(spark):
    digits = "7" * 5000
    layered = {"phases": ["P1"]}
    for _ in range(7):
        layered = json.dumps(layered)
    long = '{"protocolSection": {"designModule": {"phases": ["P1", %s]}}, "unknown": %s}' % (digits, digits)
    got = found(spark, row(1, long), row(2, raw(designModule=layered)))
    assert got == {(1, "/phases/0", ""), (1, "/phases/1", ""), (2, "/phases/0", "")}
    frame = nested.typed_records(spark.createDataFrame([row(1, long)], SCHEMA))
    assert frame.first()["phases"] == ["P1", digits]

"""Rules over schemes, enumeration, and gates."""

import pytest
from pyspark.sql import functions as F

from sievemill.operators import gates, schemes

MATERIALS = [("LNMO", ["spinel"], 4.9, 4.7, 135.0), ("LFP", [], 3.8, 3.4, 160.0), ("graphite", [], None, None, None), ("li_metal", ["li foil"], None, None, None), ("carbonate_ec", ["ec/dmc"], None, None, None), ("lhce", [], None, None, None)]
FIELDS = "scheme_id int, cathode string, anode string, electrolyte string, additives array<string>, notes string, modifications array<string>, user_locked array<string>, target_energy double, claimed_energy double"


def materials(spark):
    return spark.createDataFrame(MATERIALS, "id string, aliases array<string>, voltage_limit double, voltage double, capacity double")


def judged(spark, rows, given=schemes.RULES):
    found = schemes.evaluated(spark.createDataFrame(rows, FIELDS), materials(spark), given).collect()
    return {r.scheme_id: ([":".join(x for x in h if x) for h in r.hits], r.feasible) for r in found}


def test_rules_targets_and_easing(spark):
    rows = [
        (1, "Spinel LNMO", "graphite", "EC/DMC", None, None, None, None, None, None), (2, "LNMO", "graphite", "carbonate_ec", ["FEC"], None, None, None, None, None),
        (3, "LFP", "Li foil", "carbonate_ec", None, "a 人工SEI", None, None, 399.9, 600.0), (4, "LFP", "graphite", "lhce", None, None, None, None, None, 500.0),
        (5, "unknown", "graphite", "lhce", None, None, None, None, None, None), (6, "LFP", None, "lhce", None, None, None, None, 450.0, None),
        (7, "LNMO", "li_metal", "carbonate_ec", None, None, ["gradient"], ["electrolyte"], None, None), (8, None, None, None, None, None, None, None, None, None),
    ]
    got = judged(spark, rows)
    assert got == {
        1: (["C1:violation", "C2:violation", "C6:audit_note"], False), 2: (["C1:eased", "C2:eased", "C6:audit_note"], True), 3: (["C3:eased"], True), 4: (["C7:violation", "C8:frontier"], False),
        5: (["C0:unverified"], False), 6: (["C7:material_energy"], True), 7: (["C1:eased", "C2:eased", "C3:eased", "C6:audit_note"], True), 8: ([], True),
    }


def test_every_action_and_operator(spark):
    given = [
        {"id": "R", "trigger": ("cathode.voltage", "lte", 3.4), "action": "reject"}, {"id": "X", "trigger": ("anode", "not_in", ["graphite"]), "action": "exclude", "target": "electrolyte:[lhce, ether]"},
        {"id": "I", "trigger": ("additives", "contains", "fec"), "action": "include", "target": "additive:[VC, DTD]"}, {"id": "W", "trigger": ("claimed_energy", "lt", 100), "action": "warn"},
        {"id": "M", "trigger": ("no_such_column", "eq", "x"), "action": "reject"}, {"id": "N", "trigger": ("cathode.no_such", "gt", 1), "action": "reject"},
    ]
    rows = [
        (1, "LFP", "graphite", "lhce", None, None, None, None, None, 99.0), (2, "LNMO", "li_metal", "lhce", ["my FEC"], None, None, None, None, 100.0),
        (3, "LNMO", "li_metal", "carbonate_ec", ["FEC", "DTD"], None, None, None, None, None),
    ]
    assert judged(spark, rows, given) == {1: (["R:rejected", "W:warning"], False), 2: (["X:violation", "I:missing:additive:VC/DTD"], False), 3: ([], True)}


def test_enumeration_and_tasks(spark):
    of = lambda *ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, place int")
    cathodes = spark.createDataFrame([("LNMO", 0, 4.7, 135.0), ("LFP", 1, 3.4, 160.0)], "id string, place int, voltage double, capacity double")
    every = schemes.enumerated(cathodes, of("graphite", "li_metal"), of("carbonate_ec", "lhce"))
    assert every.count() == 8
    tasks = {r.target: r for r in schemes.combination_tasks(every, materials(spark), [300, 310, 400]).collect()}
    assert (tasks[300].n_feasible, tasks[300].cathode, tasks[300].anode, tasks[300].electrolyte) == (5, "LNMO", "graphite", "lhce")
    assert tasks[310].feasible and not tasks[400].feasible and tasks[400].cathode is None
    first = {r.rule: (r.cathode, r.anode, r.electrolyte) for r in schemes.violating_tasks(every, materials(spark)).collect()}
    assert first == {"C1": ("LNMO", "graphite", "carbonate_ec"), "C2": ("LNMO", "graphite", "carbonate_ec"), "C3": ("LNMO", "li_metal", "carbonate_ec"), "C7": ("LNMO", "graphite", "carbonate_ec")}


def gate(df):
    r = df.collect()
    assert len(r) == 1
    return r[0].code, r[0].passed, r[0].observed, [(e.code, e.rows, e.first, e.notes) for e in r[0].evidence]


def test_cell_gate(spark):
    parts = lambda *ids: spark.createDataFrame([(x,) for x in ids], "material_id string")
    cells = lambda *rows: spark.createDataFrame(rows, "cell_id string, cathode string, anode string, electrolyte string, provenance string")
    good = ("c1", "a", "b", "e", "doi")
    assert gate(gates.cell_assembly(parts("a", "b", "e"), cells(good))) == ("OK", True, 1, [])
    assert gate(gates.cell_assembly(parts(), cells(good)))[0] == "NO_MATERIALS_EXTRACTED"
    assert gate(gates.cell_assembly(parts("a"), cells()))[:3] == ("NO_CELLS_ASSEMBLED", False, 0)
    assert gate(gates.cell_assembly(parts(None, " "), cells(good)))[0] == "MISSING_NORMALIZED_IDS"
    found = gate(gates.cell_assembly(parts("a", "b", "e"), cells(good, good, ("c2", "a", "x", "e", "doi"), (None, "a", " ", "e", None), ("c3", "y", "b", "e", "d"))))
    assert found == ("CELL_SPEC_INCOMPLETE", False, 5, [("CELL_SPEC_INCOMPLETE", 1, "", "cell_id,anode,provenance"), ("CELL_ID_REPEATED", 2, "c1", ""), ("UNKNOWN_COMPONENT", 2, "c2", "x")])


def test_design_and_report_gates_of_no_rows(spark):
    design = spark.createDataFrame([], "scheme_id int, markdown string, cathode string, anode string, electrolyte string, reviewed boolean, feasible boolean")
    assert gate(gates.design(design, spark.createDataFrame([], "scheme_id int, is_evidence boolean, is_foreign boolean")))[0] == "DESIGN_SCHEME_FILE_MISSING"
    stages = spark.createDataFrame([], "goal string, stage int, status string, allow_skip boolean, skip boolean")
    journals = spark.createDataFrame([], "goal string, delivers_simulation boolean, has_simulation boolean")
    assert gate(gates.report(spark.createDataFrame([], "goal string, markdown string"), stages, journals))[0] == "SYNTHESIS_REPORT_MISSING"


def test_sections(spark):
    text = "# Targets\n## combination of x\n**3. Metrics**\ntext 可行性依据\n#### RISKS"
    rows = spark.createDataFrame([(text,), (None,)], "text string")
    got = [r.m for r in rows.select(gates.missing_sections(F.col("text"), gates.DESIGN_SECTIONS).alias("m")).collect()]
    assert got[0] == ["可行性依据"] and len(got[1]) == 5

"""Contracts, revisions, anchors and extraction on small cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.operators import anchors, contracts, extractor, rules

QUOTE = "For NCM811 the solid-state diffusion coefficient is constant, 2.5e-10 cm²/s at 25 °C (GITT)"
CLAIM = ("p", QUOTE, "NCM811", "solid_diffusion_coefficient", "2.5e-10", "cm2/s", "298.15", "constant_full_soc", "gitt", "NCM811", 2.5e-14)
CLAIM_SCHEMA = "passage_id string, quote string, material_id string, parameter string, value string, unit string, temperature_K string, applicability string, method string, material string, used double"


@pytest.mark.parametrize(
    "change, code",
    [
        ({}, "OK"), ({0: None}, "FIELDS_MISSING"), ({0: "other"}, "QUOTE_NOT_IN_PASSAGE"), ({1: " "}, "QUOTE_NOT_IN_PASSAGE"), ({1: QUOTE + "!"}, "QUOTE_NOT_IN_PASSAGE"), ({9: "LFP"}, "OTHER_MATERIAL"),
        ({3: "x"}, "NOT_SOLID_DIFFUSION"), ({7: "local"}, "NOT_CONSTANT"), ({6: "298.3"}, "OTHER_TEMPERATURE"), ({6: "true"}, "OTHER_TEMPERATURE"), ({1: QUOTE.split(" at ")[0]}, "TEMPERATURE_NOT_QUOTED"),
        ({8: "EIS"}, "METHOD_NOT_QUOTED"), ({5: "mm2/s"}, "BAD_VALUE_OR_UNIT"), ({4: "-1"}, "BAD_VALUE_OR_UNIT"), ({4: '"2.5e-10"'}, "BAD_VALUE_OR_UNIT"), ({5: "m2/s"}, "VALUE_NOT_BESIDE_UNIT"), ({4: "25"}, "VALUE_NOT_BESIDE_UNIT"), ({10: 2.5e-10}, "OTHER_VALUE_USED"), ({6: "298.2", 10: 2.5e-14 * (1 + 1e-12)}, "OK"),
    ],
)
def test_each_check_of_evidence(spark, change, code):
    claim = tuple(change.get(i, x) for i, x in enumerate(CLAIM))
    passages = spark.createDataFrame([("p", f"Before. {QUOTE}. After"), ("p", None)], "passage_id string, text string")
    (r,) = contracts.evidence_codes(spark.createDataFrame([claim], CLAIM_SCHEMA), passages).collect()
    assert r.code == code and (r.source_hash is not None) == (code == "OK")


def test_revisions_are_locked_whole_and_in_order(spark):
    geometry = {"cathode.L_um": 60.0, "cathode.porosity": 0.3}
    row = lambda g: spark.createDataFrame([(1, 4, g)], "scheme_id long, revision int, geometry map<string,double>")
    of = lambda g: row(g).select(contracts.geometry_hash(F.col("geometry")).alias("h")).first().h
    assert of(geometry) == of(dict(reversed(geometry.items()))) != of({"cathode.L_um": 60.0})
    h0, h1 = of(geometry), of(geometry | {"cathode.L_um": 70.0})
    requests = [
        (1, 1, 4, h0, {"cathode.L_um": "70", "cathode.porosity": "9"}), (2, 1, 4, h0, {"cathode.L_um": "70"}), (2, 1, 4, h0, {"cathode.L_um": "70"}), (3, 1, 4, h0, {"cathode.L_um": "80"}), (4, 1, 5, h0, {"cathode.L_um": "80"}),
        (5, 1, 5, h1, {"cathode.L_um": "true"}), (6, 1, 5, h1, {}), (7, 1, 5, h1, {"x": "1"}), (8, 1, 5, h1, None), (9, 1, 5, h1, {"cathode.porosity": "0.2"}), (10, 2, 0, h0, {"cathode.L_um": "70"}),
    ]
    asked = spark.createDataFrame(requests, "request_id long, scheme_id long, base_revision int, base_hash string, changes map<string,string>")
    ranges = {"cathode.L_um": (10, 200), "cathode.porosity": (0.1, 0.6)}
    (r,) = contracts.revised(row(geometry), asked, ranges, budget=1).collect()
    codes = {x.request_id: x.code for x in r.log}
    assert codes == {1: "OUT_OF_RANGE", 2: "OK", 3: "STALE", 4: "STALE", 5: "BUDGET_EXHAUSTED", 6: "BUDGET_EXHAUSTED", 7: "BUDGET_EXHAUSTED", 8: "BUDGET_EXHAUSTED", 9: "BUDGET_EXHAUSTED"}
    assert (r.revision, r.geometry) == (5, geometry | {"cathode.L_um": 70.0})
    (r,) = contracts.revised(row(geometry), asked, ranges).collect()
    codes = {x.request_id: x.code for x in r.log}
    assert (codes[5], codes[6], codes[7], codes[9]) == ("VALUE_ILLEGAL", "EMPTY", "FIELD_UNKNOWN", "OK") and codes[8] in ("EMPTY", "STALE") and r.revision == 6
    (r,) = contracts.revised(row(geometry), asked.limit(0), ranges).collect()
    assert (r.revision, r.log, r.geometry) == (4, [], geometry)


def test_contract_of_a_lithium_anode(spark):
    schemes = spark.createDataFrame([(1, "NCM", "li_metal"), (2, "NCM", "graphite")], "scheme_id int, cathode string, anode string")
    full = {p: ("1", "llm_design") for p in contracts.PATHS} | {"cathode.D_s_m2s": ("1e-14", "literature"), "anode.R_s_um": (None, "not_applicable"), "anode.D_s_m2s": (None, "missing")}
    values = [(1, p, *v) for p, v in full.items()] + [(2, p, *v) for p, v in full.items() if p != "anode.L_um"] + [(1, "other.x", "1", "odd")]
    baseline = spark.createDataFrame([("graphite", "D_s_m2s", 1.0)], "material string, field string, value double")
    got = {r.scheme_id: r.problems for r in contracts.contract_problems(schemes, spark.createDataFrame(values, "scheme_id int, path string, value string, origin string"), baseline).collect()}
    assert got == {1: [], 2: ["anode.L_um:no_source", "anode.R_s_um:not_allowed_missing", "anode.D_s_m2s:not_allowed_missing"]}


def test_tasks_and_answers(spark):
    rows = spark.createDataFrame(
        [(1, "constraint_check", False, False, None, None, "fine"), (2, "constraint_check", None, False, None, None, "不可行"), (3, "combination_recommendation", True, None, 100.0, 100.9, "80 Wh/kg"), (4, "combination_recommendation", True, None, None, 100.0, "60 Wh/kg"),
         (5, "combination_recommendation", None, None, None, None, "x"), (6, "other", None, None, None, None, "x"), (7, "constraint_check", True, True, None, None, "不可行")],
        "i int, kind string, expected boolean, found boolean, energy double, estimate double, answer string",
    )
    c = F.col
    got = {r.i: (r.ok, r.h.hit, r.h.strict, r.h.error) for r in rows.select("i", rules.task_consistent(c("kind"), c("expected"), c("found"), c("energy"), c("estimate")).alias("ok"), rules.answer_hit(c("kind"), c("answer"), c("expected"), c("estimate")).alias("h")).collect()}
    assert got == {1: (True, False, False, None), 2: (False, True, True, None), 3: (True, True, True, 0.207), 4: (False, False, False, 0.4), 5: (True, None, None, None), 6: (True, None, None, None), 7: (True, True, False, None)}


def test_anchors_of_nulls_repeats_and_plain_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "plain"), (3, "路线A: 固相法\n---\n煅烧 900°C"), (3, "路线A: 固相法\n---\n煅烧 900°C"), (4, "首选 sol-gel; 煅烧 800℃ 2h\n路线B 固相法; 煅烧 700 ℃\n# end\n煅烧 600 ℃")], "doc_id int, text string")
    got = {r.doc_id: tuple(r)[1:] for r in anchors.anchors(docs).collect()}
    assert got == {1: (None,) * 6, 2: (None,) * 6, 3: (None, "solid_state", 900.0, 900.0, None, None), 4: (None, "sol_gel", 800.0, 800.0, 2.0, 2.0)}


def test_extraction_reports_what_fails(spark):
    schema = T.StructType([T.StructField("x", T.IntegerType(), False), T.StructField("y", T.StringType())])

    def odd(text):
        yield {"x": 1, "y": text}
        yield {"x": "no"}
        yield {"y": "only"}
        yield {"x": True}
        yield {"x": 2, "z": 3}
        yield "row"
        if text == "bad":
            raise ValueError("broken")

    docs = spark.createDataFrame([(1, "good", "k"), (2, "bad", "k"), (3, None, "k")], "doc_id int, text string, x string")
    got = extractor.extracted(docs, odd, schema).orderBy("doc_id", "n").collect()
    assert [r.asDict() for r in got if r.error is None] == [{"doc_id": d, "n": 0, "x": 1, "y": t, "error": None} for d, t in ((1, "good"), (2, "bad"))]
    wrong = ["x is no int: 'no'", "x is missing", "x is no int: True", "unknown fields: z", "not a row: str"]
    assert [r.error for r in got if r.doc_id == 1] == [None, *wrong] and [r.error for r in got if r.doc_id == 2] == [None, *wrong, "ValueError: broken"]


def test_measures(spark):
    docs = spark.createDataFrame([(1, "LFP and NCM811 give 160.5 mAh/g at 25 °C. At 3.4V, graphite 5 %x; 7 Vx 8 Wh/kg/h")], "doc_id int, text string")
    got = [(r.property, r.value, r.unit, r.subject) for r in extractor.extracted(docs).orderBy("n").collect()]
    assert got == [("capacity", 160.5, "mAh/g", "NCM811"), ("temperature", 25.0, "°C", "NCM811"), ("voltage", 3.4, "V", None)]

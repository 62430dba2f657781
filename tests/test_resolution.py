"""One automaton for all words, and the chain of ways to resolve a name."""

import random

import pytest
from pyspark.sql import functions as F

from sievemill.functions import text as t
from sievemill.operators import labels, matching, resolution


def test_counts_and_places_against_plain_search(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(30)})
    tables = [("x", words[:10] + words[:2]), ("y", words[5:]), ("z", [])], [("w", words[-3:])]
    texts = ["".join(rng.choice("abéc ") for _ in range(rng.randint(0, 60))) for _ in range(50)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    found = {r.i: r for r in rows.select("i", matching.keyword_counts(F.col("text"), *tables).alias("n"), matching.places(F.col("text"), words).alias("at")).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert found[i].n is None and found[i]["at"] is None
            continue
        assert found[i].n == [sum(1 for w in listed if w in text) for table in tables for _, listed in table]
        want = sorted((s, -len(w), w) for w in words for s in range(len(text)) if text.startswith(w, s))
        assert [(p.start, p.word) for p in found[i]["at"]] == [(s, w) for s, _, w in want]


def test_no_words_at_all(spark):
    row = spark.range(1).select(matching.keyword_counts(F.lit("x"), [("a", [])]).alias("n"), matching.places(F.lit("x"), []).alias("at")).first()
    assert row.n == [0] and row["at"] == []


@pytest.mark.parametrize("limit", [50_000, 0])
def test_longest_contained_by_automaton_and_by_join(spark, limit):
    names = spark.createDataFrame([("ab", 1), ("abc", 2), ("zz", 3), ("bcd", 4), ("abc", 5), ("é", 6)], "name string, id int")
    texts = ["xabcdx", "ab", "zzab", "", "none", "ééab", None, "ab"]
    got = matching.longest_contained(spark.createDataFrame([(x,) for x in texts], "text string"), "text", names, limit)
    assert sorted((r.text or "-", r.hit or 0) for r in got.collect()) == sorted([("xabcdx", 2), ("ab", 1), ("ab", 1), ("zzab", 1), ("-", 0), ("none", 0), ("ééab", 1), ("-", 0)])


def test_label_of_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, "b A"), (2, None), (3, "zzz"), (4, "b B c")], "i int, text string")
    got = {r.i: (r.label, r.score) for r in labels.with_label(rows, [("one", ["a"]), ("two", ["b", "b"]), ("three", ["c", "b"])], "none").collect()}
    assert got == {1: ("two", 2), 2: ("none", 0), 3: ("none", 0), 4: ("two", 2)}


VOCABULARY = [
    ("NCM811", "LiNi0.8Co0.1Mn0.1O2", ["NCM 811", "nickel-rich NCM"], 1), ("LCO", "LiCoO2", ["cobaltate"], 2), ("graphite", None, ["natural graphite", "C6"], 3),
    ("LIPF6_DEC-EC", None, None, 4), ("dup", None, ["NCM-811"], 9),
]
CASES = [
    ("1M LiPF6 in EC/DEC", None, None, ("LIPF6_DEC-EC", "LIPF6_DEC-EC", "formulation")), ("1M LiTFSI in DOL", None, "NCM811", (None, None, "none")), ("NCM-811", None, None, ("NCM811", "NCM811", "alias")),
    ("what", "LiCoO2", None, ("LCO", "LCO", "formula")), ("CoLiO2", None, None, ("LCO", "LCO", "formula")), ("flakes of natural graphite X", None, None, ("graphite", "graphite", "alias-contains")),
    ("Al2O3-coated NCM811", None, None, ("NCM811", "NCM811_Al2O3-coated", "alias")), ("some powder", None, "ncm 811", ("NCM811", "NCM811", "alias+hint")), ("LCO", None, "no hint", ("LCO", "LCO", "alias")),
    ("what else", None, None, (None, None, "none")), ("  ", "LiCoO2", "LCO", (None, None, "none")), (None, None, None, (None, None, "none")), ("NCM-811", None, None, ("NCM811", "NCM811", "alias")),
]


def test_each_way_of_the_chain(spark):
    vocabulary = spark.createDataFrame(VOCABULARY, "id string, formula string, aliases array<string>, rank int")
    rows = spark.createDataFrame([(i, *c[:3], "x") for i, c in enumerate(CASES)], "i int, name string, formula string, hint string, base_id string").repartition(3)
    got = resolution.resolved(rows, vocabulary)
    assert {r.i: (r.base_id, r.variant_id, r.norm_method) for r in got.collect()} == {i: c[3] for i, c in enumerate(CASES)}
    queue = {(r.name, r.formula): r.n for r in resolution.unresolved(got).collect()}
    assert queue == {("1M LiTFSI in DOL", None): 1, ("what else", None): 1}
    assert resolution.resolved(rows.limit(0), vocabulary).collect() == []


def test_indexes_keep_the_first(spark):
    vocabulary = spark.createDataFrame(VOCABULARY, "id string, formula string, aliases array<string>, rank int")
    aliases, formulas = resolution.indexes(vocabulary)
    assert {r.alias_key: r.id for r in aliases.collect()}["ncm811"] == "NCM811"
    assert {r.id for r in formulas.collect()} == {"NCM811", "LCO", "graphite"}
    assert spark.range(1).select(t.formula_key(F.lit("CoLiO2")).alias("k")).first().k == "Co1Li1O2"


def test_foreign_evidence_and_routes(spark):
    rows = spark.createDataFrame(
        [(1, "NCM cell", "s", "na-ION only"), (2, "NCM cell", "s", "Na-ion and lithium"), (3, "sodium", "s", "na-ion"), (4, "NCM", None, "na-ion"), (5, "NCM", "s", ""), (6, None, "s", "na-ion"), (7, "NCM", "k-ion", "plain")],
        "i int, scheme string, source string, text string",
    )
    got = {r.i: (r.is_evidence, r.is_foreign) for r in labels.foreign_evidence(rows, "scheme", "source", "text").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (False, False), 6: (True, False), 7: (True, True)}
    texts = spark.createDataFrame([("固相法 and sol-gel",), ("Ni(OH) 2",), (None,), ("plain",)], "text string")
    assert [r.routes for r in labels.with_routes(texts).collect()] == [["solid_state", "sol_gel"], ["hydroxide_coprecipitation"], [], []]

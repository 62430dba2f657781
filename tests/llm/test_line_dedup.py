from sievemill.llm import line_dedup


def test_drops_lines_above_the_ratio(spark):
    rows = [(i, f"menu\n \nown {i}\nmenu" if i < 30 else f"own {i}\nrare", "a", 1) for i in range(100)]
    rows += [(200 + i, f"menu\n{i}", None, 1) for i in range(6)] + [(300, None, "a", 1), (301, "", "b", 1), (302, "menu\nx", "c", 1), (5, "menu\n \nown 5\nmenu", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, line_total long")
    for limit in (10**6, 0):
        got = {(r.doc_id, r.source): r for r in line_dedup.drop_boilerplate(docs, host="source", ratio=0.2, broadcast_lines=limit).collect()}
        assert got[3, "a"].text == " \nown 3" and (got[3, "a"].line_total, got[3, "a"].line_dropped) == (4, 2)
        assert got[50, "a"].text == "own 50"  # rare is on 70 of 102
        assert got[200, None].text == "0" and got[302, "c"].text == "menu\nx"
        assert (got[300, "a"].text, got[300, "a"].line_total) == (None, 0) and got[301, "b"].text == ""
    out = line_dedup.drop_boilerplate(docs, host="source", ratio=0.2)
    assert out.count() == len(rows) and out.columns == ["doc_id", "text", "source", "line_total", "line_dropped"]
    assert line_dedup.drop_boilerplate(docs.limit(0), host="source").count() == 0


def test_all_lines_go_and_spaces_at_ends_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "\tnav \r" if i % 2 else "nav", "h") for i in range(8)], "doc_id long, text string, source string")
    assert {r.text for r in line_dedup.drop_boilerplate(docs, host="source", ratio=0.5).collect()} == {""}


def test_exact_copies_count_once(spark):
    body = "a story\nof three\nlines"
    rows = [(i, f"menu\nown {i}", "a") for i in range(100)] + [(100 + i, body, "a") for i in range(40)] + [(200 + i, None, "a") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs, host="source", copies_once=True).collect()}
    assert {got[100 + i] for i in range(40)} == {body} and got[3] == "own 3" and got[200] is None and len(got) == len(rows)
    found = {r.pages: r.ratio for r in line_dedup.boilerplate(docs, host="source", copies_once=True).collect()}
    assert found == {100: 100 / 102}  # the menu only; the copies are one page, and so are the nulls
    assert {r.text for r in line_dedup.drop_boilerplate(docs, host="source").filter("doc_id between 100 and 139").collect()} == {""}


def test_columns_of_any_name_and_long_texts(spark):
    names = ["__host", "__lines", "__kept", "__drop", "__salt", "__k0", "__s0", "host"]
    rows = [(i, "menu\n" + f"own {i}\n" * (100_000 if i == 3 else 1), "a", *[f"{n}{i}" for n in names]) for i in range(20)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in names]]))
    for limit in (10**6, 0):
        got = line_dedup.drop_boilerplate(docs, host="source", broadcast_lines=limit)
        assert got.columns == [*docs.columns, "line_total", "line_dropped"]
        for r in got.collect():
            assert r.line_dropped == 1 and r.text == f"own {r.doc_id}\n" * (100_000 if r.doc_id == 3 else 1) and all(r[n] == f"{n}{r.doc_id}" for n in names)

"""The audit of filters against applying each order one by one."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill.llm import audit, registry


def plain(rows, names):
    """rows: (part, failing letters, losses). {(part, order, step): numbers} by walking each order."""
    out, removed_by = {}, Counter()
    orders = ["".join(o) for o in itertools.permutations(names)]
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in orders:
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                removed_by[part, letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(1 for r in mine if letter in r[1]) - len(gone), sum(1 for r in mine if r[1] == letter), sum(1 for r in gone if r[2])]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, names):
    df = spark.createDataFrame(rows, "part string, failing string, bad boolean, kept int").repartition(3)
    fails = {n: F.contains("failing", F.lit(n)) for n in names}
    found = audit.audit(df, fails, F.coalesce("part", F.lit("")), {"bad": F.col("bad")})
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "lost_bad", "shapley"]
    rows = found.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.lost_bad, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("names", ["A", "AB", "ABCD"])
def test_every_order(spark, names):
    kinds = ["".join(c) for n in range(len(names) + 1) for c in itertools.combinations(names, n)]
    rows = [(f"s{i % 3}" if i % 4 else "", kinds[(i * 7) % len(kinds)], i % 5 == 0, 1) for i in range(60)] + [("hot", names, True, 1)] * 20 + [("clean", "", None, 1)]
    assert audited(spark, rows, names) == plain(rows, names)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "A", None, None), (None, "A", None, None), ("", None, True, 1), ("x", "", True, 2)]
    want = plain([("", "A", None), ("", "A", None), ("", "", True), ("x", "", True)], "AB")
    assert audited(spark, rows, "AB") == want
    assert audited(spark, [], "AB") == {}
    with pytest.raises(ValueError):
        audit.audit(spark.range(1), {}, F.lit(""))


def test_states_are_visited_once_and_few_are_persisted(spark, monkeypatch):
    seen, held, most = [], [], []
    frame = type(spark.range(1))
    persist, unpersist = frame.persist, frame.unpersist
    monkeypatch.setattr(frame, "persist", lambda self, *a: (held.append(1), seen.append(1), most.append(len(held)), persist(self, *a))[-1])
    monkeypatch.setattr(frame, "unpersist", lambda self, *a: (held.pop(), unpersist(self, *a))[-1])
    audited(spark, [("a", "AC", False, 1), ("a", "B", True, 1)], "ABCD")
    assert len(seen) == 2**4 - 1 and not held and max(most) <= 4


def test_repeats_of_smaller_ids(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (1, "a"), (None, "a"), (2, "b"), (None, "c"), (None, "c"), (5, "")], "doc_id long, key string")
    got = Counter((r.doc_id, r.key, r.repeats) for r in audit.repeats_smaller(rows, "key", "doc_id").collect())
    assert got == Counter({(3, "a", True): 1, (1, "a", False): 2, (None, "a", False): 1, (2, "b", False): 1, (None, "c", False): 2, (5, "", False): 1})


def test_query_conditions(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(200))
    docs = [
        (1, long, "s"), (2, long, "s"), (3, long + " Ab", None), (4, "few words", "s"), (5, None, "s"), (6, "", ""), (7, ("a " * 100 + "b c ") * 2, "t"),
        (8, long + " " + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2, "t"), (9, long + " #", "t"), (None, long, "t"), (9, long + " #", "t"),
    ]
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(2, 1, 0), (2, 0, 1), (4, None, 1), (None, 1, 1), (99, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = registry.op13_filter_audit(spark, str(tmp_path)).collect()
    known = {1: "", 2: "E", 3: "", 4: "A", 5: "A", 6: "AE", 7: "B", 8: "C", 9: "D", None: ""}
    rows = [(d[2] or "", known[d[0]], d[0]) for d in docs]
    for column, good in (("good_lost", {2}), ("toxic_lost", {2, 4})):
        want = plain([(p, f, i in good) for p, f, i in rows], "ABCDE")
        assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r[column], r.shapley) for r in found} == want

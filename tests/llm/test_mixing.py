import pytest

from sievemill.llm import mixing


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string")


def waterfill(sizes, weights, repeats):
    total, targets, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(repeats * sizes[s] for s in capped)
        open_ = sum(weights[s] for s in sizes if s not in capped)
        targets = {s: repeats * sizes[s] if s in capped else left * weights[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in capped and targets[s] > repeats * sizes[s] + 1e-9}
        if not over:
            return targets
        capped |= over


def test_targets_and_words_taken(spark):
    rows = [(i, "w " * (i % 7 + 1), "abc"[min(2, i // 40)], "clash") for i in range(100)] + [(100 + i, "x", None, None) for i in range(3)]
    rows += [(200, None, "a", None), (201, "", "b", None), (None, "p q", "c", None), (5, "w w w w w w", "a", "again")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs, mixing.cyclic_weights(docs)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    targets = waterfill(sizes, {"a": 1, "b": 2, "c": 3, None: 1}, 3)
    taken = {}
    for r in got:
        assert r.mix_size == len((r.text or "").split()) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(targets[r.source]) and 0 <= r.mix_taken <= 3 * r.mix_size
        assert r.mix_taken == sum(c.words for c in r.mix_copies) and all(0 <= c.position < 1 for c in r.mix_copies)
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(7), mixing.cyclic_weights(docs)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_weights_that_change(spark):
    docs = docs_of(spark, [(i, "w", "ab"[i % 2], None) for i in range(4000)])
    weights = spark.createDataFrame([("a", [2.0, 0.0, 0.0]), ("b", [0.0, 2.0, 2.0]), (None, None)], "source string, weights array<double>")
    ordered = mixing.training_order(mixing.mix(docs, weights, grid=(0.0, 0.5, 1.0)), 4).collect()
    positions = [r.position for r in ordered]
    assert positions == sorted(positions) and 3990 <= len(ordered) <= 4010
    share = lambda lo, hi: sum(r.source == "a" for r in ordered if lo <= r.position < hi) / max(1, sum(lo <= r.position < hi for r in ordered))
    assert share(0.0, 0.05) > 0.9 and abs(share(0.2, 0.3) - 0.5) < 0.05 and share(0.6, 1.0) == 0


def test_empty_and_unweighted(spark):
    docs = docs_of(spark, [(1, "a b", "x", None)])
    assert mixing.mix(docs.limit(0), mixing.cyclic_weights(docs)).count() == 0
    none = spark.createDataFrame([("y", [1.0, 1.0, 1.0])], "source string, weights array<double>")
    assert [r.mix_taken for r in mixing.mix(docs, none).collect()] == [0]
    blank = docs_of(spark, [(1, None, None, None), (2, " ", "s", None)])
    assert [(r.mix_size, r.mix_taken) for r in mixing.mix(blank, mixing.cyclic_weights(blank)).collect()] == [(0, 0)] * 2


def test_columns_of_any_name_are_carried(spark):
    names = ["weight", "offset", "shares", "start", "__x0", "__y0", "__src", "__key", "__bucket", "words", "position", "mix_target", "Target"]
    docs = spark.createDataFrame([(i, "w " * i, "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(1, 9)], ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in names]]))
    got = mixing.mix(docs, mixing.cyclic_weights(docs))
    assert got.columns == [c for c in docs.columns if c != "mix_target"] + ["mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_copies"]
    for r in got.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names if n != "mix_target")
    ordered = mixing.training_order(got)
    assert {"__x0", "start", "position", "words"} <= set(ordered.columns) and "mix_copies" not in ordered.columns


def test_water_levels(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 1000]) for i in range(40)}
        weights = {s: rng.choice([0.5, 1.0, 2.0, 3.0]) for s in sizes}
        rows = spark.createDataFrame([(s, weights[s], 3 * sizes[s]) for s in sizes] + [("none", 0.0, 30)], "source_key string, weight double, cap long")
        got = {r.source_key: r.target for r in mixing.water_filled(rows, sum(sizes.values())).collect()}
        want = waterfill(sizes, weights, 3)
        assert got.pop("none") == 0 and got == pytest.approx(want)


def test_schedules_integrate_to_one_two_three(spark):
    area = lambda w: sum((w[k] + w[k + 1]) * (mixing.GRID[k + 1] - mixing.GRID[k]) / 2 for k in range(len(w) - 1))
    assert [area(w) for w in mixing.CURRICULUM] == [1, 2, 3]
    docs = docs_of(spark, [(i, "w", "abc"[i % 3], None) for i in range(9000)])
    ordered = mixing.training_order(mixing.mix(docs, mixing.cyclic_weights(docs)), 4).collect()
    share = lambda s, lo, hi: sum(r.source == s for r in ordered if lo <= r.position < hi) / sum(lo <= r.position < hi for r in ordered)
    assert abs(share("a", 0, 0.05) - 1 / 3) < 0.03 and share("a", 0.95, 1) < 0.03 and abs(share("c", 0.95, 1) - 2 / 3) < 0.03 and abs(share("b", 0.4, 0.6) - 1 / 3) < 0.03


def test_counted_words_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "x", "a")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.mix_size, r.mix_taken) for r in mixing.mix(docs, mixing.cyclic_weights(docs)).collect()}
    assert got == {1: (300_000, 300_000), 2: (1, 1)}
    counted = docs.selectExpr("doc_id", "source", "case when doc_id = 1 then 300000 else 1 end as n")
    assert {r.doc_id: (r.mix_size, r.mix_taken) for r in mixing.mix(counted, mixing.cyclic_weights(counted), size="n").collect()} == got

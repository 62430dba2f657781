"""Whitening against exact fractions and numpy on a fixture."""

from fractions import Fraction

import numpy as np
import pytest

from sievemill.llm import registry, whitening

SMALL = "/root/testdata/sf0.001"


def rows_of(spark, vectors, kind="double"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, whitened string, deviation int").repartition(3)


def plain(vectors):
    """n, sums, deviations and covariance by exact fractions."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    cov = [[float(sum((Fraction(r[i]) - Fraction(sums[i], n)) * (Fraction(r[j]) - Fraction(sums[j], n)) for r in x) / n) for j in range(d)] for i in range(d)]
    return n, sums, deviations, np.array(cov), np.array([[float(Fraction(r[j]) - Fraction(sums[j], n)) for j in range(d)] for r in x])


def test_against_exact_fractions(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(40, 5)) * [3, 2, 1, 0.5, 0.1] + 7).tolist()
    model = whitening.fit(rows_of(spark, vectors), components=8)
    n, sums, deviations, cov, centred = plain(vectors)
    values, basis = np.linalg.eigh(cov)
    assert model.n == n and model.sums == sums and len(model.eigenvalues) == 5 and model.identity_error < 1e-9
    assert np.allclose(model.explained, values[::-1] / np.trace(cov), rtol=1e-12)
    found = {r.vec_id: r for r in whitening.transform(rows_of(spark, vectors), model, "vec_id").collect()}
    assert [found[i].deviation for i in range(n)] == deviations
    want = centred @ basis[:, ::-1] / np.sqrt(values[::-1])
    got = np.array([found[i].whitened for i in range(n)])
    assert np.allclose(np.abs(got), np.abs(want), rtol=1e-9, atol=1e-9)


def test_merging_does_not_depend_on_partitions():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1000, (60, 4)) + 10**9
    one = whitening._whole_moments(x)
    cuts = [whitening._whole_moments(p) for p in np.split(x, [1, 7, 30])]
    many = cuts[0].merged(cuts[1]).merged(cuts[2].merged(cuts[3]))
    assert many.n == one.n and many.sums == one.sums and np.allclose(many.scatter, one.scatter, rtol=1e-12)


def test_unusable_vectors_and_other_lengths_take_no_part(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [3.0, 5.0], [3.0, 5.0]]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1e300, 0.0], [1.0, 2.0, 3.0]]
    rows = rows_of(spark, good + bad)
    model = whitening.fit(rows)
    assert (model.n, model.sums) == plain(good)[:2]
    found = whitening.transform(rows, model, "vec_id")
    assert found.columns == ["vec_id", "deviation", "whitened"] and sorted(r.vec_id for r in found.collect()) == [0, 1, 2, 3]


def test_no_variance_one_row_and_no_rows(spark):
    flat = whitening.fit(rows_of(spark, [[1.0, 2.0]] * 3))
    assert flat.identity_error is None and flat.explained == [None, None]
    assert [r.whitened for r in whitening.transform(rows_of(spark, [[1.0, 2.0]] * 3), flat, "vec_id").collect()] == [[None, None]] * 3
    line = whitening.fit(rows_of(spark, [[1.0, 2.0], [2.0, 4.0]]))
    assert line.identity_error < 1e-9 and line.explained[1] == 0
    white = [r.whitened for r in whitening.transform(rows_of(spark, [[1.0, 2.0], [2.0, 4.0]]), line, "vec_id").collect()]
    assert sorted(round(w[0], 9) for w in white) == [-1, 1] and all(w[1] is None for w in white)
    assert whitening.fit(rows_of(spark, [[1.0]]).limit(0)) is None and whitening.fit(rows_of(spark, [None, []])) is None


@pytest.mark.parametrize("scale, exact", [(1.0, True), (1e5, True), (1e9, False)])
def test_deviations_are_exact_or_null(spark, scale, exact):
    vectors = [[scale, -scale], [0.0, scale / 3], [-scale, 0.5]]
    rows = rows_of(spark, vectors)
    found = {r.vec_id: r.deviation for r in whitening.transform(rows, whitening.fit(rows), "vec_id").collect()}
    want = plain(vectors)[2]
    assert [found[i] for i in range(3)] == [d if d < 1 << 63 else None for d in want] and exact == all(d < 1 << 63 for d in want)


def test_query(spark, tmp_path):
    found = registry.op12_whitening(spark, SMALL).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    order = sorted(vectors)
    n, _, deviations, cov, centred = plain([vectors[i] for i in order])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(found) == 8 * n and {r.component for r in found} == set(range(1, 9))
    got = np.zeros((n, 8))
    at = {v: i for i, v in enumerate(order)}
    for r in found:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviations[at[r.vec_id]] and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-12
    want = centred @ basis[:, :8] / np.sqrt(values[:8])
    signs = np.sign((got * want).sum(0))
    assert np.allclose(got, want * signs, rtol=1e-6, atol=1e-8)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.op12_whitening(spark, str(tmp_path)).collect() == []

import math

import numpy as np

from sievemill.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[500]  # one very common vector
    got = ann.nearest(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), "vec_id % 100 = 0").toPandas()
    hits = total = 0
    for q in range(0, 3000, 100):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), far)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, far[own.vec_id], rtol=0, atol=1e-12)
        assert own[["score", "vec_id"]].values.tolist() == sorted(own[["score", "vec_id"]].values.tolist())
        hits, total = hits + len(set(order) & set(own.vec_id)), total + 10
    assert hits / total >= 0.95


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [math.nan, 1.0], 1), (5, [math.inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [], 1), (1, [0.0, 1.0], 1)]
    got = ann.nearest(table(spark, rows), "vec_id % 100 = 0").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, math.sqrt(2))]
    assert ann.nearest(table(spark, rows).limit(0), "vec_id = 0").count() == 0


def test_boundary_vectors_are_in_several_lists():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    index = ann.Index(x, len(x))
    lists = index.lists_of(x)
    to = ann._near(x, index.centres)
    assert all(len(a) == len(set(a.tolist())) >= 1 for a in lists) and sum(len(a) > 1 for a in lists) > 20
    assert np.mean([a[0] == t.argmin() for a, t in zip(lists, to, strict=True)]) > 0.99
    sizes = np.bincount(np.concatenate(lists), minlength=len(index.centres))
    assert sizes.max() < 6 * sizes.mean()


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    near = [(1, (x[0] + 0.001).tolist(), 0)] * 40  # one row many times, next to a query
    once, often = ([tuple(r) for r in ann.nearest(table(spark, t), "vec_id % 100 = 0").orderBy("query_id", "rank").collect()] for t in (rows + near[:1], rows * 2 + near))
    assert often == once and len(once) == 30


def test_rows_of_one_id_and_distance_count_once(spark):
    rows = [(0, [1.0, 0.0], 0), *[(i, [0.0, -1.0 - i], 0) for i in range(2, 13)]]
    rows += [(1, [1.0, y], 0) for y in (0.5, -0.5)] * 12  # two vectors of one id, equally far from the query
    got = ann.nearest(table(spark, rows), "vec_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11))


def test_fewer_comparisons_than_brute_force_at_64_dimensions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    vectors = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    dim, _, _, sizes, probes = ann.lists(ann.usable(vectors, "vec_id", "embedding"), "vec_id % 100 = 0")
    assert dim == 64 and sum(sizes.values()) < 1.4 * 6000
    assert sum(sizes[c] * n for c, n in probes.items()) < 0.95 * 60 * 6000
    got = ann.nearest(vectors, "vec_id % 100 = 0").toPandas()
    hits = 0
    for q in range(0, 6000, 100):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        hits += len({i for i in np.argsort(far) if i != q} and set(np.argsort(far)[1:11]) & set(got[got.query_id == q].vec_id))
    assert hits / 600 >= 0.9


def test_a_walk_has_distances_to_what_it_meets_only():
    x = np.random.default_rng(4).normal(size=(12_000, 32))
    index = ann.Index(x, len(x))
    row, centre, far = index.walk(x[:200], index.boundary)
    assert len(row) < 0.8 * 200 * len(index.centres) and len(set(zip(row.tolist(), centre.tolist(), strict=True))) == len(row)
    assert np.allclose(far, np.sqrt(((x[row] - index.centres[centre]) ** 2).sum(1)))

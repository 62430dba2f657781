import random

import numpy as np

from sievemill.llm import toxicity


def random_examples(seed, n=300, terms=20):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        ids = np.unique(rng.integers(0, terms, rng.integers(1, 6)))
        w = rng.random(len(ids)) + 0.1
        rows.append((i, int(rng.integers(0, 2)), ids.tolist(), (w / np.sqrt((w * w).sum())).tolist()))
    return rows


def test_block_max_search_is_exact():
    for seed in range(24):
        rows = random_examples(seed)
        index = toxicity.Examples(rows, 20, long=(0.0, 0.15, 1.0)[seed % 3])
        dense = np.zeros((len(rows), 20))
        for k, i in enumerate(index.ids):
            dense[k, rows[i][2]] = rows[i][3]
        rng = np.random.default_rng(seed + 100)
        for _ in range(20):
            terms = np.unique(rng.integers(0, 20, 4))
            weights = rng.random(len(terms))
            sims = dense[:, terms] @ weights
            found, cosines = index.nearest(terms, weights, 10)
            least = np.sort(sims[sims > 0])[-10:].min()
            want = np.flatnonzero((sims >= least - 1e-12) & (sims > 0))
            assert set(found.tolist()) == set(want.tolist()) and np.allclose(cosines, sims[found])


def test_isotonic_rises_and_stays_inside():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5])
    centres, levels = toxicity.isotonic(x, np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(levels) >= 0).all() and (levels > 0).all() and (levels < 1).all() and len(centres) == len(levels)


def corpus(spark, n=400):
    rng = random.Random(1)
    words = [a + b for a in "bcdfgl" for b in "aeiou"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = " ".join(rng.choice(words) for _ in range(30)) + (" you Scumbag" if toxic else "")
        rows.append((i, text, 0.5))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(900, None, 0.0), (901, "", 0.0), (None, "scumbag", 0.0), (901, "", 0.0)], "doc_id long, text string, tox_score double")
    return docs, spark.createDataFrame(labels + [(3, None), (None, 1), (3, 0)], "doc_id long, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    assert len(got) == 404
    for r in got:
        assert 0 <= r.tox_score <= 1
        if r.doc_id is not None and r.doc_id < 400:
            assert (r.tox_score >= 0.5) == (r.doc_id % 5 == 0)
    by = {r.doc_id: r for r in got}
    assert by[900].tox_score == by[901].tox_score < 0.5 and by[None].tox_score >= 0.5 and by[None].held
    assert by[0].tox_evidence and all(e.toxic == 1 for e in by[0].tox_evidence)
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 404 - 80 - 1


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 20)
    model = toxicity.fit(docs, labels.limit(0))
    assert {r.tox_score for r in toxicity.score(docs, model).collect()} == {toxicity.PRIOR}
    assert toxicity.reject_toxic(docs.limit(0), labels).count() == 0


def test_scores_by_brute_force(spark):
    import math
    import zlib
    from collections import Counter, defaultdict

    docs, labels = corpus(spark, 150)
    docs = docs.unionByName(docs.filter("doc_id < 30").selectExpr("doc_id + 1000 as doc_id", "text", "tox_score"))  # copies, some with other labels
    labels = labels.unionByName(spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i in range(30)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    texts, given = [(r.doc_id, r.text) for r in docs.collect()], defaultdict(list)
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            given[r.doc_id].append(r.toxic)
    of = lambda t: Counter(x for w in toxicity.alnum_words((t or "").encode()) for x in toxicity.terms_of(w))
    by_text = defaultdict(list)
    for i, t in texts:
        if i in given:
            by_text[t].append((i, int(2 * sum(given[i]) >= len(given[i]))))
    examples = [(min(i for i, _ in m), int(2 * sum(y for _, y in m) >= len(m)), of(t)) for t, m in by_text.items()]
    p, n = Counter(), Counter()
    for _, y, c in examples:
        (p if y else n).update(c.keys())
    toxic = sum(y for _, y, _ in examples)
    other, part = len(examples) - toxic, lambda s, e: s * math.log(s / e) if s else 0.0
    scale = {}
    for t in p | n:
        if p[t] + n[t] >= 2:
            h, lacks, total = p[t] + n[t], len(examples) - p[t] - n[t], len(examples)
            g = 2 * (part(p[t], h * toxic / total) + part(n[t], h * other / total) + part(toxic - p[t], lacks * toxic / total) + part(other - n[t], lacks * other / total))
            telling = p[t] * other > 4 * n[t] * toxic and g > 2 * math.log(len(p | n) + 1) + 8
            if not (telling or t.startswith("=")):
                continue
            scale[t] = math.log((len(texts) + 1) / (sum(t in of(x) for _, x in texts) + 1)) * (1.0 if telling else toxicity.WEAK)

    def vector(c):
        v = {t: (1 + math.log(k)) * scale[t] for t, k in c.items() if t in scale}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else v

    vectors = [(i, y, vector(c)) for i, y, c in examples]

    def vote(v, without=None):
        sims = sorted(((sum(x * w.get(t, 0) for t, x in v.items()), y) for i, y, w in vectors if i != without), reverse=True)
        sims = [s for s in sims if s[0] > 1e-12]
        least = sims[14][0] if len(sims) > 14 else 0
        near = [s for s in sims if s[0] >= least - 1e-9]
        return sum(s * (2 * y - 1) for s, y in near) / max(15, len(near)), bool(near)

    bare = [y for _, y, v in vectors if not v]
    empty = (sum(bare) + 2 * toxicity.PRIOR) / (len(bare) + 2)
    own = [(vote(v, i)[0], y) for i, y, v in vectors if v]
    centres, levels = toxicity.isotonic(np.array([x for x, _ in own]), np.array([float(y) for _, y in own]))
    for i, t in texts:
        v, any_near = vote(vector(of(t)))
        assert abs(got[i].tox_score - (np.interp(v, centres, levels) if any_near else empty)) < 1e-6


def test_long_text(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    long = spark.createDataFrame([(1, "bade " * 200_000 + "scumbag", 0.0)], docs.schema)
    assert 0 <= toxicity.score(long, model).first().tox_score <= 1


def small_model(n=300, words=200):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        ids = np.unique(rng.integers(0, words, 12))
        w = rng.random(len(ids)) + 0.1
        rows.append((i, i % 2, ids, w / np.sqrt((w * w).sum())))
    model = toxicity.Model(toxicity.Terms([f"=w{i}" for i in range(words)], range(words)), np.ones(words), toxicity.Examples(rows, words), toxicity.PRIOR)
    return model, [" ".join(f"w{j}" for j in rng.integers(0, words, 9)).encode() + b" %d" % i for i in range(2_000)]


def test_a_task_remembers_no_evidence_that_nobody_asked_for():
    import tracemalloc

    model, texts = small_model()
    assert sum(isinstance(v, dict) and len(v) == 200 for v in vars(model.terms).values()) == 1  # each term once
    tracemalloc.start()
    bare = [s for s, _, _ in model.scores(texts, evidence=False)]
    held = tracemalloc.get_traced_memory()[0] / len(texts)
    tracemalloc.stop()
    assert held < 400
    full = list(model.scores(texts))  # by the same model
    assert bare == [s for s, _, _ in full] and all(len(numbers) == len(cosines) > 0 for _, numbers, cosines in full)


def test_cosines_beside_others_are_those_alone():
    rows = random_examples(7, n=900, terms=60)
    index, rng = toxicity.Examples(rows, 60), np.random.default_rng(8)
    often = np.bincount(np.concatenate([r[2] for r in rows]), minlength=60)
    assert len(index.example) == often[often <= toxicity.LONG * 900].sum()  # lists of frequent terms are not read text by text
    vectors = [(t, rng.random(len(t))) for t in (np.unique(rng.integers(0, 60, rng.integers(0, 9))) for _ in range(100))]
    without = [i if i % 3 else -1 for i in range(100)]
    for found, vector, own in zip(index.nearest_of(vectors, 15, without), vectors, without, strict=True):
        alone = index.nearest(*vector, 15, own)
        assert (found[0] == alone[0]).all() and (found[1] == alone[1]).all() and own not in found[0]
        sims = np.zeros(900)
        for k, i in enumerate(index.ids):
            weight = dict(zip(rows[i][2], rows[i][3], strict=True))
            sims[k] = 0 if k == own else sum(w * weight.get(t, 0) for t, w in zip(vector[0].tolist(), vector[1].tolist(), strict=True))
        least = np.sort(sims)[-15]
        assert set(found[0].tolist()) == set(np.flatnonzero((sims > 0) & (sims >= least - 1e-12)).tolist())

import itertools
import random

import numpy as np

from sievemill.llm import licenses
from sievemill.llm.common import alnum_words


def best_share(template, words):
    """Longest common subsequence share, as an upper bound and for exact copies the value."""
    row = [0] * (len(words) + 1)
    for x in template:
        new = [0]
        for j, y in enumerate(words):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / len(template)


def test_finds_planted_notices_and_leaves_others():
    templates = licenses.Templates(licenses.TEMPLATES)
    rng = random.Random(0)
    filler = lambda n: " ".join(rng.choice(["the", "of", "and", "zq", "software", "lorem"]) for _ in range(n))
    for name, text in licenses.TEMPLATES:
        words = text.split()
        for k in range(4):
            changed = list(words)
            if k:  # one word in twelve is changed or dropped
                for at in sorted(rng.sample(range(len(words)), len(words) // 12), reverse=True):
                    changed[at : at + 1] = [] if k == 1 else ["other"]
            doc = f"{filler(50)} {' '.join(changed)} {filler(40)}"
            found = licenses.scan(doc.encode(), templates)
            own = [f for f in found if templates.names[f[0]] == name]
            assert len(own) == 1, (name, k)
            _, start, stop, matched = own[0]
            size = len(templates.words[own[0][0]])
            assert matched / size >= 0.8 and abs(start - 50) <= 6 and abs(stop - 50 - len(alnum_words(" ".join(changed).encode()))) <= 6
            assert k or (matched == size and start == 50)
    assert licenses.scan(filler(3000).encode(), templates) == []


def test_alignment_never_exceeds_the_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        template, words = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 30))
        wide = licenses.aligned(template, words, 0, 40)
        assert wide[0] / len(template) == best_share(template.tolist(), words.tolist())
        assert licenses.aligned(template, words, 3, 2)[0] <= wide[0]


def test_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x Released under the MIT License. y " * 3, 0), (2, None, 0), (3, "", 0), (None, "Licensed under CC BY-NC 4.0.", 0)], "doc_id long, text string, license_matches int")
    got = {r.doc_id: [(m.license, m.start, m.stop) for m in r.license_matches] for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: [("MIT-notice", 7 * k + 1, 7 * k + 6) for k in range(3)], 2: [], 3: [], None: [("CC-BY-NC-4.0-notice", 0, 7)]}
    own = licenses.scan_licenses(docs, templates=[("a", "mit"), (None, "x"), ("b", "")])
    assert sorted(len(r.license_matches) for r in own.collect()) == [0, 0, 0, 3]
    assert licenses.license_rows(docs).count() == 4 and licenses.scan_licenses(docs.limit(0)).count() == 0


def everywhere(words, templates, coverage=licenses.COVERAGE):
    """Best places of each template by exact alignment at every diagonal of the text."""
    ids = np.array([templates.vocabulary.get(w, 0) for w in words], np.int32)
    out = []
    for i, t in enumerate(templates.words):
        band = max(licenses.BAND_LEAST, int(licenses.BAND_SHARE * len(t)))
        found = {licenses.placed(t, ids, d, licenses.reach(len(t), band, coverage), coverage * len(t), len(t) + band) for d in range(-len(t) - band, len(ids) + band + 1)} - {None}
        spans = []
        for matched, a, b in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
            if all(b <= x or y <= a for x, y in spans):
                spans.append((a, b))
                out.append((i, a, b, matched))
    return sorted(out, key=lambda f: (f[1], f[2], f[0]))


def window_shares(template, words, limit):
    """The largest share of the template in any window of the text: plain longest common subsequences, without bands."""
    return max((best_share(template, words[a : a + limit]) for a in range(max(1, len(words) - limit + 1))), default=0)


def test_words_that_stand_apart_do_not_hide_a_match():
    text = [f"w{i}" for i in range(100)]
    templates = licenses.Templates([("t", " ".join(text))])
    away = ["x"] * 10
    (found,) = licenses.scan(" ".join([text[0], *away, *text[1:-1], *away, text[-1]]).encode(), templates)
    assert found[3] >= 98 and found[2] - found[1] <= 100 + max(licenses.BAND_LEAST, int(licenses.BAND_SHARE * 100))
    own = licenses.Templates(licenses.TEMPLATES)
    name, mit = max((t for t in licenses.TEMPLATES if "MIT" in t[0]), key=lambda t: len(t[1]))
    words = mit.split()
    strayed = " ".join([words[0], *["stray"] * 12, *words[1:-1], *["stray"] * 12, words[-1]])
    assert name in {own.names[f[0]] for f in licenses.scan(strayed.encode(), own)}


def test_no_match_is_lost_against_plain_subsequences():
    rng = random.Random(7)
    text = [f"w{i}" for i in range(60)]
    templates = licenses.Templates([("t", " ".join(text))])
    limit = 60 + max(licenses.BAND_LEAST, int(licenses.BAND_SHARE * 60))
    hits = 0
    for _ in range(150):
        words = list(text)
        for at in sorted(rng.sample(range(60), rng.randrange(0, 14)), reverse=True):
            words[at : at + 1] = rng.choice([[], ["x"], [words[at], *["y"] * rng.randrange(1, 9)]])
        words = ["z"] * rng.randrange(0, 20) + words + ["z"] * rng.randrange(0, 20)
        share, found = window_shares(text, words, limit), licenses.scan(" ".join(words).encode(), templates)
        if share < licenses.COVERAGE:
            assert found == []
        elif found:
            assert found[0][3] <= share * 60 + 1e-9
            hits += 1
        else:  # a match is found by any run of the winnowing's words; only a text without one may go without
            runs = max((len(list(g)) for ok, g in itertools.groupby(range(len(words) - 1), key=lambda k: words[k] in text and words[k + 1] in text and text.index(words[k + 1]) == text.index(words[k]) + 1) if ok), default=0) + 1
            assert runs < licenses.GRAM + licenses.WINDOW - 1
    assert hits > 60


def test_alignment_is_fast_enough():
    import time

    name, text = max(licenses.TEMPLATES, key=lambda t: len(t[1]))
    templates = licenses.Templates(licenses.TEMPLATES)
    began = time.process_time()
    assert licenses.scan((text + " ").encode() * 10, templates)
    assert time.process_time() - began < 3


def test_same_as_aligning_every_template_everywhere():
    templates = licenses.Templates([("a", "one two three four five six seven eight nine ten"), ("b", "five six seven eight nine ten one two three four six"), ("c", "red green blue red green blue red green"), ("d", "one")])
    for seed in range(60):
        rng = random.Random(seed)
        words = []
        for _ in range(rng.randrange(1, 5)):
            t = list(rng.choice(templates.words))
            if len(t) > 5 and rng.random() < 0.7:
                at = rng.choice([0, len(t) - 1])  # at an end, so that enough neighbouring words stay
                t[at : at + 1] = rng.choice([[], [0], [t[at], 0]])
            words += t + [0] * rng.randrange(0, 6)
        name = {n: w for w, n in templates.vocabulary.items()} | {0: b"other"}
        text = b" ".join(name[int(w)] for w in words)
        assert licenses.scan(text, templates) == everywhere(text.split(), templates), seed


def test_long_texts_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum " * 200_000 + "Released under the MIT License."), (1, "Released under the MIT License.")] * 2, "doc_id long, text string")
    assert sorted(r.start for r in licenses.license_rows(docs).collect()) == [0, 0, 400_000, 400_000]

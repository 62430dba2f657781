import random
import re

import pytest

from sievemill.llm import decontaminate as dc


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(texts, items, window):
    out = []
    for text in texts:
        ws, hit, names = words(text), set(), set()
        for name, item in items:
            iw = words(item)
            size = min(window, len(iw))
            for i in range(len(iw) - size + 1 if size else 0):
                for j in range(len(ws) - size + 1):
                    if ws[j : j + size] == iw[i : i + size]:
                        hit |= set(range(j, j + size))
                        names.add(name)
        out.append((len(ws), hit, sorted(names)))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_shard_matches_brute_force(seed):
    rng = random.Random(seed)
    letters = "abcdé"[: rng.randint(1, 5)]
    text = lambda n: " ".join(rng.choice(letters) + rng.choice(["", "x"]) for _ in range(rng.randrange(n + 1)))
    items = [(str(rng.randrange(6)), text(rng.choice([2, 8, 20]))) for _ in range(rng.randrange(1, 8))]
    texts = [rng.choice([None, "", text(5), text(60), items[0][1], (items[0][1] + " q ") * 3]) for _ in range(rng.randrange(1, 9))]
    window = rng.choice([1, 2, 3, 6])
    bench = dc.Benchmark([(n, t.encode()) for n, t in items], window)
    got = dc.search_shard([t and t.encode() for t in texts], bench)
    for (n, spans, names, matches), (n_words, hit, want) in zip(got, brute(texts, items, window), strict=True):
        assert (n, names) == (n_words, want)
        assert {i for a, b in spans for i in range(a, b)} == hit
    for text, row in zip(texts, got, strict=True):
        ws, want = words(text), set()
        for name, item in set(items):
            iw = words(item)
            size = min(window, len(iw))
            for i in range(len(iw)):
                for j in range(len(ws)):
                    if iw[i] == ws[j] and (i == 0 or j == 0 or iw[i - 1] != ws[j - 1]):
                        n = next((k for k in range(min(len(iw) - i, len(ws) - j)) if iw[i + k] != ws[j + k]), min(len(iw) - i, len(ws) - j))
                        if n >= size:
                            want.add((name, i, j, n))
        assert set(row[3]) == want


def test_longest_matches_are_maximal():
    bench = dc.Benchmark([("7", b"one two three four five six")], 3)
    assert dc.search_shard([b"x one two three four y two three four five six"], bench)[0][3] == [("7", 0, 1, 4), ("7", 1, 6, 5)]


def test_matches_of_several_blocks(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    items = [(i, text(rng.choice([3, 12, 30]))) for i in range(30)]
    docs = [(i, f"{text(10)} {rng.choice(items)[1]} {text(5)} {rng.choice(items)[1]}") for i in range(40)]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    one, many = ({r.doc_id: r for r in dc.search(table, bench, window=5, block_bytes=size).collect()} for size in (1 << 20, 200))
    assert one == many and all(one.values())
    for i, (_, hit, names) in enumerate(brute([t for _, t in docs], [(str(k), t) for k, t in items], 5)):
        assert one[i].hit_items == names and {k for s in one[i].hit_spans for k in range(s.start, s.stop)} == hit
        assert {k for m in one[i].hit_matches for k in range(m.start, m.start + m.words)} == hit


def test_long_texts_and_memory(spark):
    import tracemalloc

    rng = random.Random(6)
    item = " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000))
    tracemalloc.start()
    bench = dc.Benchmark([("a", item.encode())], 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 16 * len(item) and peak < 80 * len(item)
    text = ("x " + item[:600_000]).encode()
    n, spans, names, matches = dc.search_shard([text, None, b""], bench)[0]
    assert spans == [(1, n)] or spans == [(1, n - 1)]
    assert len(matches) == 1 and names == ["a"]


def test_columns_blocks_and_odd_rows(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (None, "q r"), (1, "a b c"), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "z A b C", "x"), (1, "z A b C", "x"), (2, None, "y"), (None, "q r s", "z"), (4, "", None)], "doc_id long, text string, hit_words string")
    for size in (1, 1 << 20):
        rows = dc.search(docs, bench, window=3, block_bytes=size).orderBy("doc_id").collect()
        assert [(r.doc_id, r.hit_words, [(s.start, s.stop) for s in r.hit_spans], r.hit_items) for r in rows] == [
            (None, 3, [(0, 2)], ["null"]), (1, 4, [(1, 4)], ["1"]), (1, 4, [(1, 4)], ["1"]), (2, 0, [], []), (4, 0, [], []),
        ]
    kept = dc.remove(docs, bench, window=3)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4]
    assert dc.search(docs.limit(0), bench).count() == 0
    assert dc.remove(docs, bench.limit(0)).count() == 5

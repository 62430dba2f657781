import random
import re

import numpy as np
import pytest
import xxhash

from sievemill.llm import simhash
from sievemill.llm.components import components


def plain_fingerprint(text, width=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, near):
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def test_fingerprints_match_the_definition():
    rng = random.Random(0)
    texts = [None, "", " \t", "One", "a b c d", "É é\x0bA B", "x " * 300] + [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randrange(2000))) for _ in range(40)]
    got = simhash.fingerprint_all((t if t is None else t.encode() for t in texts), len(texts))
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("seed", range(60))
def test_trie_join_matches_all_pairs(seed):
    rng = random.Random(seed)
    centres, codes = [rng.getrandbits(64) for _ in range(rng.randint(1, 9))], set()
    for _ in range(rng.choice([2, 9, 150])):
        code = rng.choice(centres)
        for _ in range(rng.randrange(8)):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    codes = sorted(codes)
    head, budget = rng.choice([0, 5, 13]), rng.choice([0, 2, 4])
    a = np.array(codes, np.uint64)
    root = a >> np.uint64(64 - head) if head else np.zeros(len(a), np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(root)) + 1, [len(a)]])
    got = simhash.trie_links(a, starts, np.full(len(starts) - 1, head), budget)
    want = plain_components(list(range(len(a))), lambda i, j: root[i] == root[j] and (codes[i] ^ codes[j]).bit_count() <= budget)
    assert got.tolist() == [want[i] for i in range(len(a))]


@pytest.mark.parametrize("max_root", [100_000, 7])
def test_near_duplicates_over_all_tries(spark, max_root):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(200)) for _ in range(12)]
    rows = [(i, base[i % 12] if i < 24 else base[i % 12] + f" tail{i}") for i in range(60)] + [(90, None), (91, ""), (None, base[0]), (7, base[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs.withColumns({"fp": docs.doc_id, "component_id": docs.text}), max_root=max_root).collect()
    fps = sorted({plain_fingerprint(t) for _, t in rows})
    roots = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for i, t in rows:
        if i is not None:
            root = roots[plain_fingerprint(t)]
            smallest[root] = min(i, smallest.get(root, i))
    want = sorted((str(i), plain_fingerprint(t), smallest[roots[plain_fingerprint(t)]]) for i, t in rows)
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == want
    if max_root > 7:
        kept = simhash.keep_one(docs)
        ids = [r.doc_id for r in kept.collect()]
        assert kept.columns == docs.columns and sorted(x for x in ids if x is not None) == sorted(set(smallest.values())) and ids.count(None) == 1


def test_empty_table_and_chain(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_block_counts_leave_small_roots():
    assert [simhash.block_count(n, 4) for n in (0, 1000, 10**5, 10**6, 10**9)] == [5, 5, 5, 6, 7]
    for m in range(5, 9):
        for order, head in simhash.tries(m, 4):
            assert sorted(b for low, size in order for b in range(low, low + size)) == list(range(64)) and 0 < head < 64


def test_keep_one_carries_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "r1", "k1"), (2, "a b c", "r2", "k2"), (1, "a b c", "r3", "k3"), (None, "a b c", "r4", "k4")], "doc_id long, text string, __rank string, __keep string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r["__rank"] in ("r1", "r3", "r4")) for r in got.collect()) == [(0, True), (1, True)]

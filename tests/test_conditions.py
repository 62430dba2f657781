"""Conditions in a batch and over a stream against folding them one by one."""

import random

import pytest

from sievemill.operators import conditions
from sievemill.streaming import conditions as growth

FIELDS = ["a", "b", "c"]


def plain(rows, share):
    """{(key, seq): (number, list after it)} of rows (key, seq, a, b, c) in order."""
    kept, out = {}, {}
    for key, seq, *new in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        mine, number = kept.setdefault(key, []), None
        if any(x is not None for x in new):
            fitting = [
                i for i, k in enumerate(mine)
                if all(x is None or y is None or x == y for x, y in zip(k, new)) and (not share or any(x is not None and x == y for x, y in zip(k, new)))
            ]
            if fitting:
                number = fitting[0] + 1
                mine[fitting[0]] = [x if x is not None else y for x, y in zip(mine[fitting[0]], new)]
            else:
                mine.append(new)
                number = len(mine)
        out[key, seq] = number, [list(k) for k in mine]
    return out


def random_rows(n_keys=6, most=40, seed=1):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, None, "x", "y", "z"])
    return [(f"k{k}", s, pick(), pick(), pick()) for k in range(n_keys) for s in range(rng.randint(0, most) if k else 300)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, a string, b string, c string")


@pytest.mark.parametrize("share", [False, True])
def test_numbers_and_merged_fields(spark, share):
    rows = random_rows() + [(None, 0, "x", None, None), (None, 1, None, None, None), (None, 2, "y", "x", None)]
    want = plain(rows, share)
    got = conditions.numbered(frame(spark, rows).repartition(5), "key", "seq", FIELDS, share)
    assert got.columns == ["key", "seq", *FIELDS, "number"]
    assert {(r.key, r.seq): r.number for r in got.collect()} == {k: v[0] for k, v in want.items()}
    last = {}
    for (key, _), (_, kept) in sorted(want.items(), key=lambda x: (x[0][0] or "", x[0][1])):
        last[key] = kept
    merged = {(r.key, r.number): [r.a, r.b, r.c] for r in conditions.merged(got, "key", "seq", FIELDS).collect()}
    assert merged == {(k, i + 1): c for k, kept in last.items() for i, c in enumerate(kept)}


def test_repeated_rows_and_no_rows(spark):
    rows = [("k", 0, "x", None, None)] * 3 + [("k", 1, None, "y", None)] * 2 + [("k", 2, "z", None, None)]
    got = conditions.numbered(frame(spark, rows), "key", "seq", FIELDS)
    assert sorted((r.seq, r.number) for r in got.collect()) == [(0, 1)] * 3 + [(1, 1)] * 2 + [(2, 2)]
    assert {r.number: r.members for r in conditions.merged(got, "key", "seq", FIELDS).collect()} == {1: 5, 2: 1}
    assert conditions.numbered(frame(spark, []), "key", "seq", FIELDS).collect() == []


def lists_after(rows):
    """The list after each paragraph, from the rows of the stream."""
    out, kept = {}, {}
    for r in sorted(rows, key=lambda r: (r.key, r.seq)):
        mine = kept.setdefault(r.key, [])
        if r.number is not None:
            if r.number > len(mine):
                mine.append(None)
            mine[r.number - 1] = [r.a, r.b, r.c]
        assert r.known == len(mine)
        out[r.key, r.seq] = r.number, [list(k) for k in mine]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_in_any_file_order_and_after_restarts(spark, tmp_path, seed):
    rows = random_rows(4, 12, seed)[-30:]
    rows = [(k, s - min(x[1] for x in rows if x[0] == k), *f) for k, s, *f in rows]
    want, schema = plain(rows, False), frame(spark, rows).schema
    random.Random(seed).shuffle(rows)
    files = [rows[i::4] for i in range(4)]
    files[3] = files[3] + files[0][:3]  # paragraphs that come again
    for i, part in enumerate(files):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i in (1, 3):  # two runs over two files each
            growth.run(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", "key", FIELDS)
    assert lists_after(spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_paragraphs_wait_for_their_turn(spark, tmp_path):
    schema = frame(spark, []).schema
    run = lambda: growth.run(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", "key", FIELDS)
    frame(spark, [("k", 1, "x", None, None), ("k", 3, None, "y", None)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    assert spark.read.schema("key string, seq long").parquet(f"{tmp_path}/out").count() == 0
    frame(spark, [("k", 0, "z", None, None)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted((r.seq, r.number) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, 1), (1, 2)]


def test_papers_of_a_bucket_share_one_look_at_the_state():
    import pandas as pd

    class Value:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    class Handle:
        def getValueState(self, name, schema):
            return states.setdefault(name, Value())

    states, rows = {}, random_rows(50, 6, 3)
    random.Random(3).shuffle(rows)
    processor, out = growth.Growing(FIELDS, False), []
    processor.init(Handle())
    for part in (rows[:200], rows[200:], rows[:9]):
        out += [r for f in processor.handleInputRows((0,), iter([pd.DataFrame(part, columns=["key", "seq", *FIELDS])]), None) for r in f.astype(object).where(f.notna(), None).itertuples()]
    assert lists_after(out) == plain(rows, False) and len(states) == 1 and sum(s.calls for s in states.values()) == 6


def test_keys_come_back_with_their_type(spark):
    rows = [(k, s, *f) for k in (2**60 + 1, 2**60, None) for s, f in enumerate([("x", None, None), (None, None, None), ("y", "z", None), (None, None, "x")])]
    got = growth.replayed(spark.createDataFrame(rows, "paper long, seq long, a string, b string, c string"), "paper", FIELDS).collect()
    assert sorted((r.paper or 0, r.seq, r.number or 0, r.known) for r in got) == [(k, s, *n) for k in (0, 2**60, 2**60 + 1) for s, n in enumerate([(1, 1), (0, 1), (2, 2), (1, 2)])]

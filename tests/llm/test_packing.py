"""Token pieces against the tokenizer itself, and packing against lower bounds."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievemill.llm import packing, registry
from sievemill.llm.tokens import Encoder

SMALL = "/root/testdata/sf0.001"
EXACT, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN, FAST = Tokenizer.from_file(EXACT), Encoder(EXACT, RANKS)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab '\n\t  \x00\x1c\x85ß中é1٣_-.,sS|<>"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_ids_are_the_tokenizers(text):
    assert FAST.ids(text).tolist() == ids(text)[:-1]


def test_special_strings_and_long_runs():
    for text in ("a<|endoftext|>b", "x" * 50_000, " \n" * 20_000 + "a", "  a\n\n\nb " * 5_000, ""):
        assert FAST.ids(text).tolist() == Encoder(EXACT).ids(text).tolist() == ids(text)[:-1]


def test_pieces_cover_each_text(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 300), (4, "word " * 300), (None, "a b"), (6, "x y " * 7)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, piece string")
    found = packing.pieces(docs, EXACT, RANKS, size=16).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault((r.doc_id, r.piece), []).append(r)
    assert all(len(v) == (2 if k[0] == 4 else 1) for k, v in by_doc.items())
    for doc_id, text in rows:
        mine = sorted((r for k, v in by_doc.items() if k[0] == doc_id for r in v[:1]), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.length for r in mine[1:]] == [16] * (len(mine) - 1) and 1 <= mine[0].length <= 16
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine[:-1]]]).tolist()
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids(text)


def whole(packed, size):
    """Sequences of (offset, length) rows; each has to be gapless and no longer than size."""
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by_sequence.values():
        members.sort()
        assert [o for o, _ in members] == [sum(n for _, n in members[:i]) for i in range(len(members))]
        assert sum(n for _, n in members) <= size
    return by_sequence


def test_trades_raise_squared_fill_and_lose_nothing():
    rng = random.Random(3)
    for size, low, high, n in ((100, 1, 99, 400), (2048, 500, 600, 300), (2048, 700, 1400, 500), (50, 25, 26, 60), (10, 10, 10, 5), (10, 3, 3, 7)):
        lengths = sorted((rng.randint(low, high) for _ in range(n)), reverse=True)
        first = packing.best_fit(lengths, size)
        last = packing.improved([list(b) for b in first], size)
        assert sorted(x for b in last for x in b) == sorted(lengths) and max(map(sum, last)) <= size
        assert sum(sum(b) ** 2 for b in last) >= sum(sum(b) ** 2 for b in first) and -(-sum(lengths) // size) <= len(last) <= len(first)
    assert packing.improved([], 10) == []


@pytest.mark.parametrize("bins, want", [([[7], [2]], [[2, 7]]), ([[6, 2], [4, 3]], [[2, 3], [4, 6]]), ([[5, 4], [3, 3]], [[5], [3, 3, 4]]), ([[3, 3, 3], [7]], [[3, 3], [3, 7]])])
def test_each_kind_of_trade(bins, want):
    """A move, one for one, two for one, one for two: the only trade that these bins of size 10 have."""
    assert [sorted(b) for b in packing.improved([list(b) for b in bins], 10)] == want


@pytest.mark.parametrize("a_task", [40_000, 150])
def test_packing_is_near_the_least(spark, a_task, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_TASK", a_task)  # the second: several tasks and rounds
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(1, 400), rng.randint(1, 2048), 2048]) for _ in range(900)]
    rows = spark.createDataFrame([(i % 7, n, "s", "o") for i, n in enumerate(lengths)], "doc_id long, length int, Sequence_ID string, note string").repartition(3)
    packed = packing.pack(rows)
    assert packed.columns == ["doc_id", "length", "note", "sequence_id", "offset"]
    found = packed.collect()
    assert sorted((r.doc_id, r.length) for r in found) == sorted((i % 7, n) for i, n in enumerate(lengths))
    assert len(whole(found, 2048)) <= -(-sum(lengths) // 2048) + 1


def test_under_two_tasks_of_pieces_go_to_one(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_TASK", 30)
    rows = spark.createDataFrame([(i, 1 + i % 9) for i in range(59)], "doc_id long, length int").repartition(3)
    assert max(r.sequence_id for r in packing.pack(rows, size=10).collect()) < 1 << 32  # the first round's only task


def test_repeated_rows_empty_tables_and_bad_lengths(spark):
    rows = spark.createDataFrame([(1, 5)] * 7, "doc_id long, length long")
    assert len(whole(packing.pack(rows, size=10).collect(), 10)) == 4
    assert packing.pack(rows.limit(0)).collect() == []
    for bad in (0, 11, None):
        with pytest.raises(Exception, match="lengths must be"):
            packing.pack(spark.createDataFrame([(1, bad)], "doc_id long, length long"), size=10).collect()


def test_query_packs_every_document(spark):
    found = registry.op11_packing(spark, SMALL).collect()
    texts = {r.doc_id: ids(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in found} == texts.keys() and sum(r.length for r in found) == sum(map(len, texts.values()))
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.length == 2048 or r.piece == 0
    assert len(whole(found, 2048)) <= -(-sum(map(len, texts.values())) // 2048) + 1


def test_sequences_hold_the_ids_in_place(spark):
    docs = spark.createDataFrame([(i, "lorem ipsum " * (i % 9)) for i in range(40)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, EXACT, RANKS, size=16), size=16).cache()
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert sum(len(x) for x in joined.values()) == packed.agg(F.sum("length")).first()[0] * 4

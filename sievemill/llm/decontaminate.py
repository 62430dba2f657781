"""Benchmark decontamination with suffix arrays of the training text.

Documents are read in shards of about SHARD_BYTES. The suffix array of a shard holds the
shard's word suffixes in order, as far as they can begin a match: those that begin with two
words that follow each other in the benchmark and have enough benchmark words ahead. Every test suffix is
binary-searched in it by its window (its first ``window`` words); the run of equal suffixes gives
all locations. Locations that follow each other at one distance are one longest verbatim match; spans and items
are those of the matches.

The benchmark is collected and broadcast in blocks of at most BLOCK_BYTES of text; each block is
another pass over the same partitions, without a shuffle, that adds to the matches found. A block is held as
word numbers and places of windows in them, about 6 bytes for each byte of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, byte_rows, free_name

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20

#: Windows that are searched for at once.
CHUNK = 100_000

_SPANS = "array<struct<start:int,stop:int>>"
_MATCHES = "array<struct<item:string,item_start:int,start:int,words:int>>"


class Benchmark:
    """Items as word numbers, and their distinct windows in order of first words."""

    def __init__(self, rows: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        number = self.vocabulary.setdefault
        texts: list[tuple[str, np.ndarray]] = []
        for name, text in rows:
            texts.append((name, np.array([number(w, len(self.vocabulary) + 1) for w in alnum_words(text)], np.int32)))
        texts = [t for t in texts if len(t[1])]
        self.names = [name for name, _ in texts]
        sizes = np.array([len(ids) for _, ids in texts], np.int64)
        # an item is followed by 0, no word, as often as a window may reach beyond it
        gap = np.zeros(window, np.int32)
        self.ids = np.concatenate([gap[:0], *(x for _, ids in texts for x in (ids, gap))])
        begins = np.cumsum(sizes + window) - sizes - window
        spans = np.minimum(sizes, window)
        count = sizes - spans + 1
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        starts = suffix_order(self.ids, np.repeat(begins, count) + within, window, self.bits)
        of_text = np.searchsorted(begins, starts, side="right") - 1
        self.item = of_text.astype(np.int32)
        self.at = (starts - begins[of_text]).astype(np.int32) if texts else np.zeros(0, np.int32)
        new = np.ones(len(starts), bool)
        for i in range(1, len(starts), CHUNK):
            some = slice(i, min(i + CHUNK, len(starts)))
            new[some] = (self.ids[starts[some, None] + np.arange(window)] != self.ids[starts[some.start - 1 : some.stop - 1, None] + np.arange(window)]).any(axis=1)
        self.of = np.append(np.flatnonzero(new), len(starts))  # places of window i: of[i] to of[i + 1]
        self.starts = starts[new].astype(np.int64)
        self.lengths = spans[of_text[new]] if texts else np.zeros(0, np.int64)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        both = self.ids[:-1].astype(np.int64) << self.bits | self.ids[1:]
        self.pairs = np.unique(both[(self.ids[:-1] > 0) & (self.ids[1:] > 0)]) if len(self.ids) else both


def numbers(text: bytes | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """A text's words as their numbers in the vocabulary, 0 for any other."""
    words = alnum_words(text or b"")
    return np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words))


def suffix_order(ids: np.ndarray, starts: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """``starts`` ordered by the ``depth`` words of ``ids`` from there. ids: padded with
    ``depth`` zeros. Ties are refined some words at a time."""
    step = max(1, 62 // bits)

    def key(at: np.ndarray, offset: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(offset, offset + step):
            out = out << bits | (ids[at + k] if k < depth else 0)
        return out

    first = key(starts, 0)
    order = np.argsort(first, kind="stable")
    group = np.concatenate([[0], np.cumsum(np.diff(first[order]) != 0)]) if len(order) else order
    for offset in range(step, depth, step):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        more = key(starts[order[at]], offset)
        moved = np.lexsort((more, group[at]))
        order[at], more = order[at[moved]], more[moved]
        turn = np.concatenate([[True], (np.diff(group[at]) != 0) | (np.diff(more) != 0)])
        split = np.zeros(len(order), np.int64)
        split[at[turn]] = 1
        begins = np.concatenate([[1], np.diff(group) != 0]) if len(group) else group
        group = np.cumsum(np.maximum(split, begins & ~tied))
    return starts[order]


def bounds(ids: np.ndarray, suffixes: np.ndarray, bench: Benchmark, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the windows, the run of the suffix array that begins with it, by binary search."""
    columns = np.arange(bench.window)
    wanted = bench.ids[bench.starts[windows, None] + columns]
    inside = columns[None, :] < bench.lengths[windows, None]

    def search(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(suffixes))
        while (going := low < high).any():
            mid = (low + high) >> 1
            words = ids[suffixes[np.where(going, mid, 0)][:, None] + columns]
            differ = (words != wanted) & inside
            at = differ.argmax(axis=1)[:, None]
            x, y = np.take_along_axis(words, at, 1)[:, 0], np.take_along_axis(wanted, at, 1)[:, 0]
            up = np.where(differ.any(axis=1), x < y, after_equal)
            low, high = np.where(going & up, mid + 1, low), np.where(going & ~up, mid, high)
        return low

    return search(False), search(True)


def occurrences(ids: np.ndarray, ends: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of each occurrence in a shard of texts, whose word numbers are ``ids``
    and whose last words stand before ``ends``."""
    none = np.zeros(0, np.int64)
    if not len(ids) or not bench.shortest:
        return none, none
    stops = ids == 0
    edge = np.zeros(len(ids) + 1, bool)
    edge[ends] = edge[-1] = True  # a run of benchmark words ends at another word and at the text's end
    breaks = np.flatnonzero(edge[1:] | stops)
    position = np.arange(len(ids))
    run = breaks[np.minimum(np.searchsorted(breaks, position), len(breaks) - 1)]
    ahead = run - position + (~stops[run])
    may = ~stops & (ahead >= bench.shortest)
    if bench.shortest > 1:
        at = np.flatnonzero(may)
        pair = ids[at].astype(np.int64) << bench.bits | ids[at + 1]
        slot = np.minimum(np.searchsorted(bench.pairs, pair), len(bench.pairs) - 1)
        starts = at[bench.pairs[slot] == pair]
    else:
        starts = np.flatnonzero(may)
    if not len(starts):
        return none, none
    # words past the end of a suffix's run count as 0
    padded = np.concatenate([ids, np.zeros(bench.window, ids.dtype)])
    suffixes = suffix_order(padded, starts, bench.window, bench.bits)
    # windows of which a suffix has the first words
    firsts = np.unique(ids[suffixes])
    may = np.flatnonzero(np.isin(bench.ids[bench.starts], firsts))
    found = []
    for i in range(0, len(may), CHUNK):
        windows = may[i : i + CHUNK]
        low, high = bounds(padded, suffixes, bench, windows)
        count = high - low
        found.append((np.repeat(windows, count), suffixes[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]))
    which, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)
    whole = ahead[place] >= bench.lengths[which]  # not over a text's end
    return which[whole], place[whole]


Match = tuple[str, int, int, int]  # item, its first matched word, the text's first matched word, words


def longest_matches(ids: np.ndarray, ends: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, first item word, first place, words) of each longest verbatim match of at least one window between
    a shard's texts and the items, by place."""
    which, place = occurrences(ids, ends, bench)
    count = bench.of[which + 1] - bench.of[which]
    slot = np.repeat(bench.of[which] - np.cumsum(count) + count, count) + np.arange(count.sum())
    item, at, place, size = bench.item[slot].astype(np.int64), bench.at[slot].astype(np.int64), np.repeat(place, count), np.repeat(bench.lengths[which], count)
    order = np.lexsort((place, place - at, item))
    item, at, place, size = item[order], at[order], place[order], size[order]
    text = np.searchsorted(ends, place, side="right")
    turn = np.ones(len(item), bool)  # a match begins where the window before is not the one a word earlier
    turn[1:] = (item[1:] != item[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (place[1:] != place[:-1] + 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(turn)
    last = np.append(first[1:], len(item)) - 1 if len(first) else first
    words = place[last] - place[first] + size[last]
    order = np.lexsort((item[first], place[first]))
    return tuple(x[order] for x in (item[first], at[first], place[first], words))


def search_shard(texts: list[bytes | None], bench: Benchmark) -> list[tuple[int, list[tuple[int, int]], list[str], list[Match]]]:
    """For each text: number of words, spans of hit words, names of items with windows in it, longest matches."""
    each = [numbers(t, bench.vocabulary) for t in texts]
    ends = np.cumsum([len(x) for x in each])
    ids = np.concatenate(each) if each else np.zeros(0, np.int32)
    matches: list[list[Match]] = [[] for _ in texts]
    found = longest_matches(ids, ends, bench)
    text = np.searchsorted(ends, found[2], side="right").tolist()
    for k, item, at, place, words in zip(text, *(x.tolist() for x in found), strict=True):
        matches[k].append((bench.names[item], at, place - int(ends[k]) + len(each[k]), words))
    return [(len(each[k]), merged([(a, a + n) for _, _, a, n in m]), sorted({name for name, *_ in m}), sorted(set(m), key=lambda x: (x[2], x[0], x[1]))) for k, m in enumerate(matches)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as spans that neither touch nor overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def bench_blocks(bench: DataFrame, window: int, item_id: str, text: str, block_bytes: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of about ``block_bytes`` of text, one collected at a time."""
    rows = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Benchmark(((r["name"], r["text"].encode()) for r in part.toLocalIterator()), window)


def search(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All columns of ``docs`` and: hit_words long (words of the text), hit_spans
    array<struct<start, stop>> (hit words, from 0), hit_items array<string> (ids of items with
    windows in the text, sorted as strings), hit_matches array<struct<item, item_start, start, words>> (longest verbatim
    matches: item, its first matched word, the text's, and how many). Columns of ``docs`` with those names are replaced.

    An item of fewer than ``window`` words is one window; one without words has none, and so has a
    null text. A null item_id is named "null", and is one with an item of that name. Texts of any length are searched whole; a match never
    runs over a text's end. Repeated documents give a row each, repeated items count once by
    item_id, with a match for each different place. No rows: no rows; no items: nothing is hit."""
    sc = docs.sparkSession.sparkContext
    base = docs.drop(*_ADDED)
    out, schema = base, T.StructType([*base.schema.fields, *[T.StructField(c, T._parse_datatype_string(kind)) for c, kind in zip(_ADDED, ("bigint", _SPANS, "array<string>", _MATCHES), strict=True)]])
    spot = base.columns.index(doc_text)
    for k, block in enumerate(bench_blocks(bench, window, item_id, item_text, block_bytes)):
        shared, again = sc.broadcast(block), k > 0

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=again) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    texts = list(byte_rows(part.column(spot)))
                    held.append((part, texts))
                    size += sum(len(t or b"") for t in texts)
                    if size >= SHARD_BYTES:
                        yield from _searched(held, shared.value, again)
                        held, size = [], 0
            yield from _searched(held, shared.value, again)

        out = out.mapInArrow(run, schema)
    return out


_ADDED = ("hit_words", "hit_spans", "hit_items", "hit_matches")
_SPAN_KIND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_MATCH_KIND = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("words", pa.int32())]))


def _searched(held: list[tuple[pa.RecordBatch, list]], bench: Benchmark, again: bool) -> Iterator[pa.RecordBatch]:
    found = iter(search_shard([t for _, texts in held for t in texts], bench))
    for part, texts in held:
        columns = list(part.columns)
        rows = [next(found) for _ in texts]
        if again:
            before = columns[-1].to_pylist()
            columns = columns[: -len(_ADDED)]
            rows = [(n, m + [(x["item"], x["item_start"], x["start"], x["words"]) for x in old]) for (n, _, _, m), old in zip(rows, before, strict=True)]
            rows = [(n, merged([(a, a + k) for _, _, a, k in m]), sorted({x[0] for x in m}), sorted(set(m), key=lambda x: (x[2], x[0], x[1]))) for n, m in rows]
        spans = [[{"start": a, "stop": b} for a, b in r[1]] for r in rows]
        matches = [[{"item": i, "item_start": at, "start": a, "words": n} for i, at, a, n in r[3]] for r in rows]
        columns += [pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, _SPAN_KIND), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array(matches, _MATCH_KIND)]
        yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[: len(columns) - len(_ADDED)], *_ADDED])


def n_hit(spans: str = "hit_spans"):
    """Column: number of hit words."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])


def remove(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit word, with their columns as they are, whatever their names."""
    own = {c: free_name(docs.columns, f"{i}_") if c.lower() in _ADDED else c for i, c in enumerate(docs.columns)}
    found = search(docs.withColumnsRenamed({c: n for c, n in own.items() if c != n}), bench, **options)
    return found.filter(F.size("hit_spans") == 0).select(*[F.col(f"`{n}`").alias(c) for c, n in own.items()])


def digest(items: str = "hit_items"):
    """Column: SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)

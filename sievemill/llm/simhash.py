"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has the bits set in over half of its shingles' hashes. Fingerprints
within ``budget`` differing bits are linked, and components of links are the groups.

The join traverses pairs of trie nodes together: a pair carries the bits in which its two paths
differ, its children are the pairs of the nodes' children, and a pair past the budget is
pruned with all that is below it. To give independent tasks, the 64 bits are cut into m blocks:
two fingerprints with at most ``budget`` differing bits agree on m - budget whole blocks at
least. For each choice of so many blocks, a trie has these blocks on top; its nodes below
them are roots with no differing bits yet, and each linked pair meets under a root of one
trie. m grows with the number of fingerprints, so that a root keeps few leaves. A root
with more leaves than ``max_root`` is left to a second pass, which deals its leaves into
chunks and joins every pair of chunks in a task of its own."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, free_name, space_words, stored
from .components import components, roots_of, unite

SEED = 42
BLOCK = 1 << 16
#: Mean leaves of a root up to which m is enough.
ROOT_LEAVES = 64
#: Leaves that a task takes from one root; rows that it joins at once (and a last root more).
MAX_ROOT, TASK_ROWS = 100_000, 50_000
#: Node pairs in one step, and leaf pairs that are compared without going further down.
FRONTIER, LEAVES = 1 << 17, 16

_EACH_BYTE = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many unsigned 64-bit ``hashes`` of each run have each bit, lowest first. starts: of
    the runs, ascending, none empty."""
    ends = np.append(starts[1:], len(hashes))
    pieces = -(-(ends - starts) // 255)  # sums in the bytes of a word hold up to 255
    first = np.cumsum(pieces) - pieces
    edges = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    counts = np.empty((len(starts), 8, 8), np.int64)  # run, byte, bit
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _EACH_BYTE, edges).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts[:, :, bit] = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    return counts.reshape(-1, 64)


def shingle_hashes(text: bytes | None, width: int) -> Iterator[list[int]]:
    """The hashes of a text's shingles, BLOCK at a time."""
    words = space_words(text or b"")
    if len(words) <= width:
        if words:
            yield [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
        return
    joined, n, digest = b" ".join(words), len(words) - width + 1, xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    for i in range(0, n, BLOCK):
        stop = min(i + BLOCK, n)
        yield [digest(joined[x:y], SEED) for x, y in zip(starts[i:stop].tolist(), ends[i + width - 1 : stop + width - 1].tolist(), strict=True)]


def fingerprint_all(texts: Iterator[bytes | None], n: int, width: int = 4) -> np.ndarray:
    """The unsigned fingerprints of n whole texts; 0 for one without words."""
    counts, totals = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    held: list[int] = []
    runs: list[tuple[int, int]] = []

    def flush() -> None:
        if runs:
            of, starts = (np.array(x) for x in zip(*runs, strict=True))
            found = bit_counts(np.array(held, np.uint64), starts)
            np.add.at(counts, of, found)
            held.clear()
            runs.clear()

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, width):
            runs.append((i, len(held)))
            held += hashes
            totals[i] += len(hashes)
            if len(held) >= BLOCK:
                flush()
    flush()
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(n).astype(np.uint64)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The unsigned fingerprint of a whole text; 0 if it has no word."""
    return int(fingerprint_all(iter([text]), 1, width)[0])


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp long (the fingerprint's bits) of every row; null text: no words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprint_all(byte_rows(batch.column(1)), batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(of, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fp long")


def blocks(m: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of m blocks of 64 bits, highest first."""
    sizes = [64 // m + (i < 64 % m) for i in range(m)]
    return [(64 - sum(sizes[: i + 1]), sizes[i]) for i in range(m)]


def block_count(n: int, budget: int) -> int:
    """The least m whose smallest head leaves ROOT_LEAVES of n fingerprints to a root."""
    m = budget + 1
    while m < 12 and n > ROOT_LEAVES << sum(sorted(size for _, size in blocks(m))[: m - budget]):
        m += 1
    return m


def tries(m: int, budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of blocks on top: all blocks in their new order, and the head's bits."""
    found = []
    for head in itertools.combinations(range(m), m - budget):
        order = [*head, *(i for i in range(m) if i not in head)]
        found.append(([blocks(m)[i] for i in order], sum(blocks(m)[i][1] for i in head)))
    return found


def _dealt(fp: Column, order: list[tuple[int, int]]) -> Column:
    """``fp`` with its blocks in ``order``, highest first."""
    out, top = F.lit(0).cast("long"), 64
    for low, size in order:
        top -= size
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << size) - 1)), top))
    return out


def rooted(fps: DataFrame, m: int, budget: int) -> DataFrame:
    """fp under every trie: trie int, root long, code long (its bits in the trie's order)."""
    each = []
    for k, (order, head) in enumerate(tries(m, budget)):
        code = _dealt(F.col("fp"), order)
        each.append(F.struct(F.lit(k).alias("trie"), F.shiftrightunsigned(code, 64 - head).alias("root"), code.alias("code")))
    return fps.select("fp", F.explode(F.array(*each)).alias("t")).select("t.*", "fp")


def trie_links(codes: np.ndarray, starts: np.ndarray, depths: np.ndarray, budget: int) -> np.ndarray:
    """For each leaf the first leaf (by place) of its component under the links.

    codes: sorted within each root, unsigned; starts: place of each root's first leaf, and the
    number of leaves; depths: bits of each root."""
    n = len(codes)
    parent, labels = np.arange(n), np.arange(n)
    turns, ones = np.arange(n), {}

    def split(at: np.ndarray, end: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Where the leaves with a set bit begin."""
        out = np.empty_like(at)
        for k in np.unique(bit).tolist():
            if k not in ones:
                ones[k] = np.concatenate([[0], np.cumsum((codes >> np.uint64(63 - k)) & np.uint64(1), dtype=np.int64)])
            own = bit == k
            out[own] = end[own] - (ones[k][end[own]] - ones[k][at[own]])
        return out

    many = np.flatnonzero(np.diff(starts) > 1)
    a, b = starts[:-1][many], starts[1:][many]
    stack = [(a, b, a, b, np.zeros(len(a), np.int64), depths[many])]
    while stack:
        a0, a1, b0, b1, apart, depth = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [tuple(x[half:] for x in (a0, a1, b0, b1, apart, depth)), tuple(x[:half] for x in (a0, a1, b0, b1, apart, depth))]
            continue
        # a pair all of whose leaves are in one component already has nothing to add
        joined = (turns[a1 - 1] == turns[a0]) & (turns[b1 - 1] == turns[b0]) & (labels[a0] == labels[b0])
        a0, a1, b0, b1, apart, depth = (x[~joined] for x in (a0, a1, b0, b1, apart, depth))
        pairs = (a1 - a0) * (b1 - b0)
        few = (pairs <= LEAVES) | (depth >= 64)
        if few.any():
            count, width = pairs[few], (b1 - b0)[few]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = np.repeat(a0[few], count) + inside // np.repeat(width, count), np.repeat(b0[few], count) + inside % np.repeat(width, count)
            near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
            if near.any() and unite(parent, i[near], j[near]):
                labels = roots_of(parent, parent)
                turns = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        a0, a1, b0, b1, apart, depth = (x[~few] for x in (a0, a1, b0, b1, apart, depth))
        if not len(a0):
            continue
        am, bm, same = split(a0, a1, depth), split(b0, b1, depth), a0 == b0
        children = [(a0, am, b0, bm, apart), (am, a1, bm, b1, apart), (a0, am, bm, b1, apart + 1)]
        other = ~same
        children.append((am[other], a1[other], b0[other], bm[other], apart[other] + 1))
        depth = np.concatenate([depth, depth, depth, depth[other]]) + 1
        a0, a1, b0, b1, apart = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (a0 < a1) & (b0 < b1) & (apart <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        if alive.any():
            stack.append((a0[alive], a1[alive], b0[alive], b1[alive], apart[alive], depth[alive]))
    return roots_of(parent, parent)


def _join(batches: Iterator[pa.RecordBatch], heads: list[int], budget: int, max_root: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (task columns..., trie, root, code, fp), sorted by all but the last two. Gives a
    and b (fingerprints of one component), and trie, root, n of a root with over max_root leaves."""

    def solve(pending: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if pending:
            root, trie, code, fp = (np.concatenate(x) for x in zip(*pending, strict=True))
            code = code.view(np.uint64)
            order = np.lexsort((code, root))
            root, trie, code, fp = root[order], trie[order], code[order], fp[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(root)) + 1, [len(root)]])
            first = trie_links(code, starts, np.asarray(heads)[trie[starts[:-1]]], budget)
            out = np.flatnonzero(first != np.arange(len(first)))
            yield _edges(fp[out], fp[first[out]])

    pending: list[tuple[np.ndarray, ...]] = []
    open_root: list[tuple[np.ndarray, ...]] = []  # rows of the root that goes on
    waiting, opened, number, last, before = 0, 0, 0, None, (0, 0)
    for batch in batches:
        *marks, code, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(code):
            continue
        new = np.zeros(len(code), bool)
        for m in marks:
            new[1:] |= m[1:] != m[:-1]
        new[0] = last is None or tuple(m[0] for m in marks) != last
        last = tuple(m[-1] for m in marks)
        columns = (number + np.cumsum(new), marks[-2], code, fp)
        number = int(columns[0][-1])
        cuts = np.flatnonzero(new)
        bounds = [0, *cuts.tolist(), len(code)]
        # the rows before the first cut go on with the open root, those after the last cut stay open
        first, final = bounds[1], bounds[-2]
        if first:
            opened += first
            if max_root is None or opened <= max_root:
                open_root.append(tuple(c[:first] for c in columns))
        if not len(cuts):
            if max_root is not None and opened > max_root:
                open_root = []
            continue
        if opened:
            yield from _closed(open_root, opened, max_root, before, pending)
            waiting += opened if max_root is None or opened <= max_root else 0
        if max_root is not None and len(cuts) > 1 and np.diff(cuts).max() > max_root:
            for x, y in itertools.pairwise(cuts.tolist()):
                yield from _closed([tuple(c[x:y] for c in columns)], y - x, max_root, (int(marks[-2][x]), int(marks[-1][x])), pending)
        elif final > cuts[0]:
            pending.append(tuple(c[cuts[0] : final] for c in columns))
        waiting += final - int(cuts[0])
        open_root, opened = [tuple(c[final:] for c in columns)], len(code) - final
        before = (int(marks[-2][-1]), int(marks[-1][-1]))
        if waiting >= TASK_ROWS:
            yield from solve(pending)
            pending, waiting = [], 0
    if opened:
        yield from _closed(open_root, opened, max_root, before, pending)
    yield from solve(pending)


def _closed(rows: list, n: int, max_root: int | None, root: tuple[int, int], pending: list) -> Iterator[pa.RecordBatch]:
    """A root all of whose n leaves have come: to be solved, or said to be too large."""
    if max_root is not None and n > max_root:
        yield _over(*root, n)
    else:
        pending += rows


_FOUND = "a long, b long, trie int, root long, n long"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int64())], ["a", "b", "trie", "root", "n"])


def _over(trie: int, root: int, n: int) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array([trie], pa.int32()), pa.array([root], pa.int64()), pa.array([n], pa.int64())], ["a", "b", "trie", "root", "n"])


def linked(fps: DataFrame, budget: int = 4, max_root: int = MAX_ROOT) -> DataFrame:
    """fps: distinct fp long. Returns a, b: pairs whose components are those of all pairs of
    fingerprints within ``budget`` differing bits."""
    m = block_count(fps.count(), budget)
    heads = [head for _, head in tries(m, budget)]
    leaves = rooted(fps, m, budget)
    dealt = leaves.repartition("trie", "root").sortWithinPartitions("trie", "root")
    found = stored(dealt.mapInArrow(lambda x: _join(x, heads, budget, max_root), _FOUND))
    over = found.filter("n is not null").select("trie", "root", F.ceil(F.col("n") / F.lit(max(1, max_root // 2))).cast("int").alias("k"))
    edges = found.filter("n is null").select("a", "b")
    if over.isEmpty():
        return edges
    chunk = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    paired = leaves.join(over, ["trie", "root"]).withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    paired = paired.select(F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "trie", "root", "code", "fp")
    dealt = paired.repartition("trie", "root", "x", "y").sortWithinPartitions("x", "y", "trie", "root")
    return edges.union(stored(dealt.mapInArrow(lambda x: _join(x, heads, budget, None), _FOUND)).select("a", "b"))


def near_duplicates(docs: DataFrame, budget: int = 4, width: int = 4, max_root: int = MAX_ROOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp long, component_id (the smallest doc_id of
    its component).

    Null and empty texts have fingerprint 0, like others that happen to have it, and are linked
    by it. Repeated rows and equal doc_ids each give a row. A null doc_id is never a component's
    id unless all of its doc_ids are null. No rows: no rows. Other columns are not read."""
    fp_of = stored(fingerprints(docs, width, doc_id, text))
    fps = stored(fp_of.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = stored(components(linked(fps.select("fp"), budget, max_root)))
    inside = labels.join(fps, labels["node"] == fps["fp"]).select("fp", "label", "first_id")
    smallest = stored(inside.groupBy("label").agg(F.min("first_id").alias("component_id")))
    named = stored(inside.join(smallest, "label").select("fp", "component_id"))
    classes = stored(fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return fp_of.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those whose doc_id is the
    component's id, of several rows with that doc_id the first by the text's hash. Rows with a
    null doc_id stay, as they cannot be named as copies of another. Columns of any names are carried. No rows: no rows."""
    key, place = free_name(docs.columns), free_name(docs.columns, "y")
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key))
    rank = F.row_number().over(Window.partitionBy(F.col(f"`{doc_id}`")).orderBy(F.xxhash64(F.col(f"`{text}`"))))
    kept = docs.join(stay, docs[f"`{doc_id}`"] == stay[key], "left_semi").withColumn(place, rank).filter(F.col(place) == 1).drop(place)
    return kept.unionByName(docs.filter(F.col(f"`{doc_id}`").isNull()))

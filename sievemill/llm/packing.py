"""Packing of token pieces into sequences of a fixed size by best fit and a swap-based local search.

Pieces are dealt over tasks by their place in a stored table, so that neither equal rows nor equal ids meet in one task.
A task places its pieces best fit, longest first; then fuller bins trade with the emptiest ones: a move, one for one, two for
one or one for two, each of which raises the sum of squared fills, until no trade is left. That drives the free space of a task into
a few bins; these are opened again and go to the next round, of fewer tasks, until one task holds what is left."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .tokens import encoder

#: Tokens of a sequence.
SIZE = 2048
#: Pieces that a task packs at least, if there are as many; under twice as many go to one task, since halves pack worse.
PIECES_A_TASK = 40_000
#: Free space, in sequences, up to which a task's emptiest bins go to the next round.
OPEN_SPACE = 4
#: So many of the emptiest bins give to all others at first; where they have nothing to give, eight times as many, up to half of all.
GIVING = 24
#: Ids of texts that a worker gathers before it hands them on, in bytes.
BATCH_BYTES = 8 << 20


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = SIZE, end: int = 0) -> DataFrame:
    """doc_id, piece int, start long, length long, ids binary (unsigned, little-endian, 32 bits each) of ``docs`` (doc_id, text).

    A document's ids are those of its whole text and then ``end``. More than ``size`` ids are cut into pieces of ``size``, of which
    the first (piece 0) may be shorter. Null and empty texts are ``end`` alone. Repeated rows are cut each, other columns are not read.
    tokenizer, ranks: files that every executor can read (see ``tokens.Encoder``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer, ranks).ids, np.array([end], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), last]).astype("<u4", copy=False).tobytes()
                n = len(ids) // 4
                first = (n - 1) % size + 1
                for k, (a, b) in enumerate([(0, first), *((s, s + size) for s in range(first, n, size))]):
                    rows.append((i, k, a, b - a, ids[4 * a : 4 * b]))
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield _piece_batch(batch.column(0), rows)
                    rows, held = [], 0
            if rows:
                yield _piece_batch(batch.column(0), rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def _piece_batch(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    at, piece, start, length, ids = zip(*rows, strict=True)
    columns = [doc_ids.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of the lengths, which fall: each goes to the bin with the least free space that holds it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit f: there is a bin with f free
    for n in lengths:
        room = mask >> n
        if room:
            free = n + (room & -room).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[at].append(n)
        else:
            free, at = size, len(bins)
            bins.append([n])
        left = free - n
        if left:
            by_free[left].append(at)
            mask |= 1 << left
    return bins


class _Givers:
    """The emptiest bins: which lengths they hold, and which sums of two from one bin."""

    def __init__(self, bins: list[list[int]], members: list[int]):
        self.bins = bins
        self.where: dict[int, set[int]] = {}
        self.singles = 0
        self.pairs: dict[int, int] = {}
        self._double: int | None = None
        for b in members:
            for n in set(bins[b]):
                self.where.setdefault(n, set()).add(b)
                self.singles |= 1 << n
            self._pair(b)

    def _pair(self, b: int) -> None:
        found, items = 0, self.bins[b]
        for i, x in enumerate(items):
            for y in items[i + 1 :]:
                found |= 1 << (x + y)
        self.pairs[b], self._double = found, None

    def double(self) -> int:
        if self._double is None:
            self._double = 0
            for mask in self.pairs.values():
                self._double |= mask
        return self._double

    def trade(self, b: int, out: tuple[int, ...], back: tuple[int, ...]) -> None:
        items = self.bins[b]
        for n in out:
            items.remove(n)
            if n not in items:
                self.where[n].discard(b)
                if not self.where[n]:
                    self.singles &= ~(1 << n)
        for n in back:
            items.append(n)
            self.where.setdefault(n, set()).add(b)
            self.singles |= 1 << n
        self._pair(b)

    def with_pair(self, total: int) -> tuple[int, tuple[int, int]]:
        b = min(b for b, mask in self.pairs.items() if mask >> total & 1)
        items = self.bins[b]
        for i, x in enumerate(items):
            if total - x in items[i + 1 :]:
                return b, (x, total - x)
        raise AssertionError(total)


def _best_trade(items: list[int], free: int, givers: _Givers) -> tuple[int, tuple[int, ...], tuple[int, ...], bool]:
    """(gain, lengths that leave, lengths that come, whether those come as a pair from one bin) of the largest gain."""
    window = (1 << free) - 1
    best = (0, (), (), False)
    gain = (givers.singles >> 1 & window).bit_length()
    if gain:
        best = (gain, (), (gain,), False)
    for a in set(items):
        if best[0] == free:
            return best
        gain = (givers.singles >> (a + 1) & window).bit_length()
        if gain > best[0]:
            best = (gain, (a,), (a + gain,), False)
    if best[0] < free:
        double = givers.double()
        for a in set(items):
            gain = (double >> (a + 1) & window).bit_length()
            if gain > best[0]:
                best = (gain, (a,), (a + gain,), True)
        for i, a in enumerate(items):
            for c in items[i + 1 :]:
                gain = (givers.singles >> (a + c + 1) & window).bit_length()
                if gain > best[0]:
                    best = (gain, (a, c), (a + c + gain,), False)
    return best


def improved(bins: list[list[int]], size: int) -> list[list[int]]:
    """``bins``, emptiest first, after trades that each move length from an emptier bin to a fuller one. The sum of squared fills
    rises with each trade, so it ends: when neither the emptiest bins nor the emptier half of all has anything to give."""
    giving = GIVING
    while True:
        bins = sorted((b for b in bins if b), key=sum)
        underfull = sum(1 for b in bins if sum(b) < size)
        half = (underfull + 1) // 2
        if underfull < 2:
            return bins
        if _pass_on(bins, min(giving, half), underfull, size):
            giving = GIVING
        elif giving >= half:
            return bins
        else:
            giving *= 8


def _pass_on(bins: list[list[int]], giving: int, underfull: int, size: int) -> bool:
    """Trades of the first ``giving`` of ``bins`` with the other underfull ones, of which the fullest takes first. True if any was made."""
    givers, traded = _Givers(bins, list(range(giving))), False
    for items in bins[underfull - 1 : giving - 1 : -1]:
        free = size - sum(items)
        while free:
            gain, leave, come, paired = _best_trade(items, free, givers)
            if not gain:
                break
            b, out = givers.with_pair(come[0]) if paired else (min(givers.where[come[0]], key=lambda x: (sum(bins[x]), x)), come)
            givers.trade(b, out, leave)
            for n in leave:
                items.remove(n)
            items.extend(out)
            free -= gain
            traded = True
    return traded


def opened(bins: list[list[int]], size: int) -> list[bool]:
    """Which of ``bins`` (emptiest first) go on: those with free space, until it is OPEN_SPACE sequences."""
    before = np.cumsum([0, *[size - sum(b) for b in bins]])
    return [sum(b) < size and before[i] < OPEN_SPACE * size for i, b in enumerate(bins)]


def _packed(size: int, turn: int, last: bool):
    """Packs the rows of a task (row, length, file, place); their order within the task is that of length and stored place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        rows = pa.Table.from_batches(found)
        lengths = rows.column("length").to_numpy()
        order = np.lexsort((rows.column("place").to_numpy(), rows.column("file").to_numpy(zero_copy_only=False).astype(str), -lengths))
        falling = lengths[order].tolist()
        full = int((lengths == size).sum())  # full sequences need no search
        bins = improved(best_fit(falling[full:], size), size)
        goes_on = [False] * full + ([False] * len(bins) if last else opened(bins, size))
        bins = [[size]] * full + bins
        flat = np.array([n for b in bins for n in b], np.int64)
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        offset = np.concatenate([np.cumsum([0, *b[:-1]]) for b in bins])
        at = np.argsort(-flat, kind="stable")  # the places of the longest piece, the next and so on
        base = (turn << 56) + (TaskContext.get().partitionId() << 32)
        out = pa.table({
            "row": rows.column("row").take(pa.array(order)), "length": pa.array(flat[at]), "sequence_id": pa.array(base + number[at]),
            "offset": pa.array(offset[at]), "open": pa.array(np.array(goes_on, bool)[number[at]]),
        })
        yield from out.combine_chunks().to_batches()

    return pack


def pack(rows: DataFrame, length: str = "length", size: int = SIZE) -> DataFrame:
    """``rows`` and sequence_id long, offset long: rows of one sequence_id stand at their offsets without a gap, ``size`` at most.

    ``length`` is a whole number from 1 to ``size``; a null, smaller or larger one raises. Repeated rows are placed each. Columns
    named sequence_id or offset are replaced. Which of equally long rows takes which place follows their places in the stored
    table, so that a task that runs again gives the same. No rows give no rows."""
    kept = [c for c in rows.columns if c.lower() not in ("sequence_id", "offset")]
    n = F.col(f"`{length}`").cast("long")
    checked = F.when(n.between(1, size), n).otherwise(F.raise_error(F.lit(f"lengths must be from 1 to {size}")))
    left = stored(rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), checked.alias("length")))
    schema = T.StructType([*left.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())])
    closed, turn, tasks = [], 0, 0
    while tasks != 1:
        tasks = max(1, left.count() // PIECES_A_TASK)
        dealt = left.select("row", "length", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
        placed = stored(dealt.repartition(tasks, F.xxhash64("file", "place")).mapInArrow(_packed(size, turn, tasks == 1), schema))
        closed.append(placed.filter("not open"))
        left, turn = stored(placed.filter("open").select("row", "length")), turn + 1
    out = reduce(DataFrame.unionByName, closed)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids binary: the ids of each sequence's pieces in order of their offsets (``pack`` of ``pieces``)."""
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(members, F.lit(b""), lambda all_ids, m: F.concat(all_ids, m["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))

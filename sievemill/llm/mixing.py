"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training progress (0 to 1): weights at the knots of
a common grid, linear in between. The integral of a source's schedule is its weight in the budget.
Its integral up to some progress, as a part of the whole, is the part of its words that is wanted by then;
inverting that at a document's first word gives the training position of the document, and a
range sort by position gives the order. Where the schedules of all sources sum to the same at all times,
progress is the part of all words done.

Nothing here needs a source in one task: the words before a document in its source are the
words of earlier hash buckets (a table of at most BUCKETS rows a source) plus those before it
in its own bucket. Sources themselves are ranked by a range sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, in_order, stored, word_count

#: Hash buckets a source is cut into; three hexadecimal digits of the ordering key.
BUCKETS = 4096
#: Knots of the default schedules, which begin alike, end apart, and integrate to 1, 2 and 3.
GRID = (0.0, 0.5, 1.0)
CURRICULUM = ((2.0, 1.0, 0.0), (2.0, 2.0, 2.0), (2.0, 3.0, 4.0))


def water_filled(sources: DataFrame, total: int) -> DataFrame:
    """Add ``target``: ``total`` words shared by ``weight``, none above ``cap``; what a cap
    leaves over is shared again by weight among the others, until none is above.

    sources: source_key, weight double, cap long. In the order of cap / weight the sources whose caps
    hold come first. If those before a source are capped, the others share what is left at a level (words for a
    weight of 1); the largest such level is the one at which all words are given. A source of no weight gets none."""
    open_ = sources.filter(F.col("weight") > 0).withColumn("ratio", F.col("cap") / F.col("weight"))
    placed = in_order(open_.select("source_key", "weight", "cap", "ratio"), ["ratio", "source_key"], sums=["cap", "weight"])
    all_weight = open_.agg(F.sum("weight")).first()[0] or 0.0
    left = F.greatest(F.lit(float(all_weight)) - F.col("weight_before"), F.col("weight"))
    level = placed.agg(F.max((F.lit(float(total)) - F.col("cap_before")) / left)).first()[0] or 0.0
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))).otherwise(F.lit(0.0)))


def _segments(weights: Column, grid: Sequence[float]) -> list[tuple[Column, Column, float]]:
    return [(weights[k], weights[k + 1], grid[k + 1] - grid[k]) for k in range(len(grid) - 1)]


def integral(weights: Column, grid: Sequence[float]) -> Column:
    """Integral of piecewise linear weights over the whole grid."""
    total = F.lit(0.0)
    for a, b, h in _segments(weights, grid):
        total = total + (a + b) * F.lit(h / 2)
    return total


def inverse(weights: Column, grid: Sequence[float], area: Column) -> Column:
    """Progress at which the integral of the weights reaches ``area``. In each segment the
    part of the area that falls in it gives a quadratic; progress is the sum of the parts."""
    progress, left = F.lit(float(grid[0])), area
    for a, b, h in _segments(weights, grid):
        part = F.greatest(F.lit(0.0), F.least(left, (a + b) * F.lit(h / 2)))
        root = a + F.sqrt(F.greatest(F.lit(0.0), a * a + F.lit(2.0 / h) * (b - a) * part))
        inside = F.least(F.lit(h), F.try_divide(2 * part, root))
        progress = progress + F.when(root > 0, inside).when(left > 0, F.lit(h)).otherwise(F.lit(0.0))
        left = left - part
    return progress


def mix(
    docs: DataFrame,
    weights: DataFrame,
    grid: Sequence[float] = GRID,
    max_repeats: int = 3,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: str | None = None,
) -> DataFrame:
    """The columns of ``docs`` and the place of each row in the mix.

    weights: source, weights array<double> (one for each knot of ``grid``, none negative); a
    source that is not listed, or whose weights are null, weighs 0 and is not taken. size: a column with the words
    of the text, if they are counted already; ``text`` is not read then. Added
    columns: mix_size long (words), mix_source_size long, mix_target double (words of its
    source in the mix), mix_taken long (words of this row in the mix, repeats counted),
    mix_copies array<struct<position double, words long>> (one for each time it is taken).
    Columns of ``docs`` with those names are replaced; columns of any other names are carried as they are.

    Sources share all words of ``docs`` by the integrals of their weights and give at most ``max_repeats`` times their own. A
    source is taken in the order of a seeded hash of doc_id, as often as its target asks; the
    last copy is cut so that the source's words are its rounded target. Null source: a source
    of its own, matched by a null in ``weights``. Null or empty text: size 0, never taken. Texts of any length are counted
    whole. Null doc_id: hashed as an empty one; rows with one hash are taken by size, and equal rows are interchangeable.
    No rows: no rows."""
    grid = [float(g) for g in grid]
    base = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_copies")
    at, of = free_name(docs.columns), free_name(docs.columns, "y")
    own, its = (lambda f: F.col(f"`{at}`.{f}")), (lambda f: F.col(f"`{of}`.{f}"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))))
    words = F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long") if size else word_count(text)
    row = base.withColumn(at, F.struct(F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`")), F.lit("n")).alias("src"), key.alias("key"), F.substring(key, 1, 3).alias("bucket"), words.alias("size")))
    buckets = stored(row.groupBy(own("src").alias("source_key"), own("bucket").alias("bucket")).agg(F.sum(own("size")).alias("words")))
    keyed = weights.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_key"), F.col("weights").alias("w"))
    by_source = buckets.groupBy("source_key").agg(F.sum("words").alias("source_size")).join(keyed, "source_key", "left")
    by_source = by_source.withColumn("w", F.coalesce("w", F.array(*[F.lit(0.0)] * len(grid)))).withColumn("cap", F.col("source_size") * max_repeats)
    by_source = stored(by_source.withColumn("weight", integral(F.col("w"), grid)))
    total = by_source.agg(F.sum("source_size")).first()[0] or 0
    targets = water_filled(by_source, total).withColumn("target", F.round("target", 6)).drop("cap")
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(targets, "source_key")
    inside = Window.partitionBy(own("src"), own("bucket")).orderBy(own("key"), own("size")).rowsBetween(Window.unboundedPreceding, -1)
    joined = row.join(offsets.select(F.struct("*").alias(of)), (own("src") == its("source_key")) & (own("bucket") == its("bucket")))
    start = its("offset") + F.coalesce(F.sum(own("size")).over(inside), F.lit(0))
    placed = joined.withColumn(of, F.struct(*[its(f).alias(f) for f in ("source_size", "target", "weight", "w")], start.alias("start")))
    copies = []
    for repeat in range(max_repeats):
        first = its("start") + F.lit(repeat) * its("source_size")
        taken = F.greatest(F.lit(0), F.least(own("size"), F.round(its("target")).cast("long") - first)).cast("long")
        position = inverse(its("w"), grid, F.try_divide(its("weight") * first, its("target")))
        copies.append(F.when(taken > 0, F.struct(position.alias("position"), taken.alias("words"))))
    out = placed.select(*[F.col(f"`{c}`") for c in base.columns], own("size").alias("mix_size"), its("source_size").alias("mix_source_size"), its("target").alias("mix_target"), F.array_compact(F.array(*copies)).alias("mix_copies"))
    taken = F.aggregate("mix_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return out.withColumn("mix_taken", taken).select(*[F.col(f"`{c}`") for c in base.columns], "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_copies")


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each copy taken, range-sorted by ``position`` (0 to 1). Added: position
    double, words long (of the copy; fewer than the text's where the target cuts it). Columns with those names are replaced."""
    copy = free_name(mixed.columns)
    each = mixed.drop("position", "words").withColumn(copy, F.explode("mix_copies")).withColumns({"position": F.col(f"`{copy}`.position"), "words": F.col(f"`{copy}`.words")}).drop(copy, "mix_copies")
    return (each.repartitionByRange(partitions, "position") if partitions else each.repartitionByRange("position")).sortWithinPartitions("position")


def cyclic_weights(docs: DataFrame, cycle: Sequence[Sequence[float]] = CURRICULUM, source: str = "source") -> DataFrame:
    """source and weights: the sources in code point order, null last, take the schedules of ``cycle`` in turn."""
    found = docs.select(F.col(f"`{source}`").alias("source")).distinct().withColumn("last", F.col("source").isNull())
    turn = (F.pmod(F.col("rank"), F.lit(len(cycle))) + 1).cast("int")
    schedules = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in cycle])
    return in_order(found, ["last", "source"]).select("source", F.element_at(schedules, turn).alias("weights"))

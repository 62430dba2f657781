"""Many words looked for in one pass over a text: an automaton over all of them, shared by every table of keywords."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import SMALL_ROWS, small

Table = Sequence[tuple[str, Sequence[str]]]

#: Automata of a worker, by their words.
_built: dict[tuple, object] = {}


def _automaton(words: tuple[str, ...]):
    if words not in _built:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, w in enumerate(words):
            found.add_word(w, i)
        found.make_automaton()
        _built[words] = found
    return _built[words]


def keyword_counts(text: Column, *tables: Table) -> Column:
    """array<int>: for each entry of the tables, one after the other, how many of its words stand in the text, wherever and however
    often; a word that an entry lists twice counts twice. Null for a null text. Case is as it is."""
    entries = [list(words) for table in tables for _, words in table]
    words = tuple(dict.fromkeys(w for e in entries for w in e))
    of_word = [[i for i, e in enumerate(entries) for x in e if x == w] for w in words]
    n = len(entries)

    @F.arrow_udf("array<int>")
    def counts(texts: pa.Array) -> pa.Array:
        automaton, out = _automaton(words), []
        for value in texts:
            s = value.as_py()
            if s is None:
                out.append(None)
                continue
            row = [0] * n
            for at in {i for _, i in automaton.iter(s)}:
                for e in of_word[at]:
                    row[e] += 1
            out.append(row)
        return pa.array(out, pa.list_(pa.int32()))

    return counts(text) if words else F.when(text.isNotNull(), F.array_repeat(F.lit(0), n))


def places(text: Column, words: Sequence[str]) -> Column:
    """array<struct<word, start>> (start from 0) of every place of every word in the text, overlapping ones too, by start and
    then the longer word first."""
    listed = tuple(dict.fromkeys(words))

    @F.arrow_udf("array<struct<word:string,start:int>>")
    def found(texts: pa.Array) -> pa.Array:
        automaton, out = _automaton(listed), []
        for value in texts:
            s = value.as_py()
            if s is None:
                out.append(None)
                continue
            hits = sorted((end - len(listed[i]) + 1, -len(listed[i]), i) for end, i in automaton.iter(s))
            out.append([{"word": listed[i], "start": start} for start, _, i in hits])
        return pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32())])))

    return found(text) if listed else F.when(text.isNotNull(), F.array().cast("array<struct<word:string,start:int>>"))


def longest_contained(rows: DataFrame, text: str, names: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``rows`` and hit: the id of the longest name (names: name string, id, none null or empty) that stands in ``text``; of equally
    long ones the least by text. Null without any.

    Up to ``limit`` names make an automaton that each task builds from the plan; more of them meet the texts by an equi-join of the
    texts' own substrings of the lengths that names have, shuffled like any join."""
    named = names.groupBy("name").agg(F.min("id").alias("id"))
    kind = names.schema["id"].dataType
    vocabulary = named.limit(limit + 1).collect()
    if len(vocabulary) <= limit:
        words = tuple(r.name for r in vocabulary)
        ids = [r.id for r in vocabulary]

        @F.arrow_udf(kind)
        def longest(texts: pa.Array) -> pa.Array:
            automaton, out = _automaton(words), []
            for value in texts:
                s = value.as_py()
                best = min(((-len(words[i]), words[i], i) for _, i in automaton.iter(s)), default=None) if s and words else None
                out.append(None if best is None else ids[best[2]])
            return pa.array(out, type=None if any(x is not None for x in out) else pa.null()).cast(_arrow_type(kind))

        return rows.withColumn("hit", longest(F.col(text)))
    return rows.join(_by_substrings(rows.select(F.col(text).alias("__text")).distinct(), named), F.col(text) == F.col("__text"), "left").drop("__text")


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _by_substrings(texts: DataFrame, named: DataFrame) -> DataFrame:
    """__text, hit: as ``longest_contained``, by a join on substrings."""
    lengths = [r.n for r in named.select(F.length("name").alias("n")).distinct().orderBy("n").limit(10_000).collect()]
    grams = F.array_distinct(F.flatten(F.transform(
        F.array(*[F.lit(n) for n in lengths]),
        lambda n: F.when(F.length("__text") >= n, F.transform(F.sequence(F.lit(1), F.length("__text") - n + 1), lambda i: F.substr(F.col("__text"), i, n))).otherwise(F.array().cast("array<string>")),
    )))
    met = texts.select("__text", F.explode(grams).alias("name")).join(small(named), "name")
    return met.groupBy("__text").agg(F.min_by("id", F.struct(-F.length("name"), F.col("name"))).alias("hit"))

"""Registration of names that no vocabulary resolves: a versioned vocabulary that grows by actions, and what is open is resolved anew.

The vocabulary is a log of entries (id, name, action, version, seq), of which the last of a name counts: ``create`` makes an id with a
name, ``merge`` makes a name another one of an id, ``discard`` closes a name without an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import relational
from .storage import small, stored

#: Names that are judged at once.
BATCH = 40


def open_names(seen: DataFrame, log: DataFrame, name: str = "name") -> DataFrame:
    """key, name, n long: names of ``seen`` that the log does not know, each key once with its number of rows and its least spelling."""
    asked = seen.select(F.col(name).alias("name"), t.key(F.col(name)).alias("key")).filter("key <> ''")
    left = asked.join(small(log.select("key").distinct()), "key", "left_anti")
    return left.groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("n"))


def in_batches(queue: DataFrame, size: int = BATCH) -> DataFrame:
    """``queue`` (key) and batch long, from 1, in order of the keys."""
    return relational.in_order(queue, ["key"], "__place").withColumn("batch", F.floor(F.col("__place") / size) + 1).drop("__place")


def accepted(actions: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected) of proposed ``actions`` (name, action, id, confidence double, seq): one action a key, rejected ones with a reason.

    Of several for one key that with the highest confidence counts, then merge before create before discard, then the first by
    seq; the others are ``outvoted``. ``known``: the log has the key. A create without an id takes its key; one of an id
    that is there is ``id_taken``; of several creates of one id the first key stays and the rest merge into it. A merge into an id that is neither
    there nor created beside it is ``no_target``; anything else than the three is ``no_action``."""
    order = F.when(F.col("action") == "merge", 0).when(F.col("action") == "create", 1).otherwise(2)
    keyed = actions.withColumn("key", t.key(F.col("name"))).withColumn("id", F.nullif(F.trim("id"), F.lit("")))
    keyed = keyed.withColumn("id", F.when(F.col("action") == "create", F.coalesce("id", "key")).when(F.col("action") == "merge", F.col("id")))
    known = small(log.select("key").distinct().withColumn("__known", F.lit(True)))
    ids = small(log.filter("id is not null").select("id").distinct().withColumn("__there", F.lit(True)))
    possible = ~F.col("action").isin("create", "merge", "discard") | F.col("action").isNull() | (F.col("key") == "")
    marked = stored(keyed.join(known, "key", "left").join(ids, "id", "left").withColumn("reason", F.when(possible, "no_action").when(F.col("__known"), "known").when((F.col("action") == "create") & F.col("__there"), "id_taken")))
    vote = Window.partitionBy("key").orderBy(F.desc_nulls_last("confidence"), order, "seq")
    voted = marked.filter("reason is null").withColumn("reason", F.when(F.row_number().over(vote) > 1, "outvoted"))
    won = voted.filter("reason is null")
    first = won.filter("action = 'create'").groupBy("id").agg(F.min("key").alias("__first"))
    won = won.join(small(first), "id", "left").withColumn("action", F.when((F.col("action") == "create") & (F.col("key") != F.col("__first")), "merge").otherwise(F.col("action")))
    won = won.withColumn("reason", F.when((F.col("action") == "merge") & F.col("__there").isNull() & F.col("__first").isNull(), "no_target"))
    columns = ["key", "name", "action", "id", "seq"]
    bad = marked.filter("reason is not null").select(*columns, "reason").unionByName(voted.filter("reason is not null").select(*columns, "reason")).unionByName(won.filter("reason is not null").select(*columns, "reason"))
    return won.filter("reason is null").select(*columns), bad


def applied(log: DataFrame, entries: DataFrame) -> DataFrame:
    """``log`` (key, name, action, id, seq, version) with ``entries`` as its next version."""
    version = log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v + 1
    return stored(log.unionByName(entries.withColumn("version", F.lit(version))))


def settled(seen: DataFrame, log: DataFrame, judge, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(log, open names) after ``judge`` (batches of open names -> actions) was asked about all that is open, again and again with the log as
    it then was, until a round changes nothing. ``rounds`` is only a guard against a judge that never ends: beyond it it raises."""
    for _ in range(rounds):
        queue = stored(open_names(seen, log))
        entries, _ = accepted(judge(in_batches(queue), log), log)
        entries = stored(entries)
        if entries.isEmpty():
            return log, queue
        log = applied(log, entries)
    raise RuntimeError(f"registration did not settle in {rounds} rounds")


def resolved(seen: DataFrame, log: DataFrame, name: str = "name") -> DataFrame:
    """``seen`` and id, status (registered, discarded or open)."""
    at = small(log.select("key", F.col("id").alias("__id"), "action").dropDuplicates(["key"]))
    status: Column = F.when(F.col("action") == "discard", "discarded").when(F.col("action").isNotNull(), "registered").otherwise("open")
    kept = seen.drop("id", "status")
    return kept.withColumn("key", t.key(F.col(name))).join(at, "key", "left").select(*kept.columns, F.col("__id").alias("id"), status.alias("status"))

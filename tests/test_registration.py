"""Registration rounds, and manifests of folders."""

import os

import pytest
from pyspark.sql import functions as F

from sievemill.operators import registration
from sievemill.sources import manifests

LOG = "key string, name string, action string, id string, seq long, version int"
ACTIONS = "name string, action string, id string, confidence double, seq long"


def log_of(spark, *rows):
    return spark.createDataFrame([(k, k, a, i, 0, 0) for k, a, i in rows], LOG)


def judged(spark, actions, *log):
    entries, bad = registration.accepted(spark.createDataFrame(actions, ACTIONS), log_of(spark, *log))
    return {(r.key, r.action, r.id) for r in entries.collect()}, {(r.key, r.action, r.reason) for r in bad.collect()}


def test_conflicts_of_actions(spark):
    actions = [
        ("New One", "create", None, 0.5, 1), ("new-one", "discard", None, 0.4, 2), ("other", "merge", "newone", 0.9, 3), ("lost", "merge", "nowhere", 0.9, 4), ("known", "create", "x", 1.0, 5),
        ("two a", "create", "two", 0.5, 6), ("two b", "create", "two", 0.5, 7), ("odd", "rename", "x", 1.0, 8), ("taken", "create", "old", 1.0, 9), ("tie", "discard", None, 0.5, 10), ("tie", "merge", "old", 0.5, 11),
        ("bin", "discard", "ignored", None, 12), (" - ", "discard", None, 1.0, 13),
    ]
    good, bad = judged(spark, actions, ("known", "create", "k"), ("o", "create", "old"))
    assert good == {("newone", "create", "newone"), ("other", "merge", "newone"), ("twoa", "create", "two"), ("twob", "merge", "two"), ("tie", "merge", "old"), ("bin", "discard", None)}
    assert bad == {("newone", "discard", "outvoted"), ("lost", "merge", "no_target"), ("known", "create", "known"), ("odd", "rename", "no_action"), ("taken", "create", "id_taken"), ("tie", "discard", "outvoted"), ("", "discard", "no_action")}


def test_rounds_until_nothing_changes(spark):
    seen = spark.createDataFrame([("a",), ("A-b",), ("a b c",), ("zz",), ("zz",), (None,), (" ",)], "name string")
    asked = []

    def judge(queue, log):
        asked.append(sorted((r.key, r.n, r.batch) for r in queue.collect()))
        ids = [r.id for r in log.filter("id is not null").collect()]
        long = F.length("key")
        action = F.when(long == 1, "create").when(F.lit("a" in ids) & (long == 2) & (F.col("key") != "zz"), "merge").when(F.lit(len(asked) > 2) & (long == 3), "discard")
        return queue.select("name", action.alias("action"), F.when(long == 1, "a").otherwise("a").alias("id"), F.lit(None).cast("double").alias("confidence"), F.lit(1).cast("long").alias("seq")).filter("action is not null")

    log, left = registration.settled(seen, log_of(spark), judge)
    assert [(r.key, r.n) for r in left.collect()] == [("zz", 2)] and {r.version for r in log.collect()} == {1, 2, 3}
    assert asked[0] == [("a", 1, 1), ("ab", 1, 1), ("abc", 1, 1), ("zz", 2, 1)] and asked[-1] == [("zz", 2, 1)]
    status = sorted((r.name or "", r.id, r.status) for r in registration.resolved(seen, log).collect())
    assert status == [("", None, "open"), (" ", None, "open"), ("A-b", "a", "registered"), ("a", "a", "registered"), ("a b c", None, "discarded"), ("zz", None, "open"), ("zz", None, "open")]
    with pytest.raises(RuntimeError):
        registration.settled(seen, log_of(spark), lambda q, _: q.limit(1).select(F.col("key").alias("name"), F.lit("discard").alias("action"), F.lit(None).cast("string").alias("id"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("seq")), rounds=2)


def test_batches_of_a_long_queue(spark):
    queue = spark.createDataFrame([(f"{i:03d}",) for i in range(95)], "key string").repartition(5)
    got = {r.key: r.batch for r in registration.in_batches(queue, 10).collect()}
    assert got == {f"{i:03d}": i // 10 + 1 for i in range(95)}
    assert registration.in_batches(queue.limit(0)).collect() == []


def write(base, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{base}/{path}"), exist_ok=True)
        with open(f"{base}/{path}", "w") as f:
            f.write(text)


def test_manifest_difference_and_pending(spark, tmp_path):
    base = str(tmp_path / "papers")
    write(base, {"cathode/a.md": "one", "Anode/b.md": "two", "anode/x/c.md": "deep", "test/cathode/d.md": "no", "cathode/e.txt": "no", "electrolyte/f.md": "f", "cathode/x/a.md": "copy", "g.md": "top"})
    first = manifests.manifest(spark, base).cache()
    assert {r.path for r in first.collect()} == {"cathode/a.md", "Anode/b.md", "anode/x/c.md", "test/cathode/d.md", "electrolyte/f.md", "cathode/x/a.md", "g.md"}
    assert {(r.component, r.stem) for r in manifests.with_component(first).collect()} == {("cathode", "a"), ("anode", "b"), ("electrolyte", "f")}
    deep = {(r.component, r.stem, r.path) for r in manifests.with_component(first, immediate=False).collect()}
    assert deep == {("cathode", "a", "cathode/a.md"), ("anode", "b", "Anode/b.md"), ("anode", "c", "anode/x/c.md"), ("electrolyte", "f", "electrolyte/f.md")}
    write(base, {"cathode/a.md": "changed", "cathode/new.md": "n"})
    os.remove(f"{base}/g.md")
    os.utime(f"{base}/electrolyte/f.md", (1, 1))
    change = {r.path: r.change for r in manifests.difference(manifests.manifest(spark, f"file://{base}/"), first).collect()}
    assert change == {"cathode/a.md": "changed", "cathode/new.md": "added", "g.md": "gone", "electrolyte/f.md": "touched", "Anode/b.md": "same", "anode/x/c.md": "same", "test/cathode/d.md": "same", "cathode/x/a.md": "same"}
    files = manifests.with_component(first, immediate=False)
    left = manifests.pending(files, files.filter("stem = 'b'"), 1)
    assert {(r.component, r.stem) for r in left.collect()} == {("cathode", "a"), ("anode", "c"), ("electrolyte", "f")}

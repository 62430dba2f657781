"""Manifests of folders: which files there are, what is in them, and what has changed since."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders of components, and names of folders that are left out.
COMPONENTS = ["cathode", "anode", "electrolyte"]
PRUNED = ["Solid_State", "test", "text_cathode"]


def manifest(spark: SparkSession, folder: str, pattern: str = "*.md", by_folder: bool = False) -> DataFrame:
    """path (below ``folder``), length long, modified timestamp, sha256: the files at any depth whose names match. Tasks read them as
    bytes; the content goes no further than its hash. by_folder: a folder of part files is one entry, by the hashes of its parts in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    below = F.substring_index(F.col("path"), f"/{folder.split('://')[-1].strip('/')}/", -1)
    found = files.select(below.alias("path"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    if not by_folder:
        return found
    up = found.withColumn("path", F.regexp_replace("path", r"/?[^/]*$", ""))
    hashes = F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256)
    return up.groupBy("path").agg(F.sum("length").alias("length"), F.max("modified").alias("modified"), hashes.alias("sha256"))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def with_component(files: DataFrame, immediate: bool = True, components: Sequence[str] = COMPONENTS, pruned: Sequence[str] = PRUNED) -> DataFrame:
    """``files`` (path) of component folders, with component and stem. immediate: the folder that a file is in has to be a component's, in any case;
    else the first component's folder above it counts. Nothing below a pruned folder; of one component and stem the first path."""
    folders = F.slice(parts(F.col("path")), 1, F.greatest(F.size(parts(F.col("path"))) - 1, F.lit(0)))
    names = F.array(*[F.lit(c) for c in components])
    found = F.lower(F.try_element_at(folders, F.lit(-1))) if immediate else F.get(F.filter(F.transform(folders, F.lower), lambda x: F.array_contains(names, x)), F.lit(0))
    kept = files.filter(~F.arrays_overlap(folders, F.array(*[F.lit(p) for p in pruned]))).withColumn("component", found)
    kept = kept.filter(F.array_contains(names, F.col("component"))).withColumn("stem", F.regexp_replace(F.element_at(parts(F.col("path")), -1), r"\.[^.]*$", ""))
    first = Window.partitionBy("component", "stem").orderBy("path")
    return kept.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, change (added, changed, gone, touched, same) of two manifests: changed by its hash; touched if only the time is another."""
    a = now.select("path", F.col("sha256").alias("__now"), F.col("modified").alias("__at"))
    b = before.select("path", F.col("sha256").alias("__then"), F.col("modified").alias("__was"))
    change = F.when(F.col("__then").isNull(), "added").when(F.col("__now").isNull(), "gone").when(F.col("__now") != F.col("__then"), "changed").when(~F.col("__at").eqNullSafe(F.col("__was")), "touched").otherwise("same")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def pending(files: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """``files`` (component, stem, path) without those that are ``done`` (component, stem), the first ``most`` of each component by path after that."""
    left = files.join(done.select("component", "stem").distinct(), ["component", "stem"], "left_anti").select(*files.columns)
    if most is None:
        return left
    return left.withColumn("__n", F.row_number().over(Window.partitionBy("component").orderBy("path"))).filter(F.col("__n") <= most).drop("__n")

"""Folder trees of any depth, by doubling: n levels take about log2(n) joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.streaming.jobs import checkpoint_folder


def ancestors(folders: DataFrame) -> DataFrame:
    """(folder, at, steps, name): every folder with itself and all folders above it, ``steps``
    levels up, from (id, parent_id, name).  A parent that is no folder ends the way, and so
    does a folder met before on it, so that a circle ends too.  Rows count as SQL's recursive
    union counts them: several rows of one id are several folders, each with its own way, and
    a null id is a folder that nothing lies in."""
    spark, root = folders.sparkSession, checkpoint_folder(folders.sparkSession)
    last = folders.select(F.col("id").alias("folder"), F.col("id").alias("at"), F.lit(0).alias("steps"), "name", F.col("parent_id").alias("parent"), F.array("id").alias("way"))
    known, reach = last, 1
    while True:
        # known: fewer steps than reach; last: one step fewer.  So the next are made of one of each, in one way only.
        met = F.coalesce(F.arrays_overlap("a.way", "b.way"), F.lit(False))
        far = last.alias("a").join(known.alias("b"), F.col("a.parent") == F.col("b.folder")).where(~met)
        far = far.select("a.folder", "b.at", (F.col("a.steps") + F.col("b.steps") + 1).alias("steps"), "b.name", "b.parent", F.concat("a.way", "b.way").alias("way"))
        # Written and read again: joined with itself, a plan would double every level.
        far.write.parquet(f"{root}/{reach}")
        far = spark.read.schema(far.schema).parquet(f"{root}/{reach}")
        known, reach = known.unionByName(far), 2 * reach
        last = far.where(F.col("steps") == reach - 1)
        if last.isEmpty():
            return known.select("folder", "at", "steps", "name")


def paths(above: DataFrame) -> DataFrame:
    """(folder, path, depth) of ``ancestors``: names from the top down, null where none has one."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("place"), "name")))
    path = F.when(F.count("name") > 0, F.array_join(F.transform(ordered, lambda x: x["name"]), "/"))
    return above.groupBy("folder").agg(path.alias("path"), F.count("*").alias("depth"))


def movable(moves: DataFrame, above: DataFrame) -> DataFrame:
    """(folder, target, allowed) of moves (folder, target): not into itself or below itself."""
    below = above.select(F.col("folder").alias("target"), F.col("at").alias("folder"), F.lit(True).alias("inside"))
    return moves.join(below, ["folder", "target"], "left").select("folder", "target", (F.col("inside").isNull() & (F.col("folder") != F.col("target"))).alias("allowed"))

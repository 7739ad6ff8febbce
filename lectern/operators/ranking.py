"""Places and running sums of a whole table in one order, without a window over all of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.streaming.jobs import checkpoint_folder


def ranked(df: DataFrame, order: Sequence[Column | str], place: str = "place", sums: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with its row number from 1 in ``order``, which must be total, and, for each
    (name, column) of ``sums``, the sum of the column over all rows before, 0 at the start;
    nulls add nothing.  An empty table stays empty.

    Rows are dealt into ranges of the order, one shuffle, and sorted there; a row's place
    in its range comes from the sort.  The ranges are written as a table beside the
    checkpoints, so that they are the same when they are counted and when they are read,
    whatever executors are lost.  What goes to all tasks is one row a range, of which there
    are at most spark.sql.shuffle.partitions.
    """
    spark, sums = df.sparkSession, dict(sums or {})
    if clash := {"_range", "_at", "_rows", *(f"_before_{n}" for n in sums)} & set(df.columns):
        raise ValueError(f"columns with names of the operator's own: {sorted(clash)}")
    folder = f"{checkpoint_folder(spark)}/ranges"
    # The lower 33 bits of the id count the rows of a partition, the upper ones name it.
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)).write.parquet(folder)
    rows = spark.read.parquet(folder)
    totals = rows.groupBy("_range").agg(F.count("*").alias("_rows"), *(F.sum(c).alias(f"_before_{n}") for n, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in totals.columns[1:]))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(F.broadcast(starts), "_range")
    running = [(F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()]
    return found.select(*df.columns, (F.col("_rows") + F.col("_at") + 1).alias(place), *running)

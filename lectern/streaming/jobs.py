"""The job log as a stream: latest state and progress of every document.

A file source feeds both; they run until the files at hand are read and give the same
rows as the batch plans over the same log.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checkpoint_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a temporary one only in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='lectern-')}/stream-{uuid.uuid4().hex}"


def log_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The events of a Parquet file, or of all files of a folder, as a stream."""
    parent, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{parent}/{name}*")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """The sink's rows when everything at hand is read: a table beside the checkpoint, which
    each batch replaces in complete mode and adds to otherwise."""
    folder = checkpoint_folder(df.sparkSession)
    kind = "overwrite" if mode == "complete" else "append"

    def add(batch: DataFrame, _: int) -> None:
        batch.write.mode(kind).parquet(f"{folder}/rows")

    df.writeStream.outputMode(mode).foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def latest_state_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(doc, state): the state of the last event by time, then event id."""
    events = log_stream(spark, path, schema)
    last = events.groupBy(F.col("user_id").alias("doc")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return drained(last, "complete")


def progress_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(doc, seen, pct): events seen and the share of finished ones, 99 at most."""
    events = log_stream(spark, path, schema)
    done = F.count(F.when(F.col("event_type") == "view", 1))
    counted = events.groupBy(F.col("user_id").alias("doc")).agg(F.count("*").alias("seen"), done.alias("done"))
    return drained(counted.select("doc", "seen", F.least(F.lit(99), F.floor(100 * F.col("done") / F.col("seen"))).cast("long").alias("pct")), "complete")


def windowed_events(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and type; in append mode a window appears when its watermark has passed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))


def ingest(uploads: DataFrame, target: str) -> None:
    """Upload batches into a Parquet table, each name once: rows already there are skipped."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["name"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(target).select("name"), "name", "left_anti")
        fresh.write.mode("append").parquet(target)

    uploads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint_folder(uploads.sparkSession)).trigger(availableNow=True).start().awaitTermination()

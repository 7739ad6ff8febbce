"""What several operators share: the shared folder, cut lineage, words, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  A session in local mode
    (tests) that names none gets a temporary one; a cluster without one fails,
    because executors and driver share no other folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage
    ends there, so a lost executor costs one task and not the whole history."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not whenever the
    driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def give_back() -> None:
    """Returns memory that was freed to the system, which C's and Arrow's allocators
    otherwise keep for themselves."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


#: What tasks keep in their worker for later ones of their kind.
KEPT: dict = {}


def let_go() -> None:
    if KEPT:
        KEPT.clear()
        give_back()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``.  Spark keeps a task's Python worker for later ones; what
    this task has freed is not held beside what they take, nor what is ``KEPT`` beside
    a task that has no use for it (not ``keeps``)."""

    def whole(batches):
        if not keeps:
            let_go()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty, a lone surrogate stays one."""
    return (text or "").encode("utf-8", "surrogatepass")


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id) that join what the links between rows i and j join, at
    most one a row: a bounded batch sends no more than it has read."""
    label = ids.copy()
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        if (before == label).all():
            break
    pairs = np.unique(np.stack([ids, label], axis=1)[ids != label], axis=0)
    return pairs[:, 0], pairs[:, 1]


def with_few(df: DataFrame, few: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """``df`` with the columns of ``few``, one row a key, null where it has none.  Up to
    ``most`` rows are sent to all tasks, so that no key of ``df`` is gathered; more are joined."""
    few = cut(few, "few")
    return df.join(F.broadcast(few) if few.count() <= most else few, key, "left")


#: Parts that the links of one node are dealt into.
SALTS = 16


def with_least(links: DataFrame) -> DataFrame:
    """(a, b, m): every link with the smallest b that its a links to.  A node of many
    links is dealt out by a hash of the other end, so that no task gets all of them."""
    salted = links.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    part = salted.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = part.groupBy("a").agg(F.min("m").alias("m"))
    return salted.join(part.select("a", "s").join(least, "a"), ["a", "s"]).select("a", "b", "m")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest
    node that links reach.

    Alternates large-star and small-star until the edges no longer change.  Both
    keep at most one edge for each edge they get, so the table never grows; every
    round is written to the shared folder and the one before removed.  Nothing
    but two numbers a round reaches the driver.
    """
    spark = edges.sparkSession
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    now = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(a != b).distinct()
    path, seen = None, None
    while True:
        new = new_path(spark, "links")
        now.write.parquet(new)
        if path:
            remove(spark, path)
        path = new
        now = spark.read.parquet(path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct().toDF("node", "component")
            )
        seen = state
        both = with_least(now.union(now.select("b", "a").toDF("a", "b")))
        large = both.where(b > a).select(b.alias("a"), F.least(a, m).alias("b")).distinct()
        pairs = with_least(large).select(F.explode(F.array(F.struct(b.alias("a"), m.alias("b")), F.struct(a, m.alias("b")))).alias("e"))
        now = pairs.select("e.a", "e.b").where(a != b).distinct()


def late_id(*content: str | Column) -> Column:
    """A number from 2^62 on, made of the content: the place of what has no id, after all ids."""
    return F.xxhash64(*content).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)


def order_id(id_col: str, *content: str | Column) -> Column:
    """An id to order and to join by: the id itself, or a late one.  Ids must be below 2^62."""
    return F.coalesce(F.col(id_col).cast("long"), late_id(*content))


def real_id(node: str) -> Column:
    """The id of an ``order_id``; null for a late one."""
    return F.when(F.col(node) < F.lit(1 << 62), F.col(node))

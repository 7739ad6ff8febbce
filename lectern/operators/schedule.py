"""Longest-processing-time assignment of documents to workers, as a fold."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lpt(jobs: DataFrame, workers: int) -> DataFrame:
    """(worker, doc_id, cost) of jobs (doc_id, cost): the next largest goes to the least
    loaded worker, the lowest number on ties.  The fold is sequential by nature; it is for
    a plan of some thousand documents, not for Spark's own scheduling."""
    rows = jobs.agg(F.sort_array(F.collect_list(F.struct((-F.col("cost")).alias("less"), "doc_id"))).alias("jobs"))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), workers).alias("load"), F.array().cast("array<struct<worker:int,doc_id:bigint,cost:bigint>>").alias("out"))

    def step(state, job):
        at = F.array_position(state["load"], F.array_min(state["load"])).cast("int")
        cost = -job["less"]
        load = F.transform(state["load"], lambda x, k: F.when(k == at - 1, x + cost).otherwise(x))
        row = F.struct((at - 1).alias("worker"), job["doc_id"].cast("bigint").alias("doc_id"), cost.cast("bigint").alias("cost"))
        return F.struct(load.alias("load"), F.concat(state["out"], F.array(row)).alias("out"))

    return rows.select(F.explode(F.aggregate("jobs", zero, step, lambda s: s["out"])).alias("r")).select("r.*")

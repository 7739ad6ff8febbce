"""From raw documents to packed training sequences.

Five stages, each an operator of ``lectern.llm``; what a stage keeps is written as
Parquet and read again as the next one's input.

* quality classifier: rows predicted 0 go.
* SimHash near-dedup: texts whose sets of five-word shingles reach a Jaccard similarity
  of 0.8 are linked; of what links join the smallest doc_id stays.
* substring dedup: of a passage of 50 words or more that repeats, the copy in the
  smallest doc_id stays; elsewhere its words and the white space after them go.
* benchmark decontamination: documents that hold a benchmark item go.
* packing: sequences of at most 4096 tokens.

Every stage decides by row.  Null doc_ids come after all others in the second and third
stage, ids that rows of different texts share in the second; of repeated rows of one id
and text the second stage keeps one.  Null texts are empty.  Empty tables pass through
every stage, and columns beside those of ``documents`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, packing, quality, simhash, substrings
from lectern.llm.queries import tokenizer_path
from lectern.llm.shared import new_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.scored_rows(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where(F.col("quality_score") >= quality.Settings().threshold).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(docs, window=50, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(F.col("id").alias("doc_id"), "text", "lang", "source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: No SQL: the classifier is trained and the tokenizer is a program; tests/llm holds each stage against brute force.
ORACLE_SQL = None

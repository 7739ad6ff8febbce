"""Margin notes: anchors that follow their quote when chunks move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.speech import ratio


def normal(x):
    """White space made one and trimmed; case stays."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def reanchor(notes: DataFrame, chunks: DataFrame, least: float = 0.6) -> DataFrame:
    """(note, doc_id, i, new_i, score): a note stays where its chunk still begins with the
    quote's first 60 characters, and a note without a quote stays; else it moves to the first chunk of best similarity, if
    that is ``least`` or more.  The cheap prefix test runs before any comparison."""
    bare = chunks.select("doc_id", F.col("i").alias("at"), normal("chunk").alias("chunk"))
    own = notes.join(bare.withColumnRenamed("at", "i"), ["doc_id", "i"], "left").withColumn("stays", F.coalesce(F.expr("startswith(chunk, left(trim(regexp_replace(quote, '\\\\s+', ' ')), 60))"), F.lit(False)) | (normal(F.coalesce("quote", F.lit(""))) == ""))
    kept = own.where("stays").select("note", "doc_id", "i", F.col("i").alias("new_i"), F.lit(1.0).alias("score"))
    moved = own.where(~F.col("stays")).select("note", "doc_id", "i", normal("quote").alias("quote")).join(bare, "doc_id")
    scored = moved.withColumn("r", ratio(F.col("quote"), F.expr("left(chunk, length(quote) + 20)")))
    best = scored.groupBy("note", "doc_id", "i").agg(F.max(F.struct("r", (-F.col("at")).alias("at"))).alias("b"))
    gone = best.select("note", "doc_id", "i", F.when(F.col("b.r") >= least, -F.col("b.at")).otherwise(F.col("i")).cast("int").alias("new_i"), F.col("b.r").alias("score"))
    return kept.unionByName(gone)

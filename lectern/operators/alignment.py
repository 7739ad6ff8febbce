"""Monotone alignment of narration tokens and page words, one document a group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.chunks import needle_tokens
from lectern.functions.speech import aligned, skeleton


def token_alignment(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, k, start, end, ord, page, line): each narration token and the page word it
    matches, null where none does.  ``words``: (doc_id, ord, word, page, line); ``texts``:
    (doc_id, text).  A group is one document on both sides; its words come as one array."""
    page = words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "word", "page", "line"))).alias("words"))
    both = texts.join(page, "doc_id", "left")

    def run(frames):
        for frame in frames:
            rows = []
            for doc, text, found in zip(frame.doc_id, frame.text, frame.words):
                hay = [(w["ord"], skeleton(w["word"]), w["page"], w["line"]) for w in (found if found is not None else [])]
                hay = [w for w in hay if w[1]]
                tokens = list(needle_tokens(text))
                to = aligned([w[1] for w in hay], [t[0] for t in tokens])
                for k, ((_, a, b), j) in enumerate(zip(tokens, to)):
                    rows.append((doc, k, a, b, *((None,) * 3 if j is None else (hay[j][0], hay[j][2], hay[j][3]))))
            out = pd.DataFrame(rows, columns=["doc_id", "k", "start", "end", "ord", "page", "line"])
            yield out.astype({"ord": "Int64", "page": "Int64", "line": "Int64"})

    return both.select("doc_id", "text", "words").mapInPandas(run, "doc_id long, k int, start int, end int, ord long, page int, line int")


def build_alignment(matches: DataFrame, chunk_spans: DataFrame, words: DataFrame, durations: DataFrame, gap: float = 0.18) -> DataFrame:
    """(doc_id, i, page, rect lines, conf, t_start, t_end, page_only) from token matches,
    chunks (doc_id, i, start, end), page words and audio seconds (doc_id, i, secs)."""
    from pyspark.sql import Window

    inside = chunk_spans.alias("c").join(matches.alias("m"), (F.col("c.doc_id") == F.col("m.doc_id")) & (F.col("m.start") >= F.col("c.start")) & (F.col("m.start") < F.col("c.end")), "left")
    conf = inside.groupBy("c.doc_id", "c.i").agg((F.count("m.ord") / F.greatest(F.count("m.k"), F.lit(1))).alias("conf"))
    sizes = words.groupBy("doc_id", "page", "line").count()
    hits = inside.where("m.ord IS NOT NULL").groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.i").alias("i"), F.col("m.page").alias("page"), F.col("m.line").alias("line")).agg(F.count("*").alias("hits"))
    rects = hits.join(sizes, ["doc_id", "page", "line"]).where(F.col("hits") >= 0.35 * F.col("count"))
    rects = rects.groupBy("doc_id", "i").agg(F.array_sort(F.collect_list(F.struct("page", "line"))).alias("rects"))
    w = Window.partitionBy("doc_id").orderBy("i")
    past, coming = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    out = conf.join(rects, ["doc_id", "i"], "left").join(durations, ["doc_id", "i"], "left")
    first = F.col("rects")[0]["page"]
    start = F.coalesce(F.sum(F.col("secs") + gap).over(past), F.lit(0.0))
    out = out.withColumn("t_start", F.when(F.col("secs").isNotNull(), start)).withColumn("t_end", F.col("t_start") + F.col("secs")).withColumn("p", first)
    near = F.coalesce(F.last("p", True).over(past), F.first("p", True).over(coming))
    return out.withColumn("page_only", F.when(F.col("p").isNull(), near).when(F.col("conf") < 0.6, F.col("p"))).drop("p", "secs")

"""Queries whose core is a Python function: chunking, token alignment, edit operations,
baseline rows, fuzzy anchors, Unicode folding, titles, and the streaming twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import chunks, names, speech, titles
from lectern.operators import alignment, duration, extraction, folders, layout, notes, ranking, schedule, title_layout
from lectern.operators import lint as lint_operators
from lectern.plans import catalog, dialect, lint, text, timeline
from lectern.streaming import jobs


def opened(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks.register(spark)
    opened(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("SELECT d.doc_id, c.i, c.chunk, c.start, c.end FROM documents d, LATERAL chunk_spans(d.text) c")


def chunk_plan(spark, sf_dir):
    rolled = chunk_rows(spark, sf_dir).rollup("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))
    return rolled.select("doc_id", "chunks", "chars")


def chunk_quote(spark, sf_dir):
    notes_ = opened(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("i"))
    return notes_.join(chunk_rows(spark, sf_dir), ["doc_id", "i"], "left").select("doc_id", "i", F.substring("chunk", 1, 120).alias("quote"))


def chunk_rate_flag(spark, sf_dir):
    secs = F.lit(2.0) + F.col("doc_id") % 50
    cps = F.length("chunk") / secs
    return chunk_rows(spark, sf_dir).select("doc_id", "i", cps.alias("cps")).where("cps NOT BETWEEN 8 AND 32")


def sentence_span_rows(spark, sf_dir):
    chunks.register(spark)
    opened(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("SELECT d.doc_id, s.i, s.start, s.end FROM documents d, LATERAL sentence_spans(d.text, 0, length(d.text)) s")


def needle_token_rows(spark, sf_dir):
    chunks.register(spark)
    opened(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("SELECT d.doc_id, t.k, t.token, t.start, t.end FROM documents d, LATERAL needle_tokens(d.text) t")


def page_words(spark, sf_dir):
    """Words of documents as a page would hold them: every ninth word is missing."""
    words = opened(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("ord", "word")).where("word <> '' AND ord % 9 <> 8")
    return words.select("doc_id", F.col("ord").cast("long").alias("ord"), "word", (F.col("ord") / 300).cast("int").alias("page"), (F.col("ord") / 10).cast("int").alias("line"))


def token_alignment(spark, sf_dir):
    texts = opened(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.token_alignment(page_words(spark, sf_dir), texts)


def alignment_confidence(spark, sf_dir):
    found = token_alignment(spark, sf_dir)
    return found.groupBy("doc_id").agg((F.count("ord") / F.greatest(F.count("*"), F.lit(1))).alias("conf"), F.count("*").alias("tokens"))


def edit_op_summary(spark, sf_dir):
    turns = opened(spark, sf_dir, "conversations")
    said = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    heard = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("heard"))
    return said.join(heard, ["conv_id", "turn"]).select("conv_id", "turn", speech.edit_summary("src", "heard").alias("e")).select("conv_id", "turn", "e.*")


def note_reanchor_fuzzy(spark, sf_dir):
    quotes = opened(spark, sf_dir, "benchmark").select((F.col("item_id") % 40).alias("doc_id"), F.col("item_id").alias("note"), (F.col("item_id") % 7).cast("int").alias("i"), F.col("text").alias("quote"))
    return notes.reanchor(quotes, chunk_rows(spark, sf_dir))


def baseline_rows(spark, sf_dir):
    x0, y0, size = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 40).cast("double"), 10.0 + F.col("l_linenumber") % 2
    lines = opened(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), y0.alias("y0"), x0.alias("x0"), (x0 + 6).alias("x1"), (y0 + size).alias("y1"), size.alias("size"), F.col("l_returnflag").alias("text"))
    return layout.baseline_rows(lines)


def unicode_text(spark, sf_dir):
    texts = opened(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("ﬁne 𝜋𝑥 α+β Å² 42% "), F.col("text"))).otherwise(F.col("text")).alias("text"))
    fold, bare, odd, clean = (speech.batched(f, k) for f, k in ((speech.fold, "string"), (speech.skeleton, "string"), (speech.exotic_count, "int"), (speech.clean_for_speech, "string")))
    return texts.select("doc_id", F.sha1(fold("text")).alias("folded_sha1"), F.sha1(bare("text")).alias("skeleton_sha1"), odd("text").alias("exotic_n"), F.sha1(clean("text")).alias("spoken_sha1"))


def repairable_tokens(spark, sf_dir):
    tokens = opened(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("token"))
    ok = speech.batched(speech.repairable, "boolean")
    return tokens.groupBy("doc_id", "token").count().withColumn("ok", ok("token")).groupBy("doc_id").agg(F.sum(F.when(F.col("ok"), F.col("count")).otherwise(0)).alias("kept"), F.sum("count").alias("tokens"))


def spoken_numbers(spark, sf_dir):
    said = speech.batched(speech.number_words, "string")
    return opened(spark, sf_dir, "orders").select("o_orderkey", said(F.col("o_orderkey").cast("string")).alias("whole"), said(F.format_string("%.2f", "o_totalprice")).alias("price"))


def compared_words(spark, sf_dir):
    words = speech.batched(lambda x: " ".join(speech.compare_words(x, True)), "string")
    return opened(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha1(words("text")).alias("words_sha1"))


def ngram_dup_coverage(spark, sf_dir):
    """Share of a document's words under repeated runs of four words, row by row."""
    cover = speech.batched(speech.dup_coverage, "double")
    return opened(spark, sf_dir, "documents").select("doc_id", cover("text").alias("coverage"))


def lint_rows(spark, sf_dir, only: str = "TRUE"):
    return dialect.run(spark, sf_dir, f"SELECT doc, i, chars, secs FROM {lint.ROWS} r WHERE {only}")


def duration_model(spark, sf_dir):
    m = duration.fit(lint_rows(spark, sf_dir, lint.CLEAN))
    return spark.range(1).select(F.round(F.lit(m.a), 7).alias("a"), F.round(F.lit(m.b), 6).alias("b"), F.lit(m.n).cast("long").alias("n"))


def predicted_seconds(spark, sf_dir):
    m = duration.fit(lint_rows(spark, sf_dir, lint.CLEAN))
    rows = lint_rows(spark, sf_dir)
    return rows.select("doc", "i", F.round(duration.predicted(rows, m), 4).alias("pred_secs"))


def content_disposition(spark, sf_dir):
    header = speech.batched(names.content_disposition, "string")
    return opened(spark, sf_dir, "documents").select("doc_id", header(F.concat(F.translate(F.substring("text", 1, 60), "\n", " "), F.lit(": ü/“x”.pdf"))).alias("header"))


def worker_schedule(spark, sf_dir):
    """Nations are the jobs, their customers the cost: the fold is for some thousand jobs."""
    jobs_ = opened(spark, sf_dir, "nation").join(opened(spark, sf_dir, "customer"), F.expr("n_nationkey = c_nationkey")).groupBy(F.col("n_nationkey").cast("long").alias("doc_id")).agg(F.count("*").alias("cost"))
    return schedule.lpt(jobs_, 4)


def measured_rows(spark, sf_dir):
    """The lint rows as the operators take them, with ligatures, odd characters and transcripts by key."""
    return dialect.run(spark, sf_dir, f"""SELECT doc, i, chars, secs, src_known, CASE WHEN is_empty THEN 'empty' WHEN absent THEN 'no such file' END AS error, math_frac, digit_frac, speakable_frac,
      CASE WHEN pk % 401 = 0 THEN 0.01 ELSE 0.0 END AS lig_frac, max_tok, CASE WHEN pk % 53 = 0 THEN 1 ELSE 0 END AS exotic_n, CAST(rms_db AS DOUBLE) AS rms_db, silence_frac, max_gap, edge AS lead_sil, 0.0 AS trail_sil,
      CAST(clip_frac AS DOUBLE) AS clip_frac, CAST(dc AS DOUBLE) AS dc, CASE WHEN sk % 5 <> 0 THEN ratio END AS ratio, ins_rate, del_rate, dup_cov, hits AS codepoint_hits FROM {lint.ASR} r""")


def lint_tiers(spark, sf_dir):
    """Classes of both tiers by the fitted line."""
    first = lint_operators.tier1(measured_rows(spark, sf_dir), duration.fit(lint_rows(spark, sf_dir, lint.CLEAN)))
    return lint_operators.tier2(first.withColumn("before", F.col("cls"))).select("doc", "i", "before", "cls", F.array_join("flags", ",").alias("flags"))


def lint_summary(spark, sf_dir):
    rows = lint_operators.tier2(lint_operators.tier1(measured_rows(spark, sf_dir), duration.fit(lint_rows(spark, sf_dir, lint.CLEAN))))
    planned = opened(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (1 + F.col("o_orderkey") % 8).alias("planned"))
    return lint_operators.summarised(rows, planned).withColumn("classes", F.to_json("classes"))


def spoken_text(spark, sf_dir):
    """The spoken text of every volume, as a digest, with the figures of its extraction."""
    pages = dialect.run(spark, sf_dir, f"SELECT book AS doc, page, text FROM {text.PAGES} p")
    return extraction.spoken_texts(pages).withColumn("text", F.sha1("text")).withColumnRenamed("text", "text_sha1")


def lint_doc_rank(spark, sf_dir):
    rows = dialect.run(spark, sf_dir, lint.ROLLUP).select("doc", "severity", "bad_secs")
    return ranking.ranked(rows, [F.desc("severity"), F.desc("bad_secs"), F.asc("doc")]).select("place", "doc", "severity")


def library_sort(spark, sf_dir):
    """Places of an item in the three sort modes."""
    items = dialect.run(spark, sf_dir, f"SELECT id, ord, created, lower(title) AS title FROM {catalog.ITEMS} i WHERE NOT deleted")
    for mode, order in (("manual", ["ord", "created", "id"]), ("z_to_a", [F.desc("title"), F.asc("id")]), ("newest", [F.desc("created"), F.asc("id")])):
        items = ranking.ranked(items, order, mode)
    return items.select("id", "manual", "z_to_a", "newest")


def manifest_view(spark, sf_dir):
    items = dialect.run(spark, sf_dir, f"SELECT id, title, ord, created FROM {catalog.ITEMS} i WHERE kind = 'paper' AND NOT deleted")
    return ranking.ranked(items, ["ord", "created", "id"], "at").select("id", "title", F.expr("coalesce(nullif(ord, 0), at)").alias("place"))


def chapters(spark, sf_dir):
    docs = dialect.run(spark, sf_dir, f"SELECT doc, sum(secs) AS secs, count(*) AS n FROM {timeline.CHUNKS} c GROUP BY doc")
    timed = ranking.ranked(docs, ["doc"], "place", {"secs_before": "secs", "chunks_before": "n"})
    return timed.select("doc", "place", F.expr("(secs_before * 100 + 18 * chunks_before) / 100").alias("starts"))


def folder_ancestors(spark, sf_dir):
    return folders.paths(folders.ancestors(dialect.run(spark, sf_dir, f"SELECT id, parent_id, name FROM {catalog.FOLDERS} f")))


def folder_move_guard(spark, sf_dir):
    above = folders.ancestors(dialect.run(spark, sf_dir, f"SELECT id, parent_id, name FROM {catalog.FOLDERS} f"))
    return folders.movable(dialect.run(spark, sf_dir, catalog.MOVES), above)


def title_recase(spark, sf_dir):
    """Upper-cased titles of pages in the spellings of the page's own text."""

    @F.pandas_udf("string")
    def run(title: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([speech.recased((t or "").upper(), layout.spellings(x or "")) for t, x in zip(title, text)])

    pages = opened(spark, sf_dir, "pages")
    return pages.select("page_id", run(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.regexp_replace("html", "<[^>]*>", " ")).alias("title"))


def title_verdict(spark, sf_dir):
    """Metadata title or heading of every page, by the rules of ``functions.titles``."""
    pages = opened(spark, sf_dir, "pages")
    parts = [F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.regexp_replace("html", "<[^>]*>", " ")]
    return pages.select("page_id", titles.title_of(*parts).alias("t")).select("page_id", "t.title", "t.source")


def title_detection(spark, sf_dir):
    """Title of every page from spans: its <h1> as two lines at 17 points under a banner, beside a
    rotated stamp and above a by-line; on some pages a label, a clipped line or an OCR slip."""
    pages = opened(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("meta"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    half, turn = F.expr("greatest(1, length(h) div 2)"), F.col("page_id") % 5
    line = lambda text, size, y, dir_y=0.0, x1=400.0: F.struct(text.alias("text"), F.lit(size).alias("size"), F.lit(y).alias("y0"), F.lit(dir_y).alias("dir_y"), F.lit(x1).alias("x1") if isinstance(x1, float) else x1.alias("x1"))
    lines = F.array(
        line(F.lit("Journal of Pages"), 9.0, 40.0), line(F.when(turn == 1, F.lit("Article")), 24.0, 60.0), line(F.substring("h", F.lit(1), half), 17.0, 100.0, x1=F.when(turn == 2, 700.0).otherwise(400.0)),
        line(F.expr("substr(h, greatest(1, length(h) div 2) + 1)"), 17.2, 121.0), line(F.lit("by Some One"), 17.0, 142.0), line(F.lit("stamp:1234 sideways"), 30.0, 300.0, 1.0),
    )
    spans = pages.select(F.col("page_id").alias("doc"), F.posexplode(lines).alias("line", "s")).where("s.text IS NOT NULL").select("doc", "line", F.lit(0).alias("span"), "s.text", "s.size", "s.dir_y", F.lit(72.0).alias("x0"), "s.y0", "s.x1", (F.col("s.y0") + F.col("s.size")).alias("y1"))
    docs = pages.select(F.col("page_id").alias("doc"), F.when(turn == 3, F.lit("final1.dvi")).otherwise(F.col("meta")).alias("meta"), F.col("text").alias("first"), F.col("text").alias("both"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return title_layout.detected_titles(spans, docs).withColumnRenamed("doc", "page_id")


def title_rejoin(spark, sf_dir):
    @F.pandas_udf("string")
    def run(title: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(title, text):
            half = max(1, len(t or "") // 2)
            out.append(speech.rejoin([(t or "")[:half] + "-", (t or "")[half:]], set(speech.title_words(x))))
        return pd.Series(out)

    pages = opened(spark, sf_dir, "pages")
    return pages.select("page_id", run(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.regexp_replace("html", "<[^>]*>", " ")).alias("title"))


def stream_latest_state(spark, sf_dir):
    return jobs.latest_state_stream(spark, f"{sf_dir}/events.parquet", opened(spark, sf_dir, "events").schema)


def stream_progress(spark, sf_dir):
    return jobs.progress_stream(spark, f"{sf_dir}/events.parquet", opened(spark, sf_dir, "events").schema)


QUERIES = {
    f.__name__: f
    for f in (
        chunk_rows, chunk_plan, chunk_quote, chunk_rate_flag, sentence_span_rows, needle_token_rows, token_alignment, alignment_confidence, edit_op_summary, note_reanchor_fuzzy, baseline_rows,
        unicode_text, repairable_tokens, spoken_numbers, compared_words, title_recase, title_verdict, title_detection, title_rejoin, ngram_dup_coverage, duration_model, predicted_seconds, content_disposition, worker_schedule, lint_tiers, lint_summary, spoken_text, lint_doc_rank, library_sort, manifest_view, chapters, folder_ancestors, folder_move_guard, stream_latest_state, stream_progress,
    )
}

#: The streaming twins must give what the batch gives.
ORACLE = {
    "stream_latest_state": "SELECT user_id AS doc, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1",
    "stream_progress": "SELECT user_id AS doc, count(*) AS seen, CAST(least(99, (100 * count(CASE WHEN event_type = 'view' THEN 1 END)) // count(*)) AS BIGINT) AS pct FROM events GROUP BY user_id",
    "ngram_dup_coverage": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
      g AS (SELECT doc_id, len(w) AS n, unnest(range(0, greatest(len(w) - 3, 0))) AS pos, w FROM w WHERE len(w) >= 8),
      t AS (SELECT doc_id, n, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(w[pos + 1:pos + 4], ' ')) AS times FROM g),
      c AS (SELECT doc_id, n, count(DISTINCT pos + k) AS covered FROM t, range(4) r(k) WHERE times > 1 GROUP BY doc_id, n)
      SELECT w.doc_id, coalesce(round(c.covered / c.n, 3), 0) AS coverage FROM w LEFT JOIN c ON c.doc_id = w.doc_id""",
    **{name: dialect.duck_sql(plan) for name, plan in (lint.MODEL_SQL | lint.ORDER_SQL | catalog.ORDER_SQL | catalog.TREE_SQL | timeline.ORDER_SQL).items()},
}

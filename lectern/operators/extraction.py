"""From the pages of documents to the text that is spoken, with the figures of what went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans import dialect, text

#: Lines at either end of a page that may be running heads, and the lengths they have.
EDGE, SHORTEST, LONGEST = 2, 4, 119
#: A closing heading counts from this page on (the first is 0), after this many characters.
CUT_PAGE, CUT_CHARS = 2, 4000
#: A paragraph of fewer characters that does not end a sentence is a stray fragment.
FRAGMENT = 25

COUNTS = "pages running_heads raw_chars caption_lines math_lines citations paragraphs table_paragraphs fragments final_chars words sentences max_sent_words".split()


def _sql(plan: str) -> Column:
    return F.expr(dialect.spark_sql(plan))


def running_heads(pages: DataFrame) -> DataFrame:
    """(doc, heads) of pages (doc, at, text): the lines that stand among the first or last two
    lines of at least half of a document's pages, of which it has three or more.  A page
    names four lines at most, so a document has at most eight."""
    lines = _sql(f"FILTER(MAP(SPLIT(text, '\\n'), FN x: {text.strip('x')}), FN x: x <> '')")
    ends = F.array_distinct(F.concat(F.slice("lines", 1, EDGE), F.slice("lines", F.greatest(F.size("lines") - EDGE + 1, F.lit(1)), F.lit(EDGE))))
    edges = pages.withColumn("lines", lines).select("doc", "n", F.explode(F.filter(ends, lambda x: F.length(x).between(SHORTEST, LONGEST))).alias("line"))
    often = edges.groupBy("doc", "line").agg(F.count("*").alias("seen"), F.first("n").alias("n")).where("n > 2 AND 2 * seen >= n")
    return often.groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("heads"))


def spoken_texts(pages: DataFrame) -> DataFrame:
    """One row per document of ``pages`` (doc, page, text): doc, text, the counts of ``COUNTS``,
    cut_page (from 0, of the first closing heading; else null), keep_percent, est_minutes
    and avg_sent_words.

    Pages stand in the order of their number, then their text, so repeated numbers have one
    order; a null text is an empty page; a null doc is a document of its own; other columns
    are left out.  A document of which nothing remains has an empty text.

    Running heads and page numbers go, words cut at a line's end are joined, the rest from
    a closing heading on goes, then captions, mathematical lines, bullets, citations, links
    and addresses; paragraphs are reflowed and rewritten for speech, and fragments and what
    looks like a table go.  Pages are shuffled once, by document; all later steps keep that
    partitioning, and a document is what one task must hold.
    """
    # As a struct a null doc equals itself, so that all steps can group and join by one key.
    own = pages.select(F.struct("doc").alias("doc"), "page", F.coalesce("text", F.lit("")).alias("text"))
    book = Window.partitionBy("doc")
    numbered = own.select("doc", "text", (F.row_number().over(book.orderBy("page", "text")) - 1).alias("at"), F.count("*").over(book).alias("n"))

    heads = running_heads(numbered)
    joined = text.rewrite("text", [(r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2")])
    headed = numbered.join(heads, "doc", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<string>")))
    lines = headed.select("doc", "at", "n", "heads", F.length("text").alias("chars"), F.posexplode(_sql(f"SPLIT({joined}, '\\n')")).alias("ln", "raw")).withColumn("line", _sql(text.strip("raw")))
    furniture = _sql(f"line <> '' AND (array_contains(heads, line) OR MATCH(line, {text.PAGE_NUMBER}))")
    order = book.orderBy("at", "ln")
    before = F.coalesce(F.sum(F.when(~F.col("furniture"), F.length("line"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    closing = F.col("at").__ge__(CUT_PAGE) & (F.col("before") > CUT_CHARS) & ~F.col("furniture") & _sql(f"MATCH(line, {text.STOP})")
    marked = lines.withColumn("furniture", furniture).withColumn("before", before).withColumn("closing", closing)
    kind = f"CASE WHEN furniture OR gone THEN 'gone' WHEN line = '' THEN 'text' WHEN MATCH(line, {text.CAPTION}) THEN 'caption' WHEN {text.MATHY} THEN 'math' ELSE 'text' END"
    sorted_out = marked.withColumn("gone", F.max("closing").over(order)).withColumn("kind", _sql(kind)).withColumn("kept", _sql(f"CASE WHEN kind = 'text' THEN RX(line, {text.BULLET}, '') END"))

    whole = sorted_out.groupBy("doc").agg(
        F.first("n").alias("pages"),
        F.size(F.first("heads")).cast("long").alias("running_heads"),
        (F.sum(F.when(F.col("ln") == 0, F.col("chars"))) + F.first("n") - 1).alias("raw_chars"),  # pages are joined by one line break
        F.min(F.when(F.col("closing"), F.col("at"))).alias("cut_page"),
        F.count_if(F.col("kind") == "caption").alias("caption_lines"),
        F.count_if(F.col("kind") == "math").alias("math_lines"),
        F.coalesce(F.expr("listagg(kept, '\\n') WITHIN GROUP (ORDER BY at * 4294967296L + ln)"), F.lit("")).alias("body"),
    )
    cited = whole.withColumn("citations", _sql(f"CAST(regexp_count(body, {text.PAREN}) + regexp_count(body, {text.BRACKET}) AS BIGINT)"))
    bare = cited.withColumn("body", _sql(text.rewrite("body", [(p[2:-1], "") for p in (text.PAREN, text.BRACKET, text.NARRATIVE, text.LINK, text.MAIL)])))
    kept_columns = [c for c in bare.columns if c != "body"]
    paragraphs = bare.select(*kept_columns, F.posexplode(_sql("SPLIT(body, R'\\n\\s*\\n')")).alias("k", "p")).withColumn("p", _sql(text.strip("RX(p, R'\\s*\\n\\s*', ' ')")))
    said = paragraphs.withColumn("blank", F.col("p") == "").withColumn("p", _sql(text.rewrite("p", text.SPEECH + text.TIDY))).withColumn("toks", _sql(text.tokens("p")))
    fate = f"CASE WHEN blank THEN 'blank' WHEN length(p) < {FRAGMENT} AND NOT MATCH(p, R'[.?!]$') THEN 'fragment' WHEN {text.TABLE_LIKE} THEN 'table' ELSE 'text' END"
    judged = said.withColumn("fate", _sql(fate))

    spoken = judged.groupBy("doc").agg(
        *(F.first(c).alias(c) for c in kept_columns if c != "doc"),
        *(F.count_if(F.col("fate") == f).alias(n) for f, n in (("text", "paragraphs"), ("table", "table_paragraphs"), ("fragment", "fragments"))),
        F.coalesce(F.expr("listagg(CASE WHEN fate = 'text' THEN p END, '\\n\\n') WITHIN GROUP (ORDER BY k)"), F.lit("")).alias("text"),
    )
    per_sentence = _sql(f"MAP(FILTER(SPLIT(text, R'(?<=[.!?])\\s+'), FN s: s <> ''), FN s: SIZE({text.tokens('s')}))")
    measured = spoken.withColumn("each", per_sentence).withColumn("words", _sql(f"CAST(SIZE({text.tokens('text')}) AS BIGINT)"))
    final = measured.withColumns(
        {
            "final_chars": F.length("text").cast("long"),
            "sentences": F.size("each").cast("long"),
            "max_sent_words": F.coalesce(F.array_max("each"), F.lit(0)).cast("long"),
            "avg_sent_words": F.expr("aggregate(each, 0, (a, x) -> a + x) / greatest(1, size(each))"),
            "keep_percent": F.expr("100.0D * length(text) / greatest(1, raw_chars)"),
            "est_minutes": F.expr("words / 150.0D"),
        }
    )
    return final.select("doc.doc", "text", *COUNTS, "cut_page", "keep_percent", "est_minutes", "avg_sent_words")

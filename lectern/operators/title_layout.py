"""Titles from the typesetting of first pages and from metadata: spans to lines, rows, groups, a title."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import titles
from lectern.functions.speech import capitalised, capitals, rejoin, respelled, tidy_title, title_words
from lectern.operators.layout import ALIKE, baseline_rows, spellings

#: A span below this share of its line's size is a mark on it; sizes below the
#: least are no points; the upper part of a page; the gap in title heights that parts two groups;
#: the most lines of a title; the fewest letters of a row.
MARK, LEAST_SIZE, TOP, GAP, MOST_LINES, LEAST_LETTERS = 0.7, 3, 0.7, 0.9, 4, 3
#: Labels of sections, which are no titles.
LABELS = ["abstract", "article", "open", "preprint", "research article", "letter", "review", "contents", "original article", "original research", "technical report"]

N_LETTERS = r"length(regexp_replace(text, r'[^\p{L}]', ''))"
IS_LABEL = f"regexp_replace(lower(trim(text)), r'\\s+', ' ') IN ({', '.join(repr(x) for x in LABELS)})"


def span_lines(spans: DataFrame) -> DataFrame:
    """(doc, y0, x0, x1, y1, size, text) of spans (doc, line, span, text, size, dir_y, x0, y0, x1, y1),
    the box being the line's: upright lines with ink.  A line is as large as its largest
    inked span; much smaller spans are left out of its text.  Where no size on a page reaches
    three points, heights stand for sizes.  Null texts are blank; a null direction is upright."""
    upright = spans.where("abs(coalesce(dir_y, 0)) <= 0.1").withColumn("text", F.coalesce("text", F.lit("")))
    inked = F.when(F.trim(F.regexp_replace("text", r"\s+", " ")) != "", F.col("size"))
    parts = F.array_sort(F.collect_list(F.struct("span", "text", "size")))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    lines = upright.groupBy("doc", "line").agg(F.max(inked).alias("big"), parts.alias("parts"), *box).where("big IS NOT NULL")
    text = F.expr(f"array_join(transform(filter(parts, s -> s.size >= {MARK} * big OR trim(s.text) = ''), s -> s.text), '')")
    largest = F.max("big").over(Window.partitionBy("doc"))
    size = F.when(largest < LEAST_SIZE, F.col("y1") - F.col("y0")).otherwise(F.col("big"))
    return lines.select("doc", "y0", "x0", "x1", "y1", size.alias("size"), text.alias("text"))


def title_groups(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, printed, parts) of baseline rows: all text at title size, and the lines of the group
    with the most letters, the topmost of equals; parts is null where no group is a title
    or the best one runs off the page.  Documents without a row at title size have no row here."""
    sized = rows.join(docs.select("doc", "width", "height").dropDuplicates(["doc"]), "doc")
    fit = sized.where(f"y0 < {TOP} * height AND size >= {LEAST_SIZE} AND {N_LETTERS} >= {LEAST_LETTERS} AND NOT {IS_LABEL} AND instr(text, '@') = 0")
    tall = fit.withColumn("big", F.max("size").over(Window.partitionBy("doc"))).where(f"size >= {ALIKE} * big")
    down = Window.partitionBy("doc").orderBy("y0", "row")
    first = F.expr(f"prev IS NULL OR y0 - prev > {GAP} * big OR regexp_like(trim(text), r'(?i)^by\\b')")
    grouped = tall.withColumn("prev", F.lag("y1").over(down)).withColumn("grp", F.sum(first.cast("int")).over(down))
    line = F.struct("y0", "row", "text")
    groups = grouped.groupBy("doc", "grp").agg(
        F.count("*").alias("n"), F.sum(F.expr(N_LETTERS)).alias("ink"), F.max(F.col("x1") > F.col("width") + 1).alias("clipped"), F.array_sort(F.collect_list(line)).alias("lines")
    )
    candidate = F.when(F.col("n") <= MOST_LINES, F.struct("ink", (-F.col("grp")).alias("up"), "clipped", "lines"))
    best = groups.groupBy("doc").agg(F.max(candidate).alias("best"), F.flatten(F.array_sort(F.collect_list("lines"))).alias("all"))
    parts = F.when(~F.col("best.clipped"), F.transform("best.lines", lambda x: x["text"]))
    return best.select("doc", F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("printed"), parts.alias("parts"))


def title_from(parts: list[str], forms: dict[str, dict[str, int]], vocabulary: set[str]) -> str:
    """The lines of a title as one, in the document's spellings."""
    own: dict[str, int] = {}
    for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", " ".join(parts))):
        own[w] = own.get(w, 0) + 1
    title = tidy_title(rejoin([respelled(p, forms, own) for p in parts], vocabulary))
    return capitalised(title) if any(map(capitals, parts)) else title


def detected_titles(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, title, source) for every row of ``docs`` (doc, meta, first, both, width, height: metadata
    title, text of the first page and of the first two, size of the first page) from ``spans``
    (see ``span_lines``) of first pages.  Source is metadata, layout or none, then with a null
    title.  A doc without spans, or null, has its metadata alone."""

    @F.pandas_udf(titles.FOUND)
    def decide(meta: pd.Series, parts: pd.Series, printed: pd.Series, first: pd.Series, both: pd.Series) -> pd.DataFrame:
        out = []
        for m, lines, p, f, b in zip(meta, parts, printed, first, both):
            forms = spellings(b or "")
            layout = title_from(list(lines), forms, set(title_words(b))) if lines is not None else ""
            out.append(titles.detected(m, layout, p, f, forms) or (None, "none"))
        return pd.DataFrame(out, columns=["title", "source"])

    found = title_groups(baseline_rows(span_lines(spans), "doc"), docs)
    both = docs.select("doc", "meta", "first", "both").join(found, "doc", "left")
    return both.select("doc", decide("meta", "parts", "printed", "first", "both").alias("t")).select("doc", "t.title", "t.source")

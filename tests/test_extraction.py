"""The extraction chain on hand-made pages; the expected texts are written out."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import extraction

LONG = "This sentence is long enough to stay as it stands here. "


def texts(df):
    return {r.doc: r for r in extraction.spoken_texts(df).collect()}


@pytest.fixture(scope="module")
def found(spark):
    head = "Journal of Hand-Made Pages"
    pages = [
        ("a", 0, f"{head}\nThe first para-\ngraph shows results [3, 14] of Simon (1969) and others (see Newell and Simon, 1972).\n\n• A bullet of more words, e.g. this one, stays.\n1"),
        ("a", 1, f"{head}\nFigure 3: the plot of all things\n∑ x ≤ ∞\nRead https://example.org/x and write me@example.org now, please do.\n\nstray words\n2"),
        ("a", 2, f"{head}\nReferences\n" + LONG * 80 + "\n- 3 -"),
        ("a", 3, f"Last words “quoted” on page four, 25% of Figs. 3 & 4.\nReferences\nSome Work 1999 that must not be read aloud.\n{head}"),
        ("a", 4, "An appendix that must not be read aloud either, after the cut."),
        ("b", 0, None), ("b", 1, ""),
        ("c", 7, "Second by text, of two pages with one number."), ("c", 7, "First by text, of two pages with one number."),
        ("d", 0, "1 22 333 4444 55 66 7 88 9.\n\nalpha 1234 beta 5678 gamma 9012 delta 3456 rows.\n\ntoo short\n\nWords of a paragraph that is not a table at all."),
        (None, 0, "No name, but a text of its own all the same."),
        ("e", 0, "[12]\nBelow a line that only cites, a paragraph begins here.\r\nIt goes on.\r\n   \r\nAnother one begins after a blank line here."),
    ]
    df = spark.createDataFrame(pages, "doc string, page int, text string").withColumn("n", F.lit("own")).withColumn("heads", F.lit(1))
    return texts(df)


def test_chain(found):
    a = found["a"]
    # References on page 2 stand before 4,000 characters were kept, so the text goes on to page 3.
    assert a.text.split("\n\n") == [
        "The first paragraph shows results of Simon and others.",
        # The bullet's paragraph runs on over the page's end; the caption and the formula are gone.
        "A bullet of more words, for example, this one, stays. Read and write now, please do.",
        # The stray words are no paragraph of their own: no blank line parts them from the next page.
        "stray words References " + LONG * 80 + 'Last words "quoted" on page four, 25 percent of Figure 3 and 4.',
    ]
    assert (a.pages, a.running_heads, a.cut_page, a.caption_lines, a.math_lines, a.citations) == (5, 1, 3, 1, 1, 2)
    assert "must not" not in a.text and "Journal" not in a.text


def test_figures(found):
    a = found["a"]
    assert a.final_chars == len(a.text) and a.words == len(a.text.split()) and a.paragraphs == len(a.text.split("\n\n"))
    assert a.est_minutes == pytest.approx(a.words / 150) and a.keep_percent == pytest.approx(100 * len(a.text) / a.raw_chars)
    assert a.avg_sent_words == pytest.approx(a.words / a.sentences)


def test_awkward_pages(found, spark):
    assert set(found) == {"a", "b", "c", "d", "e", None}
    assert (found["b"].text, found["b"].pages, found["b"].raw_chars, found["b"].words, found["b"].sentences, found["b"].avg_sent_words) == ("", 2, 1, 0, 0, 0)
    assert found["c"].text == "First by text, of two pages with one number. Second by text, of two pages with one number."
    assert found["d"].text == "Words of a paragraph that is not a table at all." and (found["d"].math_lines, found["d"].table_paragraphs, found["d"].fragments) == (1, 1, 1)
    assert found[None].text == "No name, but a text of its own all the same."
    assert found["e"].text == "Below a line that only cites, a paragraph begins here. It goes on.\n\nAnother one begins after a blank line here."
    assert texts(spark.createDataFrame([], "doc long, page int, text string")) == {}


def test_heads_of_pages_with_few_lines(spark):
    rows = [(1, k, "Head of the book\nbody " + "xyz" * k) for k in range(4)] + [(2, 0, "Head of the book"), (2, 1, "Head of the book")]
    got = {r.doc: r for r in extraction.spoken_texts(spark.createDataFrame(rows, "doc long, page int, text string")).collect()}
    assert got[1].running_heads == 1 and got[2].running_heads == 0  # two pages are too few


def test_one_shuffle_of_the_pages(spark):
    """One exchange deals the pages, one sends their few edges; neither gathers all in one task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(10).selectExpr("id % 3 AS doc", "id AS page", "'x y' AS text")
        plan = extraction.spoken_texts(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2 and "SinglePartition" not in plan and "Python" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

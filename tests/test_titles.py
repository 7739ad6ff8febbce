"""Titles from hand-made spans: what each rule must do, with the titles written out."""

from lectern.operators import title_layout

SPANS = "doc string, line int, span int, text string, size double, dir_y double, x0 double, y0 double, x1 double, y1 double"
DOCS = "doc string, meta string, first string, both string, width double, height double"


def titles(spark, pages):
    """``pages``: doc -> (meta, text of the first two pages, lines (text, size, y, and what differs))."""
    spans, docs = [], []
    for doc, (meta, both, lines) in pages.items():
        for k, (text, size, y, *more) in enumerate(lines):
            own = {"dir_y": 0.0, "x0": 72.0, "x1": 400.0, "line": k, "span": 0, "y1": y + size} | (more[0] if more else {})
            spans.append((doc, own["line"], own["span"], text, size, own["dir_y"], own["x0"], y, own["x1"], own["y1"]))
        docs.append((doc, meta, " ".join(x[0] or "" for x in lines), both, 612.0, 792.0))
    found = title_layout.detected_titles(spark.createDataFrame(spans, SPANS), spark.createDataFrame(docs, DOCS)).collect()
    assert len(found) == len(docs)
    return {r.doc: (r.title, r.source) for r in found}


BODY = [("Abstract", 12.0, 260.0), ("We measure rivers at some length.", 10.0, 280.0)]


def test_rules_of_the_page(spark):
    got = titles(spark, {
        "wrapped": (None, "", [("sideways:9912 stamp", 30.0, 300.0, {"dir_y": -1.0}), ("Measuring Slow Rivers in", 17.0, 100.0), ("Northern Valleys", 17.3, 121.0), ("Ann Other", 12.0, 150.0), *BODY]),
        "label": (None, "", [("Research  Article", 24.0, 40.0), ("Slow Rivers Revisited", 16.0, 100.0), *BODY]),
        "by": (None, "", [("Slow Rivers Revisited", 16.0, 100.0), ("by Ann Other", 16.0, 118.0), *BODY]),
        "gap": (None, "", [("Rivers Weekly", 16.0, 30.0), ("Slow Rivers and Their Many Bends", 16.0, 100.0), *BODY]),
        "tie": (None, "", [("Upper Title", 16.0, 30.0), ("Lower Title", 16.0, 100.0), *BODY]),
        "clipped": (None, "", [("Slow rivers and their many bends in nor", 20.0, 100.0, {"x1": 640.0}), *BODY]),
        "low": (None, "", [("Printed Far Below", 20.0, 600.0), *BODY[:1]]),
        "mail": (None, "", [("river@valley.org And More", 20.0, 90.0), ("Slow Rivers Revisited", 16.0, 110.0), *BODY]),
        "marks": (None, "", [("Slow Rivers", 16.0, 100.0, {"line": 0}), ("1,2", 9.0, 100.0, {"line": 0, "span": 1}), (" Revisited", 16.0, 100.0, {"line": 0, "span": 2})]),
        "split": (None, "", [("Slow Ri", 16.0, 100.0, {"x1": 130.0}), ("vers", 16.0, 100.0, {"x0": 131.0, "x1": 160.0}), ("Revisited", 16.0, 100.5, {"x0": 170.0, "y1": 116.5})]),
        "tiny": (None, "", [("Slow Rivers Revisited", 0.1, 100.0, {"y1": 118.0}), ("of no matter to us", 0.1, 200.0, {"y1": 209.0})]),
        "five": (None, "", [(f"Line {'abcde'[k]} of a body", 12.0, 100.0 + 13 * k) for k in range(5)]),
    })
    again = ("Slow Rivers Revisited", "layout")
    assert got == {
        "wrapped": ("Measuring Slow Rivers in Northern Valleys", "layout"), "label": again, "by": again, "gap": ("Slow Rivers and Their Many Bends", "layout"), "tie": ("Upper Title", "layout"),
        "clipped": (None, "none"), "low": (None, "none"), "mail": again, "marks": again, "split": again, "tiny": again, "five": (None, "none"),
    }


def test_metadata_and_spellings(spark):
    got = titles(spark, {
        "agrees": ("Slow Rivers Revisited Often", "", [("Slow Rlvers Revisited Often Now", 16.0, 100.0), *BODY]),
        "junk": ("draft7.docx", "", [("Slow Rivers Revisited", 16.0, 100.0), *BODY]),
        "banner": ("Rivers Weekly", "", [("Rivers Weekly", 9.0, 40.0), ("Slow Bends Revisited", 16.0, 100.0), *BODY]),
        "part": ("Slow Rivers", "", [("Slow Rivers Revisited", 16.0, 100.0), *BODY]),
        "site": ("Slow Rivers Revisited | Valley News", "", [("Slow Rivers Revisited", 16.0, 100.0), *BODY]),
        "capitals": (None, "We built RiVer, a tool. RiVer measures water. Such water measurement is new.", [("RIVER: A TOOL FOR WATER MEASURE-", 17.0, 100.0), ("MENT", 17.0, 121.0), *BODY]),
        "hyphen": (None, "", [("River Maps: Self-", 17.0, 100.0), ("Drawn Charts of Water", 17.0, 121.0), *BODY]),
        "no page": ("A Title Without Its Page", "", []),
    })
    assert got == {
        "agrees": ("Slow Rlvers Revisited Often Now", "layout"), "junk": ("Slow Rivers Revisited", "layout"), "banner": ("Slow Bends Revisited", "layout"), "part": ("Slow Rivers Revisited", "layout"),
        "site": ("Slow Rivers Revisited", "metadata"), "capitals": ("RiVer: A Tool for Water Measurement", "layout"), "hyphen": ("River Maps: Self-Drawn Charts of Water", "layout"), "no page": (None, "none"),
    }


def test_awkward_spans(spark):
    spans = [("a", 0, 0, None, 16.0, None, 72.0, 100.0, 90.0, 116.0), ("a", 1, 0, "Slow Rivers Revisited", 16.0, None, 72.0, 100.0, 300.0, 116.0), ("a", 1, 0, "Slow Rivers Revisited", 16.0, None, 72.0, 100.0, None, None), (None, 0, 0, "Lost Title Here", 16.0, 0.0, 1.0, 1.0, 2.0, 3.0), ("b", 0, 0, "No size at all", None, 0.0, 1.0, 1.0, 2.0, 3.0)]
    docs = [("a", None, "x", None, 612.0, 792.0), ("b", "Meta Words Here", "meta words here", "", 612.0, 792.0), (None, None, None, None, None, None), ("a", None, "x", None, 612.0, 792.0)]
    of = lambda s, d: sorted((str(r.doc), r.title, r.source) for r in title_layout.detected_titles(s, d).collect())
    s, d = spark.createDataFrame(spans, SPANS), spark.createDataFrame(docs, DOCS)
    twice = "Slow Rivers RevisitedSlow Rivers Revisited"  # a repeated span is text of its line
    assert of(s, d) == [("None", None, "none"), ("a", twice, "layout"), ("a", twice, "layout"), ("b", "Meta Words Here", "metadata")]
    assert of(s.limit(0), d.where("doc = 'b'")) == [("b", "Meta Words Here", "metadata")]
    assert of(s, d.limit(0)) == []

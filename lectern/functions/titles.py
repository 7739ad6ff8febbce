"""A document's title from its metadata and from what is printed at title size."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lectern.functions.speech import capitalised, capitals, respelled, tidy_title, title_words

#: Endings and beginnings of metadata that hold no title, and what a site adds behind one.
FILE_ENDINGS = ["dvi", "pdf", "doc", "docx", "tex", "indd", "ps", "eps", "rtf", "qxd", "odt", "ppt", "pptx"]
NOISE = [r"microsoft\s+\w+\s+-", "untitled", "pii:", "doi:", "arxiv:"]
CUT_OFF = ("...", "…")
SITE_MARKS = "»|"
#: The most characters and fewest words of a title, its least share of letters, and
#: the share of a metadata title's words that must be printed at title size.
MOST_CHARS, LEAST_WORDS, LEAST_LETTERS, AGREE = 250, 2, 0.6, 0.8

_NOISE = re.compile("|".join(NOISE), re.I)


def junk(meta: str) -> bool:
    """File names, producers' noise and titles that a producer cut off."""
    ending = meta.rpartition(".")
    return bool(ending[1] and ending[2].lower() in FILE_ENDINGS or _NOISE.match(meta) or meta.endswith(CUT_OFF))


def acceptable(title: str) -> bool:
    ink = [c for c in title if not c.isspace()]
    return 0 < len(title) <= MOST_CHARS and len(title_words(title)) >= LEAST_WORDS and sum(map(str.isalpha, ink)) >= LEAST_LETTERS * len(ink)


def without_site(meta: str) -> str:
    """What stands before the first site mark between white space, if something stands behind it."""
    return re.sub(rf"\s+[{SITE_MARKS}]\s+.*\Z", "", meta, flags=re.S)


def detected(meta: str | None, layout: str | None, printed: str | None, page: str | None, forms: dict[str, dict[str, int]]) -> tuple[str, str] | None:
    """(title, source).  Metadata wins where it is no junk, enough of its longer words stand
    among those ``printed`` at title size (on the ``page`` if none are), and it is not a part of
    the layout's title; else the layout's title; else nothing."""
    name, layout = without_site(tidy_title(meta)), layout or ""
    words = [w for w in title_words(name) if len(w) > 2] or title_words(name)
    known = set(title_words(printed)) or set(title_words(page))
    if words and not junk(name) and sum(w in known for w in words) >= AGREE * len(words):
        own: dict[str, int] = {}
        for w in re.findall(r"[^\W_]+", name):
            own[w] = own.get(w, 0) + 1
        spelled = respelled(name, forms, own)
        spelled = capitalised(spelled) if capitals(name) else spelled
        if not set(title_words(spelled)) < set(title_words(layout)) and acceptable(spelled):
            return spelled, "metadata"
    return (layout, "layout") if acceptable(layout) else None


FOUND = StructType().add("title", StringType()).add("source", StringType())


@F.pandas_udf(FOUND)
def title_of(meta: pd.Series, layout: pd.Series, page: pd.Series) -> pd.DataFrame:
    """Title and source of pages whose layout title is all that is printed at title size."""
    from lectern.operators.layout import spellings

    found = [detected(m, x, x, p, spellings(p or "")) for m, x, p in zip(meta, layout, page)]
    return pd.DataFrame([f or (None, "none") for f in found], columns=["title", "source"])

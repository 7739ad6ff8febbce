"""File names as they go over the wire."""

from __future__ import annotations

import unicodedata
from urllib.parse import quote

#: The marks that an old client's file name may hold, and its name where nothing is left.
PLAIN_MARKS, NOTHING_LEFT = "_ .-()[],", "download"


def plain_name(name: str) -> str:
    """The name in ASCII: accents go, and every run of other marks is one underscore."""
    out: list[str] = []
    for c in unicodedata.normalize("NFKD", name):
        if not c.isascii():
            continue
        if c.isalnum() or c in PLAIN_MARKS:
            out.append(c)
        elif not out or out[-1] != "\0":
            out.append("\0")  # stands for the run, so that an underscore of the name stays apart
    return "".join(out).replace("\0", "_").strip() or NOTHING_LEFT


def content_disposition(name: str | None) -> str:
    """The header that shows a file and names a download of it: a plain name for old clients,
    then the exact one, percent-encoded.  Null is an empty name."""
    return f"inline; filename=\"{plain_name(name or '')}\"; filename*=UTF-8''{quote(name or '', safe='')}"

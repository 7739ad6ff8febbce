"""Baseline rows and spellings for title detection."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Two lines share a row within this share of the row's size between their lower edges, and
#: with sizes this alike; a gap of more than the third share of the size is a space.
NEAR, ALIKE, SPACE = 0.3, 0.92, 0.15

Line = tuple[float, float, float, float, float, str]  # y0, x0, x1, y1, size, text


def merged(lines: list[Line]) -> list[list[Line]]:
    """Lines in reading order, put into the first row whose first line has a near lower edge
    and a like size; the lines of a row stand from left to right."""
    rows: list[list[Line]] = []
    for line in sorted(lines):
        _, _, _, y1, size, _ = line
        for row in rows:
            like = min(row[0][4], size) >= ALIKE * max(row[0][4], size)
            if like and abs(y1 - row[0][3]) < NEAR * row[0][4]:
                row.append(line)
                break
        else:
            rows.append([line])
    return rows


def row_of(lines: list[Line]) -> tuple[float, float, float, float, int, str]:
    """(y0, y1, right edge, size, segments, text) of a row; its edges are its first line's."""
    y0, _, _, y1, size, _ = lines[0]
    ordered = sorted(lines, key=lambda x: x[1])
    text = ordered[0][5]
    for left, right in zip(ordered, ordered[1:]):
        text += (" " if right[1] - left[2] > SPACE * size else "") + right[5]
    return y0, y1, max(x[2] for x in lines), max(x[4] for x in lines), len(lines), text


def baseline_rows(lines: DataFrame, key: str = "page") -> DataFrame:
    """(key, row, y0, y1, x1, size, segments, text) of lines (key, y0, x0, x1, y1, size, text).
    Lines with a null among these are left out.  Pages stream through sorted partitions, so
    a small page costs no group of its own."""
    columns = [key, "row", "y0", "y1", "x1", "size", "segments", "text"]

    def done(page, held):
        return [(page, k, *row_of(r)) for k, r in enumerate(merged(held))]

    def run(frames):
        page, held = None, []
        for frame in frames:
            rows = []
            for p, *line in zip(*(frame[c] for c in frame.columns)):
                if held and p != page:
                    rows += done(page, held)
                    held = []
                page = p
                held.append(tuple(line))
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(done(page, held) if held else [], columns=columns)

    kind = lines.schema[key].dataType.simpleString()
    numbers = [F.col(c).cast("double").alias(c) for c in ("y0", "x0", "x1", "y1", "size")]
    sorted_ = lines.select(key, *numbers, "text").dropna().repartition(key).sortWithinPartitions(key)
    return sorted_.mapInPandas(run, f"{key} {kind}, row int, y0 double, y1 double, x1 double, size double, segments int, text string")


def spellings(text: str) -> dict[str, dict[str, int]]:
    """How often each folded word is spelled in which way, in composed form."""
    out: dict[str, dict[str, int]] = {}
    for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text)):
        own = out.setdefault(w.casefold(), {})
        own[w] = own.get(w, 0) + 1
    return out

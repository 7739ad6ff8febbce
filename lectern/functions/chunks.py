"""Chunk packing, sentence spans and tokens as table functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from lectern.functions.speech import skeleton

MOST = 400
PARAGRAPH = re.compile(r"(?:(?!\n\n).)+", re.S)
BREAK = re.compile(r"(?<=[.!?])\s+")


def trimmed(text: str, low: int, high: int) -> tuple[int, int]:
    """The part of [low, high) without white space at its ends."""
    part = text[low:high]
    return low + len(part) - len(part.lstrip()), high - len(part) + len(part.rstrip())


def sentence_spans(text: str, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int]]:
    """Half-open spans of the sentences in a range, in code points of the text."""
    high = len(text) if high is None else high
    at = low
    for m in [*BREAK.finditer(text, low, high), None]:
        end = m.start() if m else high
        i, j = trimmed(text, at, end)
        if i < j:
            yield i, j
        at = m.end() if m else high


def chunk_spans(text: str | None, most: int = MOST) -> Iterator[tuple[str, int, int]]:
    """(chunk, start, end): sentences packed across paragraphs while they and the spaces
    between them, one paid in front as well, stay within ``most``.  A longer sentence is
    cut at the last comma past the middle of the limit, else at the limit, and its tail
    goes on packing."""
    text = text or ""
    buffer, start, end = "", 0, 0
    for p in PARAGRAPH.finditer(text):
        for i, j in sentence_spans(text, *trimmed(text, p.start(), p.end())):
            if len(buffer) + j - i + 1 <= most:
                start = start if buffer else i
                buffer, end = f"{buffer} {text[i:j]}".strip(), j
                continue
            if buffer:
                yield buffer, start, end
            while j - i > most:
                comma = text.rfind(",", i, i + most) - i
                cut = i + (comma if comma > most // 2 else most)
                yield (text[slice(*trimmed(text, i, cut))], *trimmed(text, i, cut))
                i, j = trimmed(text, cut, j)
            buffer, start, end = text[i:j], i, j
    if buffer:
        yield buffer, start, end


def needle_tokens(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(skeleton, start, end) of the words that have a skeleton."""
    for m in re.finditer(r"\S+", text or ""):
        bare = skeleton(m[0])
        if bare:
            yield bare, m.start(), m.end()


INT, TEXT = IntegerType(), StringType()


@udtf(returnType=StructType().add("i", INT).add("chunk", TEXT).add("start", INT).add("end", INT))
class Chunks:
    def eval(self, text: str):
        for i, (chunk, start, end) in enumerate(chunk_spans(text)):
            yield i, chunk, start, end


@udtf(returnType=StructType().add("i", INT).add("start", INT).add("end", INT))
class Sentences:
    def eval(self, text: str, low: int, high: int):
        for i, (a, b) in enumerate(sentence_spans(text or "", low, high)):
            yield i, a, b


@udtf(returnType=StructType().add("k", INT).add("token", TEXT).add("start", INT).add("end", INT))
class Tokens:
    def eval(self, text: str):
        for k, (token, a, b) in enumerate(needle_tokens(text)):
            yield k, token, a, b


def register(spark) -> None:
    spark.udtf.register("chunk_spans", Chunks)
    spark.udtf.register("sentence_spans", Sentences)
    spark.udtf.register("needle_tokens", Tokens)

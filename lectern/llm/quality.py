"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, pairs of words and
character n-grams, and a softmax gives the class.  The vectors and the output layer are
trained by numpy stochastic gradient descent on a bounded sample of labelled rows.
Because average and output are linear before the softmax, every hash bucket has one
number for scoring; a whole text is scored with a few array operations.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 18
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Settings:
    """``sample``, ``sample_bytes``: the most labelled rows to learn from, those of smallest
    hash, and the most bytes of one of them that are learned from (scores are of whole texts)."""

    buckets: int = 1 << 18
    dim: int = 12
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 4
    rate: float = 1.0
    sample: int = 5000
    sample_bytes: int = 1 << 14
    threshold: float = 0.7
    seed: int = 7


def bucket_of(hashed: np.ndarray, buckets: int) -> np.ndarray:
    x = hashed * MIX
    x ^= x >> np.uint64(32)
    return (x % np.uint64(buckets)).astype(np.int64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS = powers(int(BASE), PIECE + 1)
_INVERSES = powers(pow(int(BASE), -1, 1 << 64), PIECE + 1)


class Features:
    """Buckets of a text's words, pairs of neighbouring words and n-grams of bytes, white
    space being one boundary.  A pair is hashed by the difference of its words' hashes, so
    that all pairs of equal words share a bucket and repetition, a common mark of junk, can
    be learned from any word (README has the figures with and without).  The text goes in piece by piece; what a cut parts (a word, a
    pair, an n-gram) is carried over, so that pieces give what the whole text gives."""

    def __init__(self, s: Settings) -> None:
        self.s = s
        self.tail = np.zeros(0, dtype=np.uint64)
        self.before: np.uint64 | None = None
        self.open = np.uint64(0)
        self.shift = np.uint64(1)
        self.inside = False
        self.spaced = True

    def words(self, found: np.ndarray) -> list[np.ndarray]:
        if not len(found):
            return []
        line = found if self.before is None else np.concatenate(([self.before], found))
        self.before = found[-1]
        pairs = (line[1:] - line[:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return [bucket_of(found ^ np.uint64(0x5555), self.s.buckets), bucket_of(pairs, self.s.buckets)]

    def piece(self, raw: np.ndarray) -> list[np.ndarray]:
        gap = SPACES[raw]
        keep = ~(gap & np.concatenate(([self.spaced], gap[:-1])))
        self.spaced = bool(gap[-1])
        gap = gap[keep]
        codes = np.where(gap, np.uint64(32), raw[keep].astype(np.uint64)) + np.uint64(1)
        if not len(codes):
            return []
        out = []
        for n in self.s.grams:
            line = np.concatenate((self.tail[max(0, len(self.tail) - n + 1) :], codes))
            m = len(line) - n + 1
            if m > 0:
                h = line[:m].copy()
                for k in range(1, n):
                    h = h * BASE + line[k : k + m]
                out.append(bucket_of(h ^ np.uint64(n), self.s.buckets))
        self.tail = np.concatenate((self.tail, codes))[-(max(self.s.grams, default=1) - 1) :] if max(self.s.grams, default=1) > 1 else self.tail
        # A word's hash is the sum of its codes times the powers of the base.
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(codes * _POWERS[: len(codes)])))
        starts = np.flatnonzero(~gap & np.concatenate(([not self.inside], gap[:-1])))
        ends = np.flatnonzero(gap & np.concatenate(([self.inside], ~gap[:-1])))
        found = []
        if self.inside:
            to = int(ends[0]) if len(ends) else len(codes)
            self.open = self.open + sums[to] * self.shift
            if len(ends):
                found.append(np.array([self.open], dtype=np.uint64))
                ends = ends[1:]
            else:
                self.shift = self.shift * _POWERS[len(codes)]
                return out
        whole = starts[: len(ends)]
        found.append((sums[ends] - sums[whole]) * _INVERSES[whole])
        self.inside = len(starts) > len(ends)
        if self.inside:
            at = int(starts[-1])
            self.open = (sums[-1] - sums[at]) * _INVERSES[at]
            self.shift = _POWERS[len(codes) - at]
        return out + self.words(np.concatenate(found))

    def rest(self) -> list[np.ndarray]:
        return self.words(np.array([self.open], dtype=np.uint64)) if self.inside else []


def pieces(text: str | None, s: Settings) -> Iterator[np.ndarray]:
    """The buckets of a text's features, some at a time."""
    raw, made = np.frombuffer(shared.utf8(text), dtype=np.uint8), Features(s)
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), PIECE):
            yield from made.piece(raw[at : at + PIECE])
        yield from made.rest()


def features(text: str | None, s: Settings) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *pieces(text, s)])


def mean_of(text: str | None, numbers: np.ndarray, s: Settings) -> float:
    """The mean of the numbers of all features of a whole text."""
    total, n = 0.0, 0
    for some in pieces(text, s):
        total += float(numbers[some].sum())
        n += len(some)
    return total / n if n else 0.0


class Counted:
    """Buckets and counts of texts' features, in a file of the driver's own that goes with the
    object: of 5,000 texts they are some 100 MB, which the driver would hold to its end."""

    def __init__(self, texts: Iterable[str | None], s: Settings) -> None:
        self.file, self.rows, at = tempfile.TemporaryFile(), [], 0
        for text in texts:
            f = features(text, s)
            both = np.stack(np.unique(f, return_counts=True)).astype(np.uint32)
            self.file.write(both.tobytes())
            self.rows.append((at, both.nbytes, np.float32(max(1, len(f)))))
            at += both.nbytes

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, np.float32]:
        start, size, n = self.rows[k]
        self.file.seek(start)
        at, times = np.frombuffer(self.file.read(size), dtype=np.uint32).reshape(2, -1)
        return at, times, n


def train(texts: Iterable[str | None], labels: list[int], s: Settings) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias): the logit of class 1 is the mean over features plus
    the bias.  One class alone, or no rows, gives a constant that says so.

    A feature's share of a document shrinks with the document, so every bucket's step is
    divided by the root of the squares of its gradients so far (Adagrad)."""
    draw = np.random.default_rng(s.seed)
    rows = Counted(texts, s)
    vectors = draw.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out = np.zeros((s.dim, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    past = np.full(s.buckets, 1e-8, dtype=np.float32)
    steps, total = 0, max(1, s.epochs * len(rows))
    for _ in range(s.epochs):
        for k in draw.permutation(len(rows)):
            at, n, size = rows[k]
            w = n / size
            rate = np.float32(s.rate * (1 - steps / total))
            steps += 1
            mean = w @ vectors[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            past[at] += w * w * np.float32(back @ back)
            vectors[at] -= np.outer(rate * w / np.sqrt(past[at]), back)
    rows.file.close()
    side = out[:, 1] - out[:, 0]
    return vectors @ side, float(bias[1] - bias[0])


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, s: Settings) -> tuple[list, list]:
    """Texts and labels of at most ``s.sample`` rows whose crc32(id as text) mod 4 is not 2."""
    label = F.min(label_col).cast("int").alias("y")
    learned = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)).groupBy(id_col).agg(label)
    some = learned.orderBy(F.xxhash64(id_col), id_col).limit(s.sample).select(F.col(id_col).alias("id"), "y")
    text = F.substring(F.col(text_col).cast("string"), 1, s.sample_bytes)
    # One row for each id, so that the sample's bound holds for repeated rows too.
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(some), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = sorted(found.collect(), key=lambda r: r.id)
    return [r.text for r in rows], [r.y for r in rows]


def scored_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, whole, with their ``quality_score``; see ``quality_scores``."""
    table, bias = train(*learning_rows(docs, labels, id_col, text_col, label_col, s), s)
    held = docs.sparkSession.sparkContext.broadcast((table.astype(np.float64), bias))
    at = docs.columns.index(text_col)

    def run(batches):
        numbers, b = held.value
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            scores = [1 / (1 + np.exp(-(b + mean_of(t, numbers, s)))) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "quality_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(shared.giving_back(run), f"{kinds}, quality_score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", s: Settings = Settings()) -> DataFrame:
    """(id, held_out, score, predicted): the score of class 1 of every whole text.

    Learns from a bounded sample (``Settings.sample``) of rows labelled 0 or 1 whose
    crc32(id as text) mod 4 is not 2; the others are held out.  Only the text is an
    input of a score.  Null and empty texts get the bias alone.  Unlabelled ids, null
    labels and labels without a document are ignored in learning; of several labels of
    one id the smallest counts, of several rows the smallest text; without any label every
    score is 0.5.  A null id is not held out.  An empty table gives an empty result; other
    columns are not used.
    """
    scored = scored_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), labels.withColumnRenamed(id_col, "id"), "id", "text", label_col, s)
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    score = F.col("quality_score")
    return scored.select("id", held_out.alias("held_out"), score.alias("score"), (score >= s.threshold).cast("int").alias("predicted"))

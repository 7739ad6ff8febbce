"""Readers and writers: manifests, waveforms, page text, lint stores, ledgers, chapters.

PDF parsing, synthesis and recognition stay outside; their results are input tables.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The papers of manifest files, one row each."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.explode("papers").alias("p")).select("p.*")


def page_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, page_no, text): pages in order, one newline between."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def cached_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, i, path, bytes, content) of files <doc>/<number>.wav; other names are ignored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.regexp_extract_all("path", F.lit(r"([^/]+)/(\d+)\.wav$"), F.lit(0))
    return files.where(F.size(parts) > 0).select(F.regexp_extract("path", r"([^/]+)/\d+\.wav$", 1).alias("doc_id"), F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("int").alias("i"), "path", F.col("length").alias("bytes"), "content")


def wave_seconds(content: bytes) -> float | None:
    """frames / rate of a WAV header; None where it can't be read."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            return w.getnframes() / w.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


def wave_samples(content: bytes) -> np.ndarray:
    """16-bit samples as floats of -1 to 1, the mean over channels."""
    with wave.open(io.BytesIO(content)) as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(np.float32) / 32767
        return raw.reshape(-1, w.getnchannels()).mean(axis=1)


def wave_bytes(samples: np.ndarray, rate: int = 24_000) -> bytes:
    """A mono 16-bit WAV; samples outside -1 to 1 are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(DoubleType())
def seconds(content: pd.Series) -> pd.Series:
    return content.map(wave_seconds).astype(float)


METRICS = StructType().add("frames", LongType())
for _name in "secs peak rms rms_db dc clip_frac silence_frac lead_sil trail_sil max_gap".split():
    METRICS = METRICS.add(_name, DoubleType())
METRICS = METRICS.add("error", StringType())


def measured(content: bytes, hop: float = 0.02) -> dict:
    """Levels and silence of one WAV; ``error`` alone where there is nothing to measure."""
    row = dict.fromkeys(METRICS.names)
    if not content:
        return row | {"error": "empty"}
    try:
        with wave.open(io.BytesIO(content)) as w:
            rate = w.getframerate()
        x = wave_samples(content).astype(float)
    except (wave.Error, EOFError, ValueError) as e:
        return row | {"error": str(e)[:80] or "unreadable"}
    if not len(x):
        return row | {"error": "zero frames"}
    rms = float(np.sqrt(np.mean(x * x)))
    step = max(1, int(rate * hop))
    whole = x[: max(1, len(x) // step) * step]
    frames = np.sqrt((whole.reshape(-1, min(step, len(whole))) ** 2).mean(axis=1))
    quiet = frames < max(3e-4, 0.03 * np.percentile(frames, 95))
    loud = np.flatnonzero(~quiet)
    lead, trail = (loud[0], len(quiet) - 1 - loud[-1]) if len(loud) else (len(quiet), len(quiet))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], quiet.astype(int), [0]))))
    longest = int(max(edges[1::2] - edges[::2], default=0))
    return row | {
        "frames": len(x), "secs": len(x) / rate, "peak": float(np.abs(x).max()), "rms": rms, "rms_db": 20 * float(np.log10(rms)) if rms else -120.0, "dc": float(x.mean()),
        "clip_frac": float((np.abs(x) >= 32700 / 32767).mean()), "silence_frac": float(quiet.mean()), "lead_sil": lead * hop, "trail_sil": trail * hop, "max_gap": longest * hop,
    }


@F.pandas_udf(METRICS)
def wave_metrics(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measured(c) for c in content], columns=METRICS.names)


def write_lint(rows: DataFrame, path: str) -> None:
    """One partition per document, less the source text."""
    rows.drop("src").write.mode("overwrite").partitionBy("doc_id").parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def changed_texts(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` (doc_id, text) that are not in ``old`` or differ from it."""
    before = old.select("doc_id", F.sha1("text").alias("was"))
    return new.join(before, "doc_id", "left").where(F.col("was").isNull() | (F.col("was") != F.sha1("text"))).drop("was")


def chapter_lines(chapters: DataFrame) -> DataFrame:
    """Metadata lines of (place, title, start_ms, end_ms); special characters become spaces."""
    title = F.regexp_replace("title", r"[=;#\\\n]", " ")
    return chapters.select("place", F.format_string("[CHAPTER]\nTIMEBASE=1/1000\nSTART=%d\nEND=%d\ntitle=%s", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), title).alias("value"))

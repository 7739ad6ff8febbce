"""The robust duration model: seconds as a line in characters.

Least squares, then up to three times the same on what lies within four median absolute
deviations of the median residual.  Every step is one small aggregate over a narrow
cached table; medians are exact and found by narrowing histograms, so no task and not
the driver ever holds more than ``EXACT`` values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, EXACT = 1024, 5000


@dataclass(frozen=True)
class Model:
    """secs = a * chars + b, from n rows; under 50 rows a fixed rate."""

    a: float
    b: float
    n: int


def ranked(df: DataFrame, value: Column, rank: int) -> float:
    """The value of 0-based ``rank`` among non-null values."""
    rows = df.select(value.alias("v")).where("v IS NOT NULL")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = (high - low) / BINS
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        inside = rows.where(F.col("v").between(low, high))
        for b in sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r.bin):
            if rank < b.n:
                break
            rank -= b.n
        if b.n <= EXACT:
            return sorted(r.v for r in rows.where(F.col("v").between(b.low, b.high)).collect())[rank]
        if (b.low, b.high) == (low, high):
            break
        low, high = b.low, b.high
    return low


def median(df: DataFrame, value: Column, n: int) -> float:
    """Exact, the mean of the two middle values of an even count."""
    one = ranked(df, value, (n - 1) // 2)
    return one if n % 2 else (one + ranked(df, value, n // 2)) / 2


def fit(clean: DataFrame) -> Model:
    """The model of clean rows (chars, secs), both doubles."""
    rows = clean.select("chars", "secs").where("chars IS NOT NULL AND secs IS NOT NULL").cache()

    def line(df: DataFrame) -> Model:
        a, b, n = df.agg(F.regr_slope("secs", "chars"), F.regr_intercept("secs", "chars"), F.count("*")).first()
        return Model(a, b, n) if a is not None and b is not None else Model(1 / 15.5, 0.0, n)

    try:
        now, kept = line(rows), rows
        if now.n < 50:
            return Model(1 / 15.5, 0.0, now.n)
        for _ in range(3):
            off = F.col("secs") - (F.lit(now.a) * F.col("chars") + F.lit(now.b))
            mid = median(kept, off, now.n)
            mad = max(median(kept, F.abs(off - mid), now.n), 1e-6)
            kept = kept.where(F.abs(off - mid) < 4 * mad)
            before, now = now, line(kept)
            if before.n == now.n:
                break
        return now
    finally:
        rows.unpersist()


def predicted(rows: DataFrame, model: Model) -> Column:
    return F.greatest(F.lit(0.35), F.lit(model.a) * F.col("chars") + F.lit(model.b))

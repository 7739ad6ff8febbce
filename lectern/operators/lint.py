"""Chunk lint over a user's own rows: two tiers of classes and a summary by document.

Rows have doc, i, src_known, chars, secs, error (null where the audio could be read) and the
measures of ``TEXT`` and ``AUDIO``.  A measure that is null raises no flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.duration import Model
from lectern.plans.lint import CPS_HIGH, CPS_LOW, LONG, SHORT, WEIGHTS

TEXT = ["math_frac", "digit_frac", "speakable_frac", "lig_frac", "max_tok", "exotic_n"]
AUDIO = ["rms_db", "silence_frac", "max_gap", "lead_sil", "trail_sil", "clip_frac", "dc"]
#: Errors of audio that holds nothing; any other error means that the file is missing.
NOTHING = ("empty", "zero frames")

#: When a text is likely to be read badly, and what the two tiers accept.
BAD_TEXT = "(coalesce(math_frac > 0.015, false) OR coalesce(digit_frac > 0.12, false) OR coalesce(speakable_frac < 0.80, false) OR coalesce(lig_frac > 0.002, false) OR coalesce(max_tok > 40, false))"
RATE = f"cps NOT BETWEEN {CPS_LOW} AND {CPS_HIGH}"
KNOWN = "coalesce(src_known, false) AND chars > 0"
#: Names of conditions, in the order of their flags: (group, condition, flag).
CHECKS = [
    ("silence", "rms_db < -55 OR silence_frac > 0.6", "'silence'"),
    ("pause", "max_gap > 2.5", "format_string('gap%.1fs', max_gap)"),
    ("pause", "lead_sil > 2.0 OR trail_sil > 2.0", "'edge-silence'"),
    ("level", "clip_frac > 5e-4", "'clipping'"),
    ("level", "abs(dc) > 0.02", "'dc-offset'"),
    ("level", "rms_db NOT BETWEEN -34 AND -8", "format_string('level%.0fdB', rms_db)"),
    ("duration", f"{KNOWN} AND dur_ratio > {LONG}", "format_string('long%.2fx', dur_ratio)"),
    ("duration", f"{KNOWN} AND dur_ratio < {SHORT}", "format_string('short%.2fx', dur_ratio)"),
    ("duration", f"{KNOWN} AND {RATE}", "format_string('cps%.1f', cps)"),
    ("text", f"{KNOWN} AND {BAD_TEXT}", "'unspeakable-source'"),
    ("token", f"{KNOWN} AND max_tok > 40", "format_string('token%d', max_tok)"),
    ("risk", f"{KNOWN} AND exotic_n > 0", "format_string('exotic%d', exotic_n)"),
    ("unknown", f"NOT coalesce({KNOWN}, false)", "'no-source'"),
]


def _any(group: str) -> str:
    return "(" + " OR ".join(f"coalesce({c}, false)" for g, c, _ in CHECKS if g == group) + ")"


def tier1(rows: DataFrame, model: Model, shortest: float = 0.35) -> DataFrame:
    """``rows`` with pred_secs, dur_ratio, cps, suspect_rule, flags and cls, by the fitted line of ``model``
    (see ``duration.fit``).  Rows with an error have that as their flag and no measures."""
    heard = F.col("error").isNull()
    pred = F.greatest(F.lit(shortest), model.a * F.col("chars") + F.lit(model.b))
    rated = rows.withColumn("pred_secs", F.when(heard, pred)).withColumns({"dur_ratio": F.col("secs") / F.col("pred_secs"), "cps": F.when(heard, F.col("chars") / F.greatest("secs", F.lit(1e-6)))})
    flags = "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN {flag} END" for _, c, flag in CHECKS) + "))"
    first = [("silence", "silence"), ("token", "unspeakable"), ("both", "unspeakable"), ("duration", "duration"), ("level", "level"), ("pause", "silence")]
    tests = {g: _any(g) for g, *_ in CHECKS} | {"both": f"({_any('text')} AND {_any('duration')})"}
    empty = " OR ".join(f"error = '{e}'" for e in NOTHING)
    cls = f"CASE WHEN {empty} THEN 'silence' WHEN error IS NOT NULL THEN 'missing' " + " ".join(f"WHEN {tests[g]} THEN '{c}'" for g, c in first) + " ELSE 'ok' END"
    return rated.withColumns({"suspect_rule": F.expr(RATE), "flags": F.when(heard, F.expr(flags)).otherwise(F.array("error")), "cls": F.expr(cls)})


def tier2(rows: DataFrame) -> DataFrame:
    """``rows`` of ``tier1`` with cls and flags as the transcript decides them.  ``rows`` have ratio (null where
    there is no transcript, or it failed: such rows stay as they are), ins_rate, del_rate, dup_cov and codepoint_hits."""
    agree, bad = "ratio BETWEEN 0.85 AND 1.30", BAD_TEXT
    cls = f"""CASE WHEN ratio IS NULL THEN cls WHEN codepoint_hits >= 1 OR ({bad} AND ratio > 1.35) THEN 'unspeakable' WHEN {bad} AND NOT {agree} THEN 'unspeakable'
      WHEN ratio >= 1.35 AND ins_rate >= 0.30 AND dup_cov >= 0.20 THEN 'repetition' WHEN ratio <= 0.75 AND del_rate >= 0.25 THEN 'truncation'
      WHEN cls NOT IN ('duration', 'unspeakable') THEN cls WHEN NOT {agree} THEN 'duration' WHEN suspect_rule THEN CASE WHEN {bad} THEN 'unspeakable' ELSE 'duration' END ELSE 'ok' END"""
    flags = "CASE WHEN ratio IS NULL THEN flags ELSE array_append(filter(flags, f -> NOT startswith(f, 'asr')), format_string('asr%.2f', ratio)) END"
    return rows.withColumns({"flags": F.expr(flags), "cls": F.expr(cls)})


def severity(cls: Column) -> Column:
    """The weight of a class; 1 for one without a weight of its own."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[cls], F.lit(1))


def summarised(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """One row per doc of ``rows`` (doc, cls, secs, ratio): chunks, bad, classes (a map of counts), bad_secs, secs,
    bad_frac, severity, tier2 (any transcript), planned and plan_mismatch, from ``planned`` (doc, planned, one row a
    doc).  Counts are taken by doc and class first, so a long document is not gathered.  Null docs form one group."""
    spoken = F.coalesce("secs", F.lit(0.0))
    by_class = rows.groupBy("doc", "cls").agg(F.count("*").alias("n"), F.sum(spoken).alias("secs"), F.max(F.col("ratio").isNotNull()).alias("tier2"))
    bad = F.col("cls") != "ok"
    by_doc = by_class.groupBy("doc").agg(
        F.sum("n").alias("chunks"),
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("bad"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("classes"),
        F.round(F.sum(F.when(bad, F.col("secs")).otherwise(0.0)), 1).alias("bad_secs"),
        F.round(F.sum("secs"), 1).alias("secs"),
        F.sum(severity(F.col("cls")) * F.col("n")).alias("severity"),
        F.max("tier2").alias("tier2"),
    )
    known = planned.select(F.col("doc").alias("_doc"), "planned")
    both = by_doc.join(known, F.col("doc").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    return both.withColumns({"bad_frac": F.round(F.col("bad") / F.greatest("chunks", F.lit(1)), 4), "plan_mismatch": ~F.col("planned").eqNullSafe(F.col("chunks"))})

"""Chunk lint: duration model, classification in two tiers, rollups, transcripts, repairs.

Chunks stand on ``lineitem``: characters follow the seconds, line 7 doubles them (an
outlier), and text and audio measures are derived from keys.
"""

from lectern.plans.catalog import CHUNKS

#: Thresholds of the two tiers.
LONG, SHORT, CPS_LOW, CPS_HIGH = 1.30, 0.72, 8.0, 32.0
WEIGHTS = {"unspeakable": 3, "repetition": 3, "truncation": 3, "missing": 3, "silence": 2, "duration": 2, "level": 1, "ok": 0}

ROWS = f"""(SELECT doc, i, CAST(16 * secs + pk % 40 AS DOUBLE) AS chars, CASE WHEN i = 6 THEN 2 * secs ELSE secs END AS secs, pk % 101 = 0 AS is_empty, pk % 103 = 0 AS absent,
  (pk % 50) / CAST(2000 AS DOUBLE) AS math_frac, (pk % 40) / CAST(250 AS DOUBLE) AS digit_frac, 1 - (pk % 30) / CAST(120 AS DOUBLE) AS speakable_frac, CASE WHEN pk % 211 = 0 THEN 55 ELSE 12 END AS max_tok,
  CASE WHEN sk % 37 = 0 THEN -60.0 WHEN sk % 41 = 0 THEN -5.0 ELSE -20.0 END AS rms_db, (sk % 20) / CAST(30 AS DOUBLE) AS silence_frac, (sk % 30) / CAST(10 AS DOUBLE) AS max_gap, (sk % 22) / CAST(10 AS DOUBLE) AS edge,
  CASE WHEN sk % 43 = 0 THEN 0.001 ELSE 0.0 END AS clip_frac, CASE WHEN sk % 47 = 0 THEN -0.03 ELSE 0.0 END AS dc, pk % 59 <> 0 AS src_known, pk, sk FROM {CHUNKS} c)"""


CLEAN = "NOT is_empty AND NOT absent AND src_known AND chars >= 40 AND speakable_frac >= 0.95 AND math_frac <= 0.002 AND digit_frac <= 0.05"


def model() -> str:
    """CTEs m0 .. m3: least squares, and up to three times what lies within 4 MAD of the median residual."""
    fit = "regr_slope(secs, chars) AS a, regr_intercept(secs, chars) AS b"
    ctes = [f"x0 AS (SELECT chars, secs FROM {ROWS} r WHERE {CLEAN})"]
    for k in range(3):
        ctes += [
            f"f{k} AS (SELECT {fit} FROM x{k})",
            f"r{k} AS (SELECT chars, secs, secs - (a * chars + b) AS res FROM x{k} CROSS JOIN f{k})",
            f"c{k} AS (SELECT median(res) AS mid FROM r{k})",
            f"d{k} AS (SELECT max(mid) AS mid, greatest(median(abs(res - mid)), 1e-6) AS mad FROM r{k} CROSS JOIN c{k})",
            f"x{k + 1} AS (SELECT chars, secs FROM r{k} CROSS JOIN d{k} WHERE abs(res - mid) < 4 * mad)",
        ]
    ctes += [f"f3 AS (SELECT {fit}, count(*) AS n FROM x3)", "model AS (SELECT CASE WHEN n < 50 THEN 1.0 / 15.5 ELSE a END AS a, CASE WHEN n < 50 THEN 0.0 ELSE b END AS b, n FROM f3)"]
    return "WITH " + ",\n".join(ctes)


BAD = "(math_frac > 0.015 OR digit_frac > 0.12 OR speakable_frac < 0.80 OR max_tok > 40)"
#: One fixed line stands for the fit, so that the classes do not hang on the last bit of a slope.
RATED = f"(SELECT *, secs / greatest(0.35, 0.06 * chars + 0.2) AS dur_ratio, chars / greatest(secs, 1e-6) AS cps FROM {ROWS} r)"
DURATION = f"(src_known AND chars > 0 AND (dur_ratio > {LONG} OR dur_ratio < {SHORT} OR cps NOT BETWEEN {CPS_LOW} AND {CPS_HIGH}))"
SILENT = "(rms_db < -55 OR silence_frac > 0.6)"
TIER1 = f"""(SELECT *, CASE WHEN is_empty THEN 'silence' WHEN absent THEN 'missing' WHEN {SILENT} THEN 'silence' WHEN src_known AND max_tok > 40 THEN 'unspeakable' WHEN src_known AND {BAD} AND {DURATION} THEN 'unspeakable'
  WHEN {DURATION} THEN 'duration' WHEN clip_frac > 5e-4 OR abs(dc) > 0.02 OR rms_db NOT BETWEEN -34 AND -8 THEN 'level' WHEN max_gap > 2.5 OR edge > 2.0 THEN 'silence' ELSE 'ok' END AS cls FROM {RATED} q)"""
FLAGS = f"""concat_ws(',', CASE WHEN {SILENT} THEN 'silence' END, CASE WHEN max_gap > 2.5 THEN 'gap' END, CASE WHEN edge > 2.0 THEN 'edge-silence' END, CASE WHEN clip_frac > 5e-4 THEN 'clipping' END, CASE WHEN abs(dc) > 0.02 THEN 'dc-offset' END,
  CASE WHEN rms_db NOT BETWEEN -34 AND -8 THEN 'level' END, CASE WHEN src_known AND dur_ratio > {LONG} THEN 'long' WHEN src_known AND dur_ratio < {SHORT} THEN 'short' END, CASE WHEN src_known AND cps NOT BETWEEN {CPS_LOW} AND {CPS_HIGH} THEN 'cps' END,
  CASE WHEN src_known AND {BAD} THEN 'unspeakable-source' END, CASE WHEN src_known AND max_tok > 40 THEN 'token' END, CASE WHEN NOT src_known THEN 'no-source' END)"""
ASR = f"""(SELECT *, sk % 5 <> 0 AS heard, 0.6 + (pk % 90) / CAST(100 AS DOUBLE) AS ratio, (sk % 60) / CAST(100 AS DOUBLE) AS ins_rate, (pk % 45) / CAST(100 AS DOUBLE) AS del_rate, (sk % 33) / CAST(100 AS DOUBLE) AS dup_cov,
  CASE WHEN pk % 307 = 0 THEN 1 ELSE 0 END AS hits FROM {TIER1} t)"""
TIER2 = f"""CASE WHEN NOT heard THEN cls WHEN hits >= 1 OR ({BAD} AND ratio > 1.35) THEN 'unspeakable' WHEN {BAD} AND ratio NOT BETWEEN 0.85 AND 1.30 THEN 'unspeakable'
  WHEN ratio >= 1.35 AND ins_rate >= 0.30 AND dup_cov >= 0.20 THEN 'repetition' WHEN ratio <= 0.75 AND del_rate >= 0.25 THEN 'truncation'
  WHEN cls IN ('duration', 'unspeakable') THEN CASE WHEN ratio NOT BETWEEN 0.85 AND 1.30 THEN 'duration' WHEN cps NOT BETWEEN {CPS_LOW} AND {CPS_HIGH} THEN CASE WHEN {BAD} THEN 'unspeakable' ELSE 'duration' END ELSE 'ok' END ELSE cls END"""
WEIGHT = "CASE cls " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"
ROLLUP = f"""SELECT doc, count(*) AS chunks, count_if(cls <> 'ok') AS bad, sum(CASE WHEN cls <> 'ok' THEN secs ELSE 0 END) AS bad_secs, sum(secs) AS secs, CAST(sum({WEIGHT}) AS BIGINT) AS severity,
  count_if(cls = 'silence') AS silence, count_if(cls = 'duration') AS duration, count_if(cls = 'unspeakable') AS unspeakable, count_if(cls = 'level') AS level, count_if(cls = 'missing') AS missing FROM {TIER1} t GROUP BY doc"""

#: Transcripts: an assistant turn is the reading of the user turn before it.
PAIRS = "(SELECT u.conv_id AS doc, u.turn AS i, u.text AS src, a.text AS heard FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user')"
HASH = "substr(sha1({0}), 1, 12)"
METRICS = ["chars", "secs", "dur_ratio", "cps", "silence_frac", "max_gap", "math_frac", "digit_frac"]

#: As SQL the trimming unrolls into a tree that reads its input many times; it is the
#: oracle only, and ``lectern.operators.duration`` runs the steps one by one.
MODEL_SQL = {
    "duration_model": f"{model()} SELECT round(a, 7) AS a, round(b, 6) AS b, n FROM model",
    "predicted_seconds": f"{model()} SELECT doc, i, round(greatest(0.35, a * chars + b), 4) AS pred_secs FROM {ROWS} r CROSS JOIN model",
}

PLANS = {
    "tier1_classify": f"SELECT doc, i, cls, CASE WHEN is_empty THEN 'empty' WHEN absent THEN 'absent' ELSE {FLAGS} END AS flags, dur_ratio, cps FROM {TIER1} t",
    "tier2_adjudicate": f"SELECT doc, i, cls AS before, {TIER2} AS cls FROM {ASR} t",
    "lint_rollup": ROLLUP,
    "lint_totals": f"SELECT coalesce(cls, 'TOTAL') AS cls, count(*) AS chunks, sum(secs) / 60 AS minutes, count(DISTINCT doc) AS docs FROM {TIER1} t GROUP BY ROLLUP (cls)",
    "calibration_percentiles": " UNION ALL ".join(f"SELECT '{m}' AS metric, " + ", ".join(f"PCT(CAST({m} AS DOUBLE), {p / 100}) AS p{p}" for p in (1, 5, 50, 95, 99)) + f" FROM {RATED} r WHERE NOT is_empty AND NOT absent" for m in METRICS),
    "rate_flag": f"SELECT doc, i, cps FROM {RATED} r WHERE cps NOT BETWEEN {CPS_LOW} AND {CPS_HIGH}",
    "rate_flag_superset": f"SELECT doc, i FROM {RATED} r WHERE cps NOT BETWEEN {CPS_LOW} AND {CPS_HIGH} AND src_known AND NOT is_empty AND NOT absent EXCEPT SELECT doc, i FROM {TIER1} t WHERE cls <> 'ok' OR instr({FLAGS}, 'cps') > 0",
    "transcript_reuse": f"SELECT doc, i, CASE WHEN i % 4 = 2 THEN NULL ELSE heard END IS NOT NULL AND (stored IS NULL AND NOT repaired OR coalesce(stored, '') = now) AS reused FROM (SELECT doc, i, heard, {HASH.format('src')} AS now, CASE WHEN doc % 3 = 0 THEN NULL WHEN doc % 3 = 1 THEN {HASH.format('src')} ELSE {HASH.format('heard')} END AS stored, doc % 6 = 0 AS repaired FROM {PAIRS} p) x",
    "effective_source": "SELECT p.doc, p.i, coalesce(r.fixed, p.src) AS src FROM @P p LEFT JOIN (SELECT doc, i, concat(left(src, 40), '.') AS fixed FROM @P q WHERE doc % 4 = 0) r ON r.doc = p.doc AND r.i = p.i".replace("@P", PAIRS),
    "transcript_counts": f"SELECT doc, i, CAST(SIZE(FILTER(SPLIT(src, R'\\s+'), FN w: w <> '')) AS BIGINT) AS src_words, SIZE(FILTER(SPLIT(heard, R'\\s+'), FN w: w <> '')) / CAST(greatest(1, SIZE(FILTER(SPLIT(src, R'\\s+'), FN w: w <> ''))) AS DOUBLE) AS ratio FROM {PAIRS} p",
    "tier2_candidates": f"SELECT t.doc, t.i FROM {TIER1} t @[LEFT ANTI@|ANTI@] JOIN (SELECT doc, i FROM {TIER1} d WHERE sk % 5 = 1) d ON d.doc = t.doc AND d.i = t.i WHERE (cls IN ('duration', 'unspeakable', 'silence') OR max_tok > 40) AND NOT is_empty AND NOT absent",
    "control_sample": f"SELECT doc, i FROM {TIER1} t WHERE cls = 'ok' ORDER BY sha1(concat('7:', CAST(doc AS STRING), ':', CAST(i AS STRING))), doc, i LIMIT 40",
    "repair_candidates": f"SELECT doc, i FROM {ASR} t WHERE {TIER2} = 'unspeakable' AND src_known",
    "repair_decision": f"""SELECT doc, i, CASE WHEN words < 3 THEN 'skip' WHEN same THEN 'skip' WHEN was_ok THEN 'skip' WHEN now_ok THEN 'repaired' ELSE 'rejected' END AS verdict FROM (
      SELECT doc, i, pk % 9 AS words, pk % 13 = 0 AS same, cps BETWEEN 8 AND 32 AND ratio BETWEEN 0.75 AND 1.35 AND hits = 0 AS was_ok, cps * 0.9 BETWEEN 8 AND 32 AND ratio * 1.1 BETWEEN 0.75 AND 1.35 AS now_ok FROM {ASR} t) x""",
}

#: One order of a whole table: as SQL a window in one task, which serves as the oracle only;
#: ``lectern.operators.ranking`` gives the places in Spark.
ORDER_SQL = {
    "lint_doc_rank": f"SELECT row_number() OVER (ORDER BY severity DESC, bad_secs DESC, doc) AS place, doc, severity FROM ({ROLLUP}) r",
}

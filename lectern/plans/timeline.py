"""Chunk timelines, chapters and waveform measures (chunks from ``lineitem``, waveforms from ``embeddings``)."""

from lectern.plans.catalog import CHUNKS

GAP = 0.18  # seconds between two chunks

#: Planned chunks: 0 .. o_orderkey % 8 of every order; present ones are CHUNKS.
DOMAIN = f"""(SELECT o.doc, @[t.i@|t.i@] AS i, o.planned FROM @[(SELECT doc, planned, explode(sequence(0, greatest(planned, present) - 1)) AS i FROM @|(SELECT doc, planned, CAST(unnest(range(0, greatest(planned, present))) AS INT) AS i FROM @]
  (SELECT o_orderkey AS doc, CAST(1 + o_orderkey % 8 AS INT) AS planned, CAST(coalesce(m.top, 0) AS INT) AS present FROM orders LEFT JOIN (SELECT doc, max(i) + 1 AS top FROM {CHUNKS} c GROUP BY doc) m ON m.doc = o_orderkey) q) o, (SELECT 0 AS z) z)""".replace("@[t.i@|t.i@]", "o.i")
PRESENT = f"""(SELECT d.doc, d.i, d.planned, c.secs, c.pk, c.flag FROM {DOMAIN} d LEFT JOIN {CHUNKS} c ON c.doc = d.doc AND c.i = d.i)"""
TIMED = f"""(SELECT doc, i, secs, CASE WHEN secs IS NULL THEN NULL ELSE coalesce(sum(secs * 100 + 18) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS start_cs FROM {PRESENT} p)"""
PROBES = "(SELECT o_orderkey AS doc, CAST(1 + o_orderkey % 97 AS DOUBLE) * 150 AS t FROM orders)"

#: Frames of four samples; the synthetic vectors stand for waveforms.
FRAMES = """(SELECT vec_id, k, sqrt((a * a + b * b + c * c + d * d) / 4) AS rms FROM (SELECT vec_id, k, CAST(e[@[4 * k@|4 * k + 1@]] AS DOUBLE) AS a, CAST(e[@[4 * k + 1@|4 * k + 2@]] AS DOUBLE) AS b, CAST(e[@[4 * k + 2@|4 * k + 3@]] AS DOUBLE) AS c, CAST(e[@[4 * k + 3@|4 * k + 4@]] AS DOUBLE) AS d
  FROM (SELECT vec_id, embedding AS e, @[explode(sequence(0, size(embedding) div 4 - 1))@|unnest(range(0, len(embedding) // 4))@] AS k FROM embeddings) x) y)"""
QUIET = f"(SELECT f.vec_id, f.k, f.rms < greatest(3e-4, 0.6 * q.p95) AS quiet, f.rms FROM {FRAMES} f JOIN (SELECT vec_id, PCT(rms, 0.95) AS p95 FROM {FRAMES} g GROUP BY vec_id) q ON q.vec_id = f.vec_id)"
ABS = "@[transform(embedding, x -> abs(CAST(x AS DOUBLE)))@|list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))@]"
LEVELS = f"""(SELECT vec_id, @[array_max({ABS})@|list_max({ABS})@] AS peak, sqrt(@[aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))@|list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), lambda a, x: a + x)@] / SIZE(embedding)) AS rms,
  @[aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE))@|list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda a, x: a + x)@] / SIZE(embedding) AS dc, SIZE(FILTER({ABS}, FN x: x >= 0.3)) AS clipped, SIZE(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL)"""

PLANS = {
    "planned_vs_present": f"SELECT doc, i, secs, i >= planned AS extra, secs IS NULL AS absent FROM {PRESENT} p",
    "missing_indices": f"SELECT doc, i FROM {PRESENT} p WHERE secs IS NULL",
    "timeline": f"SELECT doc, i, start_cs / 100 AS t_start, (start_cs + secs * 100) / 100 AS t_end FROM {TIMED} t",
    "assembly_report": f"SELECT doc, count(secs) AS chunks, count_if(secs IS NULL) AS missing, count(CASE WHEN flag = 'R' THEN 1 END) AS suspects, sum(coalesce(secs, 0)) / 60 AS minutes FROM {PRESENT} p GROUP BY doc",
    "chunk_at_time": f"SELECT p.doc, p.t / 100 AS t, max(c.i) AS i FROM {PROBES} p LEFT JOIN {TIMED} c ON c.doc = p.doc AND c.start_cs <= p.t GROUP BY p.doc, p.t",
    "segment_at_time": f"""SELECT p.doc, coalesce(min(CASE WHEN p.pos < c.hi THEN c.seg END), max(c.seg)) AS seg FROM (SELECT o_orderkey AS doc, (o_orderkey % 100) / CAST(100 AS DOUBLE) AS pos FROM orders) p
      JOIN (SELECT doc, i AS seg, sum(secs) OVER (PARTITION BY doc ORDER BY i) / sum(secs) OVER (PARTITION BY doc) AS hi FROM {CHUNKS} c) c ON c.doc = p.doc GROUP BY p.doc""",
    "segment_fractions": f"SELECT doc, i, round(1.0 * coalesce(sum(secs) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(secs) OVER (PARTITION BY doc), 4) AS f0, round(1.0 * sum(secs) OVER (PARTITION BY doc ORDER BY i) / sum(secs) OVER (PARTITION BY doc), 4) AS f1 FROM {CHUNKS} c",
    "waveform_levels": f"SELECT vec_id, peak, round(rms, 9) AS rms, round(dc, 9) AS dc, round(CASE WHEN rms = 0 THEN -120 ELSE 20 * log10(rms) END, 6) AS rms_db, clipped / CAST(n AS DOUBLE) AS clip_frac FROM {LEVELS} l",
    "gain_normalise": f"SELECT vec_id, CASE WHEN rms < 1e-6 THEN 1 ELSE round(least(0.10 / rms, 0.97 / peak), 9) END AS gain FROM {LEVELS} l",
    "frame_silence": f"SELECT vec_id, count_if(quiet) / CAST(count(*) AS DOUBLE) AS quiet_frac FROM {QUIET} q GROUP BY vec_id",
    "longest_quiet_run": f"""SELECT v.vec_id, coalesce(max(r.n), 0) AS longest FROM embeddings v LEFT JOIN (SELECT vec_id, count(*) AS n FROM (
      SELECT vec_id, k - row_number() OVER (PARTITION BY vec_id ORDER BY k) AS island FROM {QUIET} q WHERE quiet) x GROUP BY vec_id, island) r ON r.vec_id = v.vec_id GROUP BY v.vec_id""",
    "edge_silence": f"SELECT vec_id, CAST(coalesce(min(CASE WHEN NOT quiet THEN k END), count(*)) AS BIGINT) AS lead, CAST(coalesce(count(*) - 1 - max(CASE WHEN NOT quiet THEN k END), count(*)) AS BIGINT) AS trail FROM {QUIET} q GROUP BY vec_id",
    "cost_estimate": f"SELECT count(*) AS chunks, sum(secs) AS secs, sum(secs) / (16 * 5) AS est_secs FROM {CHUNKS} c WHERE flag = 'R'",
}

#: One order of a whole table: as SQL a window in one task, which serves as the oracle only;
#: ``lectern.operators.ranking`` gives the places in Spark.
ORDER_SQL = {
    "chapters": f"""SELECT doc, place, (secs_before * 100 + 18 * chunks_before) / 100 AS starts FROM (SELECT doc, row_number() OVER (ORDER BY doc) AS place,
      coalesce(sum(secs) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS secs_before, coalesce(sum(n) OVER (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunks_before
      FROM (SELECT doc, sum(secs) AS secs, count(*) AS n FROM {CHUNKS} c GROUP BY doc) d) x""",
}

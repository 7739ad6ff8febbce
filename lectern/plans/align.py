"""Page-to-narration alignment: rects, confidence, fallback pages, lookups, notes, jobs."""

from lectern.plans.catalog import CHUNKS

#: Page words from lines of orders: page, block and line by part key, boxes by arithmetic.
WORDS = """(SELECT l_orderkey AS doc, l_linenumber AS ord, l_partkey % 3 AS page, l_partkey % 2 AS block, l_suppkey % 4 AS line, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0,
  CAST(l_partkey % 500 + 12 AS DOUBLE) AS x1, CAST(l_suppkey % 700 + 9 AS DOUBLE) AS y1, l_quantity < 30 AS matched FROM lineitem)"""
SPANS = f"""(SELECT doc, page, block, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count_if(matched) AS hits, count(*) AS words FROM {WORDS} w GROUP BY doc, page, block, line)"""
CONF = f"(SELECT doc, ord % 4 AS i, count_if(matched) / CAST(greatest(count(*), 1) AS DOUBLE) AS conf FROM {WORDS} w GROUP BY doc, ord % 4)"
FILL = """coalesce(CASE WHEN p IS NOT NULL AND conf < 0.6 THEN p END, CASE WHEN p IS NULL THEN coalesce(@[last_value(p) IGNORE NULLS@|last_value(p IGNORE NULLS)@] OVER (PARTITION BY {0} ORDER BY {1} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  @[first_value(p) IGNORE NULLS@|first_value(p IGNORE NULLS)@] OVER (PARTITION BY {0} ORDER BY {1} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) END)"""
PAGED = f"(SELECT doc, i, CASE WHEN pk % 3 = 0 THEN NULL ELSE i + pk % 2 END AS p, (sk % 10) / CAST(10 AS DOUBLE) AS conf FROM {CHUNKS} c)"
#: A note quotes its own document; every seventh quote is not there any more.
NOTES = "(SELECT doc_id AS note, doc_id AS pid, CASE WHEN doc_id % 7 = 0 THEN concat('gone: ', source) ELSE substr(text, CAST(1 + doc_id % 200 AS INT), 60) END AS quote FROM documents)"
FOUND = f"(SELECT n.note, n.quote, n.pid, d.text, instr(d.text, n.quote) AS pos FROM {NOTES} n JOIN documents d ON d.doc_id = n.pid AND instr(d.text, n.quote) > 0)"
CLICKS = "(SELECT o_orderkey AS doc, o_orderkey % 3 AS page, CAST(o_orderkey % 500 AS DOUBLE) AS px, CAST(o_custkey % 700 AS DOUBLE) AS py FROM orders)"
LOG = "(SELECT user_id AS doc, ts, event_id, event_type AS state FROM events)"

PLANS = {
    "line_word_counts": f"SELECT doc, page, block, line, count(*) AS words FROM {WORDS} w GROUP BY doc, page, block, line",
    "line_rects": f"SELECT doc, page, block, line, round(x0, 1) AS x0, round(y0, 1) AS y0, round(x1, 1) AS x1, round(y1, 1) AS y1 FROM {SPANS} s WHERE hits >= 0.35 * words AND hits > 0",
    "span_confidence": f"SELECT doc, CAST(i AS BIGINT) AS i, conf FROM {CONF} c",
    "alignment_confidence_bands": f"SELECT doc, count_if(conf >= 0.95) AS high, count_if(conf >= 0.6 AND conf < 0.95) AS middle, count_if(conf < 0.6) AS low FROM {CONF} c GROUP BY doc",
    "worst_confidence": f"SELECT doc, CAST(i AS BIGINT) AS i, conf FROM {CONF} c ORDER BY conf, doc, i LIMIT 10",
    "token_band_join": f"""SELECT c.doc, c.i, count(t.o) AS tokens FROM (SELECT doc, i, CAST(i * 60 AS BIGINT) AS lo, CAST(i * 60 + 60 AS BIGINT) AS hi FROM {CHUNKS} c) c
      LEFT JOIN (SELECT l_orderkey AS doc, l_partkey % 420 AS o FROM lineitem) t ON t.doc = c.doc AND t.o >= c.lo AND t.o < c.hi GROUP BY c.doc, c.i""",
    "token_page_word": f"SELECT n.doc, n.k, w.page FROM (SELECT o_orderkey AS doc, CAST(1 + o_orderkey % 7 AS INT) AS k FROM orders) n LEFT JOIN (SELECT doc, ord, max(page) AS page FROM {WORDS} w GROUP BY doc, ord) w ON w.doc = n.doc AND w.ord = n.k",
    "page_fallback_fill": f"SELECT doc, i, {FILL.format('doc', 'i')} AS page_only FROM {PAGED} p",
    "segment_fallback_fill": f"SELECT doc, chunk, i, coalesce({FILL.format('doc, chunk', 'i')}, CASE WHEN p IS NULL THEN whole END) AS page_only FROM (SELECT *, CAST(i DIV 3 AS BIGINT) AS chunk, doc % 5 AS whole FROM {PAGED} q) p",
    # Every click: the first line whose box, one point wider, holds it; else the first line of the page; else none.
    "point_in_rect": f"""SELECT c.doc, c.page, c.px, c.py, coalesce(h.at, f.at) DIV 100 AS block, coalesce(h.at, f.at) % 100 AS line, CASE WHEN h.at IS NOT NULL THEN 'rect' WHEN f.at IS NOT NULL THEN 'page' ELSE 'none' END AS kind FROM {CLICKS} c
      LEFT JOIN (SELECT k.doc, k.page, k.px, k.py, min(s.block * 100 + s.line) AS at FROM {CLICKS} k JOIN {SPANS} s ON s.doc = k.doc AND s.page = k.page AND k.px BETWEEN s.x0 - 1 AND s.x1 + 1 AND k.py BETWEEN s.y0 - 1 AND s.y1 + 1 GROUP BY k.doc, k.page, k.px, k.py) h ON h.doc = c.doc AND h.page = c.page AND h.px = c.px AND h.py = c.py
      LEFT JOIN (SELECT doc, page, min(block * 100 + line) AS at FROM {SPANS} s GROUP BY doc, page) f ON f.doc = c.doc AND f.page = c.page""",
    "note_reanchor_exact": f"SELECT note, pid, CAST((pos - 1) DIV 400 AS BIGINT) AS chunk_idx, CAST((pos - 1) % 400 AS BIGINT) AS char_off FROM {FOUND} f",
    "note_chunk_quote": f"SELECT note, pid, left(substr(text, CAST(pos AS INT)), 120) AS quote FROM {FOUND} f",
    "note_reanchor_apply": f"SELECT n.id, coalesce(m.new, n.idx) AS idx FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS idx, l_orderkey AS doc FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x) n LEFT JOIN (SELECT o_orderkey AS doc, CAST(3 AS INT) AS old, CAST(5 AS INT) AS new FROM orders UNION ALL SELECT o_orderkey, CAST(5 AS INT), CAST(7 AS INT) FROM orders) m ON m.doc = n.doc AND m.old = n.idx",
    "alignment_stale": "SELECT doc_id, built IS NULL OR version <> 2 OR built <> sha1(text) OR (NOT complete AND audio > 0) AS stale FROM (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN sha1(concat(text, '.')) ELSE sha1(text) END AS built, CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 2 END AS version, doc_id % 4 <> 0 AS complete, doc_id % 3 AS audio FROM documents) x",
    "job_latest_state": f"SELECT doc, state FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ts DESC, event_id DESC) AS rn FROM {LOG} l) x WHERE rn = 1",
    "job_progress": f"SELECT doc, CAST(CASE WHEN bool_or(state = 'purchase') AND count(*) > 80 THEN 100 ELSE least(99, (100 * count_if(state = 'view')) DIV greatest(1, count(*))) END AS BIGINT) AS pct FROM {LOG} l GROUP BY doc",
    "resumable_skip": f"SELECT c.doc, c.i FROM {CHUNKS} c @[LEFT ANTI@|ANTI@] JOIN (SELECT doc, i FROM {CHUNKS} d WHERE secs * 100 > 1000) d ON d.doc = c.doc AND d.i = c.i",
    "recent_finished": f"SELECT doc FROM {LOG} l CROSS JOIN (SELECT max(ts) AS now FROM events) n GROUP BY doc HAVING max(ts) > max(now) - INTERVAL '25' MINUTE",
    "incremental_recompute": "SELECT a.doc_id FROM (SELECT doc_id, substr(sha1(text), 1, 12) AS h FROM documents) a LEFT JOIN (SELECT doc_id, substr(sha1(CASE WHEN doc_id % 7 = 0 THEN lang ELSE text END), 1, 12) AS h FROM documents WHERE doc_id % 10 <> 0) b ON b.doc_id = a.doc_id WHERE b.h IS NULL OR b.h <> a.h",
    "class_priors": "SELECT d.source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source",
}

"""The workspace catalog over region, nation, customer (folders), orders (items) and part.

Folder ids: region r is 1 + r, nation n is 100 + n, customer c is 1000 + c; 0 is the root.
"""

FOLDERS = """(SELECT CAST(1 + r_regionkey AS BIGINT) AS id, CAST(0 AS BIGINT) AS parent_id, r_name AS name FROM region
  UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, n_name FROM nation
  UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, c_name FROM customer)"""

ANCESTORS = f"""up AS (
  SELECT id AS folder, id AS at, parent_id, name, 0 AS steps FROM {FOLDERS} f
  UNION ALL SELECT u.folder, f.id, f.parent_id, f.name, u.steps + 1 FROM up u JOIN {FOLDERS} f ON f.id = u.parent_id)"""

ITEMS = """(SELECT o_orderkey AS id, 1000 + o_custkey AS folder_id, CASE WHEN o_orderkey % 5 = 0 THEN 'attachment' ELSE 'paper' END AS kind, o_orderkey % 17 = 0 AS deleted,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 1000 END AS ord, o_orderdate AS created, concat('Order ', CAST(o_orderkey AS STRING)) AS title, concat('order_', CAST(o_orderkey AS STRING), '.pdf') AS orig_name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'uploaded' ELSE o_orderpriority END AS authors FROM orders)"""

#: Chunks of an item: lines of an order made unique by a total order.
CHUNKS = """(SELECT l_orderkey AS doc, l_linenumber - 1 AS i, l_quantity AS secs, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS flag, l_linestatus AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn FROM lineitem) x WHERE rn = 1)"""

JOB = "(SELECT user_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1)"

LIBRARY = f"""(SELECT i.*, coalesce(f.name, '/') AS folder, coalesce(c.chunks, 0) AS chunks, coalesce(c.suspects, 0) AS suspects, coalesce(c.secs, 0) AS secs, i.id % 6 <> 0 AS has_pdf, coalesce(c.chunks, 0) > 3 AS has_wav, j.state AS job
  FROM {ITEMS} i LEFT JOIN {FOLDERS} f ON f.id = i.folder_id
  LEFT JOIN (SELECT doc, count(*) AS chunks, count_if(flag = 'R') AS suspects, sum(round(secs, 1)) AS secs FROM {CHUNKS} k GROUP BY doc) c ON c.doc = i.id
  LEFT JOIN {JOB} j ON j.user_id = i.id)"""

STATE = "CASE WHEN kind <> 'paper' THEN 'file' WHEN job = 'click' THEN 'rendering' WHEN job = 'view' THEN 'queued' WHEN has_wav THEN 'narrated' WHEN has_pdf THEN 'not rendered' ELSE 'needs PDF' END"

NAMES = "(SELECT p_partkey AS id, concat(split_part(p_name, ' ', 1), CASE WHEN p_partkey % 50 = 0 THEN ' (2)' ELSE '' END) AS base, p_partkey % 3 = 0 AS known FROM part)"

TITLES = """(SELECT page_id, @[regexp_extract(html, '<title>([^<]*)</title>', 1)@|regexp_extract(html, '<title>([^<]*)</title>', 1)@] AS meta,
  concat(@[regexp_extract(html, '<h1>([^<]*)</h1>', 1)@|regexp_extract(html, '<h1>([^<]*)</h1>', 1)@], CASE page_id % 4 WHEN 1 THEN ' and more words' WHEN 2 THEN '' ELSE ' x' END) AS layout FROM pages)"""
WORDS = "FILTER(SPLIT(lower({0}), R'[^\\p{{L}}\\p{{N}}]+'), FN w: length(w) > {1})"
META, PRINTED = WORDS.format("CASE WHEN page_id % 5 = 0 THEN concat('untitled scan ', meta) ELSE meta END", 2), WORDS.format("layout", 0)

PLANS = {
    "folder_delete_reparent": f"""SELECT f.id, coalesce(g.parent_id, f.parent_id) AS parent_id, f.name FROM {FOLDERS} f LEFT JOIN (SELECT id, parent_id FROM {FOLDERS} d WHERE id BETWEEN 100 AND 124 AND id % 4 = 0) g ON g.id = f.parent_id
      WHERE NOT (f.id BETWEEN 100 AND 124 AND f.id % 4 = 0)""",
    # A deleted folder's items move up, as its folders do.
    "folder_delete_items": f"SELECT i.id, coalesce(g.parent_id, i.folder_id) AS folder_id, g.id IS NOT NULL AS moved FROM {ITEMS} i LEFT JOIN (SELECT id, parent_id FROM {FOLDERS} d WHERE id > 1000 AND id % 4 = 0) g ON g.id = i.folder_id",
    "folder_status": f"SELECT kind, deleted, count(*) AS items, count(DISTINCT folder_id) AS folders FROM {ITEMS} i GROUP BY kind, deleted",
    "ensure_path": """SELECT DISTINCT concat_ws('/', CASE WHEN k >= 1 THEN a END, CASE WHEN k >= 2 THEN b END, CASE WHEN k >= 3 THEN c END) AS path, k AS depth FROM (
      SELECT r_name AS a, n_name AS b, c_mktsegment AS c FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) p CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) t
      WHERE NOT (k = 1 AND a IN (SELECT r_name FROM region WHERE r_regionkey < 2))""",
    # The first of a base keeps it; the k-th other one gets the k-th number from 2 on that no base has as its own.
    "unique_names": f"""SELECT x.id, concat(x.base, CASE WHEN x.n = 1 THEN '' ELSE concat(' (', CAST(@[aggregate(coalesce(t.taken, CAST(array() AS ARRAY<BIGINT>)), x.n, (c, k) -> CASE WHEN k <= c THEN c + 1 ELSE c END)@|list_reduce(list_prepend(x.n, coalesce(t.taken, CAST([] AS BIGINT[]))), lambda c, k: CASE WHEN k <= c THEN c + 1 ELSE c END)@] AS STRING), ')') END) AS name FROM (
      SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY CASE WHEN known THEN 0 ELSE 1 END, id) AS n FROM {NAMES} n) x
      LEFT JOIN (SELECT stem, @[sort_array(collect_list(k))@|list_sort(list(k))@] AS taken FROM (SELECT DISTINCT RX(base, R' \\([0-9]+\\)$', '') AS stem, CAST(@[regexp_extract(base, r' \\(([0-9]+)\\)$', 1)@|regexp_extract(base, ' \\(([0-9]+)\\)$', 1)@] AS BIGINT) AS k FROM {NAMES} m WHERE MATCH(base, R' \\([0-9]+\\)$')) y GROUP BY stem) t ON t.stem = x.base""",
    "library_items": f"SELECT id, folder, title, CAST(chunks AS BIGINT) AS chunks, CAST(suspects AS BIGINT) AS suspects, has_pdf, has_wav FROM {LIBRARY} l WHERE NOT deleted",
    "library_search": " UNION ALL ".join(f"SELECT '{q}' AS q, id FROM {ITEMS} i WHERE NOT deleted AND (instr(lower(title), lower('{q}')) > 0 OR instr(lower(authors), lower('{q}')) > 0 OR instr(lower(orig_name), lower('{q}')) > 0)" for q in ("Urgent", "ORDER 77", "_9.pdf")),
    "item_state": f"SELECT id, {STATE} AS state FROM {LIBRARY} l",
    "library_totals": f"""SELECT count_if(kind = 'paper') AS docs, count_if(kind <> 'paper') AS files, count_if({STATE} = 'narrated') AS ready, CAST(sum(chunks) AS BIGINT) AS chunks,
      CAST(sum(suspects) AS BIGINT) AS suspects, round(sum(secs), 1) AS secs FROM {LIBRARY} l WHERE NOT deleted""",
    "manifest_import": f"SELECT o_orderkey AS id, o_orderpriority AS authors FROM orders o @[LEFT ANTI@|ANTI@] JOIN (SELECT id FROM {ITEMS} i WHERE id % 4 <> 1) k ON k.id = o.o_orderkey",
    "next_order": f"SELECT folder_id, coalesce(max(ord), 0) + 1 AS next_ord FROM {ITEMS} i WHERE NOT deleted GROUP BY folder_id",
    # An id is taken by an item, a source or dropped file, audio, cached chunks, a text or an attachment.
    "id_conflicts": f"""SELECT w.id, h.places FROM (SELECT p_partkey AS id FROM part) w JOIN (SELECT id, count(DISTINCT place) AS places FROM (
      SELECT id, 'item' AS place FROM {ITEMS} i UNION ALL SELECT doc, 'cache' FROM {CHUNKS} c UNION ALL SELECT user_id, 'audio' FROM events UNION ALL SELECT doc_id, 'text' FROM documents
      UNION ALL SELECT page_id, 'source' FROM pages UNION ALL SELECT item_id, 'attachment' FROM benchmark) x GROUP BY id) h ON h.id = w.id""",
    "gated_mutation": f"SELECT m.id, m.parent FROM (SELECT o_orderkey AS id, 1000 + o_custkey * 2 AS parent FROM orders) m @[LEFT SEMI@|SEMI@] JOIN {FOLDERS} f ON f.id = m.parent",
    "item_upsert": f"SELECT coalesce(n.id, i.id) AS id, coalesce(n.title, i.title) AS title, n.id IS NOT NULL AS changed FROM {ITEMS} i FULL OUTER JOIN (SELECT p_partkey * 3 AS id, p_name AS title FROM part) n ON n.id = i.id",
    "title_source_migration": f"""SELECT id, CASE WHEN kind = 'attachment' THEN 'filename' WHEN authors <> 'uploaded' THEN 'manifest' WHEN title = CASE WHEN id % 8 = 0 THEN title ELSE '' END THEN 'pending' ELSE 'manual' END AS title_source FROM {ITEMS} i""",
    "title_compare_and_set": f"""SELECT i.id, CASE WHEN s.src IN ('pending', 'filename') THEN coalesce(t.layout, i.title) ELSE i.title END AS title,
      CASE WHEN s.src IN ('pending', 'filename') THEN CASE WHEN t.layout IS NULL THEN 'filename' ELSE 'layout' END ELSE s.src END AS title_source
      FROM {ITEMS} i JOIN (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'filename' WHEN 2 THEN 'manual' ELSE 'manifest' END AS src FROM orders) s ON s.id = i.id LEFT JOIN {TITLES} t ON t.page_id = i.id""",
    "title_metadata_agreement": f"""SELECT page_id, CAST(SIZE(m) AS BIGINT) AS meta_words, 10 * SIZE(FILTER(m, FN w: @[array_contains(p, w)@|list_contains(p, w)@])) >= 8 * SIZE(m) AND SIZE(m) > 0 AS printed,
      SIZE(FILTER(m, FN w: NOT @[array_contains(p, w)@|list_contains(p, w)@])) = 0 AND SIZE(@[array_distinct(p)@|list_distinct(p)@]) > SIZE(@[array_distinct(m)@|list_distinct(m)@]) AS strict_subset
      FROM (SELECT page_id, {META} AS m, {PRINTED} AS p FROM {TITLES} t) x""",
    "title_line_groups": """SELECT doc, CAST(grp AS BIGINT) AS grp, count(*) AS lines, CAST(sum(ink) AS BIGINT) AS ink, CAST(min(y) AS BIGINT) AS top FROM (
      SELECT *, sum(CASE WHEN prev IS NULL OR y - prev > 9 OR starts_by THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY y, i) AS grp FROM (
        SELECT doc, i, y, ink, starts_by, lag(y) OVER (PARTITION BY doc ORDER BY y, i) AS prev FROM (SELECT doc, i, CAST(10 * i + pk % 7 AS BIGINT) AS y, sk AS ink, flag = 'R' AND status = 'F' AND i = 3 AS starts_by FROM @CHUNKS c) a) b) d
      GROUP BY doc, grp HAVING count(*) <= 4""".replace("@CHUNKS", CHUNKS),
    "acquisition_routing": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'have' WHEN p_partkey % 5 = 0 THEN 'drop-in' WHEN p_partkey % 3 = 0 THEN 'NEED' WHEN s_suppkey IS NULL THEN 'FAIL' ELSE 'get' END AS route FROM part LEFT JOIN supplier ON s_suppkey = p_partkey",
}

#: Moves of folders: into regions, into themselves, into nations.
MOVES = f"SELECT id AS folder, CASE WHEN id % 3 = 0 THEN 1 + id % 5 WHEN id % 3 = 1 THEN id ELSE 100 + id % 25 END AS target FROM {FOLDERS} f"

#: Walks up the folders: as SQL a recursion, which Spark ends at a million rows, so it serves as
#: the oracle only; ``lectern.operators.folders`` walks in Spark.
TREE_SQL = {
    "folder_ancestors": f"WITH RECURSIVE {ANCESTORS} SELECT folder, @[listagg(name, '/') WITHIN GROUP (ORDER BY steps DESC)@|string_agg(name, '/' ORDER BY steps DESC)@] AS path, count(*) AS depth FROM up GROUP BY folder",
    "folder_move_guard": f"""WITH RECURSIVE {ANCESTORS}, moves AS ({MOVES})
      SELECT m.folder, m.target, m.folder <> m.target AND u.at IS NULL AS allowed FROM moves m LEFT JOIN up u ON u.folder = m.target AND u.at = m.folder""",
}

#: One order of a whole table: as SQL a window in one task, which serves as the oracle only;
#: ``lectern.operators.ranking`` gives the places in Spark.
ORDER_SQL = {
    "library_sort": f"SELECT id, row_number() OVER (ORDER BY ord, created, id) AS manual, row_number() OVER (ORDER BY lower(title) DESC, id) AS z_to_a, row_number() OVER (ORDER BY created DESC, id) AS newest FROM {ITEMS} i WHERE NOT deleted",
    "manifest_view": f"SELECT id, title, coalesce(nullif(ord, 0), row_number() OVER (ORDER BY ord, created, id)) AS place FROM {ITEMS} i WHERE kind = 'paper' AND NOT deleted",
}

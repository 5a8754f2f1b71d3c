"""SQL with the same results, where SQL can express them."""

_SAME = "query_index, total_queries, query_start, query_stop, ref_id, ref_start, ref_stop, match_score, time_factor, frequency_factor, coverage, run_at"

ORACLE = {
    "p1_found": f"""
WITH v AS (SELECT line_id, trim(query_path, ' ' || chr(9)) AS query_path, trim(ref_path, ' ' || chr(9)) AS ref_path, {_SAME} FROM result_lines
  WHERE query_path IS NOT NULL AND ref_path IS NOT NULL AND match_score IS NOT NULL),
d AS (SELECT query_path, ref_path, {_SAME}, min(line_id) AS line_id FROM v GROUP BY query_path, ref_path, {_SAME})
SELECT query_path, line_id FROM d QUALIFY row_number() OVER (PARTITION BY query_path ORDER BY match_score DESC, ref_id, line_id) <= 5""",
    "p2_found": "SELECT hash FROM postings WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) * 1000 >= (SELECT count(hash) FROM postings)",
    "p2_bounds": "SELECT hash, count(*) AS n_rows, true AS within FROM postings WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) * 1000 >= (SELECT count(hash) FROM postings)",
    "p8_kept": """
WITH a AS (SELECT lower(trim(source, ' ' || chr(9))) AS source, count(*) AS n FROM documents WHERE text <> '' AND source IS NOT NULL GROUP BY 1)
SELECT m.mixture, t.source, coalesce(n, 0) AS available, true AS once, true AS capped, true AS close FROM mix_targets t CROSS JOIN (VALUES ('shares'), ('capped')) m(mixture) LEFT JOIN a ON a.source = t.source""",
    "p9_held_out": "SELECT reading_level, count(*) AS judged, true AS agree FROM reading_levels WHERE reading_level IS NOT NULL AND doc_id % 2 = 1 GROUP BY 1",
    "p5_found": """
WITH RECURSIVE e AS (SELECT DISTINCT trim(query_path, ' ' || chr(9)) AS a, trim(ref_path, ' ' || chr(9)) AS b FROM dedup_lines WHERE query_path IS NOT NULL AND ref_path IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS item, a AS seen FROM s UNION SELECT r.item, s.b FROM r JOIN s ON r.seen = s.a)
SELECT item AS item_path, min(seen) AS group_path FROM r GROUP BY item""",
}

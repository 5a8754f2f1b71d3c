"""Queries over the project's tables for the general problems, with the same result in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.operators.intervals import periods_and_gaps
from echolattice.operators.skew import profile_both_ways
from echolattice.sources.rawlines import parse_result_lines
from echolattice.sources.tables import millis, table, trimmed


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods covered by matches and the gaps between them, of each file as query and as reference."""
    lines = table(spark, folder, "result_lines").where("query_path IS NOT NULL AND ref_path IS NOT NULL")
    side = lambda name, p: F.struct(F.lit(name).alias("side"), trimmed(f"{p}_path").alias("item_path"), millis(f"{p}_start").alias("s"), millis(f"{p}_stop").alias("t"))
    rows = lines.select(F.inline(F.array(side("query", "query"), side("ref", "ref"))))
    return periods_and_gaps(rows, ["side", "item_path"], "s", "t").select("side", "item_path", "kind", F.col("start_at").alias("start_ms"), F.col("stop_at").alias("stop_ms"))


def p4_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct partners, first and last frame of every hash and of every resource."""
    found = profile_both_ways(table(spark, folder, "postings"), "hash", "resource_id", "t1")
    return found.select("field_name", "key_value", "n_rows", "n_partners", F.col("first_value").alias("first_t1"), F.col("last_value").alias("last_t1"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that hold at least 3 of 100 rows in which the field isn't null."""
    found = profile_both_ways(table(spark, folder, "postings"), "hash", "resource_id", "t1")
    return found.where("n_rows * 100 >= field_rows * 3").select("field_name", "key_value")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that can't be parsed, with the reason."""
    return parse_result_lines(table(spark, folder, "raw_result_lines")).where("reason IS NOT NULL").select("line_no", "reason")


def p6_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The valid lines as typed rows."""
    return parse_result_lines(table(spark, folder, "raw_result_lines")).where("reason IS NULL").drop("reason", "reason_at")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_keys": p4_keys, "p6_found": p6_found, "p6_lines": p6_lines}

_SIDES = """
  SELECT 'query' AS side, trim(query_path, ' ' || chr(9)) AS item_path, CAST(round(query_start * 1000) AS BIGINT) AS s, CAST(round(query_stop * 1000) AS BIGINT) AS t
  FROM result_lines WHERE query_path IS NOT NULL AND ref_path IS NOT NULL
  UNION ALL
  SELECT 'ref', trim(ref_path, ' ' || chr(9)), CAST(round(ref_start * 1000) AS BIGINT), CAST(round(ref_stop * 1000) AS BIGINT)
  FROM result_lines WHERE query_path IS NOT NULL AND ref_path IS NOT NULL
"""
_FIELD = """[ \\t\\r]*"(?:[^"]|"")*"[ \\t\\r]*|[ \\t\\r]*(?:[^";\\t\\r ][^";]*)?"""
_SPLIT = f"""
  SELECT line_no, regexp_full_match(raw_line, '(?s)(?:{_FIELD})(?:;(?:{_FIELD}))*') AS quoted_well,
    regexp_full_match(raw_line, '(?s)(?:{_FIELD})(?:;(?:{_FIELD})){{12}}') AS wide,
    [CASE WHEN f LIKE '"%' THEN replace(f[2:-2], '""', '"') ELSE f END FOR f IN [trim(g, ' ' || chr(9) || chr(13)) FOR g IN
      regexp_extract_all(raw_line, '(?s)(?:^|;)({_FIELD})', 1)]] AS f
  FROM raw_result_lines
"""
_INT = lambda i, kind: f"regexp_full_match(f[{i}], '-?[0-9]+') AND try_cast(f[{i}] AS {kind}) IS NOT NULL"
_REAL = lambda i: f"regexp_full_match(f[{i}], '-?[0-9]+(\\.[0-9]+)?') AND isfinite(try_cast(f[{i}] AS DOUBLE))"
_FACTOR = lambda i: f"regexp_full_match(f[{i}], '-?[0-9]+(\\.[0-9]+)?[ \\t\\r]*%?')"
_PATH = lambda i: f"trim(f[{i}], ' ' || chr(9) || chr(13)) <> ''"
_VALID = " AND ".join(f"({x})" for x in (_INT(1, "INT"), _INT(2, "INT"), _PATH(3), _REAL(4), _REAL(5), _PATH(6), _INT(7, "INT") + " OR f[7] = 'null'", _REAL(8), _REAL(9), _INT(10, "BIGINT"), _FACTOR(11), _FACTOR(12), _REAL(13)))
_NUM = lambda i: f"CAST(regexp_extract(f[{i}], '-?[0-9]+(\\.[0-9]+)?') AS DOUBLE)"

ORACLE = {
    "p3_found": f"""
WITH v AS (SELECT DISTINCT * FROM ({_SIDES}) WHERE s < t),
m AS (SELECT *, max(t) OVER (PARTITION BY side, item_path ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY side, item_path ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT side, item_path, min(s) AS start_ms, max(t) AS stop_ms FROM g GROUP BY side, item_path, island),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY side, item_path ORDER BY start_ms) AS next_ms FROM p)
SELECT side, item_path, 'period' AS kind, start_ms, stop_ms FROM p
UNION ALL SELECT side, item_path, 'gap', stop_ms, next_ms FROM n WHERE next_ms IS NOT NULL""",
    "p4_keys": """
SELECT 'hash' AS field_name, hash AS key_value, count(*) AS n_rows, count(DISTINCT resource_id) AS n_partners, min(t1) AS first_t1, max(t1) AS last_t1 FROM postings WHERE hash IS NOT NULL GROUP BY hash
UNION ALL
SELECT 'resource_id', CAST(resource_id AS BIGINT), count(*), count(DISTINCT hash), min(t1), max(t1) FROM postings WHERE resource_id IS NOT NULL GROUP BY resource_id""",
    "p4_found": """
SELECT 'hash' AS field_name, hash AS key_value FROM postings WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) * 100 >= 3 * (SELECT count(hash) FROM postings)
UNION ALL
SELECT 'resource_id', CAST(resource_id AS BIGINT) FROM postings WHERE resource_id IS NOT NULL GROUP BY resource_id HAVING count(*) * 100 >= 3 * (SELECT count(resource_id) FROM postings)""",
    "p6_found": f"""
SELECT line_no, CASE WHEN NOT coalesce(quoted_well, true) THEN 'quoting' WHEN NOT coalesce(wide, false) THEN 'columns' ELSE 'value' END AS reason
FROM ({_SPLIT}) WHERE NOT (coalesce(quoted_well, false) AND wide AND coalesce({_VALID}, false))""",
    "p6_lines": f"""
SELECT line_no, CAST(f[1] AS INT) AS query_index, CAST(f[2] AS INT) AS total_queries, f[3] AS query_path, {_NUM(4)} AS query_start, {_NUM(5)} AS query_stop, f[6] AS ref_path, try_cast(f[7] AS INT) AS ref_id,
  {_NUM(8)} AS ref_start, {_NUM(9)} AS ref_stop, CAST(f[10] AS BIGINT) AS match_score, {_NUM(11)} AS time_factor, {_NUM(12)} AS frequency_factor, {_NUM(13)} AS seconds_with_match
FROM ({_SPLIT}) WHERE coalesce(quoted_well, false) AND wide AND {_VALID}""",
}

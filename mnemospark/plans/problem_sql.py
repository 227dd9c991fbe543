"""DuckDB SQL for the general problems' queries."""

_STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}\x{{1c}}-\x{{1f}}]+|[\s\p{{Z}}\x{{1c}}-\x{{1f}}]+$', '', 'g')"


def strip(c: str) -> str:
    """SQL for ``c`` without surrounding white space."""
    return _STRIP.format(c=c)


# DuckDB takes a comma before a closing bracket, which is not JSON.
_P4 = r"""
WITH RECURSIVE base AS (
  SELECT 'adb_vectors' AS source_table, collection_id || '|' || id AS record_id, arg_max(coalesce(metadata, chr(0)), (updated_at, created_at)) AS j FROM adb_vectors GROUP BY collection_id, id
  UNION ALL SELECT 'nodes', id, arg_max(coalesce(data, chr(0)), (updated_at, created_at)) FROM nodes GROUP BY id
  UNION ALL SELECT 'workflows', id, arg_max(coalesce(input, chr(0)), (updated_at, created_at)) FROM workflows GROUP BY id
), valid AS (
  SELECT source_table, record_id, j::JSON AS j FROM base WHERE json_valid(j) AND NOT regexp_matches(j, ',\s*[}\]]')
), opened AS (
  SELECT source_table, record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') AND NOT regexp_matches(j ->> '$', ',\s*[}\]]') THEN (j ->> '$')::JSON END ELSE j END AS j FROM valid
), t AS (
  SELECT source_table, record_id, '$' AS path, j AS node, false AS in_array FROM opened WHERE j IS NOT NULL
  UNION ALL
  SELECT source_table, record_id, t.path || CASE WHEN json_type(node) = 'ARRAY' THEN '[' || e.key || ']' ELSE '.' || e.key END, e.value, json_type(node) = 'ARRAY'
  FROM t, json_each(t.node) e WHERE json_type(node) IN ('ARRAY', 'OBJECT')
)
SELECT DISTINCT source_table, record_id, path FROM t WHERE in_array AND json_type(node) = 'OBJECT'
"""


def _ref(source: str, field: str, key: str, target: str, at: str) -> str:
    return f"SELECT '{source}' AS source_table, '{field}' AS field_name, {key} AS record_key, lower({strip(field)}) AS ref_key, {at} AS moment, '{target}' AS target FROM {source}"


_EDGE = "coalesce(src, '') || '|' || coalesce(dst, '') || '|' || coalesce(relation, '')"
_P6 = f"""
WITH refs AS (
  {_ref('edges', 'src', _EDGE, '_adb_nodes', 'created_at')}
  UNION ALL {_ref('edges', 'dst', _EDGE, '_adb_nodes', 'created_at')}
  UNION ALL {_ref('adb_vectors', 'collection_id', 'id', '_adb_collections', 'created_at')}
  UNION ALL {_ref('workflow_steps', 'workflow_id', 'id', '_adb_workflows', 'coalesce(started_at, completed_at)')}
), targets AS (
  SELECT target, id, min(created_at) AS made FROM (
    SELECT '_adb_nodes' AS target, id, created_at FROM nodes UNION ALL SELECT '_adb_collections', id, created_at FROM adb_collections
    UNION ALL SELECT '_adb_workflows', id, created_at FROM workflows) GROUP BY target, id
), gone AS (
  SELECT DISTINCT table_name AS target, record_id AS id FROM audit_log WHERE lower({strip('action')}) = 'delete'
)
SELECT DISTINCT source_table, field_name, record_key, ref_key, coalesce(strftime(make_timestamp(moment * 1000), '%Y-%m'), 'unknown') AS period,
  CASE WHEN t.id IS NOT NULL THEN 'late' WHEN g.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason
FROM refs r LEFT JOIN targets t ON t.target = r.target AND t.id = r.ref_key LEFT JOIN gone g ON g.target = r.target AND g.id = r.ref_key
WHERE ref_key <> '' AND (t.id IS NULL OR made > moment)
"""

_P7 = f"""
WITH e AS (
  SELECT DISTINCT id, timestamp AS moment, lower({strip('action')}) AS act, table_name, record_id, new_value, TRY_CAST(json_extract_string(CASE WHEN json_valid(new_value) THEN new_value END, '$.rev') AS DOUBLE) AS rev FROM audit_log
), effective AS (
  SELECT * FROM e WHERE act = 'delete' OR (act IN ('insert', 'update') AND new_value IS NOT NULL)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY table_name, record_id ORDER BY moment, rev NULLS FIRST, id) AS n FROM effective
), last AS (
  SELECT table_name, record_id, coalesce(max(n) FILTER (act = 'delete'), 0) AS removed, max(n) FILTER (act = 'insert') AS made, max(n) FILTER (act <> 'delete') AS current FROM placed GROUP BY ALL
)
SELECT p.table_name, p.record_id, p.id FROM last l JOIN placed p ON p.table_name = l.table_name AND p.record_id = l.record_id AND p.n = l.current WHERE made > removed
"""

ORACLES = {
    "p4_found": _P4,
    "p6_found": _P6,
    "p6_counts": f"SELECT source_table, field_name, period, reason, count(*) AS n FROM ({_P6}) GROUP BY ALL",
    "p7_found": _P7,
}

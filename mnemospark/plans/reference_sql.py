"""DuckDB SQL for the queries of :mod:`reference`."""

import re

from .reference import SHARED

ORACLES: dict[str, str] = {n: re.sub(r"\{(\w+)\}", r"\1", t) for n, (t, _) in SHARED.items()}

_COS = "CASE WHEN sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(q.v, q.v)) = 0 THEN 1.0 ELSE 1 - list_inner_product(a.v, q.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(q.v, q.v))) END"
_METRIC = {"cosine": _COS, "l2": "list_distance(a.v, q.v)", "dot": "-list_inner_product(a.v, q.v)"}
_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def _topk(metric: str, where: str = "true") -> str:
    return f"WITH {_E} SELECT a.id, round({_METRIC[metric]}, 6) AS score FROM e a, (SELECT v FROM e WHERE id = 0) q WHERE {where} ORDER BY {_METRIC[metric]}, a.id LIMIT 10"


ORACLES |= {
    "vec_cosine_topk": _topk("cosine"),
    "vec_l2_topk": _topk("l2"),
    "vec_dot_topk": _topk("dot"),
    "vec_filtered_topk": _topk("cosine", "a.label IN (1, 3, 5)"),
    "vec_overfetch_filtered": f"WITH {_E}, near AS (SELECT a.id, a.label, {_COS} AS s FROM e a, (SELECT v FROM e WHERE id = 0) q ORDER BY s, a.id LIMIT 100) SELECT id, round(s, 6) AS score FROM near WHERE label = 4 ORDER BY s, id LIMIT 10",
    "vec_knn_join": f"WITH {_E}, s AS (SELECT q.id AS query_id, a.id, {_COS} AS s FROM e q JOIN e a ON a.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, id)::INTEGER AS rank FROM s) SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 5",
    "vec_upsert_latest": "SELECT id, collection_id, max(updated_at) AS updated_at, arg_max(created_at, (updated_at, created_at)) AS created_at FROM adb_vectors GROUP BY id, collection_id",
    "vec_collection_stats": "SELECT name, dim, metric, count(v.id) AS count FROM adb_collections c LEFT JOIN (SELECT DISTINCT id, collection_id FROM adb_vectors) v ON v.collection_id = c.id GROUP BY c.id, name, dim, metric",
    "vec_zero_norm": "SELECT vec_id AS id, 1.0::DOUBLE AS cosine, 0.0::DOUBLE AS dot FROM embeddings",
}

_K = "json_extract(props, '$.k')::BIGINT"
_NODES = "n AS (SELECT id, arg_max(coalesce(data, chr(0)), (updated_at, created_at)) AS j FROM nodes GROUP BY id), m AS (SELECT id, CASE WHEN json_valid(j) AND NOT regexp_matches(j, ',\\s*[}\\]]') THEN j::JSON END AS j FROM n)"
_LABEL = "json_type(j, '$.label') = 'VARCHAR'"
ORACLES |= {
    "filter_eq_ne": f"SELECT event_id FROM events WHERE {_K} = 7",
    "filter_range": f"SELECT event_id FROM events WHERE {_K} >= 10 AND {_K} < 20",
    "filter_in_nin": f"SELECT event_id FROM events WHERE {_K} IN (1, 3)",
    "filter_exists": f"WITH {_NODES} SELECT id FROM m WHERE json_type(j) = 'OBJECT' AND json_exists(j, '$.origin') AND NOT json_exists(j, '$.facts')",
    "filter_contains_regex": f"WITH {_NODES} SELECT id FROM m WHERE {_LABEL} AND contains(j ->> '$.label', 'o') AND regexp_matches(j ->> '$.label', '^[a-m].*n')",
    "filter_and_or_not": f"SELECT event_id FROM events WHERE {_K} > 5 AND {_K} <= 50 AND ({_K} = 6 OR {_K} >= 40)",
    "filter_dotted": f"WITH {_NODES} SELECT id FROM m WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.origin') = 'OBJECT' AND json_type(j, '$.origin.agent') = 'VARCHAR' AND j ->> '$.origin.agent' = 'graph layer'",
    "filter_float_not_int": "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 0",
}

_G = """c AS (SELECT count(*) AS n FROM embeddings), g AS (
  SELECT vec_id::VARCHAR AS src, ((a * vec_id + b) % n)::VARCHAR AS dst, relation, ((31 * vec_id + 17 * k) % 100) / 100.0 AS weight
  FROM embeddings, c, (VALUES (0, 'next', 1, 1), (1, 'cites', 7, 3), (2, 'similar', 13, 5)) r(k, relation, a, b)
  UNION ALL VALUES ('0', '0', 'self', 0.5), ('0', '9', 'bad', -0.5))"""


def _walk(depth: int, least: float = 0.0, relation: str | None = None, start: str = "SELECT '0' AS s") -> str:
    rel = f" AND g.relation = '{relation}'" if relation else ""
    return f"""p(start, id, depth, weight, seen) AS (
  SELECT s, g.dst, 1, g.weight::DOUBLE, [g.src, g.dst] FROM g, ({start}) x WHERE g.src = x.s AND g.weight >= {least}{rel}
  UNION ALL SELECT p.start, g.dst, p.depth + 1, g.weight::DOUBLE, list_append(p.seen, g.dst) FROM p JOIN g ON g.src = p.id WHERE p.depth < {max(depth, 1)} AND g.weight >= {least}{rel} AND NOT list_contains(p.seen, g.dst)
), reach AS (SELECT start, id, min(depth)::INTEGER AS depth, max(weight) AS weight FROM p GROUP BY start, id)"""


def _neighbors(depth: int, **kw) -> str:
    return f"WITH RECURSIVE {_G}, {_walk(depth, **kw)} SELECT r.id, e.label::VARCHAR AS kind, depth, round(weight, 6) AS weight FROM reach r JOIN embeddings e ON e.vec_id::VARCHAR = r.id"


ORACLES |= {f"graph_neighbors_d{d}": _neighbors(d) for d in (0, 1, 2, 3, 5)}
_EDGES = "g AS (SELECT src, dst, relation, arg_max(weight, (created_at, weight)) AS weight FROM edges GROUP BY src, dst, relation)"
ORACLES |= {
    "graph_relation": _neighbors(3, relation="cites"),
    "graph_min_weight": _neighbors(3, least=0.3),
    "graph_negative": _neighbors(1, least=-1.0),
    "graph_bfs_depth": f"WITH RECURSIVE {_G}, {_walk(4)} SELECT id, depth FROM reach",
    "graph_walk_all": f"WITH RECURSIVE {_G}, {_walk(2, start='SELECT vec_id::VARCHAR AS s FROM embeddings')} SELECT start, id, depth, round(weight, 6) AS weight FROM reach",
    "graph_store_walk": f"WITH RECURSIVE {_EDGES}, {_walk(2, start='SELECT DISTINCT src AS s FROM g WHERE length(trim(src)) > 0')} SELECT start, id, depth, round(weight, 6) AS weight FROM reach",
    "graph_by_kind": "SELECT id, kind, created_at, updated_at FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, created_at DESC) = 1 AND kind = 'task'",
    "graph_stats": "SELECT (SELECT count(DISTINCT id) FROM nodes) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst, relation FROM edges)) AS edges",
    "graph_valid_edges": "SELECT DISTINCT src, dst, relation FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)",
}

_TOK = "regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+')"
_ID, _TXT = _TOK.format(c="doc_id::VARCHAR"), _TOK.format(c="coalesce(text, '')")
_DOCS = f"""d AS (SELECT doc_id::VARCHAR AS doc_id, {_ID} AS i, {_TXT} AS t FROM documents), st AS (SELECT count(*) AS total, avg(len(i) + len(t)) AS average FROM d),
 w AS (SELECT doc_id, len(i) + len(t) AS length, unnest(list_concat(i, t)) AS term FROM d)"""


def _score(hits: str) -> str:
    """hits has (phrase, doc_id, length, tf)."""
    return f"""h AS ({hits}), n AS (SELECT phrase, count(*) AS n FROM h GROUP BY phrase),
 s AS (SELECT doc_id, -sum(CASE WHEN ln((total - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n + 0.5) / (n + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS rank, list(phrase) AS phrases FROM h JOIN n USING (phrase), st GROUP BY doc_id)"""


_TERMS = "SELECT term AS phrase, doc_id, any_value(length) AS length, count(*)::DOUBLE AS tf FROM w WHERE term IN ({terms}) GROUP BY term, doc_id"
_PHRASE = "SELECT 'p' AS phrase, doc_id, len(i) + len(t) AS length, len(list_filter(range(1, len(t)), lambda k: t[k] = 'cache' AND t[k + 1] = 'layer'))::DOUBLE AS tf FROM d WHERE len(list_filter(range(1, len(t)), lambda k: t[k] = 'cache' AND t[k + 1] = 'layer')) > 0"
_PREFIX = "SELECT 'p' AS phrase, doc_id, any_value(length) AS length, count(*)::DOUBLE AS tf FROM w WHERE starts_with(term, 'reindex') GROUP BY doc_id"


_OR_TERMS = _TERMS.format(terms="'gateway', 'sandbox'")


def _fts(hits: str, where: str = "true") -> str:
    return f"WITH {_DOCS}, {_score(hits)} SELECT doc_id, round(rank, 6) AS rank FROM s WHERE {where}"


_GRAPH_SCORES = f"{_G}, {_walk(2)}"
_VEC = f"{_E}, near AS (SELECT a.id::VARCHAR AS id, {_COS} AS s FROM e a, (SELECT v FROM e WHERE id = 0) q ORDER BY s, a.id::VARCHAR LIMIT {{fetch}}), sim AS (SELECT id, 1 - (s - min(s) OVER ()) / greatest(max(s) OVER () - min(s) OVER (), 1e-6) AS sim FROM near)"
ORACLES |= {
    "fts_bm25_unstemmed": _fts(_TERMS.format(terms="'scheduler', 'checkpoint'"), "len(phrases) = 2"),
    "fts_phrase": _fts(_PHRASE),
    "fts_prefix": _fts(_PREFIX),
    # NOT binds tighter than OR
    "fts_or_not": f"WITH {_DOCS}, {_score(_OR_TERMS)}, no AS (SELECT DISTINCT doc_id FROM w WHERE term = 'planner'), gate AS (SELECT DISTINCT doc_id FROM w WHERE term = 'gateway') SELECT doc_id, round(rank, 6) AS rank FROM s WHERE doc_id IN (SELECT doc_id FROM gate) OR doc_id NOT IN (SELECT doc_id FROM no)",
    "fts_doc_id": _fts(_TERMS.format(terms="'17'")),
    "fts_messages": f"""WITH m AS (SELECT id, arg_max(content, (created_at, content)) AS content FROM messages GROUP BY id), d AS (SELECT id AS doc_id, {_TOK.format(c="coalesce(content, '')")} AS t FROM m),
 st AS (SELECT count(*) AS total, avg(len(t)) AS average FROM d), w AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d), {_score(_TERMS.format(terms="'gateway'"))} SELECT doc_id AS id, round(rank, 6) AS rank FROM s ORDER BY s.rank, doc_id LIMIT 25""",
    "hybrid_bimodal": f"WITH RECURSIVE {_GRAPH_SCORES}, {_VEC.format(fetch=200)} SELECT s.id, round(0.6 * sim + 0.4 * coalesce(greatest(weight, 0), 0), 6) AS score, round(sim, 6) AS vector_score, round(coalesce(greatest(weight, 0), 0), 6) AS graph_weight FROM sim s LEFT JOIN reach r ON r.id = s.id ORDER BY 0.6 * sim + 0.4 * coalesce(greatest(weight, 0), 0) DESC, s.id LIMIT 10",
    "hybrid_trimodal": f"""WITH RECURSIVE {_GRAPH_SCORES}, {_VEC.format(fetch=400)}, gs AS (SELECT id, (weight - min(weight) OVER ()) / greatest(max(weight) OVER () - min(weight) OVER (), 1e-9) AS gs FROM (SELECT id, greatest(weight, 0) AS weight FROM reach)),
 {_DOCS}, {_score(_TERMS.format(terms="'gateway'"))}, th AS (SELECT doc_id AS id, -rank AS r FROM s ORDER BY rank, doc_id LIMIT 400), ts AS (SELECT id, (r - min(r) OVER ()) / greatest(max(r) OVER () - min(r) OVER (), 1e-9) AS ts FROM th),
 o AS (SELECT id, sim, gs, ts, 0.4 * coalesce(sim, 0) + 0.3 * coalesce(gs, 0) + 0.3 * coalesce(ts, 0) AS score FROM sim FULL JOIN gs USING (id) FULL JOIN ts USING (id))
 SELECT id, round(score, 6) AS score, round(sim, 6) AS vector_score, round(gs, 6) AS graph_score, round(ts, 6) AS text_score FROM o ORDER BY o.score DESC, id LIMIT 20""",
    "trimodal_single_channel": f"WITH RECURSIVE {_G}, {_walk(3)}, gs AS (SELECT id, (weight - min(weight) OVER ()) / greatest(max(weight) OVER () - min(weight) OVER (), 1e-9) AS gs FROM (SELECT id, greatest(weight, 0) AS weight FROM reach)) SELECT id, round(gs, 6) AS score, round(gs, 6) AS graph_score FROM gs ORDER BY gs DESC, id LIMIT 30",
}

_M = "m AS (SELECT * FROM messages WHERE conversation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, conversation_id DESC, role DESC, content DESC) = 1)"
_W = "wf AS (SELECT * FROM workflows QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, created_at DESC, name DESC, status DESC) = 1), ws AS (SELECT workflow_id, count(*) AS n FROM (SELECT DISTINCT id, workflow_id, step_index FROM workflow_steps) GROUP BY workflow_id)"
_C = "c AS (SELECT * FROM context_entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY included_at DESC, session_id DESC, token_count DESC, relevance_score DESC, priority DESC) = 1)"
_A = "a AS (SELECT * FROM audit_log QUALIFY row_number() OVER (PARTITION BY id) = 1)"
_O = "o AS (SELECT event_id, event_id::VARCHAR AS op_id, ((epoch_us(ts) // 1000) << 16) | (event_id & 65535) AS hlc_ts, event_type AS table_name, user_id::VARCHAR AS record_id FROM events)"


def _workflows(where: str) -> str:
    return f"WITH {_W} SELECT id, name, status, created_at, coalesce(n, 0) AS step_count FROM wf LEFT JOIN ws ON ws.workflow_id = wf.id WHERE {where}"


def _last(value: str, where: str) -> str:
    return f"arg_max({value}, (l_linenumber, {value})) FILTER ({where})"


def _sync(direction: str) -> str:
    return f"WITH {_O} SELECT table_name, record_id, op_id, hlc_ts FROM o QUALIFY row_number() OVER (PARTITION BY table_name, record_id ORDER BY hlc_ts {direction}, event_id % 2, event_id) = 1"


ORACLES |= {
    "conv_last_n": f"WITH {_M}, b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) <= 5) SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id)::INTEGER AS position FROM b",
    "conv_list": f"WITH {_M} SELECT conversation_id, count(*) AS messages, min(created_at) AS created_at, max(created_at) AS updated_at FROM m GROUP BY conversation_id",
    "conv_transcript": f"WITH {_M}, o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) - 1 AS n FROM m), l AS (SELECT conversation_id, n // 1000 AS part, string_agg(CASE WHEN lower(role) IN ('ai', 'assistant', 'system') THEN 'AI' ELSE 'Human' END || ': ' || coalesce(content, ''), chr(10) ORDER BY n) AS t FROM o GROUP BY ALL) SELECT conversation_id, part, length(t)::INTEGER AS chars, md5(t) AS digest FROM l",
    "conv_message_at": f"WITH {_M} SELECT conversation_id, id FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) = 2",
    "workflow_list_counts": _workflows("true"),
    "workflow_by_status": _workflows("status = 'completed'"),
    "workflow_step_fold": f"""WITH x AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'running' WHEN 'R' THEN 'failed' ELSE 'completed' END AS st FROM lineitem)
 SELECT l_orderkey AS step_id, {_last('st', 'true')} AS status, {_last('l_partkey::VARCHAR', "l_linestatus = 'O'")} AS output, {_last('l_suppkey::VARCHAR', "l_linestatus = 'F'")} AS error, {_last('l_quantity', "st = 'running'")} AS started_at, {_last('l_quantity', "st IN ('completed', 'failed')")} AS completed_at FROM x GROUP BY l_orderkey""",
    "workflow_number_steps": "WITH s AS (SELECT DISTINCT id, workflow_id, step_index AS old FROM workflow_steps WHERE workflow_id IS NOT NULL) SELECT id, workflow_id, old, row_number() OVER (PARTITION BY workflow_id ORDER BY old, id) - 1 AS step_index FROM s",
    "trace_tree": "WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN (c_custkey + 8) // 10 END AS parent_id FROM customer), t(id, parent_id, depth) AS (SELECT id, parent_id, 0 FROM c WHERE id = 2 UNION ALL SELECT c.id, c.parent_id, t.depth + 1 FROM c JOIN t ON c.parent_id = t.id) SELECT id, parent_id, depth FROM t",
    "tool_calls_recent": "SELECT event_id AS id, user_id::VARCHAR AS session_id, event_type AS tool_name, (epoch_us(ts) // 1000) AS created_at FROM events WHERE event_type = 'purchase' ORDER BY (epoch_us(ts) // 1000) DESC, event_id LIMIT 100",
    "audit_by_record": f"WITH {_A} SELECT id, timestamp, actor FROM a WHERE table_name = 'agent_state' AND record_id = 'agent-primary' ORDER BY timestamp DESC, id LIMIT 100",
    "audit_by_actor": f"WITH {_A} SELECT id, timestamp, record_id FROM a WHERE actor = 'agent-11' ORDER BY timestamp DESC, id LIMIT 100",
    "audit_recent": f"WITH {_A} SELECT id, timestamp FROM a ORDER BY timestamp DESC, id LIMIT 100",
    "context_window": f"""WITH RECURSIVE {_C}, r AS (SELECT session_id, id, coalesce(token_count, 0) AS t, row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, relevance_score DESC, id) AS n FROM c WHERE coalesce(token_count, 0) <= 4096),
 f(session_id, n, id, t, used, taken) AS (SELECT session_id, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT session_id FROM r) UNION ALL SELECT f.session_id, r.n, r.id, r.t, CASE WHEN f.used + r.t <= 4096 THEN f.used + r.t ELSE f.used END, f.used + r.t <= 4096 FROM f JOIN r ON r.session_id = f.session_id AND r.n = f.n + 1)
 SELECT session_id, id, t AS token_count, used FROM f WHERE taken""",
    "context_entries_order": f"WITH {_C} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, relevance_score DESC, id) AS place FROM c",
    "prompt_latest": "SELECT p_brand AS name, max(p_size * 1000000 + p_partkey) AS version, arg_max('Buy {{what}} of ' || p_name, p_size * 1000000 + p_partkey) AS template FROM part GROUP BY p_brand",
    "prompt_render": "SELECT p_partkey, 'Hi Ann, {{id}} is ' || p_name AS text FROM part",
    "labels_find": "SELECT doc_id::VARCHAR AS record_id, lower(trim(lang)) AS label, (epoch_us(ingested_at) // 1000) AS tagged_at FROM documents WHERE lower(trim(lang)) = 'de' ORDER BY (epoch_us(ingested_at) // 1000) DESC, doc_id::VARCHAR LIMIT 100",
    "sync_lww": _sync("DESC"),
    "sync_fww": _sync("ASC"),
    "sync_counts": f"""WITH {_O}, k AS (SELECT table_name, record_id, max(hlc_ts) AS known FROM o WHERE event_id % 2 = 0 GROUP BY ALL), r AS (SELECT o.*, known, max(hlc_ts) OVER (PARTITION BY o.table_name, o.record_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o LEFT JOIN k USING (table_name, record_id) WHERE event_id % 2 = 1),
 x AS (SELECT hlc_ts, CASE WHEN known IS NULL THEN before WHEN before IS NULL THEN known ELSE greatest(known, before) END AS met FROM r) SELECT count(*) FILTER (met IS NULL OR hlc_ts > met) AS applied, count(*) FILTER (met IS NOT NULL) AS conflicts, count(*) FILTER (met IS NOT NULL AND hlc_ts <= met) AS skipped FROM x""",
    "sync_pending": f"WITH {_O}, p AS (SELECT n_name AS peer_id, (1704067200000 + n_nationkey::BIGINT * 86400000) << 16 AS last_synced_hlc FROM nation) SELECT peer_id, last_synced_hlc, count(o.op_id) AS ops_pending FROM p LEFT JOIN o ON o.hlc_ts > p.last_synced_hlc GROUP BY peer_id, last_synced_hlc",
    "hlc_pack": f"WITH {_O} SELECT op_id, hlc_ts, hlc_ts >> 16 AS ms, hlc_ts & 65535 AS counter FROM o",
    "engine_stats": "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in ("adb_collections", "adb_vectors", "nodes", "edges", "messages", "workflows", "workflow_steps", "audit_log", "context_entries", "documents")),
    "events_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "events_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM e ORDER BY user_id, ts)) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
}

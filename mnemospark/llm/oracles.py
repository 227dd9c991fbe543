"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from ..plans.problem_sql import strip

_ROWS = f"""
WITH m AS (
  SELECT id, nullif(conversation_id, '') AS c, lower({strip('role')}) AS role, content, CASE WHEN created_at < 100000000000 THEN created_at * 1000 ELSE created_at END AS moment FROM messages
), once AS (
  SELECT * FROM m WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY moment, c, role, content) = 1
), kept AS (
  SELECT c, id, moment, content, CASE role WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' ELSE role END AS role FROM once
  WHERE regexp_matches(content, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]')
), turns AS (
  SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS n, count(*) OVER (PARTITION BY c) AS of FROM kept WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY c ORDER BY moment, id)
), found AS (
  SELECT DISTINCT c AS conversation_id FROM kept WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'system', 'tool')
  UNION SELECT c FROM turns WHERE (n = 1 AND role <> 'user') OR (n = of AND role <> 'assistant') OR (role = 'user' AND prev = 'user')
  UNION (SELECT c FROM once EXCEPT SELECT c FROM turns)
)"""
_P1 = f"{_ROWS} SELECT conversation_id FROM found"
_P1_TURNS = f"{_ROWS} SELECT c AS conversation_id, row_number() OVER (PARTITION BY c ORDER BY moment, id) AS turn, role, content, id, moment AS created_at FROM kept WHERE c NOT IN (SELECT conversation_id FROM found)"

# linked over replies, a conversation has the name of its least message; one of a single message has no link
_P1_LINKED = f"""{_ROWS}, names AS (SELECT c, 'link:' || min(id) AS name FROM once GROUP BY c HAVING count(*) > 1), sizes AS (SELECT c, count(*) AS n FROM kept GROUP BY c)
SELECT name AS conversation_id, coalesce(n, 0) AS turns, c IN (SELECT conversation_id FROM found) AS broken FROM names LEFT JOIN sizes USING (c)"""

_P3 = """
WITH newest AS (
  SELECT v.*, c.dim FROM adb_vectors v JOIN adb_collections c ON c.id = v.collection_id
  QUALIFY row_number() OVER (PARTITION BY v.id, v.collection_id ORDER BY v.updated_at DESC, v.created_at DESC) = 1
), usable AS (
  SELECT id, collection_id, vector::DOUBLE[] AS v FROM newest
  WHERE vector IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
)
SELECT a.collection_id, a.id AS id_a, b.id AS id_b FROM usable a JOIN usable b ON a.collection_id = b.collection_id AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.97
"""

_P9 = f"""
WITH s AS (
  SELECT lower({strip('source')}) AS source, sum(len(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+'))) AS size FROM documents GROUP BY 1
), t AS (SELECT m.source, target_share, max_repeats, coalesce(size, 0) AS size FROM mix_targets m LEFT JOIN s USING (source))
SELECT source FROM t WHERE size * max_repeats < target_share * (SELECT sum(size) FROM t)
"""

_P9_BOUNDS = f"""
WITH s AS (
  SELECT lower({strip('source')}) AS source, sum(len(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+'))) AS size FROM documents GROUP BY 1
), t AS (SELECT m.source, target_share, max_repeats, coalesce(size, 0) AS size FROM mix_targets m LEFT JOIN s USING (source))
SELECT source, size * max_repeats < target_share * (SELECT sum(size) FROM t) AS short, true AS repeats_kept, true AS size_kept FROM t
"""

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_P8 = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT least(13, len(w)) AS k FROM i WHERE len(w) > 0),
seeds AS (SELECT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
windows AS (SELECT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k))
SELECT DISTINCT doc_id, item_id FROM windows JOIN seeds USING (k, s)
"""

# the words of an item that lie in seeds of the document; where tiles overlap nowhere, these are the words in tiles
_P8_COVERED = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT least(13, len(w)) AS k FROM i WHERE len(w) > 0),
seeds AS (SELECT item_id, p, n, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT item_id, w, len(w) AS n, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
windows AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
marked AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(p, p + k)) AS place FROM windows JOIN seeds USING (k, s))
SELECT doc_id, item_id, count(*) AS covered, count(*) / n AS coverage, count(*) / n >= 0.6 AS leaked FROM marked GROUP BY doc_id, item_id, n
"""

_WINDOWS = """
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL AND length(text) >= 400),
w AS (SELECT doc_id, p, hash(substring(text, p, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS p FROM t)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), r AS (SELECT doc_id, p, h FROM w WHERE h IN (SELECT h FROM g))"""
_P10 = f"{_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id"
_P10_SHARES = f"""{_WINDOWS}, c AS (SELECT doc_id, sum(least(400, coalesce(nxt - p, 400)))::BIGINT AS n FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM (SELECT DISTINCT doc_id, p FROM r)) GROUP BY doc_id)
SELECT t.doc_id, length(text) AS chars, coalesce(n, 0) AS shared_chars, coalesce(n, 0) / length(text) AS share FROM t LEFT JOIN c ON c.doc_id = t.doc_id"""

ORACLES: dict[str, str] = {"p1_found": _P1, "p1_turns": _P1_TURNS, "p1_linked": _P1_LINKED, "p3_found": _P3, "p8_found": _P8, "p8_covered": _P8_COVERED, "p9_found": _P9, "p9_bounds": _P9_BOUNDS, "p10_found": _P10, "p10_shares": _P10_SHARES}

"""Queries on the engine's write side: each opens a store, changes it and returns what it then holds.

Each query stands with the DuckDB SQL for what must come out; where only single operations are shown, that is a list of
fixed rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.text import ms_of
from ..operators import graph, memory, sync, vector
from ..operators.filters import compile_filter, metadata_variant
from ..operators.ranking import latest_rows
from ..schemas import SCHEMAS, VERSION
from ..session import cut, load, scratch
from ..sources.adapters import ChatHistory, ChatStore, TextVectorStore
from ..sources.engine import Engine
from ..sources.service import Dispatcher
from ..sources.store import Store, create_statement, sql_dump
from ..streaming.feed import apply_feed, file_stream
from . import reference, reference_sql
from .sql import run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(sql: str):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return take


def _fixed(rows: Sequence[tuple], *names: str) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else str(v) if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(text(v) for v in r) + ')' for r in rows)}) t({', '.join(names)})"


def _engine(spark: SparkSession) -> Engine:
    return Engine.open(spark, scratch(spark, "engine"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.current_nodes(load(spark, d, "nodes")).filter("id IS NOT NULL AND kind IS NOT NULL")


_NODES = "n AS (SELECT id, arg_max(kind, (updated_at, created_at, kind)) AS kind FROM nodes WHERE id IS NOT NULL GROUP BY id)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.current_edges(load(spark, d, "edges").filter("src IS NOT NULL AND dst IS NOT NULL AND relation IS NOT NULL"))


_EDGES = "e AS (SELECT src, dst, relation FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND relation IS NOT NULL GROUP BY ALL)"


# ---- the store ----


@_add("SELECT unnest([" + ", ".join(f"'{t}'" for t in SCHEMAS) + "]) AS name, 0::BIGINT AS n")
def store_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a new store, all empty."""
    e = _engine(spark)
    counts = None
    for t in e.store.tables():
        one = e.store.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@_add(_fixed([("opened", "refused"), ("migrated", VERSION), ("again", VERSION), ("closed", "refused")], "step", "result"))
def store_version(spark: SparkSession, d: str) -> DataFrame:
    """A store of an older version is refused until it is migrated; a closed one takes no calls."""
    root = scratch(spark, "old")
    old = Store(spark, root)
    m = old.manifest()
    old._publish(m | {"schema_version": "4", "version": m["version"] + 1})
    steps = []
    try:
        Store(spark, root)
        steps.append(("opened", "taken"))
    except EngineError:
        steps.append(("opened", "refused"))
    for name in ("migrated", "again"):
        Store(spark, root, check=False).migrate()
        steps.append((name, Store(spark, root).manifest()["schema_version"]))
    new = Store(spark, root)
    new.close()
    try:
        new.manifest()
        steps.append(("closed", "taken"))
    except EngineError:
        steps.append(("closed", "refused"))
    return spark.createDataFrame(steps, "step string, result string")


@_add(f"WITH {_NODES} SELECT * FROM (VALUES ('inside', (SELECT count(*) FROM n)), ('after failure', 0), ('after success', (SELECT count(*) FROM n WHERE kind <> 'task'))) t(phase, rows)")
def store_transaction(spark: SparkSession, d: str) -> DataFrame:
    """Rows seen inside a transaction, after one that failed and after one that put and deleted."""
    e, nodes, seen = _engine(spark), cut(_nodes(spark, d)), []
    try:
        with e.store.transaction():
            e.store.put("nodes", nodes)
            seen.append(("inside", e.store.read("nodes").count()))
            raise KeyError("stop")
    except KeyError:
        seen.append(("after failure", e.store.read("nodes").count()))
    with e.store.transaction():
        e.store.put("nodes", nodes)
        e.store.delete("nodes", nodes.filter("kind = 'task'"))
    seen.append(("after success", e.store.read("nodes").count()))
    return spark.createDataFrame(seen, "phase string, rows long")


@_add(f"WITH {_NODES} SELECT * FROM n")
def store_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A store's nodes, read from a copy after the store itself was emptied."""
    e, path = _engine(spark), scratch(spark, "copy")
    e.store.put("nodes", _nodes(spark, d))
    e.store.snapshot(path)
    e.store.replace("nodes", e.store.read("nodes").limit(0))
    return Store(spark, path).read("nodes").select("id", "kind")


@_add(f"WITH {_NODES} SELECT f.format, count(*) AS n, count(DISTINCT kind) AS kinds FROM n, (VALUES ('parquet'), ('json'), ('csv'), ('orc')) f(format) GROUP BY f.format")
def store_export(spark: SparkSession, d: str) -> DataFrame:
    """Nodes exported in each format and read again."""
    e, out = _engine(spark), None
    e.store.put("nodes", _nodes(spark, d).withColumn("data", F.lit(None).cast("string")))
    for kind in ("parquet", "json", "csv", "orc"):
        path = scratch(spark, kind)
        e.store.export(path, kind, ["nodes"])
        one = spark.read.schema(SCHEMAS["nodes"]).format(kind).load(f"{path}/nodes").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds")).select(F.lit(kind).alias("format"), "n", "kinds")
        out = one if out is None else out.unionByName(one)
    return out


@_add("""SELECT 'INSERT INTO "nation" ("n_nationkey", "n_name") VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''');' AS statement FROM nation""")
def store_dump(spark: SparkSession, d: str) -> DataFrame:
    """A table as INSERT statements."""
    return sql_dump(load(spark, d, "nation").select("n_nationkey", "n_name"), "nation")


_COUNTS = {
    "collections": "SELECT count(DISTINCT id) FROM adb_collections", "vectors": "SELECT count(*) FROM (SELECT DISTINCT id, collection_id FROM adb_vectors WHERE id IS NOT NULL AND collection_id IS NOT NULL)",
    "nodes": "SELECT count(DISTINCT id) FROM nodes", "edges": f"WITH {_EDGES} SELECT count(*) FROM e", "conversations": "SELECT count(DISTINCT conversation_id) FROM messages", "messages": "SELECT count(DISTINCT id) FROM messages WHERE conversation_id IS NOT NULL",
    "workflows": "SELECT count(DISTINCT id) FROM workflows", "traces": "SELECT count(*) FROM customer", "tools": "SELECT count(DISTINCT event_type) FROM events", "tool_calls": "SELECT count(*) FROM events",
    "audit_log": "SELECT count(DISTINCT id) FROM audit_log", "context_entries": "SELECT count(DISTINCT id) FROM context_entries", "prompt_templates": "SELECT count(*) FROM part",
}


@_add("SELECT " + ", ".join(f"({v}) AS {k}" for k, v in _COUNTS.items()))
def engine_counters(spark: SparkSession, d: str) -> DataFrame:
    """The thirteen counters of a store that holds the test tables."""
    e = _engine(spark)
    m, calls, part = load(spark, d, "messages").filter("conversation_id IS NOT NULL"), load(spark, d, "events"), load(spark, d, "part")
    text = lambda c: F.col(c).cast("string")
    frames = {
        "collections": load(spark, d, "adb_collections").dropDuplicates(["id"]), "vectors": load(spark, d, "adb_vectors").filter("id IS NOT NULL AND collection_id IS NOT NULL").select("id", "collection_id", "updated_at"),
        "nodes": _nodes(spark, d), "edges": _edges(spark, d), "conversations": m.select(F.col("conversation_id").alias("id")).distinct(), "messages": m.select("id", "conversation_id", "created_at"),
        "workflows": load(spark, d, "workflows").select("id", "updated_at"), "traces": load(spark, d, "customer").select(text("c_custkey").alias("id")), "tools": calls.select(F.col("event_type").alias("name")).distinct(),
        "tool_calls": calls.select(text("event_id").alias("id"), F.col("event_type").alias("tool_name")), "audit_log": load(spark, d, "audit_log").dropDuplicates(["id"]), "context_entries": load(spark, d, "context_entries").select("id", "token_count"),
        "prompt_templates": part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("version")),
    }
    with e.store.transaction():
        for name, df in frames.items():
            e.store.put(name, df)
    return spark.createDataFrame([e.stats()], ", ".join(f"{c} long" for c in _COUNTS))


@_add(_fixed([('CREATE TABLE IF NOT EXISTS "data_labels" ("table_name" TEXT NOT NULL, "record_id" TEXT NOT NULL, "label" TEXT NOT NULL, "tagged_by" TEXT, "tagged_at" INTEGER NOT NULL, PRIMARY KEY ("table_name", "record_id", "label"));',)], "statement"))
def store_ddl(spark: SparkSession, d: str) -> DataFrame:
    """A table's CREATE statement, as an export has it."""
    return spark.createDataFrame([(create_statement(_engine(spark).store, "data_labels"),)], "statement string")


# ---- SQL changes ----


def _nations(spark: SparkSession, d: str) -> Engine:
    e = _engine(spark)
    e.execute("CREATE TABLE nat (key INTEGER PRIMARY KEY, name TEXT, region INTEGER)")
    e.store.put("nat", load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region")))
    return e


_NAT = "n AS (SELECT n_nationkey::BIGINT AS key, n_name AS name, n_regionkey::BIGINT AS region FROM nation)"


@_add(f"WITH {_NAT} SELECT key, CASE WHEN region = 2 AND name <> ' where ' THEN 'kept where it was, set = 1' ELSE name END AS name, CASE WHEN region = 2 THEN region + 40 ELSE region END AS region FROM n")
def sql_update_params(spark: SparkSession, d: str) -> DataFrame:
    """UPDATE with numbered parameters, and texts that hold its words."""
    e = _nations(spark, d)
    e.execute("UPDATE nat SET name = ?2, region = region + ?1 WHERE region = ?3 AND name <> ' where '", [40, "kept where it was, set = 1", 2])
    return e.query("SELECT key, name, region FROM nat")


@_add(f"WITH {_NAT} SELECT key, name, CASE WHEN key < 5 THEN 9 ELSE region END AS region FROM n")
def sql_coalesce_patch(spark: SparkSession, d: str) -> DataFrame:
    """A patch that leaves out what is null."""
    e = _nations(spark, d)
    e.execute("UPDATE nat SET name = coalesce(:name, name), region = coalesce(:region, region) WHERE key < :top", {"name": None, "region": 9, "top": 5})
    return e.query("SELECT * FROM nat")


@_add(f"WITH {_NAT} SELECT * FROM n UNION ALL VALUES (100::BIGINT, 'hundred', 7::BIGINT), (101, 'again', 101)")
def sql_insert_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Numbered parameters out of order and repeated."""
    e = _nations(spark, d)
    e.execute("INSERT INTO nat (region, key, name) VALUES (?3, ?1, ?2)", [100, "hundred", 7])
    e.execute("INSERT INTO nat VALUES (?1, ?2, ?1)", [101, "again"])
    return e.query("SELECT * FROM nat")


@_add(f"WITH {_NAT} SELECT key, CASE WHEN key % 2 = 0 AND region < 3 THEN 'new ' || name ELSE name END AS name, CASE WHEN key % 2 = 0 AND region < 3 THEN region + 10 ELSE region END AS region FROM n UNION ALL VALUES (500::BIGINT, 'more', 1::BIGINT)")
def sql_upsert(spark: SparkSession, d: str) -> DataFrame:
    """ON CONFLICT: new rows come in, known ones are updated under a condition or left."""
    e = _nations(spark, d)
    e.execute("INSERT INTO nat SELECT key, 'new ' || name, 10 FROM nat WHERE key % 2 = 0 ON CONFLICT (key) DO UPDATE SET name = excluded.name, region = region + excluded.region WHERE region < 3")
    e.execute("INSERT INTO nat VALUES (500, 'more', 1), (1, 'not this', 1) ON CONFLICT DO NOTHING")
    return e.query("SELECT * FROM nat")


@_add(f"WITH {_NAT} SELECT * FROM n WHERE key <> 3 UNION ALL VALUES (3::BIGINT, 'replaced', NULL), (77, 'kept', 7)")
def sql_replace_ignore(spark: SparkSession, d: str) -> DataFrame:
    """INSERT OR REPLACE and OR IGNORE, in a batch after one that fails as a whole."""
    e = _nations(spark, d)
    try:
        e.execute_batch("DELETE FROM nat; INSERT INTO nat VALUES (1, 'x', 1); SELECT FROM WHERE")
    except EngineError:
        pass
    e.execute_batch("INSERT OR REPLACE INTO nat VALUES (3, 'replaced', NULL); -- a comment; with a semicolon\nINSERT OR IGNORE INTO nat VALUES (77, 'kept', 7), (4, 'ignored', 0)")
    return e.query("SELECT * FROM nat")


@_add(f"WITH {_NODES}, {_EDGES}, k AS (SELECT id FROM n WHERE kind <> 'task') SELECT src, dst, relation FROM e WHERE src NOT IN (SELECT id FROM n WHERE kind = 'task') AND dst NOT IN (SELECT id FROM n WHERE kind = 'task')")
def sql_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Edges that are left when the nodes of a kind are deleted."""
    e = _engine(spark)
    e.store.put("nodes", _nodes(spark, d))
    e.store.put("edges", _edges(spark, d))
    e.execute("DELETE FROM nodes WHERE kind = ?", ["task"])
    return e.query("SELECT src, dst, relation FROM edges")


@_add(f"""WITH {_NAT} SELECT '{{"key":' || key || ',"name":"' || name || '","none":null,"bytes":"<blob 3 bytes>","ratio":null}}' AS row FROM n WHERE region = 1 OR key > 20""")
def sql_json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON: null, bytes and NaN, with parameters."""
    return _nations(spark, d).query_json("SELECT key, name, NULL AS none, CAST('abc' AS BINARY) AS bytes, double('NaN') AS ratio FROM nat WHERE region = ?1 OR key > ?2", [1, 20])


@_add("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS s, coalesce(o_comment_null, 'none') AS c, 'z' AS j FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_comment_null FROM orders)")
def sql_shims(spark: SparkSession, d: str) -> DataFrame:
    """Functions as SQLite spells them, on a table of the user's own."""
    e = _engine(spark)
    e.execute("CREATE TABLE o (k INTEGER, day TEXT, p TEXT)")
    e.store.put("o", load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("p")))
    return e.query("SELECT k AS o_orderkey, strftime('%s', day) AS s, IFNULL(p, 'none') AS c, json_extract('{\"a\": \"z\"}', '$.a') AS j FROM o WHERE datetime('now') IS NOT NULL")


@_add(_fixed([("id", 1), ("kind", 0), ("data", 0), ("created_at", 0), ("updated_at", 0)], "name", "pk"))
def sql_pragma(spark: SparkSession, d: str) -> DataFrame:
    """A PRAGMA goes to the reader like a SELECT."""
    return run(_engine(spark).store, "PRAGMA table_info(nodes)").select("name", F.col("pk").cast("long").alias("pk"))


# ---- vectors ----

_EMB = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _loaded(spark: SparkSession, d: str, metric: str = "cosine"):
    """An engine with a collection of all embeddings."""
    e, rows = _engine(spark), load(spark, d, "embeddings")
    dim = rows.select(F.size("embedding")).first()[0]
    c = e.collection("all", dim, metric)
    c.upsert_frame(rows.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata")))
    return e, c, [float(x) for x in rows.filter("vec_id = 0").first()["embedding"]]


@_add(f"WITH {_EMB}, q AS (SELECT e FROM v WHERE vec_id = 0), c AS (SELECT CASE vec_id WHEN 3 THEN 'again' ELSE vec_id::VARCHAR END AS id, CASE WHEN vec_id = 3 THEN (SELECT e FROM q) ELSE v.e END AS e FROM v WHERE vec_id NOT IN (5) UNION ALL SELECT '3', e FROM v WHERE vec_id = 3) SELECT id, round(list_distance(c.e, q.e), 6) AS score FROM c, q ORDER BY list_distance(c.e, q.e), id LIMIT 12")
def vec_engine_changes(spark: SparkSession, d: str) -> DataFrame:
    """Search after an insert, a replacement and a delete through a collection."""
    e, c, q = _loaded(spark, d, "euclidean")
    c.upsert("again", [0.0] * c.dim, {"label": 1})
    c.upsert_batch([("again", q, {"label": 2})])
    c.delete("5")
    c.delete("never there")
    return e.get_collection("all").search(q, 12).select("id", F.round("score", 6).alias("score"))


_COSINE = "1 - list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(q.e, q.e))"


@_add(f"WITH {_EMB}, q AS (SELECT e FROM v WHERE vec_id = 0) SELECT v.vec_id::VARCHAR AS id, round({_COSINE}, 6) AS score FROM v, q WHERE vec_id NOT IN (8, 9) ORDER BY {_COSINE}, id LIMIT 10")
def vec_engine_index(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search through the saved index, all lists, after rows were taken away and put back."""
    e, c, q = _loaded(spark, d)
    c.reindex(16)
    for i in ("8", "9"):
        c.delete(i)
    c.upsert("8", q)
    c.delete("8")
    return c.search(q, 10, mode="approx", probes=16).select("id", F.round("score", 6).alias("score"))


@_add("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vec_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index, with fewer lists probed than it has, meets 0.9 of the ten nearest of the stated queries."""
    e = reference._embeddings(spark, d)
    asked = e.filter("id % 100 = 0")
    found = vector.ListIndex(e, lists=16).knn_join(asked, 10, probes=14)
    best = vector.knn_join(asked, e, 10)
    hits = best.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*") >= 0.9).alias("enough"))


@_add("WITH s AS (SELECT id, collection_id, min(created_at) AS made, max(updated_at) AS latest FROM adb_vectors WHERE id IS NOT NULL AND collection_id IS NOT NULL GROUP BY ALL), o AS (SELECT id, collection_id, arg_min(created_at, (updated_at, created_at)) AS made FROM adb_vectors WHERE id IS NOT NULL AND collection_id IS NOT NULL GROUP BY ALL) SELECT s.id, s.collection_id, o.made AS created_at, s.latest AS updated_at FROM s JOIN o ON o.id = s.id AND o.collection_id = s.collection_id")
def vec_upsert_keeps_creation(spark: SparkSession, d: str) -> DataFrame:
    """First states upserted with all others: the newest update time, the first creation time."""
    v = load(spark, d, "adb_vectors").filter("id IS NOT NULL AND collection_id IS NOT NULL").select("id", "collection_id", "created_at", "updated_at")
    first = v.groupBy("id", "collection_id").agg(F.min(F.struct("updated_at", "created_at")).alias("r")).select("id", "collection_id", "r.created_at", "r.updated_at")
    return vector.upsert(first, v, ["id", "collection_id"], F.col("updated_at"))


@_add(_fixed([("docs", 2, "cosine", 1, True), ("other", 3, "dot", 0, True), ("again", 4, "euclidean", 0, False)], "name", "dim", "metric", "count", "there"))
def vec_collections(spark: SparkSession, d: str) -> DataFrame:
    """Collections made, found, and one dropped with its vectors and texts."""
    e = _engine(spark)
    e.collection("docs", 2).upsert_with_text("a", [1.0, 0.0], "a note")
    e.collection("other", 3, "dot")
    gone = e.collection("again", 4, "euclidean")
    gone.upsert_with_text("x", [1.0, 0.0, 0.0, 0.0], "a text")
    e.drop_collection("again")
    e.drop_collection("never there")
    left = e.list_collections().collect()
    texts = e.search_text("again", "text").count()
    rows = [(r["name"], r["dim"], r["metric"], r["count"], True) for r in left] + [("again", 4, "euclidean", gone.count() + texts, False)]
    return spark.createDataFrame(rows, "name string, dim long, metric string, count long, there boolean")


@_add("SELECT event_id FROM events WHERE props IS NOT NULL")
def filter_empty_operators(spark: SparkSession, d: str) -> DataFrame:
    """A field without operators, and a filter without fields, leave every row that has metadata."""
    e = load(spark, d, "events").select("event_id", "props")
    meta = metadata_variant(F.col("props"))
    return e.filter(compile_filter({"k": {}}, meta)).filter(compile_filter({}, meta)).select("event_id")


# ---- graph, text, hybrid ----


@_add(f"""WITH {_EDGES}, a AS (SELECT min(src) AS id FROM e WHERE trim(src) <> ''), k AS (SELECT e.* FROM e, a WHERE e.src <> a.id AND e.dst <> a.id), f AS (SELECT min(src || '|' || dst || '|' || relation) AS key FROM k)
SELECT src, dst, relation FROM k, f WHERE src || '|' || dst || '|' || relation <> key UNION ALL VALUES ('new one', 'new two', 'leads to')""")
def graph_engine_changes(spark: SparkSession, d: str) -> DataFrame:
    """Edges after nodes and edges were added and deleted one by one."""
    e, edges = _engine(spark), cut(_edges(spark, d))
    e.store.put("edges", edges)
    first = edges.filter("trim(src) <> ''").agg(F.min("src")).first()[0]
    e.add_node(first, "hub")
    e.delete_node(first)
    e.add_node("new one", "thing", {"a": 1})
    e.add_node("new two", "thing")
    e.add_edge("new one", "new two", "leads to", 0.5)
    e.add_edge("new one", "new two", "leads to", 0.7)
    least = e.store.read("edges").filter("src <> 'new one'").orderBy(F.concat_ws("|", "src", "dst", "relation")).first()
    e.delete_edge(least["src"], least["dst"], least["relation"])
    return e.store.read("edges").select("src", "dst", "relation")


@_add(_fixed([("new one", "thing", '{"a": 2}'), ("refused", None, None)], "id", "kind", "data"))
def graph_engine_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A node replaced and read; an edge to a missing node is refused."""
    e = _engine(spark)
    e.add_node("new one", "other", {"a": 1})
    e.add_node("new one", "thing", {"a": 2})
    n = e.get_node("new one")
    rows = [(n["id"], n["kind"], n["data"])]
    try:
        e.add_edge("new one", "nobody", "x")
        rows.append(("taken", None, None))
    except EngineError:
        rows.append(("refused", None, None))
    return spark.createDataFrame(rows, "id string, kind string, data string")


@_add("WITH t AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda x: x = '17')) AS tf FROM documents) SELECT DISTINCT doc_id::VARCHAR AS doc_id FROM t WHERE (tf > 0 OR doc_id = 17) AND doc_id NOT IN (SELECT min(doc_id) FROM t WHERE tf > 0) UNION ALL SELECT 'new'")
def fts_engine_changes(spark: SparkSession, d: str) -> DataFrame:
    """What matches after a text was put in place of another, one was added and one deleted, and the log compacted."""
    e = _engine(spark)
    texts = load(spark, d, "documents").select(F.lit("docs").alias("collection"), F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = cut(texts.groupBy("collection", "id").agg(F.max("text").alias("text")))
    e.store.put("texts", texts)
    hit = texts.filter(F.array_contains(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), "17")).agg(F.min(F.col("id").cast("long"))).first()[0]
    e.delete_text("docs", str(hit))
    e.index_text("docs", "new", "nothing")
    e.index_text("docs", "new", "number 17 once more")
    e.store.compact(["texts"])
    e.optimize_text("docs")
    return e.search_text("docs", "17", None).select("doc_id")


@_add(reference_sql.ORACLES["hybrid_bimodal"])
def hybrid_engine(spark: SparkSession, d: str) -> DataFrame:
    """Vector and graph through the engine."""
    e, _, q = _loaded(spark, d)
    e.store.put("edges", reference._graph(spark, d)[1])
    return e.hybrid_query("all", q, "0", 0.6, 2, 10).select("id", *[F.round(c, 6).alias(c) for c in ("score", "vector_score", "graph_weight")])


@_add(reference_sql.ORACLES["trimodal_single_channel"])
def trimodal_engine(spark: SparkSession, d: str) -> DataFrame:
    """The graph channel alone, through the engine."""
    e = _engine(spark)
    e.store.put("edges", reference._graph(spark, d)[1])
    return e.tri_modal_query("none", (), "0", "", 0.0, 1.0, 0.0, 3, 30).select("id", F.round("score", 6).alias("score"), F.round("graph_score", 6).alias("graph_score"))


# ---- memory ----


@_add(_fixed([("user", "second", "b"), ("assistant", "third", "b"), ("found", "third", "b")], "role", "content", "title"))
def conv_engine(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's last messages, and a search, after another was deleted with its own."""
    e = _engine(spark)
    a, b = e.create_conversation("a"), e.create_conversation("b", {"x": 1})
    e.add_message(a, "user", "third is here, too")
    for role, text in (("user", "first"), ("user", "second"), ("assistant", "third")):
        e.add_message(b, role, text)
    e.delete_conversation(a)
    title = e.list_conversations().first()["title"]
    rows = [(r["role"], r["content"], title) for r in e.get_messages(b, 2).collect()]
    rows += [("found", r["content"], title) for r in e.search_messages("third").collect()]
    return spark.createDataFrame(rows, "role string, content string, title string")


@_add(_fixed([("completed", '{"n": 3}', None, "load", 0, "completed", '{"ok": 1}'), ("completed", '{"n": 3}', None, "check", 1, "failed", None), ("failed", None, "out of time", None, None, None, None)], "status", "output", "error", "step", "step_index", "step_status", "step_output"))
def workflow_engine(spark: SparkSession, d: str) -> DataFrame:
    """Workflows with steps: created, run, patched, completed and failed."""
    e = _engine(spark)
    w, x = e.create_workflow("one", {"in": 1}), e.create_workflow("two")
    s, t = e.add_step(w, "load"), e.add_step(w, "check")
    e.update_step(s, "running")
    e.update_step(s, "completed", {"ok": 1})
    e.update_step(t, "failed", error="bad")
    e.complete_workflow(w, {"n": 3})
    e.fail_workflow(x, "out of time")
    rows = []
    for id in (w, x):
        f = e.get_workflow(id)
        rows += [(f["status"], f["output"], f["error"], s["name"], s["step_index"], s["status"], s["output"]) for s in f["steps"] or []] or [(f["status"], f["output"], f["error"], None, None, None, None)]
    return spark.createDataFrame(rows, "status string, output string, error string, step string, step_index long, step_status string, step_output string")


@_add("SELECT c_custkey AS id FROM customer ORDER BY c_acctbal, c_custkey LIMIT 40 OFFSET 25")
def trace_paging(spark: SparkSession, d: str) -> DataFrame:
    """A page of a session's traces."""
    c = load(spark, d, "customer")
    t = c.select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("s").alias("session_id"), F.lit("step").alias("trace_type"), F.col("c_name").alias("content"), F.col("c_acctbal").alias("created_at"))
    return memory.session_traces(t, "s", 40, 25).select("id")


@_add(_fixed([("plan", 0), ("act", 1), ("see", 2), ("refused", -1)], "content", "depth"))
def trace_engine(spark: SparkSession, d: str) -> DataFrame:
    """A tree of traces; one without its parent is refused."""
    e = _engine(spark)
    a = e.add_trace("thought", "plan", "s")
    b = e.add_trace("action", "act", "s", a)
    e.add_trace("observation", "see", "s", b)
    e.add_trace("thought", "apart", "s")
    rows = [(r["content"], int(r["depth"])) for r in e.get_trace_tree(a).collect()]
    try:
        e.add_trace("thought", "lost", "s", "nobody")
    except EngineError:
        rows.append(("refused", -1))
    return spark.createDataFrame(rows, "content string, depth long")


@_add(_fixed([("adder", "adds well", "2.0", 2), ("mult", "multiplies", "1.0.0", 1)], "name", "description", "version", "calls"))
def tool_engine(spark: SparkSession, d: str) -> DataFrame:
    """Tools registered, replaced and deleted, with the calls that were logged."""
    e = _engine(spark)
    first = e.register_tool("adder", "adds")
    same = e.register_tool("adder", "adds well", {"type": "object"}, "2.0") == first
    e.register_tool("mult", "multiplies")
    e.register_tool("gone")
    e.delete_tool("gone")
    for name in ("adder", "adder", "mult"):
        e.log_tool_call(name, {"a": 1}, {"b": 2}, None, 5, "s")
    rows = [(t["name"], e.get_tool(t["name"])["description"], t["version"], e.get_tool_calls("s", t["name"]).count()) for t in e.list_tools().collect() if same]
    return spark.createDataFrame(rows, "name string, description string, version string, calls long")


@_add(_fixed([("insert", "r1"), ("update", "r1"), ("delete refused", ""), ("update refused", "")], "action", "record_id"))
def audit_engine(spark: SparkSession, d: str) -> DataFrame:
    """Audit entries can be added, and neither changed nor deleted."""
    e = _engine(spark)
    e.audit("insert", "t", "r1", "me", None, {"v": 1})
    e.audit("update", "t", "r1", "me", {"v": 1}, {"v": 2}, "why not")
    rows = []
    for name, text in (("delete refused", "DELETE FROM audit_log"), ("update refused", "UPDATE audit_log SET actor = 'x'")):
        try:
            e.execute(text)
        except EngineError:
            rows.append((name, ""))
    rows += [(r["action"], r["record_id"]) for r in e.store.read("audit_log").collect()]
    return spark.createDataFrame(rows, "action string, record_id string")


@_add(_fixed([("window", "high", 60), ("window", "low", 100), ("left", "low", 40), ("cleared", None, 0)], "step", "source_id", "tokens"))
def context_engine(spark: SparkSession, d: str) -> DataFrame:
    """Context entries packed, one removed, and the session cleared."""
    e = _engine(spark)
    high = e.add_context("s", "doc", "high", 60, priority=5)
    e.add_context("s", "doc", "low", 40, relevance_score=0.2)
    big = e.add_context("s", "doc", "big", 70, priority=1)
    e.add_context("other", "doc", "else", 1)
    names = {r["id"]: r["source_id"] for r in e.get_entries("s").collect()}
    rows = [("window", names[r["id"]], r["used"]) for r in e.build_window("s", 100).collect()]
    e.remove_entry(high)
    e.remove_entry(big)
    rows += [("left", r["source_id"], r["token_count"]) for r in e.get_entries("s").collect()]
    e.clear_session("s")
    rows.append(("cleared", None, e.get_entries("s").count()))
    return spark.createDataFrame(rows, "step string, source_id string, tokens long")


@_add(_fixed([("latest", 2, "Dear {{name}}"), ("first", 1, "Hi {{name}}"), ("rendered", 2, "Dear Ann"), ("listed", 2, "greet"), ("deleted", 0, "greet")], "step", "version", "text"))
def prompt_engine(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a template: made, read, filled, listed and deleted."""
    e = _engine(spark)
    e.create_template("greet", "Hi {{name}}")
    v = e.create_template("greet", "Dear {{name}}", "small", 100, {"k": 1})
    rows = [("latest", v, e.get_template("greet")["template"]), ("first", 1, e.get_template("greet", 1)["template"]), ("rendered", v, e.render("greet", {"name": "Ann", "unused": "x"})), ("listed", e.list_templates().count(), "greet")]
    e.delete_template("greet")
    rows.append(("deleted", e.list_templates().count(), "greet"))
    return spark.createDataFrame(rows, "step string, version long, text string")


@_add(_fixed([("get", "x", True), ("get", "y", True), ("has", "y", True), ("has", "z", False), ("untag", "x", False), ("clear", "y", False), ("find", "x", True)], "step", "label", "there"))
def label_engine(spark: SparkSession, d: str) -> DataFrame:
    """Labels put on, read and taken off."""
    e = _engine(spark)
    for record, label in (("1", "x"), ("1", "x"), ("1", "y"), ("2", "x")):
        e.tag("t", record, label, "me")
    rows = [("get", r["label"], True) for r in e.get_labels("t", "1").collect()] + [("has", "y", e.has_label("t", "1", "y")), ("has", "z", e.has_label("t", "1", "z"))]
    e.untag("t", "1", "x")
    rows.append(("untag", "x", e.has_label("t", "1", "x")))
    e.clear_record("t", "1")
    rows.append(("clear", "y", e.has_label("t", "1", "y")))
    rows += [("find", r["label"], r["record_id"] == "2") for r in e.find_by_label("x").collect()]
    return spark.createDataFrame(rows, "step string, label string, there boolean")


# ---- sync, feeds, service ----


@_add(f"WITH {reference_sql._O}, t AS (SELECT max(hlc_ts) - ((max(hlc_ts) - min(hlc_ts)) // 3) AS mark FROM o) SELECT op_id, hlc_ts FROM o, t WHERE hlc_ts > mark")
def sync_ops_since(spark: SparkSession, d: str) -> DataFrame:
    """Operations of the last third of the time."""
    o = reference._ops(spark, d)
    low, high = o.agg(F.min("hlc_ts"), F.max("hlc_ts")).first()
    return sync.ops_since(o, high - (high - low) // 3).select("op_id", "hlc_ts")


@_add(_fixed([("now", 1000, 0), ("now", 1000, 1), ("behind", 1000, 2), ("same", 1000, 8), ("ahead", 2000, 4), ("now", 2000, 5)], "step", "ms", "counter"))
def hlc_clock(spark: SparkSession, d: str) -> DataFrame:
    """Times of a clock whose wall stands still, with times received."""
    c = sync.Clock(lambda: 1000)
    got = [("now", c.now()), ("now", c.now()), ("behind", c.update(sync.pack(500, 9))), ("same", c.update(sync.pack(1000, 7))), ("ahead", c.update(sync.pack(2000, 3))), ("now", c.now())]
    return spark.createDataFrame([(s, *sync.unpack(h)) for s, h in got], "step string, ms long, counter long")


@_add(_fixed([("t", "1", "far"), ("t", "2", "local"), ("peer a", "pending", "2"), ("bad strategy", "refused", "")], "table_name", "record_id", "node_id"))
def sync_engine(spark: SparkSession, d: str) -> DataFrame:
    """Mutations recorded, a remote one merged, peers and a strategy set."""
    e = _engine(spark)
    e.record_mutation("t", "1", "insert", {"v": 1})
    h = e.record_mutation("t", "2", "update")
    e.add_peer("peer a", "http://a")
    e.set_strategy("lww")
    e.apply_remote_ops(e.store.frame("sync_log", [{"op_id": "r", "hlc_ts": h + 9, "node_id": "far", "table_name": "t", "record_id": "1", "op_type": "update", "payload": "{}"}]))
    rows = [(r["table_name"], r["record_id"], r["node_id"]) for r in e.get_ops_since(0).collect()]
    rows += [(r["peer_id"], "pending", str(r["ops_pending"])) for r in e.sync_status().collect()]
    try:
        e.set_strategy("any")
    except EngineError:
        rows.append(("bad strategy", "refused", ""))
    return spark.createDataFrame(rows, "table_name string, record_id string, node_id string")


@_add("SELECT user_id::VARCHAR AS key, arg_max(event_id, (ts, event_id))::VARCHAR AS entry FROM events GROUP BY user_id")
def feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change feed: a stream, merged batch by batch into a table of the last of each user."""
    from ..operators.changes import BucketedTable

    source, events = scratch(spark, "arriving"), load(spark, d, "events")
    rows = events.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("key"), F.lit("insert").alias("action"), F.col("props").alias("new_value"), ms_of(F.col("ts")).alias("timestamp"), F.col("event_id").alias("n"))
    rows.withColumn("new_value", F.coalesce("new_value", F.lit("{}"))).repartition(3).write.parquet(source)
    table = BucketedTable(spark, scratch(spark, "current"), ["key"], 8)
    stream = file_stream(spark, source, spark.read.parquet(source).schema, 1)
    apply_feed(stream, table, scratch(spark, "stream"), order=("timestamp", "n")).awaitTermination()
    return table.read().select("key", "entry")


@_add(_fixed([("tools/list", "22"), ("vector_search", "b"), ("label_has", "true"), ("unknown method", "-32601"), ("notification", "none")], "call", "answer"))
def service_calls(spark: SparkSession, d: str) -> DataFrame:
    """Requests to the JSON-RPC service."""
    s = Dispatcher(_engine(spark))
    ask = lambda method, **p: json.loads(s.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})))
    tool = lambda name, **a: json.loads(ask("tools/call", name=name, arguments=a)["result"]["content"][0]["text"])
    for id, v in (("a", [1, 0]), ("b", [0, 1])):
        tool("vector_upsert", collection="c", id=id, vector=v)
    tool("label_tag", table_name="t", record_id="1", label="x")
    rows = [("tools/list", str(len(ask("tools/list")["result"]["tools"]))), ("vector_search", tool("vector_search", collection="c", vector=[0, 2], top_k=1)[0]["id"]), ("label_has", str(tool("label_has", table_name="t", record_id="1", label="x")).lower()), ("unknown method", str(ask("none")["error"]["code"])), ("notification", "none" if s.handle('{"jsonrpc": "2.0", "method": "ping"}') is None else "answered")]
    return spark.createDataFrame(rows, "call string, answer string")


@_add(_fixed([("nearest", "ccc"), ("after delete", "cc"), ("by document", "1"), ("chat", "user:hi"), ("chat", "assistant:ho"), ("removed", "ho"), ("query", "cc 1.0"), ("history", "ai:yes")], "step", "result"))
def adapter_calls(spark: SparkSession, d: str) -> DataFrame:
    """Text and chat stores as agent frameworks call them."""
    e = _engine(spark)
    texts = TextVectorStore(e, lambda xs: [[float(x.count("c")), 1.0] for x in xs], metric="euclidean")
    ids = texts.add_texts(["c", "cc", "ccc"], [{"n": 1}, {"n": 2}, {"n": 3}])
    texts.add_texts(["cccccc"], ref_doc_id="doc")
    rows = [("nearest", texts.similarity_search("ccc", 1)[0])]
    texts.delete([ids[2]])
    rows += [("after delete", texts.similarity_search("ccc", 1)[0]), ("by document", str(texts.delete_ref_doc("doc")))]
    chat = ChatStore(e)
    chat.set_messages("k", [("user", "hi"), ("assistant", "ho")])
    rows += [("chat", f"{r}:{t}") for r, t in chat.get_messages("k")]
    rows.append(("removed", chat.delete_last_message("k")[1]))
    found = texts.query([2.0, 1.0], 1)
    rows.append(("query", f"{found['nodes'][0]['text']} {found['similarities'][0]}"))
    history = ChatHistory(e, "s1")
    history.add_message("human", "no")
    history.clear()
    history.add_message("ai", "yes")
    rows += [("history", f"{m['type']}:{m['content']}") for m in history.messages]
    return spark.createDataFrame(rows, "step string, result string")


def _sql(name: str, text: str, tables: str) -> None:
    reference._sql(name, text, tables)
    QUERIES[name], ORACLES[name] = reference.QUERIES.pop(name), text.format(**{t: t for t in tables.split()})


_sql("rel_right_outer", "SELECT n_name, count(s_suppkey) AS suppliers FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_name", "supplier nation")
_sql("rel_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}", "region nation")
_sql("rel_recursive_table", "WITH RECURSIVE t(k, hops) AS (SELECT c_custkey, 0 FROM {customer} WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, hops + 1 FROM t JOIN {customer} c ON (c.c_custkey + 8) // 10 = t.k AND c.c_custkey > 1) SELECT k, hops FROM t".replace("(c.c_custkey + 8) // 10", "CAST(floor((c.c_custkey + 8) / 10) AS BIGINT)"), "customer")
_sql("rel_approx", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) AS near FROM {events} GROUP BY event_type", "events")

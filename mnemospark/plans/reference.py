"""One query for each operator of the engine, on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import distance
from ..functions.text import ms_of
from ..operators import fulltext, graph, hybrid, memory, sync, vector
from ..operators.filters import compile_filter, metadata_variant
from ..operators.ranking import latest_rows, spread_row_number
from ..session import load
from ..streaming.feed import sessions, tumbling
from .sql import table_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Add a query to the catalogue."""
    QUERIES[f.__name__] = f
    return f


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# ---- vectors ----


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))


def _first(df: DataFrame, id: int = 0) -> list[float]:
    return df.filter(F.col("id") == id).select("vector").first()[0]


def _topk(metric: str, **kw):
    def f(spark: SparkSession, d: str) -> DataFrame:
        e = _embeddings(spark, d)
        return vector.vector_search(e, _first(e), 10, metric, **kw).select("id", _r("score"))

    return f


QUERIES["vec_cosine_topk"] = _topk("cosine")
QUERIES["vec_l2_topk"] = _topk("euclidean")
QUERIES["vec_dot_topk"] = _topk("dot")
QUERIES["vec_filtered_topk"] = _topk("cosine", filter={"label": {"$in": [1, 3, 5]}})
QUERIES["vec_overfetch_filtered"] = _topk("cosine", filter={"label": 4}, mode="overfetch")


@query
def vec_knn_join(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest of every vector."""
    e = _embeddings(spark, d)
    return vector.knn_join(e, e, 5).select("query_id", "id", _r("score"), "rank")


@query
def vec_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Newest state of each vector's key."""
    v = load(spark, d, "adb_vectors").select("id", "collection_id", "updated_at", "created_at")
    return latest_rows(v, ["id", "collection_id"], ["updated_at", "created_at"])


@query
def vec_collection_stats(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of each registered collection."""
    v = latest_rows(load(spark, d, "adb_vectors").select("id", "collection_id", "updated_at"), ["id", "collection_id"], ["updated_at"])
    return vector.collection_stats(load(spark, d, "adb_collections"), v)


@query
def vec_zero_norm(spark: SparkSession, d: str) -> DataFrame:
    """Distances to a vector of zeros."""
    e = _embeddings(spark, d)
    zero = F.transform("vector", lambda x: F.lit(0.0))
    return e.select("id", distance(F.col("vector"), zero, "cosine").alias("cosine"), F.round(distance(F.col("vector"), zero, "dot"), 6).alias("dot"))


# ---- metadata filters ----


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.col("props").alias("meta"))


def _nodes_meta(spark: SparkSession, d: str) -> DataFrame:
    n = latest_rows(load(spark, d, "nodes").select("id", "updated_at", "created_at", "data"), ["id"], ["updated_at", "created_at"])
    return n.select("id", F.col("data").alias("meta"))


def _filtered(source, spec: dict):
    def f(spark: SparkSession, d: str) -> DataFrame:
        df = source(spark, d)
        return df.filter(compile_filter(spec, metadata_variant(F.col("meta")))).select(df.columns[0])

    return f


QUERIES["filter_eq_ne"] = _filtered(_events, {"k": {"$eq": 7}, "other": {"$ne": 1}})
QUERIES["filter_range"] = _filtered(_events, {"k": {"$gte": 10, "$lt": 20}})
QUERIES["filter_in_nin"] = _filtered(_events, {"k": {"$in": [1, 2, 3, "4"], "$nin": [2]}})
QUERIES["filter_exists"] = _filtered(_nodes_meta, {"origin": {"$exists": True}, "facts": {"$exists": False}})
QUERIES["filter_contains_regex"] = _filtered(_nodes_meta, {"label": {"$contains": "o", "$regex": "^[a-m].*n"}})
QUERIES["filter_and_or_not"] = _filtered(_events, {"$and": [{"k": {"$gt": 5}}, {"$not": {"k": {"$gt": 50}}}], "$or": [{"k": 6}, {"k": {"$gte": 40}}]})
QUERIES["filter_dotted"] = _filtered(_nodes_meta, {"origin.agent": "graph layer"})
QUERIES["filter_float_not_int"] = _filtered(_events, {"$and": [{"$not": {"k": 5.0}}, {"$not": {"k": {"$regex": "("}}}, {"$not": {"k": {"$bad": 1}}}, {"k": {"$gte": 0}}]})


# ---- graph ----


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with integer ids out of the embeddings; a loop at the anchor and a negative edge."""
    e = load(spark, d, "embeddings").select("vec_id", "label")
    n = F.broadcast(e.agg(F.count("*").alias("n")))  # one row
    v = e.crossJoin(n)
    edges = None
    for k, (name, a, b) in enumerate((("next", 1, 1), ("cites", 7, 3), ("similar", 13, 5))):
        one = v.select(F.col("vec_id").cast("string").alias("src"), ((a * F.col("vec_id") + b) % F.col("n")).cast("string").alias("dst"), F.lit(name).alias("relation"), (((31 * F.col("vec_id") + 17 * k) % 100) / 100.0).alias("weight"))
        edges = one if edges is None else edges.unionByName(one)
    extra = spark.sql("SELECT * FROM VALUES ('0', '0', 'self', 0.5D), ('0', '9', 'bad', -0.5D) AS t(src, dst, relation, weight)")
    nodes = e.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("kind"), F.lit(None).cast("string").alias("data"))
    return nodes, edges.unionByName(extra)


def _neighbors(depth: int, **kw):
    def f(spark: SparkSession, d: str) -> DataFrame:
        nodes, edges = _graph(spark, d)
        return graph.neighbors(nodes, edges, "0", depth, **kw).select("id", "kind", "depth", _r("weight"))

    return f


for _d in (0, 1, 2, 3, 5):
    QUERIES[f"graph_neighbors_d{_d}"] = _neighbors(_d)
QUERIES["graph_relation"] = _neighbors(3, relation="cites")
QUERIES["graph_min_weight"] = _neighbors(3, min_weight=0.3)
QUERIES["graph_negative"] = _neighbors(1, min_weight=-1.0)


@query
def graph_bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depths by level search."""
    nodes, edges = _graph(spark, d)
    return graph.neighbors(nodes, edges, "0", 4, mode="bfs").select("id", "depth")


@query
def graph_store_walk(spark: SparkSession, d: str) -> DataFrame:
    """What every source of the edge table reaches in two hops."""
    edges = graph.current_edges(load(spark, d, "edges"))
    starts = edges.filter("src IS NOT NULL AND trim(src) <> ''").select(F.col("src").alias("start")).distinct()
    return graph.walk(edges, starts, 2).select("start", "id", "depth", _r("weight"))


@query
def graph_walk_all(spark: SparkSession, d: str) -> DataFrame:
    """What every node reaches in two hops."""
    nodes, edges = _graph(spark, d)
    return graph.walk(edges, nodes.select(F.col("id").alias("start")), 2).select("start", "id", "depth", _r("weight"))


@query
def graph_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a kind."""
    return graph.nodes_by_kind(graph.current_nodes(load(spark, d, "nodes")), "task").select("id", "kind", "created_at", "updated_at")


@query
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges."""
    return graph.graph_stats(graph.current_nodes(load(spark, d, "nodes")), graph.current_edges(load(spark, d, "edges")))


@query
def graph_valid_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between nodes that exist."""
    return graph.valid_edges(graph.current_edges(load(spark, d, "edges")), load(spark, d, "nodes")).select("src", "dst", "relation")


# ---- full text ----


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _search(text: str, stemmed: bool = False, k: int | None = None, snippets: bool = False):
    def f(spark: SparkSession, d: str) -> DataFrame:
        found = fulltext.TextIndex(_texts(spark, d), stemmed, unique=True).search(text, k, snippets)
        return found.select("doc_id", _r("rank"), *(["snippet"] if snippets else []))

    return f


QUERIES["fts_bm25_unstemmed"] = _search("scheduler checkpoint")
QUERIES["fts_phrase"] = _search('"cache layer"')
QUERIES["fts_prefix"] = _search("reindex*")
QUERIES["fts_or_not"] = _search("gateway OR sandbox NOT planner")
QUERIES["fts_near"] = _search("NEAR(planner queue, 3)")
QUERIES["fts_doc_id"] = _search("17")
QUERIES["fts_bm25_porter"] = _search("ranking caches", stemmed=True, k=50)
QUERIES["fts_snippet"] = _search("stale scheduler", stemmed=True, k=10, snippets=True)


@query
def fts_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages that match, ranked."""
    m = latest_rows(load(spark, d, "messages").select("id", "created_at", "conversation_id", "role", "content"), ["id"], ["created_at"])
    return fulltext.search_messages(m, "gateway", 25).select("id", _r("rank"))


# ---- hybrid ----


def _string_ids(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).withColumn("id", F.col("id").cast("string"))


@query
def hybrid_bimodal(spark: SparkSession, d: str) -> DataFrame:
    """Vector and graph."""
    _, edges = _graph(spark, d)
    q = _first(_embeddings(spark, d))
    return hybrid.hybrid_query(_string_ids(spark, d), edges, q, "0", 0.6, 2, 10).select("id", _r("score"), _r("vector_score"), _r("graph_weight"))


@query
def hybrid_trimodal(spark: SparkSession, d: str) -> DataFrame:
    """Vector, graph and text."""
    _, edges = _graph(spark, d)
    q = _first(_embeddings(spark, d))
    index = fulltext.TextIndex(_texts(spark, d), False, unique=True)
    return hybrid.tri_modal_query(_string_ids(spark, d), edges, index, q, "0", "gateway", 0.4, 0.3, 0.3, 2, 20).select("id", _r("score"), _r("vector_score"), _r("graph_score"), _r("text_score"))


@query
def trimodal_single_channel(spark: SparkSession, d: str) -> DataFrame:
    """The graph channel alone."""
    _, edges = _graph(spark, d)
    return hybrid.tri_modal_query(None, edges, None, (), "0", "", 0.0, 1.0, 0.0, 3, 30).select("id", _r("score"), _r("graph_score"))


# ---- stores ----


def _messages(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "messages").filter("conversation_id IS NOT NULL")
    return latest_rows(m.select("id", "created_at", "conversation_id", "role", "content"), ["id"], ["created_at"])


@query
def conv_last_n(spark: SparkSession, d: str) -> DataFrame:
    """The last five messages of each conversation."""
    return memory.last_messages(_messages(spark, d), 5).select("conversation_id", "id", "position")


@query
def conv_list(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with their extent."""
    return memory.list_conversations(_messages(spark, d))


@query
def conv_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts, by their length and digest."""
    t = memory.transcript(_messages(spark, d))
    return t.select("conversation_id", "part", F.length("transcript").alias("chars"), F.md5("transcript").alias("digest"))


@query
def conv_message_at(spark: SparkSession, d: str) -> DataFrame:
    """The second message of each conversation."""
    return memory.message_at(_messages(spark, d), 1).select("conversation_id", "id")


def _workflows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = load(spark, d, "workflows").select("id", "updated_at", "created_at", "name", "status")
    s = load(spark, d, "workflow_steps")
    return latest_rows(w, ["id"], ["updated_at", "created_at"]), s.dropDuplicates(["id", "workflow_id", "step_index"])


@query
def workflow_list_counts(spark: SparkSession, d: str) -> DataFrame:
    """Workflows with their number of steps."""
    return memory.list_workflows(*_workflows(spark, d))


@query
def workflow_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Completed workflows."""
    return memory.list_workflows(*_workflows(spark, d), status="completed")


@query
def workflow_step_fold(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders taken as updates of one step."""
    item = load(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "running").when(F.col("l_returnflag") == "R", "failed").otherwise("completed")
    events = item.select(F.col("l_orderkey").alias("step_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("at"), status.alias("status"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).alias("output"), F.when(F.col("l_linestatus") == "F", F.col("l_suppkey").cast("string")).alias("error"))
    return memory.fold_step_updates(events)


@query
def workflow_number_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps numbered anew."""
    s = load(spark, d, "workflow_steps").filter("workflow_id IS NOT NULL").select("id", "workflow_id", F.col("step_index").alias("old")).distinct()
    return memory.number_steps(s, ["old", "id"]).select("id", "workflow_id", "old", "step_index")


@query
def trace_tree(spark: SparkSession, d: str) -> DataFrame:
    """Customers as traces: everyone's parent is the tenth of the key."""
    c = load(spark, d, "customer")
    t = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 1, F.floor((F.col("c_custkey") + 8) / 10)).cast("long").alias("parent_id"), F.lit("s").alias("session_id"), F.lit("step").alias("trace_type"), F.col("c_name").alias("content"), F.col("c_custkey").alias("created_at"))
    return memory.trace_tree(t, 2).select("id", "parent_id", "depth")


@query
def tool_calls_recent(spark: SparkSession, d: str) -> DataFrame:
    """Newest events of a type, as tool calls."""
    e = load(spark, d, "events")
    calls = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_name"), ms_of(F.col("ts")).alias("created_at"))
    return memory.recent_tool_calls(calls, tool_name="purchase", limit=100)


@query
def audit_by_record(spark: SparkSession, d: str) -> DataFrame:
    """Newest entries of the busiest record."""
    a = load(spark, d, "audit_log").dropDuplicates(["id"])
    return memory.audit_by_record(a, "agent_state", "agent-primary").select("id", "timestamp", "actor")


@query
def audit_by_actor(spark: SparkSession, d: str) -> DataFrame:
    """Newest entries of an actor."""
    a = load(spark, d, "audit_log").dropDuplicates(["id"])
    return memory.audit_by_actor(a, "agent-11").select("id", "timestamp", "record_id")


@query
def audit_recent(spark: SparkSession, d: str) -> DataFrame:
    """Newest entries."""
    return memory.audit_recent(load(spark, d, "audit_log").dropDuplicates(["id"])).select("id", "timestamp")


@query
def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Greedy packing of each session into 4,096 tokens."""
    c = load(spark, d, "context_entries")
    c = latest_rows(c.select("id", "included_at", "session_id", "token_count", "relevance_score", "priority"), ["id"], ["included_at"])
    return memory.build_window(c, 4096)


@query
def context_entries_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of every entry in its session's packing order."""
    c = latest_rows(load(spark, d, "context_entries").select("id", "included_at", "session_id", "relevance_score", "priority"), ["id"], ["included_at"])
    return spread_row_number(c, ["session_id"], [F.desc("priority"), F.desc("relevance_score"), F.col("id")], "place").select("session_id", "id", "place")


@query
def prompt_latest(spark: SparkSession, d: str) -> DataFrame:
    """Newest version of each template; parts' sizes as versions."""
    p = load(spark, d, "part")
    t = p.select(F.col("p_brand").alias("name"), (F.col("p_size") * 1_000_000 + F.col("p_partkey")).alias("version"), F.concat(F.lit("Buy {{what}} of "), "p_name").alias("template"))
    return memory.latest_templates(t)


@query
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    """Filled templates; unknown places stay."""
    p = load(spark, d, "part")
    t = F.concat(F.lit("Hi {{name}}, {{id}} is "), "p_name")
    return p.select("p_partkey", memory.render(t, {"name": "Ann"}).alias("text"))


@query
def labels_find(spark: SparkSession, d: str) -> DataFrame:
    """Newest records with a label; document languages as labels."""
    x = load(spark, d, "documents")
    labels = x.select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("record_id"), F.lower(F.trim("lang")).alias("label"), F.unix_millis("ingested_at").alias("tagged_at"))
    return memory.find_by_label(labels, "de", 100).select("record_id", "label", "tagged_at")


# ---- sync ----


def _ops(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    hlc = sync.pack_column(ms_of(F.col("ts")), F.col("event_id"))
    return e.select(F.col("event_id").cast("string").alias("op_id"), hlc.alias("hlc_ts"), F.lit("n").alias("node_id"), F.col("event_type").alias("table_name"), F.col("user_id").cast("string").alias("record_id"), F.lit("update").alias("op_type"), F.col("props").alias("payload"), F.col("event_id").alias("seq"))


def _merged(strategy: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        ops = _ops(spark, d)
        return sync.merge_ops(ops.filter("seq % 2 = 0"), ops.filter("seq % 2 = 1"), strategy).select("table_name", "record_id", "op_id", "hlc_ts")

    return f


QUERIES["sync_lww"] = _merged("lww")
QUERIES["sync_fww"] = _merged("fww")


@query
def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    """What taking the odd operations into the even ones does."""
    ops = _ops(spark, d)
    return sync.merge_counts(ops.filter("seq % 2 = 0"), ops.filter("seq % 2 = 1"))


@query
def sync_pending(spark: SparkSession, d: str) -> DataFrame:
    """Operations that peers lack; nations as peers that are so many days behind."""
    n = load(spark, d, "nation")
    day = sync.pack_column(F.lit(1704067200000) + F.col("n_nationkey").cast("long") * 86_400_000, F.lit(0))
    peers = n.select(F.col("n_name").alias("peer_id"), F.lit(None).cast("string").alias("endpoint"), day.alias("last_synced_hlc"))
    return sync.sync_status(_ops(spark, d), peers).select("peer_id", "last_synced_hlc", "ops_pending")


@query
def hlc_pack(spark: SparkSession, d: str) -> DataFrame:
    """Packed clocks and what they unpack to."""
    o = _ops(spark, d)
    return o.select("op_id", "hlc_ts", sync.physical(F.col("hlc_ts")).alias("ms"), sync.logical(F.col("hlc_ts")).alias("counter"))


# ---- relational ----


def _sql(name: str, text: str, tables: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(text, **{t: load(spark, d, t) for t in tables.split()})

    QUERIES[name] = f


#: name -> (text for both engines, tables); {t} stands for a table.
SHARED = {
    "rel_join_agg": ("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 5", "orders customer nation"),
    "rel_pricing": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", "lineitem"),
    "rel_left_outer": ("SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey", "customer orders"),
    "rel_semi": ("SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)", "customer orders"),
    "rel_anti": ("SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer orders"),
    "rel_full_outer": ("SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM {customer} GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM {supplier} GROUP BY s_nationkey) b ON c_nationkey = s_nationkey", "customer supplier"),
    "rel_window_rank": ("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM {orders}", "orders"),
    "rel_window_lag": ("SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM {events}", "events"),
    "rel_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem"),
    "rel_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders"),
    "rel_grouping_sets": ("SELECT p_brand, p_size, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())", "part"),
    "rel_union": ("SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", "customer supplier"),
    "rel_intersect": ("SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM {supplier}", "customer supplier"),
    "rel_except": ("SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000", "nation supplier"),
    "rel_topk": ("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5", "orders"),
    "rel_scalar_subquery": ("SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders})", "orders"),
    "rel_correlated": ("SELECT p_partkey FROM {part} p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM {part} q WHERE q.p_brand = p.p_brand)", "part"),
    "rel_recursive_cte": ("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", ""),
    "rel_in_like": ("SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%7' AND c_name NOT LIKE '%77'", "customer"),
    "rel_theta_join": ("SELECT r.r_name, count(*) AS n FROM {region} r JOIN {nation} n ON n.n_regionkey > r.r_regionkey GROUP BY r.r_name", "region nation"),
    "rel_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}", "orders"),
    "rel_count_distinct": ("SELECT event_type, count(DISTINCT user_id) AS users, count(value) AS n FROM {events} GROUP BY event_type", "events"),
    "rel_case_coalesce": ("SELECT doc_id, coalesce(lower(trim(source)), 'none') AS source, CASE WHEN n_chars IS NULL THEN 'null' WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS size FROM {documents}", "documents"),
    "rel_string_functions": ("SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 3) AS s, replace(p_type, ' ', '_') AS t, CAST(instr(p_name, 'a') AS BIGINT) AS i, p_brand || '-' || p_size AS b FROM {part}", "part"),
}
for _name, (_text, _tables) in SHARED.items():
    _sql(_name, _text, _tables)


# ---- counters, windows of time ----


@query
def engine_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the stores' tables."""
    names = ("adb_collections", "adb_vectors", "nodes", "edges", "messages", "workflows", "workflow_steps", "audit_log", "context_entries", "documents")
    return table_counts({t: load(spark, d, t) for t in names})


@query
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type."""
    return tumbling(load(spark, d, "events"), "ts", "1 hour", ["event_type"]).drop("end")


@query
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the users."""
    return sessions(load(spark, d, "events"), "ts", "30 minutes", "user_id")

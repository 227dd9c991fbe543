import json

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.errors import CollectionNotFound, DimensionMismatch, EdgeNotFound, InvalidArgument, NodeNotFound, SchemaMigration, SqlError
from mnemospark.plans.sql import bind, json_rows, run, shim, split_statements, split_top
from mnemospark.sources.engine import Engine
from mnemospark.sources.service import Dispatcher
from mnemospark.sources.store import Store, sql_dump


@pytest.fixture
def engine(spark, tmp_path):
    with Engine.open(spark, str(tmp_path / "store")) as e:
        yield e


def test_collections(engine):
    c = engine.collection("docs", 2)
    assert c.upsert_batch([("a", [1, 0], {"role": "user"}), ("b", [0, 1]), ("a", [2, 0], {"role": "agent"})]) == 2
    assert c.upsert_batch([("a", [1, 0]), ("z", [1, 1])]) == 1 and c.count() == 3 and c.upsert_batch([]) == 0
    with pytest.raises(DimensionMismatch):
        c.upsert_batch([("q", [1, 0]), ("r", [1])])
    assert c.count() == 3
    c.upsert("a", [1, 0], {"role": "user"})
    assert [r["id"] for r in c.search([1, 0], 5, {"role": "user"}).collect()] == ["a"]
    with pytest.raises(DimensionMismatch):
        c.search([1, 0, 0])
    assert engine.collection("docs", 2, "dot").metric == "cosine"
    with pytest.raises(DimensionMismatch):
        engine.collection("docs", 3)
    with pytest.raises(CollectionNotFound):
        engine.get_collection("none")
    assert [(r["name"], r["count"]) for r in engine.list_collections().collect()] == [("docs", 3)]
    c.delete("nobody")
    c.delete("z")
    assert c.delete_where({"role": "user"}) == 1 and c.count() == 1
    c.upsert_with_text("t", [1, 1], "hello world")
    assert [r["doc_id"] for r in engine.search_text("docs", "hello").collect()] == ["t"]
    engine.drop_collection("docs")
    engine.drop_collection("docs")
    assert engine.stats()["vectors"] == 0 and engine.search_text("docs", "hello").count() == 0


def test_graph(engine):
    for n in "abc":
        engine.add_node(n, "kind", {"n": n})
    made = engine.get_node("a")["created_at"]
    engine.add_node("a", "other")
    assert engine.get_node("a")["created_at"] == made and engine.get_node("a")["data"] is None
    engine.add_edge("a", "b", "r", 0.5)
    engine.add_edge("b", "c", "r", 0.7)
    engine.add_edge("b", "c", "r", 0.9)
    with pytest.raises(NodeNotFound):
        engine.add_edge("a", "none", "r")
    assert [(r["id"], r["depth"], r["weight"]) for r in engine.neighbors("a").collect()] == [("b", 1, 0.5), ("c", 2, 0.9)]
    engine.delete_node("b")
    assert engine.stats()["edges"] == 0
    with pytest.raises(EdgeNotFound):
        engine.delete_edge("a", "b", "r")
    with pytest.raises(NodeNotFound):
        engine.get_node("b")


def test_transactions(spark, engine):
    with pytest.raises(RuntimeError):
        with engine.store.transaction():
            engine.add_node("x", "k")
            assert engine.get_node("x")["kind"] == "k"
            raise RuntimeError
    with pytest.raises(NodeNotFound):
        engine.get_node("x")
    before = engine.store.manifest()["version"]
    with engine.store.transaction():
        engine.add_node("x", "k")
        engine.add_node("y", "k")
    assert engine.store.manifest()["version"] == before + 1
    again = Engine.open(spark, engine.store.root)
    assert again.get_node("y")["id"] == "y"


def test_conversations(engine):
    c = engine.create_conversation("t")
    with pytest.raises(InvalidArgument):
        engine.create_conversation(id=c)
    with pytest.raises(InvalidArgument):
        engine.add_message("none", "user", "x")
    for i in range(4):
        engine.add_message(c, ("user", "assistant")[i % 2], f"message number {i}")
    assert [r["content"][-1] for r in engine.get_messages(c, 2).collect()] == ["2", "3"]
    assert engine.get_messages(c).count() == 4
    assert engine.search_messages("number", conversation_id=c).count() == 4
    engine.delete_conversation(c)
    engine.delete_conversation(c)
    assert engine.stats()["messages"] == 0


def test_workflows_and_traces(engine):
    w = engine.create_workflow("w", {"x": 1})
    s0, s1 = engine.add_step(w, "one"), engine.add_step(w, "two")
    engine.update_step(s0, "running")
    engine.update_step(s0, "completed", output={"ok": True})
    engine.update_step(s0, "whatever")
    with pytest.raises(InvalidArgument):
        engine.update_step(s1, "whatever", strict=True)
    with pytest.raises(InvalidArgument):
        engine.update_step("none", "running")
    got = engine.get_workflow(w)
    assert [s["step_index"] for s in got["steps"]] == [0, 1] and got["steps"][0]["status"] == "whatever" and json.loads(got["steps"][0]["output"]) == {"ok": True}
    assert got["steps"][0]["started_at"] and got["steps"][0]["completed_at"] and got["step_count"] == 2
    engine.complete_workflow(w, {"done": 1})
    engine.fail_workflow(w, "boom")
    engine.fail_workflow(w)
    assert engine.get_workflow(w)["error"] == "boom"
    engine.complete_workflow(w)
    assert engine.get_workflow(w)["output"] is None
    empty = engine.create_workflow("e")
    assert {(r["id"], r["step_count"]) for r in engine.list_workflows().collect()} == {(w, 2), (empty, 0)}
    assert [r["id"] for r in engine.list_workflows("pending").collect()] == [empty]
    a = engine.add_trace("thought", "root", "s")
    b = engine.add_trace("step", "child", "s", a)
    engine.add_trace("step", "alone", "s")
    with pytest.raises(InvalidArgument):
        engine.add_trace("step", "x", "s", "none")
    assert [r["id"] for r in engine.get_trace_tree(a).collect()] == [a, b] and engine.get_trace_tree("none").count() == 0
    assert engine.get_traces("s", 1, 1).first()["id"] == b


def test_small_stores(engine):
    t = engine.register_tool("t", parameters_schema={"type": "object"})
    assert engine.register_tool("t", version="2.0.0") == t and engine.get_tool("t")["version"] == "2.0.0"
    engine.log_tool_call("t", session_id="s")
    engine.log_tool_call("unknown")
    assert engine.get_tool_calls(tool_name="t").count() == 1 and engine.get_tool_calls().count() == 2
    engine.delete_tool("t")
    assert engine.get_tool("t") is None and engine.list_tools().count() == 0
    engine.audit("insert", "x", "1", new_value={"a": 1})
    for table in schemas.APPEND_ONLY:
        with pytest.raises(InvalidArgument):
            engine.store.delete(table, engine.store.read(table))
    for tokens, priority in ((50, 2), (50, 1), (50, 0)):
        engine.add_context("s", "v", "x", tokens, priority=priority)
    assert engine.build_window("s", 100).count() == 2
    engine.add_context("z", "v", "x", 1000, priority=9)
    small = engine.add_context("z", "v", "x", 10)
    assert [r["id"] for r in engine.build_window("z", 50).collect()] == [small]
    engine.remove_entry(small)
    engine.clear_session("s")
    assert engine.get_entries("s").count() == 0 and engine.get_entries("z").count() == 1
    assert engine.create_template("p", "Hi {{name}}, your id is {{id}}") == 1 and engine.create_template("p", "v2 {{a}} {{b}}") == 2
    assert engine.render("p", {"a": "{{b}}", "b": "x"}) == "v2 x x"
    assert engine.get_template("p", 1)["version"] == 1
    engine.delete_template("p")
    with pytest.raises(InvalidArgument):
        engine.get_template("p")
    engine.tag("m", "1", "good")
    engine.tag("m", "1", "good", "me")
    engine.tag("m", "1", "bad")
    assert engine.has_label("m", "1", "good") and engine.find_by_label("good").count() == 1
    engine.untag("m", "1", "good")
    engine.untag("m", "1", "good")
    assert not engine.has_label("m", "1", "good")
    engine.clear_record("m", "1")
    assert engine.get_labels("m", "1").count() == 0


def test_sql(engine):
    assert engine.execute("CREATE TABLE notes (id INTEGER PRIMARY KEY, body TEXT, score REAL, raw BLOB)") == 0
    assert engine.execute("CREATE TABLE IF NOT EXISTS notes (id INTEGER)") == 0
    assert engine.execute("INSERT INTO notes (id, body, score) VALUES (1, 'it''s; fine', 1.5), (2, 'two', NULL)") == 2
    assert engine.execute("INSERT INTO notes (id, body) VALUES (?1, ?2)", [3, "three"]) == 1
    assert engine.execute("UPDATE notes SET score = 9.0, body = upper(body) WHERE id >= 2") == 2
    assert engine.execute("DELETE FROM notes WHERE body = :b", {"b": "TWO"}) == 1
    rows = engine.query("SELECT id, body, score FROM notes WHERE id > ? ORDER BY id", [0]).collect()
    assert [tuple(r) for r in rows] == [(1, "it's; fine", 1.5), (3, "THREE", 9.0)]
    with pytest.raises(SqlError):
        engine.query("SELECT nothing FROM nowhere").collect()
    with pytest.raises(SqlError):
        engine.execute_batch("INSERT INTO notes (id) VALUES (7); BROKEN")
    assert engine.query("SELECT count(*) AS n FROM notes").first()["n"] == 2
    assert engine.execute_batch("INSERT INTO notes (id) VALUES (7); -- a comment\nDELETE FROM notes WHERE id = 1") == 2
    engine.execute("INSERT INTO data_labels VALUES ('t', '1', 'x', NULL, 5)")
    with pytest.raises(SqlError):
        engine.execute("INSERT INTO data_labels VALUES ('t', '1', 'x', NULL, 6)")
    engine.execute("INSERT OR REPLACE INTO data_labels VALUES ('t', '1', 'x', 'me', 7)")
    assert engine.execute("INSERT OR IGNORE INTO data_labels VALUES ('t', '1', 'x', NULL, 8)") == 0
    assert engine.get_labels("t", "1").first()["tagged_by"] == "me"
    assert run(engine.store, "SELECT 1 AS x").first()["x"] == 1
    assert engine.execute("DROP TABLE notes") == 0 and engine.execute("DROP TABLE IF EXISTS notes") == 0
    with pytest.raises(SqlError):
        engine.execute("FROB")


def test_json_rows(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, CAST('xyz' AS BINARY) AS c, double('NaN') AS d, 2 AS a")
    assert json.loads(json_rows(df).first()["row"]) == {"a": 2, "b": None, "c": "<blob 3 bytes>", "d": None}
    assert shim("SELECT IFNULL(a, 'b') FROM t WHERE x = ?1") == "SELECT coalesce(a, 'b') FROM t WHERE x = ?1"
    assert bind("a = ?2 AND b = ? AND c = '?' AND d = ?1", [5, 6, 7]) == ("a = :_p2 AND b = :_p3 AND c = '?' AND d = :_p1", {"_p1": 5, "_p2": 6, "_p3": 7})
    with pytest.raises(SqlError):
        bind("?3", [1])
    assert split_top("a = f(1, 2), b = 'x, y', c = 3", ",") == ["a = f(1, 2)", " b = 'x, y'", " c = 3"]
    assert split_top("SET a = 'w where x' WHERE b = (SELECT 1 WHERE true)", "WHERE") == ["SET a = 'w where x' ", " b = (SELECT 1 WHERE true)"]
    assert split_statements("a; 'b;c' -- d;\n; e") == ["a", "'b;c'", "e"]


def test_versions_and_snapshots(spark, engine, tmp_path):
    engine.add_node("a", "k")
    engine.execute("CREATE TABLE own (x INTEGER)")
    engine.execute("INSERT INTO own VALUES (5)")
    engine.store.snapshot(str(tmp_path / "copy"))
    other = Engine.open(spark, str(tmp_path / "copy"))
    assert other.get_node("a")["kind"] == "k" and other.query("SELECT x FROM own").first()["x"] == 5
    m = other.store.manifest()
    other.store._publish(m | {"schema_version": "4", "version": m["version"] + 1})
    with pytest.raises(SchemaMigration):
        Store(spark, other.store.root)
    old = Store(spark, other.store.root, check=False)
    old.migrate()
    old.migrate()
    assert Engine.open(spark, other.store.root).get_node("a")
    for fmt in ("parquet", "json", "csv", "orc"):
        engine.store.export(str(tmp_path / fmt), fmt, ["nodes", "vectors"])
        assert getattr(spark.read, fmt)(str(tmp_path / fmt / "nodes")).count() == 1
    df = spark.createDataFrame([("it's", None, bytearray(b"\x01\xff"), 2.5)], "a string, b long, c binary, d double")
    assert sql_dump(df, "t").first()["statement"] == "INSERT INTO \"t\" (\"a\", \"b\", \"c\", \"d\") VALUES ('it''s', NULL, X'01FF', 2.5);"
    engine.add_node("a", "k2")
    engine.store.compact()
    assert engine.get_node("a")["kind"] == "k2" and len(engine.store.manifest()["tables"]["nodes"]) == 1
    engine.close()
    with pytest.raises(InvalidArgument):
        engine.get_node("a")


def test_hybrid_and_missing_collection(engine):
    engine.add_node("root", "k")
    engine.add_node("a", "k")
    engine.add_edge("root", "a", "r", 0.9)
    engine.collection("c", 2).upsert_batch([("a", [1, 0]), ("b", [0.9, 0.1])])
    assert engine.hybrid_query("c", [1, 0], "root").first()["id"] == "a"
    assert engine.hybrid_query("none", [1, 0], "root").count() == 0
    assert engine.tri_modal_query("c", [1, 0], "root", "").first()["id"] == "a"
    with pytest.raises(DimensionMismatch):
        engine.hybrid_query("c", [1], "root")


def test_sync(spark, engine):
    h = engine.record_mutation("t", "1", "insert", {"a": 1})
    ops = lambda rows: spark.createDataFrame(rows, "op_id string, hlc_ts long, node_id string, table_name string, record_id string, op_type string, payload string")
    got = engine.apply_remote_ops(ops([("r1", h + 5, "n", "t", "1", "update", None), ("r2", h - 5, "n", "t", "1", "update", None), ("r3", 7, "n", "t", "2", "insert", None)]))
    assert got == {"applied": 2, "conflicts": 2, "skipped": 1}
    assert {r["record_id"]: r["op_id"] for r in engine.get_ops_since(0).collect()} == {"1": "r1", "2": "r3"}
    engine.add_peer("p", "url")
    engine.add_peer("p", "url2")
    s = engine.sync_status().first()
    assert s["ops_pending"] == 2 and s["endpoint"] == "url2"
    engine.set_strategy("fww")
    assert engine.apply_remote_ops(ops([("r9", 3, "n", "t", "2", "update", None)]))["applied"] == 1
    with pytest.raises(InvalidArgument):
        engine.set_strategy("x")
    with pytest.raises(InvalidArgument):
        engine.record_mutation("t", "1", "merge")


def test_dispatcher(engine):
    d = Dispatcher(engine)
    ask = lambda m, /, **params: json.loads(d.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": params})))
    call = lambda n, /, **a: ask("tools/call", name=n, arguments=a)
    assert len(ask("tools/list")["result"]["tools"]) == 22
    assert json.loads(d.handle("{"))["error"]["code"] == -32700
    assert ask("nope")["error"]["code"] == -32601
    assert call("query")["error"]["code"] == -32602
    assert call("query", sql="SELECT x FROM nowhere")["error"]["code"] == -32000
    assert ask("resources/read", uri="x")["error"]["code"] == -32002
    assert d.handle(json.dumps({"jsonrpc": "2.0", "method": "ping"})) is None
    call("vector_upsert", collection="c", id="a", vector=[1, 0], metadata={"k": 1})
    assert json.loads(call("vector_search", collection="c", vector=[1, 0])["result"]["content"][0]["text"])[0]["id"] == "a"
    call("prompt_create", name="p", template="Hi {{x}}")
    assert ask("prompts/get", name="p", arguments={"x": "you"})["result"]["messages"][0]["content"]["text"] == "Hi you"
    assert json.loads(ask("resources/read", uri="mnemospark://stats")["result"]["contents"][0]["text"])["vectors"] == 1
    assert engine.store.read("vectors").filter(F.col("id") == "a").count() == 1


def test_numbered_parameters_and_updates(engine):
    engine.execute("CREATE TABLE kv (key TEXT PRIMARY KEY, val TEXT, n INTEGER)")
    assert engine.execute("INSERT INTO kv (val, key) VALUES (?2, ?1)", ["k1", "seven"]) == 1
    assert engine.execute("INSERT INTO kv VALUES (?1, ?1, ?2)", ["k2", 4]) == 1
    assert engine.execute("UPDATE kv SET val = ?1 WHERE key = ?2", ["kept where it was, set = 5", "k1"]) == 1
    assert engine.execute("UPDATE kv SET n = 5, val = 'z' WHERE key = 'k2' AND val <> ' where '") == 1
    assert {tuple(r) for r in engine.query("SELECT * FROM kv").collect()} == {("k1", "kept where it was, set = 5", None), ("k2", "z", 5)}
    with pytest.raises(SqlError):
        engine.execute("INSERT INTO kv VALUES ('k1', 'again', 1)")
    assert engine.execute("INSERT OR REPLACE INTO kv VALUES ('k1', 'new', 1)") == 1
    assert engine.query("SELECT val FROM kv WHERE key = 'k1'").collect()[0][0] == "new"
    with pytest.raises(SqlError):
        engine.execute("INSERT INTO kv (key, nothing) VALUES ('a', 1)")


def test_on_conflict(engine):
    engine.execute("CREATE TABLE kv (key TEXT PRIMARY KEY, val TEXT, n INTEGER)")
    engine.execute("INSERT INTO kv VALUES ('a', 'x', 1), ('b', 'y', 2)")
    assert engine.execute("INSERT INTO kv VALUES ('a', 'new', 10), ('c', 'z', 3) ON CONFLICT (key) DO UPDATE SET val = excluded.val, n = n + excluded.n WHERE kv.n < 5") == 2
    assert engine.execute("INSERT INTO kv VALUES ('a', 'no', 0) ON CONFLICT DO NOTHING") == 0
    assert engine.execute("INSERT INTO kv VALUES ('a', 'no', 0) ON CONFLICT (key) DO UPDATE SET val = ?1 WHERE n < 0", ["never"]) == 0
    assert {tuple(r) for r in engine.query("SELECT * FROM kv").collect()} == {("a", "new", 11), ("b", "y", 2), ("c", "z", 3)}
    with pytest.raises(SqlError):
        engine.execute("INSERT INTO kv VALUES ('q', '', 0), ('q', '', 1) ON CONFLICT (key) DO UPDATE SET n = 0")
    engine.add_node("n1", "person", {"a": 1})
    engine.execute("INSERT INTO nodes VALUES ('n1', 'city', NULL, 5, 6) ON CONFLICT (id) DO UPDATE SET kind = excluded.kind, data = coalesce(excluded.data, data)")
    assert engine.get_node("n1")["kind"] == "city" and engine.get_node("n1")["data"] == '{"a": 1}'


def test_pragma(engine):
    assert [r["name"] for r in run(engine.store, "PRAGMA table_info(nodes)").collect()][:2] == ["id", "kind"]
    assert run(engine.store, "PRAGMA integrity_check").first()[0] == "ok" and run(engine.store, "PRAGMA journal_mode = WAL").count() == 0


def test_remote_operations_leave_others(engine):
    """Only the operation that lost is replaced; what peers have not fetched stays."""
    a, b = engine.record_mutation("t", "1", "insert", {"v": 1}), engine.record_mutation("t", "1", "update", {"v": 2})
    c = engine.record_mutation("t", "2", "insert")
    kind = "op_id string, hlc_ts long, node_id string, table_name string, record_id string, op_type string, payload string"
    ops = engine.store.spark.createDataFrame([("r1", b + 5, "far", "t", "1", "update", "{}"), ("r2", 1, "far", "t", "2", "update", "{}"), ("r3", 7, "far", "t", "3", "insert", "{}")], kind)
    assert engine.apply_remote_ops(ops) == {"applied": 2, "conflicts": 2, "skipped": 1}
    log = {(r["record_id"], r["hlc_ts"], r["node_id"]) for r in engine.get_ops_since(0).collect()}
    assert log == {("1", a, "local"), ("1", b + 5, "far"), ("2", c, "local"), ("3", 7, "far")}


def test_approximate_search_follows_the_store(engine):
    """The index is built once, then follows inserts, replacements and deletes, and is found again after opening."""
    import random

    r = random.Random(3)
    c = engine.collection("ann", 4)
    c.upsert_batch([(f"v{i}", [r.gauss(0, 1) for _ in range(4)], {"i": i}) for i in range(120)])
    q = [1.0, 0.2, -0.3, 0.1]
    ids = lambda **kw: [x["id"] for x in c.search(q, 5, **kw).collect()]
    assert ids(mode="approx", probes=64) == ids()
    assert len(set(ids(mode="approx", probes=16)) & set(ids())) >= 3
    c.upsert("new", q)
    c.delete(ids()[1])
    c.upsert("v7", [-x for x in q])
    assert ids(mode="approx", probes=64) == ids() and ids()[0] == "new"
    assert ids(mode="approx", probes=64, filter={"i": {"$lt": 50}}) == ids(filter={"i": {"$lt": 50}})
    other = Engine(Store(engine.store.spark, engine.store.root)).get_collection("ann")
    assert [x["id"] for x in other.search(q, 5, mode="approx", probes=64).collect()] == ids()
    engine.store.compact(["vectors"])
    assert ids(mode="approx", probes=64) == ids()
    with pytest.raises(DimensionMismatch):
        c.search([1.0], mode="approx")

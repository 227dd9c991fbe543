"""A JSON-RPC 2.0 dispatcher over an engine, and a command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..errors import EngineError, InvalidArgument
from ..operators import memory
from .engine import Engine

PARSE, METHOD, PARAMS, ENGINE, RESOURCE = -32700, -32601, -32602, -32000, -32002

_S, _I, _N, _O, _A = ({"type": t} for t in ("string", "integer", "number", "object", "array"))
# tool -> (description, parameters, required)
TOOLS: dict[str, tuple[str, dict, tuple[str, ...]]] = {
    "execute": ("Run a statement", {"sql": _S}, ("sql",)),
    "query": ("Run a query", {"sql": _S}, ("sql",)),
    "vector_upsert": ("Insert or replace a vector", {"collection": _S, "id": _S, "vector": _A, "metadata": _O}, ("collection", "id", "vector")),
    "vector_search": ("Nearest vectors", {"collection": _S, "vector": _A, "top_k": _I, "filter": _O}, ("collection", "vector")),
    "graph_add_node": ("Insert or replace a node", {"id": _S, "kind": _S, "data": _O}, ("id", "kind")),
    "graph_add_edge": ("Insert or replace an edge", {"src": _S, "dst": _S, "relation": _S, "weight": _N}, ("src", "dst", "relation")),
    "graph_neighbors": ("What a node reaches", {"id": _S, "max_depth": _I, "min_weight": _N}, ("id",)),
    "tool_register": ("Register a tool", {"name": _S, "description": _S, "parameters_schema": _O, "version": _S}, ("name",)),
    "tool_list": ("List tools", {}, ()),
    "tool_log_call": ("Log a tool call", {"tool_name": _S, "arguments": _O, "result": _O, "error": _S, "latency_ms": _I, "session_id": _S}, ("tool_name",)),
    "audit_log": ("Append an audit entry", {"action": _S, "table_name": _S, "record_id": _S, "actor": _S, "reason": _S}, ("action", "table_name", "record_id")),
    "audit_query_recent": ("Newest audit entries", {"limit": _I}, ()),
    "context_add": ("Add a context entry", {"session_id": _S, "source_type": _S, "source_id": _S, "token_count": _I, "content_preview": _S, "relevance_score": _N, "priority": _I}, ("session_id", "source_type", "source_id", "token_count")),
    "context_build_window": ("Entries that fit", {"session_id": _S, "max_tokens": _I}, ("session_id", "max_tokens")),
    "context_clear": ("Delete a session's entries", {"session_id": _S}, ("session_id",)),
    "prompt_create": ("A new version of a template", {"name": _S, "template": _S}, ("name", "template")),
    "prompt_render": ("Fill a template", {"name": _S, "variables": _O}, ("name",)),
    "label_tag": ("Label a record", {"table_name": _S, "record_id": _S, "label": _S, "tagged_by": _S}, ("table_name", "record_id", "label")),
    "label_untag": ("Take a label off", {"table_name": _S, "record_id": _S, "label": _S}, ("table_name", "record_id", "label")),
    "label_get": ("A record's labels", {"table_name": _S, "record_id": _S}, ("table_name", "record_id")),
    "label_has": ("Whether a record has a label", {"table_name": _S, "record_id": _S, "label": _S}, ("table_name", "record_id", "label")),
    "stats": ("Counters", {}, ()),
}


class RpcError(Exception):
    """An error with a JSON-RPC code."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Dispatcher:
    """Requests to results; results leave the engine, so they are what fits on one machine."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def handle(self, text: str) -> str | None:
        """The answer to one request; None to a notification."""
        try:
            request = json.loads(text)
        except ValueError as e:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": f"parse error: {e}"}})
        id = request.get("id")
        try:
            result = self.call(request.get("method", ""), request.get("params") or {})
        except RpcError as e:
            answer = {"jsonrpc": "2.0", "id": id, "error": {"code": e.code, "message": str(e)}}
        else:
            answer = {"jsonrpc": "2.0", "id": id, "result": result}
        return None if "id" not in request else json.dumps(answer, default=str)

    def call(self, method: str, params: dict):
        """The result of a method."""
        if method == "initialize":
            return {"protocolVersion": "2024-11-05", "serverInfo": {"name": "mnemospark", "version": __version__}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}}
        if method in ("ping", "notifications/initialized"):
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": list(r)}} for n, (d, p, r) in TOOLS.items()]}
        if method == "tools/call":
            return {"content": [{"type": "text", "text": json.dumps(self.tool(params.get("name", ""), params.get("arguments") or {}), default=str)}]}
        if method == "resources/list":
            return {"resources": [{"uri": "mnemospark://stats", "name": "Counters", "mimeType": "application/json"}]}
        if method == "resources/read":
            if params.get("uri") != "mnemospark://stats":
                raise RpcError(RESOURCE, f"no resource {params.get('uri')}")
            return {"contents": [{"uri": params["uri"], "mimeType": "application/json", "text": json.dumps(self.engine.stats())}]}
        if method == "prompts/list":
            return {"prompts": [{"name": r["name"]} for r in self.engine.list_templates().select("name").distinct().orderBy("name").collect()]}
        if method == "prompts/get":
            try:
                text = self.engine.render(params.get("name", ""), params.get("arguments") or {})
            except InvalidArgument as e:
                raise RpcError(PARAMS, str(e)) from e
            return {"messages": [{"role": "user", "content": {"type": "text", "text": text}}]}
        raise RpcError(METHOD, f"no method {method}")

    def tool(self, name: str, a: dict):
        """The result of a tool."""
        if name not in TOOLS:
            raise RpcError(METHOD, f"no tool {name}")
        if missing := [p for p in TOOLS[name][2] if p not in a]:
            raise RpcError(PARAMS, f"missing {', '.join(missing)}")
        e = self.engine
        own = {
            "execute": lambda: {"rows_affected": e.execute(a["sql"])},
            "query": lambda: _rows(e.query(a["sql"])),
            "vector_upsert": lambda: e.collection(a["collection"], len(a["vector"])).upsert(a["id"], a["vector"], a.get("metadata")),
            "vector_search": lambda: _rows(e.collection(a["collection"], len(a["vector"])).search(a["vector"], a.get("top_k", 10), a.get("filter"))),
            "graph_add_node": lambda: e.add_node(a["id"], a["kind"], a.get("data")),
            "graph_add_edge": lambda: e.add_edge(a["src"], a["dst"], a["relation"], a.get("weight", 1.0)),
            "graph_neighbors": lambda: _rows(e.neighbors(a["id"], a.get("max_depth", 2), a.get("min_weight"))),
            "tool_register": lambda: {"id": e.register_tool(**a)},
            "tool_list": lambda: _rows(e.list_tools()),
            "tool_log_call": lambda: {"id": e.log_tool_call(**a)},
            "audit_log": lambda: {"id": e.audit(**a)},
            "audit_query_recent": lambda: _rows(memory.audit_recent(e.store.read("audit_log"), a.get("limit", 100))),
            "context_add": lambda: {"id": e.add_context(**a)},
            "context_build_window": lambda: _rows(e.build_window(a["session_id"], a["max_tokens"])),
            "context_clear": lambda: e.clear_session(a["session_id"]),
            "prompt_create": lambda: {"version": e.create_template(a["name"], a["template"])},
            "prompt_render": lambda: {"text": e.render(a["name"], a.get("variables") or {})},
            "label_tag": lambda: e.tag(**a),
            "label_untag": lambda: e.untag(**a),
            "label_get": lambda: _rows(e.get_labels(a["table_name"], a["record_id"])),
            "label_has": lambda: e.has_label(a["table_name"], a["record_id"], a["label"]),
            "stats": e.stats,
        }
        try:
            out = own[name]()
        except TypeError as x:
            raise RpcError(PARAMS, str(x)) from x
        except EngineError as x:
            raise RpcError(ENGINE, str(x)) from x
        return {"ok": True} if out is None else out


def completions(shell: str, commands: list[str]) -> str:
    """A line for a shell's start file that completes the commands."""
    words = " ".join(commands)
    return {"bash": f'complete -W "{words}" mnemospark', "zsh": f"compctl -k '({words})' mnemospark", "fish": f"complete -c mnemospark -f -a '{words}'"}[shell]


def main(argv: list[str] | None = None) -> int:
    """The command line; ``python -m mnemospark --help`` lists the commands."""
    from ..plans.sql import run
    from ..session import get_spark
    from .store import create_statement, sql_dump

    p = argparse.ArgumentParser(prog="mnemospark")
    p.add_argument("--root", help="the store's folder")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("completions").add_argument("shell", choices=["bash", "zsh", "fish"])
    for name in ("version", "stats", "collections", "inspect", "migrate", "shell", "mcp"):
        sub.add_parser(name)
    sub.add_parser("sql").add_argument("text")
    s = sub.add_parser("search")
    s.add_argument("collection")
    s.add_argument("vector", help="JSON array")
    s.add_argument("--top-k", type=int, default=5)
    sub.add_parser("reindex").add_argument("collection")
    x = sub.add_parser("export")
    x.add_argument("path")
    x.add_argument("--table")
    x.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "orc", "sql"])
    a = p.parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "completions":
        print(completions(a.shell, sorted(sub.choices)))
        return 0
    spark = get_spark("local[*]")
    if a.command == "migrate":
        from .store import Store

        Store(spark, a.root, check=False).migrate()
        return 0
    with Engine.open(spark, a.root) as e:
        if a.command == "stats":
            print(json.dumps(e.stats()))
        elif a.command == "collections":
            e.list_collections().show(truncate=False)
        elif a.command == "inspect":
            print(json.dumps(e.stats()))
            e.store.read("nodes").orderBy(F.desc("created_at"), "id").limit(10).show(truncate=False)
        elif a.command == "search":
            v = json.loads(a.vector)
            e.collection(a.collection, len(v)).search(v, a.top_k).show(truncate=False)
        elif a.command == "reindex":
            e.get_collection(a.collection).reindex()
        elif a.command == "export":
            tables = [a.table] if a.table else None
            if a.format == "sql":
                for t in tables or e.store.tables():
                    ddl = spark.createDataFrame([(create_statement(e.store, t),)], "statement string")
                    ddl.unionByName(sql_dump(e.store.read(t), t)).write.mode("overwrite").text(f"{a.path}/{t}")
            else:
                e.store.export(a.path, a.format, tables)
        elif a.command in ("sql", "shell"):
            for line in [a.text] if a.command == "sql" else sys.stdin:
                if line.strip():
                    out = run(e.store, line.strip().rstrip(";"))
                    out.show(truncate=False) if isinstance(out, DataFrame) else print(out)
        elif a.command == "mcp":
            d = Dispatcher(e)
            for line in sys.stdin:
                if line.strip() and (answer := d.handle(line)):
                    print(answer, flush=True)
    return 0

"""Schemas of the stored tables. Times are epoch milliseconds, JSON is text."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = "5"

# Table -> (columns, key columns); a question mark allows null.
_TABLES = {
    "meta": ("key string, value string", ("key",)),
    "collections": ("id string, name string, dim long, metric string, created_at long", ("id",)),
    "vectors": ("id string, collection_id string, vector array<float>, metadata string?, created_at long, updated_at long", ("id", "collection_id")),
    "texts": ("collection string, id string, text string", ("collection", "id")),
    "nodes": ("id string, kind string, data string?, created_at long, updated_at long", ("id",)),
    "edges": ("src string, dst string, relation string, weight double, created_at long", ("src", "dst", "relation")),
    "conversations": ("id string, title string?, metadata string?, created_at long, updated_at long", ("id",)),
    "messages": ("id string, conversation_id string, role string, content string, metadata string?, created_at long", ("id",)),
    "workflows": ("id string, name string, status string, input string?, output string?, error string?, metadata string?, created_at long, updated_at long", ("id",)),
    "workflow_steps": ("id string, workflow_id string, step_index long, name string, status string, input string?, output string?, error string?, started_at long?, completed_at long?", ("id",)),
    "traces": ("id string, session_id string?, parent_id string?, trace_type string, content string, metadata string?, created_at long", ("id",)),
    "tools": ("id string, name string, description string?, parameters_schema string?, version string, created_at long, updated_at long", ("name",)),
    "tool_calls": ("id string, session_id string?, tool_name string, arguments string?, result string?, error string?, latency_ms long?, created_at long", ("id",)),
    "audit_log": ("id string, timestamp long, actor string?, action string, table_name string, record_id string, old_value string?, new_value string?, reason string?", ("id",)),
    "context_entries": ("id string, session_id string, source_type string, source_id string, content_preview string?, token_count long, relevance_score double, priority long, included_at long", ("id",)),
    "prompt_templates": ("id string, name string, version long, template string, model_hint string?, max_tokens long?, metadata string?, created_at long", ("name", "version")),
    "data_labels": ("table_name string, record_id string, label string, tagged_by string?, tagged_at long", ("table_name", "record_id", "label")),
    "sync_log": ("op_id string, hlc_ts long, node_id string, table_name string, record_id string, op_type string, payload string?", ("op_id",)),
    "sync_peers": ("peer_id string, last_synced_hlc long, endpoint string?", ("peer_id",)),
}

KEYS: dict[str, tuple[str, ...]] = {n: k for n, (_, k) in _TABLES.items()}


_SIMPLE = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "array<float>": T.ArrayType(T.FloatType())}
SCHEMAS: dict[str, T.StructType] = {
    n: T.StructType([T.StructField(p.rstrip("?").split(" ", 1)[0], _SIMPLE[p.rstrip("?").split(" ", 1)[1]]) for p in ddl.split(", ")]) for n, (ddl, _) in _TABLES.items()
}
REQUIRED: dict[str, tuple[str, ...]] = {n: tuple(p.split(" ", 1)[0] for p in ddl.split(", ") if not p.endswith("?")) for n, (ddl, _) in _TABLES.items()}
APPEND_ONLY = ("audit_log", "tool_calls", "sync_log")
#: Child table -> (column, parent table, parent column) along which deletes cascade.
CASCADES = {"vectors": (("collection_id", "collections", "id"),), "edges": (("src", "nodes", "id"), ("dst", "nodes", "id")), "messages": (("conversation_id", "conversations", "id"),), "workflow_steps": (("workflow_id", "workflows", "id"),)}

"""The engine: one object over a store with all stores' operations."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CollectionNotFound, DimensionMismatch, EdgeNotFound, InvalidArgument, NodeNotFound
from ..functions.distance import METRICS
from ..operators import fulltext, graph, hybrid, memory, sync, vector
from .store import Store, now_ms


def _json(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def _id() -> str:
    return str(uuid.uuid4())


class Collection:
    """A named set of vectors of one length and metric."""

    def __init__(self, engine: "Engine", row: dict):
        self.engine, self.id, self.name, self.dim, self.metric = engine, row["id"], row["name"], row["dim"], row["metric"]

    def rows(self) -> DataFrame:
        """(id, vector, metadata, created_at, updated_at)."""
        return self.engine.store.read("vectors").filter(F.col("collection_id") == self.id).drop("collection_id")

    def upsert(self, id: str, vec: Sequence[float], metadata=None) -> None:
        """Insert or replace one vector; metadata is replaced, too."""
        self.upsert_batch([(id, vec, metadata)])

    def upsert_batch(self, entries: Sequence[tuple]) -> int:
        """Insert or replace (id, vector, metadata) entries, all or none; the number of new ids. The last of an id counts."""
        for _, v, *_ in entries:
            if len(v) != self.dim:
                raise DimensionMismatch(self.dim, len(v))
        if not entries:
            return 0
        last = {e[0]: e for e in entries}
        ids = self.engine.store.spark.createDataFrame([(i,) for i in last], "id string")
        known = {r["id"]: r["created_at"] for r in self.rows().join(ids, "id", "left_semi").select("id", "created_at").collect()}  # at most the batch
        t = now_ms()
        self.engine.store.put("vectors", [{"id": i, "collection_id": self.id, "vector": [float(x) for x in e[1]], "metadata": _json(e[2] if len(e) > 2 else None), "created_at": known.get(i, t), "updated_at": t} for i, e in last.items()])
        return len(last) - len(known)

    def upsert_frame(self, df: DataFrame) -> None:
        """Insert or replace the rows (id, vector[, metadata]) of a frame of any size; of an id that stands twice any row counts.

        Rows whose vector is null or of another length are refused before anything is written.
        """
        rows = df.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), (F.col("metadata").cast("string") if "metadata" in df.columns else F.lit(None).cast("string")).alias("metadata"))
        wrong = rows.filter(F.coalesce(F.size("vector") != self.dim, F.lit(True))).select(F.size("vector")).limit(1).collect()
        if wrong:
            raise DimensionMismatch(self.dim, max(0, wrong[0][0] or 0))
        t, known = now_ms(), self.rows().select("id", F.col("created_at").alias("_made"))
        rows = rows.dropDuplicates(["id"]).join(known, "id", "left")
        self.engine.store.put("vectors", rows.select("id", F.lit(self.id).alias("collection_id"), "vector", "metadata", F.coalesce("_made", F.lit(t)).alias("created_at"), F.lit(t).alias("updated_at")))

    def upsert_with_text(self, id: str, vec: Sequence[float], text: str, metadata=None) -> None:
        """A vector and its text, together or not at all."""
        with self.engine.store.transaction():
            self.upsert(id, vec, metadata)
            self.engine.index_text(self.name, id, text)

    def search(self, query: Sequence[float], top_k: int = 10, filter: dict | None = None, mode: str = "prefilter", probes: int = 8) -> DataFrame:
        """Nearest vectors by the collection's metric: exact (``prefilter``, ``overfetch``), or ``approx``, in ``probes`` lists of the index."""
        if mode == "approx":
            if len(query) != self.dim:
                raise DimensionMismatch(self.dim, len(query))
            return self.ensure_index().search(query, top_k, probes, filter)
        return vector.vector_search(self.rows(), query, top_k, self.metric, filter, mode, self.dim)

    def _index_path(self) -> str:
        return f"{self.engine.store.root}/indexes/{self.id}"

    def ensure_index(self) -> vector.ListIndex:
        """The collection's index in its present state: built if there is none, brought up to date from what was written since.

        What was written is taken from the new files of the change log; if the log was compacted, the index is built anew.
        """
        store = self.engine.store
        files = store.manifest()["tables"].get("vectors", [])
        state = store.note(f"{self._index_path()}/state.json")
        if state is None or state["files"] != files[: len(state["files"])]:
            return self.reindex()
        index = vector.ListIndex.open(store.spark, state["path"])
        new = files[len(state["files"]) :]
        if new:
            log = store.log("vectors", new).filter(F.col("collection_id") == self.id)
            last = log.groupBy("id").agg(F.max_by(F.struct("_op", "vector", "metadata"), "_seq").alias("r")).select("id", "r.*")
            seq = state["seq"] + 1
            index.add(last.filter("_op = 'put'"), seq)
            index.remove(last.filter("_op = 'delete'"), seq)
            store.note(f"{self._index_path()}/state.json", {"path": state["path"], "files": files, "seq": seq})
        return index

    def delete(self, id: str) -> None:
        """Delete a vector; an unknown id is no error, its text stays."""
        self.engine.store.delete("vectors", self.engine.store.spark.createDataFrame([(id, self.id)], "id string, collection_id string"))

    def delete_where(self, spec: dict) -> int:
        """Delete the vectors whose metadata matches a filter; their number."""
        from ..operators.filters import compile_filter, metadata_variant

        hit = self.rows().filter(compile_filter(spec, metadata_variant(F.col("metadata")))).select("id", F.lit(self.id).alias("collection_id"))
        n = hit.count()
        if n:
            self.engine.store.delete("vectors", hit)
        return n

    def count(self) -> int:
        """Number of vectors."""
        return self.rows().count()

    def reindex(self, lists: int = 64) -> vector.ListIndex:
        """Build the inverted-list index for approximate search anew; it is kept beside the store's tables."""
        store = self.engine.store
        path = f"{self._index_path()}/{_id()[:8]}"
        index = vector.ListIndex(self.rows(), lists, self.metric, path=path)
        store.note(f"{self._index_path()}/state.json", {"path": path, "files": store.manifest()["tables"].get("vectors", []), "seq": 0})
        return index


class Engine:
    """``Engine.open(spark, folder)``; a context manager that closes itself."""

    def __init__(self, store: Store):
        self.store, self.clock = store, sync.Clock()
        self.strategy = "lww"

    @classmethod
    def open(cls, spark: SparkSession, root: str | None = None) -> "Engine":
        """Open or create a store."""
        return cls(Store(spark, root))

    def close(self) -> None:
        """Compact and close."""
        self.store.close()

    def __enter__(self) -> "Engine":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _one(self, table: str, cond) -> dict | None:
        rows = self.store.read(table).filter(cond).limit(2).collect()
        return rows[0].asDict() if rows else None

    def _keys(self, table: str, **key) -> DataFrame:
        from ..schemas import SCHEMAS

        return self.store.spark.createDataFrame([tuple(key.values())], ", ".join(f"{k} {SCHEMAS[table][k].dataType.simpleString()}" for k in key))

    # ---- collections ----

    def collection(self, name: str, dim: int, metric: str = "cosine") -> Collection:
        """Get or create; a known one keeps its metric and must have this length."""
        if metric not in METRICS:
            raise InvalidArgument(f"metric must be one of {METRICS}")
        row = self._one("collections", F.col("name") == name)
        if row is None:
            row = {"id": _id(), "name": name, "dim": int(dim), "metric": metric, "created_at": now_ms()}
            self.store.put("collections", [row])
        elif row["dim"] != dim:
            raise DimensionMismatch(row["dim"], dim)
        return Collection(self, row)

    def get_collection(self, name: str) -> Collection:
        """An existing collection."""
        row = self._one("collections", F.col("name") == name)
        if row is None:
            raise CollectionNotFound(name)
        return Collection(self, row)

    def list_collections(self) -> DataFrame:
        """(name, dim, metric, count) by name."""
        return vector.collection_stats(self.store.read("collections"), self.store.read("vectors"))

    def drop_collection(self, name: str, keep_text: bool = False) -> None:
        """Drop a collection with its vectors and, unless ``keep_text``, its texts; an unknown name is no error."""
        row = self._one("collections", F.col("name") == name)
        with self.store.transaction():
            if row:
                self.store.delete("collections", self._keys("collections", id=row["id"]))
            if not keep_text:
                texts = self.store.read("texts").filter(F.col("collection") == name)
                if not texts.isEmpty():
                    self.store.delete("texts", texts)

    # ---- text ----

    def index_text(self, collection: str, id: str, text: str) -> None:
        """Put a text in place of the id's last."""
        self.store.put("texts", [{"collection": collection, "id": id, "text": text}])

    def _text_state(self, collection: str) -> str:
        return f"{self.store.root}/indexes/text-{collection.encode().hex()}/state.json"

    def text_index(self, collection: str) -> fulltext.TextIndex:
        """The index of a collection's texts: the one that :meth:`optimize_text` saved if no text was written since, else one made for the search."""
        state = self.store.note(self._text_state(collection))
        if state is not None and state["files"] == self.store.manifest()["tables"].get("texts", []):
            return fulltext.TextIndex.open(self.store.spark, state["path"])
        return fulltext.TextIndex(self.store.read("texts").filter(F.col("collection") == collection).select("id", "text"))

    def optimize_text(self, collection: str) -> None:
        """Save the index of a collection's texts, sorted by term, beside the store's tables; searches read the parts with their terms."""
        path = self._text_state(collection).replace("state.json", _id()[:8])
        fulltext.TextIndex(self.store.read("texts").filter(F.col("collection") == collection).select("id", "text")).save(path)
        self.store.note(self._text_state(collection), {"path": path, "files": self.store.manifest()["tables"].get("texts", [])})

    def search_text(self, collection: str, query: str, top_k: int = 10) -> DataFrame:
        """(doc_id, rank, snippet), best first; a collection without texts finds nothing."""
        return self.text_index(collection).search(query, top_k, snippets=True)

    def delete_text(self, collection: str, id: str) -> None:
        """Delete a text; an unknown one is no error."""
        self.store.delete("texts", self._keys("texts", collection=collection, id=id))

    # ---- graph ----

    def add_node(self, id: str, kind: str, data=None) -> None:
        """Insert or replace a node; its creation stays."""
        old, t = self._one("nodes", F.col("id") == id), now_ms()
        self.store.put("nodes", [{"id": id, "kind": kind, "data": _json(data), "created_at": old["created_at"] if old else t, "updated_at": t}])

    def get_node(self, id: str) -> dict:
        """A node; ``NodeNotFound``."""
        row = self._one("nodes", F.col("id") == id)
        if row is None:
            raise NodeNotFound(id)
        return row

    def delete_node(self, id: str) -> None:
        """Delete a node and the edges at it."""
        self.store.delete("nodes", self._keys("nodes", id=id))

    def add_edge(self, src: str, dst: str, relation: str, weight: float = 1.0) -> None:
        """Insert or replace an edge; both ends must exist."""
        for end in (src, dst):
            self.get_node(end)
        self.store.put("edges", [{"src": src, "dst": dst, "relation": relation, "weight": float(weight), "created_at": now_ms()}])

    def delete_edge(self, src: str, dst: str, relation: str) -> None:
        """Delete an edge; ``EdgeNotFound``."""
        if self._one("edges", (F.col("src") == src) & (F.col("dst") == dst) & (F.col("relation") == relation)) is None:
            raise EdgeNotFound(f"{src} -{relation}-> {dst}")
        self.store.delete("edges", self._keys("edges", src=src, dst=dst, relation=relation))

    def neighbors(self, start: str, max_depth: int = 2, min_weight: float | None = None, relation: str | None = None, mode: str = "exact") -> DataFrame:
        """What a node reaches."""
        return graph.neighbors(self.store.read("nodes"), self.store.read("edges"), start, max_depth, min_weight, relation, mode)

    # ---- hybrid ----

    def hybrid_query(self, collection: str, query: Sequence[float], anchor: str, alpha: float = 0.6, depth: int = 2, top_k: int = 10, filter: dict | None = None) -> DataFrame:
        """Vector and graph blended; a missing collection finds nothing."""
        row = self._one("collections", F.col("name") == collection)
        if row is None:
            return self.store.spark.createDataFrame([], "id string, score double, vector_score double, graph_weight double, metadata string")
        c = Collection(self, row)
        if len(query) != c.dim:
            raise DimensionMismatch(c.dim, len(query))
        return hybrid.hybrid_query(c.rows(), self.store.read("edges"), query, anchor, alpha, depth, top_k, c.metric, filter)

    def tri_modal_query(self, collection: str, query: Sequence[float] = (), anchor: str = "", text: str = "", alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3, depth: int = 2, top_k: int = 10, filter: dict | None = None) -> DataFrame:
        """Vector, graph and text blended."""
        row = self._one("collections", F.col("name") == collection)
        rows = Collection(self, row).rows() if row and len(query) == row["dim"] else None
        return hybrid.tri_modal_query(rows, self.store.read("edges"), self.text_index(collection), query, anchor, text, alpha, beta, gamma, depth, top_k, row["metric"] if row else "cosine", filter)

    # ---- conversations ----

    def create_conversation(self, title: str | None = None, metadata=None, id: str | None = None) -> str:
        """A new conversation; an id that exists is an error."""
        id, t = id or _id(), now_ms()
        if self._one("conversations", F.col("id") == id):
            raise InvalidArgument(f"conversation {id} exists")
        self.store.put("conversations", [{"id": id, "title": title, "metadata": _json(metadata), "created_at": t, "updated_at": t}])
        return id

    def add_message(self, conversation_id: str, role: str, content: str, metadata=None) -> str:
        """Add a message and touch its conversation, together."""
        conv = self._one("conversations", F.col("id") == conversation_id)
        if conv is None:
            raise InvalidArgument(f"no conversation {conversation_id}")
        # the sequence number keeps messages of one millisecond in order
        id, t = f"{self.clock.now():020d}-{_id()[:8]}", now_ms()
        with self.store.transaction():
            self.store.put("messages", [{"id": id, "conversation_id": conversation_id, "role": role, "content": content, "metadata": _json(metadata), "created_at": t}])
            self.store.put("conversations", [conv | {"updated_at": t}])
        return id

    def get_messages(self, conversation_id: str, limit: int | None = None) -> DataFrame:
        """The last messages in order."""
        return memory.last_messages(self.store.read("messages"), limit, conversation_id).orderBy("position")

    def list_conversations(self) -> DataFrame:
        """Conversations, the last touched first."""
        return self.store.read("conversations").orderBy(F.desc("updated_at"), "id")

    def delete_conversation(self, id: str) -> None:
        """Delete a conversation with its messages."""
        self.store.delete("conversations", self._keys("conversations", id=id))

    def delete_message(self, id: str) -> None:
        """Delete one message."""
        self.store.delete("messages", self._keys("messages", id=id))

    def search_messages(self, query: str, top_k: int = 10, conversation_id: str | None = None) -> DataFrame:
        """Messages that match."""
        return fulltext.search_messages(self.store.read("messages"), query, top_k, conversation_id, stemmed=True)

    # ---- workflows ----

    def create_workflow(self, name: str, input=None, metadata=None) -> str:
        """A new workflow, pending."""
        id, t = _id(), now_ms()
        self.store.put("workflows", [{"id": id, "name": name, "status": "pending", "input": _json(input), "metadata": _json(metadata), "created_at": t, "updated_at": t}])
        return id

    def add_step(self, workflow_id: str, name: str, input=None) -> str:
        """A step after the last."""
        top = self.store.read("workflow_steps").filter(F.col("workflow_id") == workflow_id).agg(F.max("step_index")).first()[0]
        id = _id()
        self.store.put("workflow_steps", [{"id": id, "workflow_id": workflow_id, "step_index": 0 if top is None else top + 1, "name": name, "status": "pending", "input": _json(input)}])
        return id

    def update_step(self, step_id: str, status: str, output=None, error: str | None = None, strict: bool = False) -> None:
        """A new status; output and error are replaced if given; times follow the status."""
        if strict and status not in memory.STATUSES:
            raise InvalidArgument(f"no status {status!r}")
        row = self._one("workflow_steps", F.col("id") == step_id)
        if row is None:
            raise InvalidArgument(f"no step {step_id}")
        t = now_ms()
        new = {"status": status, "output": row["output"] if output is None else _json(output), "error": row["error"] if error is None else error}
        new |= {"started_at": t} if status == "running" else {"completed_at": t} if status in ("completed", "failed") else {}
        self.store.put("workflow_steps", [row | new])

    def complete_workflow(self, id: str, output=None) -> None:
        """Completed; the output is replaced even by nothing."""
        self._set_workflow(id, {"status": "completed", "output": _json(output)})

    def fail_workflow(self, id: str, error: str | None = None) -> None:
        """Failed; the error is replaced if given."""
        self._set_workflow(id, {"status": "failed"} | ({} if error is None else {"error": error}))

    def _set_workflow(self, id: str, new: dict) -> None:
        row = self._one("workflows", F.col("id") == id)
        if row is None:
            raise InvalidArgument(f"no workflow {id}")
        self.store.put("workflows", [row | new | {"updated_at": now_ms()}])

    def get_workflow(self, id: str) -> dict:
        """A workflow with its steps."""
        rows = memory.get_workflow(self.store.read("workflows"), self.store.read("workflow_steps"), id).collect()
        if not rows:
            raise InvalidArgument(f"no workflow {id}")
        return rows[0].asDict(recursive=True)

    def list_workflows(self, status: str | None = None) -> DataFrame:
        """Workflows with their number of steps."""
        return memory.list_workflows(self.store.read("workflows"), self.store.read("workflow_steps"), status)

    # ---- traces ----

    def add_trace(self, trace_type: str, content: str, session_id: str | None = None, parent_id: str | None = None, metadata=None) -> str:
        """A trace; its parent must exist."""
        if parent_id is not None and self._one("traces", F.col("id") == parent_id) is None:
            raise InvalidArgument(f"no trace {parent_id}")
        id = f"{self.clock.now():020d}-{_id()[:8]}"
        self.store.put("traces", [{"id": id, "session_id": session_id, "parent_id": parent_id, "trace_type": trace_type, "content": content, "metadata": _json(metadata), "created_at": now_ms()}])
        return id

    def get_traces(self, session_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        """A session's traces."""
        return memory.session_traces(self.store.read("traces"), session_id, limit, offset)

    def get_trace_tree(self, root: str) -> DataFrame:
        """A trace and all below it."""
        return memory.trace_tree(self.store.read("traces"), root)

    # ---- tools, audit ----

    def register_tool(self, name: str, description: str | None = None, parameters_schema=None, version: str = "1.0.0") -> str:
        """Insert or replace a tool by name; returns the stored id."""
        old, t = self._one("tools", F.col("name") == name), now_ms()
        id = old["id"] if old else _id()
        self.store.put("tools", [{"id": id, "name": name, "description": description, "parameters_schema": _json(parameters_schema), "version": version, "created_at": old["created_at"] if old else t, "updated_at": t}])
        return id

    def get_tool(self, name: str) -> dict | None:
        """A tool by name."""
        return self._one("tools", F.col("name") == name)

    def list_tools(self) -> DataFrame:
        """Tools by name."""
        return self.store.read("tools").orderBy("name")

    def delete_tool(self, name: str) -> None:
        """Delete a tool."""
        self.store.delete("tools", self._keys("tools", name=name))

    def log_tool_call(self, tool_name: str, arguments=None, result=None, error: str | None = None, latency_ms: int | None = None, session_id: str | None = None) -> str:
        """Append a call; the tool needn't be registered."""
        id = _id()
        self.store.put("tool_calls", [{"id": id, "session_id": session_id, "tool_name": tool_name, "arguments": _json(arguments), "result": _json(result), "error": error, "latency_ms": latency_ms, "created_at": now_ms()}])
        return id

    def get_tool_calls(self, session_id: str | None = None, tool_name: str | None = None, limit: int = 100) -> DataFrame:
        """Calls, the newest first."""
        return memory.recent_tool_calls(self.store.read("tool_calls"), session_id, tool_name, limit)

    def audit(self, action: str, table_name: str, record_id: str, actor: str | None = None, old_value=None, new_value=None, reason: str | None = None) -> str:
        """Append an audit entry."""
        id = _id()
        self.store.put("audit_log", [{"id": id, "timestamp": now_ms(), "actor": actor, "action": action, "table_name": table_name, "record_id": record_id, "old_value": _json(old_value), "new_value": _json(new_value), "reason": reason}])
        return id

    # ---- context, prompts, labels ----

    def add_context(self, session_id: str, source_type: str, source_id: str, token_count: int, content_preview: str | None = None, relevance_score: float = 1.0, priority: int = 0) -> str:
        """A context entry."""
        id = _id()
        self.store.put("context_entries", [{"id": id, "session_id": session_id, "source_type": source_type, "source_id": source_id, "content_preview": content_preview, "token_count": int(token_count), "relevance_score": float(relevance_score), "priority": int(priority), "included_at": now_ms()}])
        return id

    def build_window(self, session_id: str, max_tokens: int) -> DataFrame:
        """Entries that fit, greedily."""
        return memory.build_window(self.store.read("context_entries"), max_tokens, session_id)

    def get_entries(self, session_id: str) -> DataFrame:
        """A session's entries in packing order."""
        return memory.session_entries(self.store.read("context_entries"), session_id)

    def clear_session(self, session_id: str) -> None:
        """Delete a session's entries."""
        self.store.delete("context_entries", self.store.read("context_entries").filter(F.col("session_id") == session_id))

    def remove_entry(self, id: str) -> None:
        """Delete an entry."""
        self.store.delete("context_entries", self._keys("context_entries", id=id))

    def create_template(self, name: str, template: str, model_hint: str | None = None, max_tokens: int | None = None, metadata=None) -> int:
        """The next version of a template, from 1."""
        top = self.store.read("prompt_templates").filter(F.col("name") == name).agg(F.max("version")).first()[0]
        version = (top or 0) + 1
        self.store.put("prompt_templates", [{"id": _id(), "name": name, "version": version, "template": template, "model_hint": model_hint, "max_tokens": max_tokens, "metadata": _json(metadata), "created_at": now_ms()}])
        return version

    def get_template(self, name: str, version: int | None = None) -> dict:
        """A version of a template, the newest unless given."""
        rows = self.store.read("prompt_templates").filter(F.col("name") == name)
        rows = rows if version is None else rows.filter(F.col("version") == version)
        row = rows.orderBy(F.desc("version")).limit(1).collect()
        if not row:
            raise InvalidArgument(f"no template {name}")
        return row[0].asDict()

    def list_templates(self) -> DataFrame:
        """All versions."""
        return memory.list_templates(self.store.read("prompt_templates"))

    def render(self, name: str, variables: dict[str, str]) -> str:
        """The newest version with its places filled, in order of the keys."""
        out = self.get_template(name)["template"]
        for k in sorted(variables):
            out = out.replace("{{" + k + "}}", variables[k])
        return out

    def delete_template(self, name: str) -> None:
        """Delete all versions."""
        self.store.delete("prompt_templates", self.store.read("prompt_templates").filter(F.col("name") == name))

    def tag(self, table_name: str, record_id: str, label: str, tagged_by: str | None = None) -> None:
        """Label a record; a repeat refreshes it."""
        self.store.put("data_labels", [{"table_name": table_name, "record_id": record_id, "label": label, "tagged_by": tagged_by, "tagged_at": now_ms()}])

    def untag(self, table_name: str, record_id: str, label: str) -> None:
        """Take a label off."""
        self.store.delete("data_labels", self._keys("data_labels", table_name=table_name, record_id=record_id, label=label))

    def clear_record(self, table_name: str, record_id: str) -> None:
        """Take all labels off a record."""
        self.store.delete("data_labels", memory.labels_of(self.store.read("data_labels"), table_name, record_id))

    def get_labels(self, table_name: str, record_id: str) -> DataFrame:
        """A record's labels."""
        return memory.labels_of(self.store.read("data_labels"), table_name, record_id)

    def has_label(self, table_name: str, record_id: str, label: str) -> bool:
        """Whether a record has a label."""
        return memory.has_label(self.store.read("data_labels"), table_name, record_id, label)

    def find_by_label(self, label: str, limit: int = 100) -> DataFrame:
        """Records with a label."""
        return memory.find_by_label(self.store.read("data_labels"), label, limit)

    # ---- sync ----

    def record_mutation(self, table_name: str, record_id: str, op_type: str, payload=None, node_id: str = "local") -> int:
        """Append an operation; its time."""
        if op_type not in ("insert", "update", "delete"):
            raise InvalidArgument(f"no operation {op_type!r}")
        h = self.clock.now()
        self.store.put("sync_log", [{"op_id": _id(), "hlc_ts": h, "node_id": node_id, "table_name": table_name, "record_id": record_id, "op_type": op_type, "payload": _json(payload)}])
        return h

    def get_ops_since(self, hlc: int) -> DataFrame:
        """Operations after a time."""
        return sync.ops_since(self.store.read("sync_log"), hlc)

    def apply_remote_ops(self, ops: DataFrame) -> dict:
        """Merge operations of another node; (applied, conflicts, skipped)."""
        log = self.store.read("sync_log")
        out = sync.merge_counts(log, ops, self.strategy).first().asDict()
        if (top := ops.agg(F.max("hlc_ts")).first()[0]) is not None:
            self.clock.update(top)
        self.store.rewrite("sync_log", sync.merge_into_log(log, ops, self.strategy))
        return out

    def set_strategy(self, strategy: str) -> None:
        """lww or fww."""
        sync._best(strategy)
        self.strategy = strategy

    def add_peer(self, peer_id: str, endpoint: str | None = None) -> None:
        """Insert or replace a peer; how far it is stays."""
        old = self._one("sync_peers", F.col("peer_id") == peer_id)
        self.store.put("sync_peers", [{"peer_id": peer_id, "last_synced_hlc": old["last_synced_hlc"] if old else 0, "endpoint": endpoint}])

    def sync_status(self) -> DataFrame:
        """Pending operations of each peer."""
        return sync.sync_status(self.store.read("sync_log"), self.store.read("sync_peers"))

    # ---- SQL ----

    def query(self, sql: str, params=None) -> DataFrame:
        """Rows of a query."""
        from ..plans import sql as s

        return s.query(self.store, sql, params)

    def execute(self, sql: str, params=None) -> int:
        """One statement."""
        from ..plans import sql as s

        return s.execute(self.store, sql, params)

    def execute_batch(self, script: str) -> int:
        """Several statements, all or none."""
        from ..plans import sql as s

        return s.execute_batch(self.store, script)

    def query_json(self, sql: str, params=None) -> DataFrame:
        """Rows as JSON objects."""
        from ..plans import sql as s

        return s.json_rows(self.query(sql, params))

    def stats(self) -> dict:
        """The thirteen counters."""
        from ..plans import sql as s

        return s.stats(self.store).first().asDict()

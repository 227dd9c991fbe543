"""Text and chat stores as agent frameworks expect them, over an engine."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import functions as F

from ..operators import memory
from .engine import Engine, _id

#: Metadata key under which a vector's text is kept, and the one that names the document it was cut from.
TEXT_KEY, REF_KEY = "text", "_ref_doc_id"


class TextVectorStore:
    """Texts with their vectors; ``embed`` maps texts to vectors."""

    def __init__(self, engine: Engine, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], name: str = "texts", metric: str = "cosine"):
        self.engine, self.embed, self.name, self.metric = engine, embed, name, metric

    @classmethod
    def from_texts(cls, texts: Sequence[str], engine: Engine, embed, metadatas: Sequence[dict] | None = None, **kw) -> "TextVectorStore":
        """A store with these texts."""
        out = cls(engine, embed, **kw)
        out.add_texts(texts, metadatas)
        return out

    def add_texts(self, texts: Sequence[str], metadatas: Sequence[dict] | None = None, ids: Sequence[str] | None = None, ref_doc_id: str | None = None) -> list[str]:
        """Add texts; their ids."""
        if not texts:
            return []
        vectors = self.embed(texts)
        ids = list(ids) if ids else [_id() for _ in texts]
        extra = {REF_KEY: ref_doc_id} if ref_doc_id else {}
        entries = [(i, v, {**(m or {}), **extra, TEXT_KEY: t}) for i, v, m, t in zip(ids, vectors, metadatas or [None] * len(texts), texts)]
        self.engine.collection(self.name, len(vectors[0]), self.metric).upsert_batch(entries)
        return ids

    def similarity_search_with_score(self, query: str, k: int = 4, filter: dict | None = None) -> list[tuple[str, dict, float]]:
        """(text, metadata, distance) of the k nearest, the nearest first."""
        return self.similarity_search_by_vector(self.embed([query])[0], k, filter)

    def similarity_search_by_vector(self, vector: Sequence[float], k: int = 4, filter: dict | None = None) -> list[tuple[str, dict, float]]:
        """The same for a vector."""
        import json

        rows = self.engine.collection(self.name, len(vector), self.metric).search(vector, k, filter).collect()
        out = []
        for r in rows:
            meta = json.loads(r["metadata"] or "{}")
            out.append((meta.pop(TEXT_KEY, ""), meta, r["score"]))
        return out

    def similarity_search(self, query: str, k: int = 4, filter: dict | None = None) -> list[str]:
        """Texts of the k nearest."""
        return [t for t, _, _ in self.similarity_search_with_score(query, k, filter)]

    def query(self, query_embedding: Sequence[float], similarity_top_k: int = 4, filters: dict | None = None) -> dict:
        """{ids, nodes, similarities} of the nearest, where nodes are {text, metadata} and a similarity is 1 less the distance."""
        found = self.engine.get_collection(self.name).search(query_embedding, similarity_top_k, filters).collect()
        near = self.similarity_search_by_vector(query_embedding, similarity_top_k, filters)
        return {"ids": [r["id"] for r in found], "nodes": [{"text": t, "metadata": m} for t, m, _ in near], "similarities": [1.0 - s for _, _, s in near]}

    def delete(self, ids: Iterable[str]) -> None:
        """Delete by id."""
        c = self.engine.get_collection(self.name)
        with self.engine.store.transaction():
            for i in ids:
                c.delete(i)

    def delete_ref_doc(self, ref_doc_id: str) -> int:
        """Delete all that was cut from a document; their number."""
        return self.engine.get_collection(self.name).delete_where({REF_KEY: ref_doc_id})


class ChatStore:
    """Ordered messages under keys."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def set_messages(self, key: str, messages: Sequence[tuple[str, str]]) -> None:
        """Replace a key's messages, (role, content) each."""
        with self.engine.store.transaction():
            self.engine.delete_conversation(key)
            self.engine.create_conversation(id=key)
            for role, content in messages:
                self.engine.add_message(key, role, content)

    def add_message(self, key: str, role: str, content: str) -> None:
        """Add a message; a new key begins."""
        with self.engine.store.transaction():
            if self.engine._one("conversations", F.col("id") == key) is None:
                self.engine.create_conversation(id=key)
            self.engine.add_message(key, role, content)

    def get_messages(self, key: str) -> list[tuple[str, str]]:
        """(role, content) in order."""
        return [(r["role"], r["content"]) for r in self.engine.get_messages(key).collect()]

    def delete_message(self, key: str, index: int) -> tuple[str, str] | None:
        """Delete the message at a place, from 0; what it was."""
        rows = memory.message_at(self.engine.store.read("messages").filter(F.col("conversation_id") == key), index).collect()
        if not rows:
            return None
        self.engine.delete_message(rows[0]["id"])
        return rows[0]["role"], rows[0]["content"]

    def delete_last_message(self, key: str) -> tuple[str, str] | None:
        """Delete the last message; what it was."""
        return self.delete_message(key, len(self.get_messages(key)) - 1)

    def delete_messages(self, key: str) -> None:
        """Delete a key."""
        self.engine.delete_conversation(key)

    def keys(self) -> list[str]:
        """All keys."""
        return sorted(r["id"] for r in self.engine.store.read("conversations").select("id").collect())

    def transcript(self, key: str) -> str:
        """Lines of Human and AI."""
        rows = memory.transcript(self.engine.store.read("messages").filter(F.col("conversation_id") == key)).orderBy("part").collect()
        return "\n".join(r["transcript"] for r in rows)


# How frameworks call who speaks, and the roles that are stored.
SPEAKERS = {"human": "user", "ai": "assistant", "system": "system", "tool": "tool"}


class ChatHistory:
    """The messages of one session as frameworks keep them: speakers instead of roles, the session as the title."""

    def __init__(self, engine: Engine, session: str, title: str | None = None):
        self.engine, self.session = engine, session
        if engine._one("conversations", F.col("id") == session) is None:
            engine.create_conversation(title or f"session {session}", id=session)

    def add_message(self, speaker: str, content: str) -> None:
        """Add what ``human``, ``ai``, ``system`` or ``tool`` said; other speakers are stored as they are."""
        self.engine.add_message(self.session, SPEAKERS.get(speaker, speaker), content)

    @property
    def messages(self) -> list[dict]:
        """{type, content} in order."""
        names = {v: k for k, v in SPEAKERS.items()}
        return [{"type": names.get(r["role"], r["role"]), "content": r["content"]} for r in self.engine.get_messages(self.session).collect()]

    def clear(self) -> None:
        """Delete the messages; the session stays."""
        title = self.engine._one("conversations", F.col("id") == self.session)["title"]
        with self.engine.store.transaction():
            self.engine.delete_conversation(self.session)
            self.engine.create_conversation(title, id=self.session)
